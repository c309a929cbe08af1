"""Texts read with a wrong character encoding, as a whole or in passages: find them and restore the original.

A hidden Markov model labels the characters of a text. One state is clean; each further state is an encoding pair (the
encoding the bytes were wrongly read with, the one they were written in). A state of a pair turns characters back into
bytes and those into original characters; a character emits the log-probability of the character it stands for, that is
itself in the clean state and the decoded one, once its bytes are complete, in a pair's state, given the script of the
character before. Switching costs ``SWITCH``; characters that no bytes of the pair give end the state. The best path
labels the passages, and each labelled passage gets its pair's inverse transform.

Character probabilities are counted over all texts, and counted again over the first round's restored texts, so garbled
passages do not pass as ordinary language. Text garbled more than once is restored by further passes over its own result.

Defined cases: null and empty texts are never garbled; a text with U+FFFD, before or after restoring, has lost
characters for good: it counts as found and its restored text is null. Bytes that the wrong encoding leaves undefined
are taken as the control character of the same number. Repeated rows are judged each for itself.

Collected and broadcast: the character table, at most one row per Unicode code point and pair of scripts.
"""

from __future__ import annotations

import bisect
import codecs
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.session import cut, spread

#: Encoding pairs (read as, written in), the states beside the clean one.
PAIRS = (
    ("latin-1", "utf-8"),
    ("cp1252", "utf-8"),
    ("mac_roman", "utf-8"),
    ("cp437", "utf-8"),
    ("cp850", "utf-8"),
    ("cp1250", "utf-8"),
    ("cp1251", "utf-8"),
    ("cp1256", "utf-8"),
    ("koi8_r", "utf-8"),
    ("gb18030", "utf-8"),
    ("cp932", "utf-8"),
    ("latin-1", "gb18030"),
    ("cp1252", "gb18030"),
    ("latin-1", "cp932"),
    ("cp1252", "cp932"),
    ("latin-1", "cp949"),
    ("cp1252", "cp949"),
    ("latin-1", "euc_jp"),
    ("cp1252", "euc_jp"),
    ("latin-1", "cp1251"),
    ("cp1252", "cp1251"),
    ("latin-1", "koi8_r"),
    ("cp1252", "koi8_r"),
    ("cp1251", "koi8_r"),
    ("koi8_r", "cp1251"),
    ("latin-1", "cp1256"),
    ("cp1252", "cp1256"),
)
#: Log-probabilities of entering a pair's state, and of entering or leaving it inside a word.
SWITCH, INSIDE = math.log(1e-4), math.log(1e-5)
#: Least log-probability of a Latin character decoded by a UTF-8 state: it may be a step of text garbled twice.
TWICE = math.log(1e-4)
#: A lost character, and its log-probability where a passage decodes to it.
LOST, LOSS = "\ufffd", -3.0
_WIDE = ("gb18030", "cp932", "cp949")
_MEMO = 1 << 19
#: First code points of character classes: control, Latin, other letters, Greek, Cyrillic, other, Arabic,
#: other, punctuation, other, kana, Hangul, Han, other, Hangul, other, Han, Arabic, punctuation, kana, Hangul, other.
_STARTS = (0, 0xA0, 0x250, 0x370, 0x400, 0x530, 0x600, 0x780, 0x2000, 0x2070, 0x3000, 0x3040, 0x3100, 0x3400, 0xA000) + (
    0xAC00, 0xD7B0, 0xF900, 0xFB50, 0xFF00, 0xFF66, 0xFFA0)
_CLASSES = (0, 1, 2, 3, 4, 2, 5, 2, 6, 2, 6, 7, 8, 9, 2, 8, 2, 9, 5, 6, 7, 2)
_KINDS = 10
#: Where class pairs are counted in the character table: after all code points.
_PAIR_AT = 0x110000


def _class(c: str) -> int:
    k = _CLASSES[bisect.bisect_right(_STARTS, ord(c)) - 1]
    return 0 if k == 1 and not c.isalpha() and ord(c) < 0xC0 else k


class Model:
    """Log-probability of a character after one of a given class; plain characters are passed over."""

    def __init__(self, counts: dict[int, int]) -> None:
        chars = {c: n for c, n in counts.items() if 0x80 <= c < _PAIR_AT and n > 0}
        self.kind = np.repeat(np.array(_CLASSES, np.uint8), np.diff([*_STARTS, _PAIR_AT]))
        for c in range(0xA0, 0xC0):
            self.kind[c] = _class(chr(c))
        of_class = np.ones(_KINDS)
        for c, n in chars.items():
            of_class[self.kind[c]] += n
        self.log = np.log(0.05 / of_class)[self.kind]
        at = np.fromiter(chars, np.int64, len(chars))
        self.log[at] = np.log(np.fromiter(chars.values(), np.float64, len(chars)) / of_class[self.kind[at]])
        after = np.zeros((_KINDS + 1, _KINDS))
        for x in range(_KINDS + 1):
            row = [max(counts.get(_PAIR_AT + x * 16 + y, 0), 0) + 0.1 for y in range(_KINDS)]
            after[x] = np.log(np.array(row) / sum(row))
        self.after_array, self.after = after, after.tolist()
        # By two classes: the most that a path whose last character is of the first one can gain on one of the second
        # by the next character.
        self.gain = np.maximum((after[:, None] - after[None]).max(axis=2), 0.0).tolist()
        self.of_char: dict[str, tuple[int, float]] = {}
        # Steps with their score: by character, then by state and class; and entries by characters and class.
        self.moves: dict[str, dict[int, tuple[float, int, int] | None]] = {}
        self.doors: dict[tuple[str, str, str, int], list[tuple[float, int, int]]] = {}

    def chars(self, text: str, before: int, least: float = -1e9) -> tuple[float, int]:
        """(log-probability, class of the last character)"""
        total = 0.0
        for c in text:
            if c > "\x7f":
                got = self.of_char.get(c)
                if got is None:
                    got = self.of_char[c] = (int(self.kind[ord(c)]), float(self.log[ord(c)]))
                k, p = got
                if c == LOST:
                    total += LOSS
                    continue
                p += self.after[before][k]
                total += max(p, least) if c < "\u0180" or "\u2010" < c < "\u2123" else p
                before = k
        return total, before


def _byte_map(read_as: str) -> dict[str, bytes]:
    """Characters of a one-byte encoding and their bytes; undefined bytes are control characters."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(read_as)] = bytes([b])
        except UnicodeDecodeError:
            out[chr(b)] = bytes([b])
    return out


class _Pair:
    """One state: the bytes of a character, and the decoding of complete bytes."""

    def __init__(self, read_as: str, written_in: str) -> None:
        self.read_as, self.written_in = read_as, written_in
        self.wide = read_as in _WIDE
        self.bytes_of: dict[str, bytes | None] = {} if self.wide else dict(_byte_map(read_as))
        self.single = written_in in ("cp1251", "koi8_r", "cp1256")
        self.legacy = written_in != "utf-8"
        self.least = -1e9 if self.legacy or self.wide else TWICE

    def to_bytes(self, c: str) -> bytes | None:
        if self.wide and c not in self.bytes_of:
            try:
                b = c.encode(self.read_as)
                self.bytes_of[c] = b if b.decode(self.read_as) == c else None
            except UnicodeEncodeError:
                self.bytes_of[c] = None
        return self.bytes_of.get(c)

    def joins(self, c: str) -> bool:
        """Whether a passage that begins after c, or ends before it, would cut a word in two."""
        return self.legacy and c.isalpha() and (self.single or c > "\x7f") and self.to_bytes(c) is not None

    def decode(self, held: bytes, new: bytes) -> tuple[str, bytes] | None:
        """(decoded characters, bytes still open) or None if the new bytes cannot follow."""
        decoder = codecs.getincrementaldecoder(self.written_in)("strict")
        try:
            text = decoder.decode(held + new)
            rest = decoder.getstate()[0]
            if not rest and text.encode(self.written_in) != held + new:
                return None
            return text, rest
        except UnicodeError:
            return None


class _Either(_Pair):
    """Latin-1 and Windows-1252 alike: as long as no character tells them apart, two pairs are one state."""

    def __init__(self, a: int, b: int, pairs: list[_Pair]) -> None:
        super().__init__(pairs[a].read_as, pairs[a].written_in)
        self.either = (a, b)
        both = pairs[b].bytes_of
        self.bytes_of = {c: x for c, x in self.bytes_of.items() if both.get(c) == x}


class _States:
    """The pairs, and the states (pair, open bytes) by number; kept by each worker process."""

    def __init__(self) -> None:
        self.pairs = [_Pair(*p) for p in PAIRS]
        for a, (read_as, written_in) in enumerate(PAIRS):
            if read_as == "latin-1":
                self.pairs.append(_Either(a, PAIRS.index(("cp1252", written_in)), self.pairs))
        self.number: dict[tuple[int, bytes], int] = {}
        self.pair_of: list[int] = []
        self.held: list[bytes] = []
        self.firsts: dict[str, tuple[list[tuple[str, bytes, int]], bool, bool]] = {}
        self.fits: dict[tuple[int, bytes, str], bool] = {}

    def state(self, k: int, held: bytes) -> int:
        n = self.number.setdefault((k, held), len(self.held))
        if n == len(self.held):
            self.pair_of.append(k)
            self.held.append(held)
        return n

    def step(self, k: int, held: bytes, c: str) -> tuple[str, bytes, int] | None:
        """(decoded characters, bytes still open, pair) after one more character, or None."""
        new = self.pairs[k].to_bytes(c)
        if new is None and isinstance(self.pairs[k], _Either):
            k = next((x for x in self.pairs[k].either if self.pairs[x].to_bytes(c) is not None), k)
            new = self.pairs[k].to_bytes(c)
        got = None if new is None else self.pairs[k].decode(held, new)
        return got and (*got, k)

    def begun(self, c: str) -> tuple[list[tuple[str, bytes, int]], bool, bool]:
        """The passages that c can begin; whether the character after it matters to them, and the one before."""
        got = self.firsts.get(c)
        if got is None:
            steps = []
            for k, p in enumerate(self.pairs):
                if p.to_bytes(c) is None:
                    continue
                # A pair of two alike ones begins alone only with a character that tells them apart.
                if k < len(PAIRS) and any(k in x.either and x.to_bytes(c) is not None for x in self.pairs[len(PAIRS) :]):
                    continue
                steps.append(self.step(k, b"", c))
            steps = [x for x in steps if x]
            got = self.firsts[c] = steps, any(x[1] for x in steps), any(self.pairs[x[2]].legacy for x in steps)
        return got

    def goes_on(self, k: int, held: bytes, c: str) -> bool:
        key = k, held, c
        if key not in self.fits:
            if len(self.fits) > _MEMO:
                self.fits.clear()
            self.fits[key] = self.step(k, held, c) is not None
        return self.fits[key]


_kept: list[_States] = []


def _states() -> _States:
    if not _kept:
        _kept.append(_States())
    return _kept[0]


_HIGH = re.compile(r"[^\x00-\x7f]")


def _move(model: Model, c: str, key: int) -> tuple[float, int, int] | None:
    """(score, state, class of the last character) after character c in the state and class of ``key``."""
    states = _states()
    sid, last = key >> 4, key & 15
    got = states.step(states.pair_of[sid], states.held[sid], c)
    if got is None:
        return None
    more, last = model.chars(got[0], last, states.pairs[got[2]].least) if got[0] else (0.0, last)
    return more, states.state(got[2], got[1]), last


def _doors(model: Model, c0: str, c: str, c1: str, before: int) -> list[tuple[float, int, int]]:
    """(score, state, class) of each passage that can begin with c, between c0 and c1."""
    states, out = _states(), []
    for chars, rest, k in states.begun(c)[0]:
        if rest and not states.goes_on(k, rest, c1):
            continue
        s, last = model.chars(chars, before, states.pairs[k].least) if chars else (0.0, before)
        out.append((s + SWITCH + (INSIDE if states.pairs[k].joins(c0) else 0.0), states.state(k, rest), last))
    return out


def label(text: str, model: Model) -> list[tuple[int, int, int]]:
    """Viterbi: the garbled passages (from, to, pair) of the best path."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = np.flatnonzero(points > 0x7F)
    if not len(high):
        return []
    kinds = model.kind[points[high]]
    before = np.concatenate([[_KINDS], kinds[:-1]])
    # What the clean state emits for the first h high characters; plain ones cost the same in every state.
    clean = [0.0, *np.cumsum(model.log[points[high]] + model.after_array[before, kinds]).tolist()]
    kinds, places = [*kinds.tolist(), _KINDS], high.tolist()  # the last one stands for the first character's forerunner
    states = _states()
    pairs, pair_of, held, moves, doors = states.pairs, states.pair_of, states.held, model.moves, model.doors
    begun, firsts = states.begun, states.firsts
    n, m, gains, after = len(text), len(places), model.gain, model.after
    if len(moves) > _MEMO or len(doors) > _MEMO:
        moves.clear()
        doors.clear()
    # The best path that is clean now: its lead over all-clean, and its switches as a linked list (earlier, from, to,
    # pair). A hypothesis, by its state: score, class of the last character, the switches before it, its start.
    lead, path = 0.0, None
    alive: dict[int, tuple[float, int, tuple | None, int]] = {}

    def going_on(c: str) -> dict[int, tuple[float, int, tuple | None, int]]:
        new: dict[int, tuple[float, int, tuple | None, int]] = {}
        of_c = moves.get(c)
        if of_c is None:
            of_c = moves[c] = {}
        for sid, (s, last, way, start) in alive.items():
            key = sid << 4 | last
            if key in of_c:
                got = of_c[key]
            else:
                got = of_c[key] = _move(model, c, key)
            if got:
                more, to, last = got
                s += more
                if to not in new or new[to][0] < s:
                    new[to] = (s, last, way, start)
        return new

    for h, i in enumerate(places):
        c, entries = text[i], ()
        steps, needs_next, needs_last = firsts.get(c) or begun(c)
        if steps:
            c0, c1 = text[i - 1] if needs_last and i else "\n", text[i + 1] if needs_next and i + 1 < n else "\n"
            key = c0, c, c1, kinds[h - 1]
            entries = doors.get(key)
            if entries is None:
                entries = doors[key] = _doors(model, *key)
        if not alive and not entries:
            continue
        new = going_on(c) if alive else {}
        begin = clean[h] + lead
        for s, sid, last in entries:
            s += begin
            if sid not in new or new[sid][0] < s:
                new[sid] = (s, last, path, i)
        j = i
        while True:
            # Leave where that is better; the next clean character follows the passage's last one.
            # Without open bytes, a path that the clean one reaches at its dearest entry can be no part of a best path:
            # entering anew with the next character is no worse. One with open bytes has yet to pay and always goes on.
            alive, again, kind = {}, clean[h + 1] + lead + SWITCH + INSIDE, kinds[h]
            for sid, x in new.items():
                if held[sid]:
                    alive[sid] = x
                    continue
                s, last, way, start = x
                if s + gains[last][kind] > again:
                    alive[sid] = x
                    if h + 1 < m:
                        s += after[last][kinds[h + 1]] - after[kind][kinds[h + 1]]
                    if s > clean[h + 1] + lead:
                        k = pair_of[sid]
                        if j + 1 < n and pairs[k].joins(text[j + 1]):
                            s += INSIDE
                        if s > clean[h + 1] + lead:
                            lead, path = s - clean[h + 1], (way, start, j + 1, k)
            j += 1
            if not (j < n and text[j] <= "\x7f" and any(held[sid] for sid in alive)):
                break
            new = going_on(text[j])
    spans = []
    while path:
        path, start, end, k = path
        spans.append((start, end, k))
    return spans[::-1]


def restore(text: str, model: Model) -> str:
    """The text with every labelled passage put through its pair's inverse transform."""
    seen = set()
    while text not in seen and (spans := label(text, model)):
        seen.add(text)
        out, at = [], 0
        for start, end, k in spans:
            p = _states().pairs[k]
            out += [text[at:start], b"".join(p.to_bytes(c) for c in text[start:end]).decode(p.written_in)]
            at = end
        text = "".join(out) + text[at:]
    return text


def character_counts(texts: DataFrame, column: str) -> DataFrame:
    """(c, n): how often each character, and each pair of classes of neighbouring characters, occurs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chars: Counter = Counter()
        twos: Counter = Counter()
        classes: dict[str, int] = {}
        for pdf in batches:
            for t in pdf[column]:
                high = "".join(_HIGH.findall(t)) if t else ""
                if high:
                    chars.update(high)
                    for c in set(high) - classes.keys():
                        classes[c] = _class(c)
                    row = [classes[c] for c in high]
                    twos.update(zip([_KINDS, *row], row))
        keys = [ord(c) for c in chars] + [_PAIR_AT + a * 16 + b for a, b in twos]
        yield pd.DataFrame({"c": keys, "n": [*chars.values(), *twos.values()]}, dtype="int64")

    counted = texts.select(column).mapInPandas(count, "c long, n long")
    return counted.groupBy("c").agg(F.sum("n").alias("n"))


def _restored(df: DataFrame, id_col: str, text_col: str, counts: dict[int, int]) -> DataFrame:
    """(id, text, restored) of the texts that change or have lost characters."""
    shared = df.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(shared.value)
        for pdf in batches:
            out = []
            for key, text in zip(pdf.id, pdf.text):
                done = text if text.isascii() else restore(text, model)
                if done != text or LOST in text:
                    out.append((key, text, done))
            yield pd.DataFrame(out, columns=["id", "text", "restored"])

    kind = dict(df.dtypes)[id_col]
    some = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text <> ''")
    return some.mapInPandas(run, f"id {kind}, text string, restored string")


def repair(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, restored): the garbled texts and their originals, null where characters are lost for good."""
    df = spread(df.select(id_col, text_col), id_col)
    counts = Counter({r.c: r.n for r in character_counts(df, text_col).collect()})
    first = cut(_restored(df, id_col, text_col, dict(counts)))
    # Garbled texts out, restored ones in: what the characters of clean text are like.
    change = (
        character_counts(first, "text")
        .select("c", (-F.col("n")).alias("n"))
        .unionByName(character_counts(first.filter(~F.contains("restored", F.lit(LOST))), "restored"))
    )
    for r in change.groupBy("c").agg(F.sum("n").alias("n")).collect():
        counts[r.c] += r.n
    # All texts again: what the first round took for ordinary language may be far from it by the cleaned table.
    second = _restored(df, id_col, text_col, dict(counts))
    lost = F.contains("restored", F.lit(LOST))
    return second.select(F.col("id").alias(id_col), F.when(~lost, F.col("restored")).alias("restored"))
