"""Structured documents: headings and sections of marked-up text, and edits addressed by JSON pointers.

Each works on one document of bounded size inside a task; Spark spreads the documents.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_HEADING = re.compile(r"(#{1,6}) +(\S.*?) *$", re.ASCII)
SECTIONS = "struct<front:array<struct<key:string,value:string>>,preamble:string,sections:array<struct<level:int,heading:string,body:string>>>"


def sections_of(text: str) -> dict:
    """The fields between two leading lines of dashes, the lines before the first heading, and each heading with its level
    and the lines below it, with their ends. Without a second line of dashes there are no fields."""
    lines = text.replace("\r\n", "\n").split("\n")
    lines = [x + "\n" for x in lines[:-1]] + lines[-1:] * (lines[-1] != "")
    front: list[dict] = []
    if lines and lines[0].strip() == "---":
        close = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), 0)
        pairs = [x.partition(":") for x in lines[1:close]]
        front = [{"key": k.strip(), "value": v.strip()} for k, colon, v in pairs if colon]
        lines = lines[close + 1 :] if close else lines
    out: dict = {"front": front, "preamble": "", "sections": []}
    bodies: list[list[str]] = [[]]
    for line in lines:
        m = _HEADING.match(line.rstrip("\n"))
        if m:
            out["sections"].append({"level": len(m[1]), "heading": m[2]})
            bodies.append([])
        else:
            bodies[-1].append(line)
    out["preamble"] = "".join(bodies[0])
    for s, body in zip(out["sections"], bodies[1:]):
        s["body"] = "".join(body)
    return out


def rendered(doc: dict) -> str:
    """The text of a document; what ``sections_of`` reads from it is the document again."""
    fields = "".join(f"{f['key']}: {f['value']}\n" for f in doc["front"])
    out = (f"---\n{fields}---\n" if fields else "") + doc["preamble"]
    for s in doc["sections"]:
        out += "\n" * (out != "" and not out.endswith("\n")) + "#" * s["level"] + f" {s['heading']}\n{s['body']}"
    return out


def parse_sections(text: Column) -> Column:
    """``SECTIONS`` of a text; null for null."""

    @F.pandas_udf(SECTIONS)
    def parse(texts: pd.Series) -> pd.DataFrame:
        got = [sections_of(t) if t is not None else None for t in texts]
        rows = lambda key: [[tuple(s.values()) for s in g[key]] if g else None for g in got]
        return pd.DataFrame({"front": rows("front"), "preamble": [g and g["preamble"] for g in got], "sections": rows("sections")})

    return F.when(text.isNotNull(), parse(text))


def render_sections(doc: Column) -> Column:
    """The text of a ``SECTIONS`` structure, in expressions; null for null."""
    fields = F.array_join(F.transform(doc["front"], lambda f: F.concat(f.key, F.lit(": "), f.value, F.lit("\n"))), "")
    front = F.when(F.size(doc["front"]) > 0, F.concat(F.lit("---\n"), fields, F.lit("---\n"))).otherwise("")
    start = F.concat(front, doc["preamble"])

    def add(out: Column, s: Column) -> Column:
        gap = F.when((out != "") & ~out.endswith("\n"), "\n").otherwise("")
        return F.concat(out, gap, F.repeat(F.lit("#"), s.level), F.lit(" "), s.heading, F.lit("\n"), s.body)

    return F.aggregate(doc["sections"], start, add)


class EditError(ValueError):
    """An edit that does not fit the document."""


def _step(node: object, token: str, heading: bool) -> object:
    """The key or index that a token of a pointer names in a list or object."""
    if heading:
        at = [i for i, s in enumerate(node) if isinstance(s, dict) and s.get("heading") == token]
        if len(at) != 1:
            raise EditError(f"{len(at)} sections are headed {token!r}")
        return at[0]
    if isinstance(node, dict):
        return token
    if isinstance(node, list) and (token == "-" or re.fullmatch(r"0|[1-9]\d*", token)):
        return len(node) if token == "-" else int(token)
    raise EditError(f"nothing at {token!r}")


def edited(document: object, edits: list[dict]) -> object:
    """The document after its edits in order. ``add`` needs a new key or a place in a list, ``replace`` and ``remove`` an
    existing one; the whole document cannot be replaced. Below ``/sections/by_heading`` a section is named by its heading,
    which must be unique."""
    top = {"": json.loads(json.dumps(document))}
    for e in edits:
        path = str(e.get("path", ""))
        if path and not path.startswith("/"):
            raise EditError(f"no pointer: {path!r}")
        tokens = [t.replace("~1", "/").replace("~0", "~") for t in path.split("/")[1:]]
        if not tokens:
            raise EditError("the document itself cannot be edited")
        named = tokens[:2] == ["sections", "by_heading"] and len(tokens) > 2
        node, key = top, ""
        for at, t in enumerate(tokens):
            if named and at == 1:
                continue
            if isinstance(node, dict) and key not in node or isinstance(node, list) and key >= len(node):
                raise EditError(f"nothing at {key!r}")
            node = node[key]
            key = _step(node, t, named and at == 2)
        there = key in node if isinstance(node, dict) else key < len(node)
        op = e.get("op")
        if op == "add" and isinstance(node, list) and key <= len(node):
            node.insert(key, e.get("value"))
        elif op == "add" and isinstance(node, dict) and not there:
            node[key] = e.get("value")
        elif op == "replace" and there:
            node[key] = e.get("value")
        elif op == "remove" and there:
            del node[key]
        else:
            raise EditError(f"cannot {op} at {path!r}")
    return top[""]


def apply_edits(document: Column, edits: Column) -> Column:
    """struct<result, error>: a JSON document after a JSON list of edits, or why they do not fit; null for null."""

    @F.pandas_udf("struct<result:string,error:string>")
    def run(docs: pd.Series, lists: pd.Series) -> pd.DataFrame:
        out = []
        for d, x in zip(docs, lists):
            try:
                out.append((json.dumps(edited(json.loads(d), json.loads(x)), ensure_ascii=False, sort_keys=True), None))
            except (ValueError, TypeError, AttributeError) as e:
                out.append((None, str(e) or type(e).__name__))
        return pd.DataFrame(out, columns=["result", "error"])

    return F.when(document.isNotNull() & edits.isNotNull(), run(document, edits))
