"""Deeply nested semi-structured records as related flat tables.

``shred`` stores each document as an adjacency table: one row per object and per scalar with its parent object, label,
ordinal and value. ``entities`` joins object nodes with their scalar children and pivots those into a table per label;
``children_of_artifacts`` links the entities to their parents.

Lists are no nodes: an element's parent is the nearest object around its list, its label is the list's, its ordinal its
place from 1, nulls not counted, lists inside a list counted through. A value outside a list has ordinal 0. Text that is
itself a JSON object or list is opened unless its label is in ``closed``. So a single object for a list of one, a list
cut into sublists, and a list sent as text give the same rows.

Defined cases: null, blank, truncated and otherwise unreadable documents, and ones nested deeper than the parser goes,
give no rows; nulls give no rows; a document whose top is a list has one node for each element; duplicate keys in one
object: the last one counts; re-sent records count once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftwork.session import cut

_COLUMNS = ("rec", "node", "parent", "label", "ordinal", "is_object", "scalar")


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _loads(text: str) -> object:
    return json.loads(text, parse_constant=_no_constant)


def _opened(value: object) -> object:
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            inner = _loads(value)
        except (ValueError, RecursionError):
            return value
        return inner if isinstance(inner, (dict, list)) else value
    return value


def _flat(value: object, closed: bool) -> Iterator[tuple[object, int]]:
    """(element, ordinal): the value itself at 0, or the elements of the list, sublists counted through."""
    if not isinstance(value, list):
        yield value, 0
        return
    todo, n = [iter(value)], 0
    while todo:
        for x in todo[-1]:
            x = x if closed else _opened(x)
            if isinstance(x, list):
                todo.append(iter(x))
                break
            if x is not None:
                n += 1
                yield x, n
        else:
            todo.pop()


def _texts(values: list[str | None]) -> pa.Array:
    """A column of text; a surrogate without its other half, which UTF-8 cannot hold, becomes a question mark."""
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())


def _adjacency(
    batches: Iterator[pa.RecordBatch], scalars: frozenset[str] | None, closed: frozenset[str]
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        recs, nodes, parents, labels, ordinals, texts = [], [], [], [], [], []
        for rec, text in zip(batch.column("rec").to_pylist(), batch.column("doc").to_pylist()):
            try:
                top = _loads(text)
            except (ValueError, TypeError, RecursionError):
                continue
            todo = [(x, None, "", o) for x, o in _flat(_opened(top), False)]
            n = 0
            while todo:
                value, parent, label, ordinal = todo.pop()
                node = text_of = None
                if isinstance(value, dict):
                    node = n
                    n += 1
                    for k, v in value.items():
                        if v.__class__ in (str, list):
                            shut = k in closed
                            todo.extend((x, node, k, o) for x, o in _flat(v if shut else _opened(v), shut) if x is not None)
                        elif v is not None:
                            todo.append((v, node, k, 0))
                elif scalars is None or label in scalars:
                    text_of = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
                else:
                    continue
                recs.append(rec)
                nodes.append(node)
                parents.append(parent)
                labels.append(label)
                ordinals.append(ordinal)
                texts.append(text_of)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(recs, pa.int64()), pa.array(nodes, pa.int32()), pa.array(parents, pa.int32()), _texts(labels),
                pa.array(ordinals, pa.int32()), pa.array([x is not None for x in nodes], pa.bool_()), _texts(texts),
            ],
            names=list(_COLUMNS),
        )


def shred(
    df: DataFrame, record: str, document: str, scalars: list[str] | None = None, closed: tuple[str, ...] = ()
) -> DataFrame:
    """The adjacency table (rec, node, parent, label, ordinal, is_object, scalar) of the documents. Narrow: no shuffle.

    ``scalars``: labels whose scalar children are wanted, all if None. The key ``record`` must be a number."""
    keep = None if scalars is None else frozenset(scalars)
    shut = frozenset(closed)
    return (
        df.filter(F.col(record).isNotNull() & F.col(document).isNotNull())
        .select(F.col(record).cast("long").alias("rec"), F.col(document).alias("doc"))
        .mapInArrow(
            lambda it: _adjacency(it, keep, shut),
            "rec long, node int, parent int, label string, ordinal int, is_object boolean, scalar string",
        )
    )


def entities(adjacency: DataFrame, labels: list[str], fields: list[str]) -> DataFrame:
    """(rec, node, parent, label, ordinal, fields...): object nodes with the given labels and their direct scalar children.

    Nodes and children meet by one aggregate on the node, which is also the pivot: children combine before the shuffle."""
    is_node = F.col("is_object") & F.col("label").isin(*labels)
    is_leaf = ~F.col("is_object") & F.col("label").isin(*fields) & (F.col("ordinal") == 0)
    rows = adjacency.filter(is_node | is_leaf).withColumn("at", F.coalesce("node", "parent"))
    own = [F.max(F.when(F.col("is_object"), F.col(c))).alias(c) for c in ("parent", "label", "ordinal")]
    pivot = [F.max(F.when(~F.col("is_object") & (F.col("label") == f), F.col("scalar"))).alias(f) for f in fields]
    return rows.groupBy("rec", F.col("at").alias("node")).agg(*own, *pivot).filter("label is not null")


#: Labels of the artifacts' child lists with the entity, its key, and the parent it hangs on.
_LISTS = {
    "products": ("product", "product_id"),
    "user_factors": ("user_factor", "user_factor_id"),
    "candidates": ("candidate", "candidate_id"),
    "judgments": ("judgment", "candidate_id"),
    "objective_checks": ("objective_check", "check_id"),
    "axis_scores": ("axis_score", "axis_id"),
}
_GROUPS = ("profile", "behavior", "context")
#: Labels of running text, never opened as JSON.
_TEXTS = ("text", "copy_text", "diagnostic", "signal_basis", "need_or_pain")


def children_of_artifacts(df: DataFrame, record: str, request: str, payload: str) -> DataFrame:
    """(record_id, entity, parent_id, child_id, pos) of every child in the payloads, whatever its shape.

    Candidates may be grouped under their factor; user state fields are the children of three groups. Children without
    an id give no row."""
    once = df.filter(F.col(record).isNotNull()).dropDuplicates([record])
    keys = sorted({k for _, k in _LISTS.values()} | {"source_user_factor_id"})
    adjacency = cut(shred(once, record, payload, closed=_TEXTS))  # several tables are made of it
    requests = once.select(F.col(record).cast("long").alias("rec"), F.col(request).alias("request_id"))
    table = entities(adjacency, list(_LISTS), keys)
    owner = table.select(
        "rec",
        F.col("node").alias("parent"),
        F.col("label").alias("up_label"),
        *[F.col(k).alias(f"up_{k}") for k in ("user_factor_id", "candidate_id", "source_user_factor_id")],
    )
    linked = table.join(owner, ["rec", "parent"], "left").join(requests, "rec")
    label = F.col("label")
    by_label = lambda i: F.element_at(
        F.create_map(*[F.lit(x) for k, v in _LISTS.items() for x in (k, v[i])]), label
    )
    key: Column = F.coalesce(*[F.when(label == k, F.col(v[1])) for k, v in _LISTS.items()])
    parent = (
        F.when(label.isin("products", "user_factors", "judgments"), F.col("request_id"))
        .when(label == "candidates", F.coalesce("source_user_factor_id", "up_source_user_factor_id"))
        .otherwise(F.col("up_candidate_id"))
    )
    from_lists = linked.select(
        "rec", by_label(0).alias("entity"), parent.alias("parent_id"), key.alias("child_id"), _pos().alias("pos")
    )

    leaf = adjacency.filter(~F.col("is_object"))
    hooks = (
        leaf.filter(label == "expression_hooks")
        .select("rec", "parent", "scalar", "ordinal")
        .join(owner.filter("up_label = 'user_factors'"), ["rec", "parent"])
        .select(
            "rec",
            F.lit("expression_hook").alias("entity"),
            F.col("up_user_factor_id").alias("parent_id"),
            F.col("scalar").alias("child_id"),
            _pos().alias("pos"),
        )
    )

    states = adjacency.filter(F.col("is_object") & (label == "user_state")).select("rec", F.col("node").alias("state"))
    groups = adjacency.filter(F.col("is_object") & label.isin(*_GROUPS)).select(
        "rec", F.col("node").alias("parent"), F.col("parent").alias("state"), label.alias("grp")
    )
    holders = states.select("rec", F.col("state").alias("parent"), F.lit(None).cast("string").alias("grp")).unionByName(
        groups.join(states, ["rec", "state"]).select("rec", "parent", "grp")
    )
    filled = (F.col("ordinal") > 0) | F.col("is_object") | (F.col("scalar") != "")
    fields = (
        adjacency.filter(filled)
        .join(holders, ["rec", "parent"])
        .filter(F.col("grp").isNotNull() | (label == "user_id"))
        .select("rec", F.concat_ws(".", "grp", label).alias("child_id"))
        .distinct()
        .join(requests, "rec")
        .select(
            "rec",
            F.lit("user_state").alias("entity"),
            F.col("request_id").alias("parent_id"),
            "child_id",
            F.lit(0).alias("pos"),
        )
    )
    return (
        from_lists.unionByName(hooks)
        .unionByName(fields)
        .filter(F.col("child_id").isNotNull())
        .withColumnRenamed("rec", "record_id")
    )


def _pos() -> Column:
    return F.greatest(F.col("ordinal"), F.lit(1))

