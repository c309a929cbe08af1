"""Delimited text whose rows may be ragged: the delimiter is detected, short rows dropped, long ones repaired.

A file is read as lines; rows are split, repaired and typed by expressions. A quoted field may hold the delimiter, a
doubled quote stands for one. Line breaks are written as ``\\n`` and ``\\r``, a backslash as two.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Delimiters in the order in which ties go.
DELIMITERS = ("#", ",", "\t", "|")


def detect_delimiter(header: str) -> str:
    """The delimiter that occurs most often in the header; a comma if none does."""
    best = max(DELIMITERS, key=header.count)
    return best if header.count(best) else ","


def split_fields(line: Column, delimiter: str) -> Column:
    """The fields of a line; a quoted field keeps its delimiters and loses its quotes."""
    d = re.escape(delimiter)
    raw = F.regexp_extract_all(
        F.concat(F.lit(delimiter), line), F.lit(rf'{d}(?:"(?:[^"]|"")*+"(?={d}|\z)|[^{d}]*+)'), F.lit(0)
    )

    def bare(x: Column) -> Column:
        text = F.substring(x, F.lit(2), F.length(x))
        quoted = text.startswith('"') & text.endswith('"') & (F.length(text) > 1)
        inner = F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit('""'), F.lit('"'))
        return F.when(quoted, inner).otherwise(text)

    return F.transform(raw, bare)


def repaired_rows(lines: DataFrame, column: str, header: list[str], delimiter: str, absorb: str) -> DataFrame:
    """(columns of the header): a row per line with as many fields as the header, or more.

    Surplus fields go back into ``absorb``, joined by the delimiter; shorter lines and null lines are dropped; an empty
    field is null."""
    width, at = len(header), header.index(absorb)
    fields = lines.select(*[c for c in lines.columns if c != column], split_fields(F.col(column), delimiter).alias("_f"))
    fields = fields.filter(F.size("_f") >= width)
    surplus = F.size("_f") - width
    cells = []
    for i, name in enumerate(header):
        if i < at:
            cell = F.get("_f", F.lit(i))
        elif i == at:
            cell = F.array_join(F.slice("_f", F.lit(at + 1), surplus + 1), delimiter)
        else:
            cell = F.get("_f", surplus + i)
        cells.append(F.nullif(cell, F.lit("")).alias(name))
    return fields.select(*[c for c in lines.columns if c != column], *cells)


def escaped(c: Column) -> Column:
    """A cell without line breaks."""
    text = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def unescaped(c: Column) -> Column:
    breaks = lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return F.array_join(F.transform(F.split(c, r"\\\\", -1), breaks), "\\")


def delimited_line(columns: list[str], delimiter: str, absorb: str) -> Column:
    """The line of a row. Cells that begin or end with a quote, and all but ``absorb`` that hold the delimiter, are quoted;
    ``absorb`` may hold it bare, as it takes surplus fields back."""

    def cell(name: str) -> Column:
        text = escaped(F.coalesce(F.col(name).cast("string"), F.lit("")))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        odd = F.contains(text, F.lit('"')) if name == absorb else F.contains(text, F.lit('"')) | F.contains(text, F.lit(delimiter))
        return F.when(odd, quoted).otherwise(text)

    return F.concat_ws(delimiter, *map(cell, columns))


def write_delimited(df: DataFrame, path: str, columns: list[str], delimiter: str, absorb: str) -> None:
    """Lines in parts under ``rows``, and the header line under ``header``: the parts of a folder have no first one."""
    header = df.sparkSession.createDataFrame([(delimiter.join(columns),)], "value string")
    header.coalesce(1).write.mode("overwrite").text(f"{path}/header")
    df.select(delimited_line(columns, delimiter, absorb).alias("value")).write.mode("overwrite").text(f"{path}/rows")


def read_delimited(
    spark: SparkSession, path: str, absorb: str, line_no: str | None = None, header: str | None = None
) -> DataFrame:
    """A delimited file with a header line, or a folder whose header is given, all columns text and line breaks put back.
    ``line_no`` adds a number that rises with the place of the line in its file; it has gaps between parts of a file."""
    lines = spark.read.text(path)
    header = header if header is not None else lines.first()[0]
    delimiter = detect_delimiter(header)
    names = header.split(delimiter)
    body = lines.filter(F.col("value") != header)
    if line_no:
        body = body.withColumn(line_no, F.monotonically_increasing_id())
    rows = repaired_rows(body, "value", names, delimiter, absorb)
    return rows.withColumns({c: unescaped(F.col(c)) for c in names})
