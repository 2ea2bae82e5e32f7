"""Scans by key, guards and small projections of records.

Orders come out as a position, since a table has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.rank import top_n

#: More rows than any group has.
ALL = 1 << 30


def lookup(df: DataFrame, **equals) -> DataFrame:
    """Rows that equal all the values given; a value of None is no condition."""
    for c, v in equals.items():
        df = df if v is None else df.where(F.col(c) == v)
    return df


def blank(c: Column) -> Column:
    """Null or empty."""
    return c.isNull() | (c == "")


def positions(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """All rows with their place from 1 in their group's order."""
    return top_n(df, group, order, ALL)


def in_set(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ids; the set may hold repeats and nulls."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def differs(c: Column, value) -> Column:
    """Not equal; null differs from every value."""
    return F.coalesce(c != value, F.lit(True))


def split_by(df: DataFrame, col: str, values: list[str]) -> dict[str, DataFrame]:
    """The rows of each value; others are in none."""
    return {v: df.where(F.col(col) == v) for v in values}


def guard(df: DataFrame, status: str, wanted: str, out: str = "rejected") -> DataFrame:
    """Rows with the reason why their state forbids the step; null where it may go on."""
    have = F.coalesce(F.col(status), F.lit("none"))
    return df.withColumn(out, F.when(have != wanted, F.concat(F.lit(f"expected {wanted}, is "), have)))


def with_status(rows: DataFrame, statuses: DataFrame, key: str, status: str, default: str) -> DataFrame:
    """Rows with the status of their key, or the default."""
    return rows.join(statuses.select(key, status), key, "left").withColumn(status, F.coalesce(status, F.lit(default)))


def camel_case(df: DataFrame) -> DataFrame:
    """Columns renamed from snake_case to camelCase."""

    def name(c: str) -> str:
        head, *rest = c.split("_")
        return head + "".join(x[:1].upper() + x[1:] for x in rest)

    return df.withColumnsRenamed({c: name(c) for c in df.columns})


def flow_nodes(nodes: DataFrame, level: str, title: str) -> DataFrame:
    """Nodes with what a graph view needs: a type by level, and a label without underscores."""
    kind = F.when(F.col(level) == "chapter", "chapterNode").when(F.col(level) == "section", "sectionNode").otherwise("conceptNode")
    return nodes.withColumns({"type": kind, "label": F.replace(F.col(title), F.lit("_"), F.lit(" "))})
