"""Changes of tables as functions of snapshots: each returns the table after the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.rank import first_by_key, latest_per_key


def with_id(rows: DataFrame, *natural: str, out: str = "id") -> DataFrame:
    """Rows with an id made from natural keys, so that a repeated job makes the same one."""
    return rows.withColumn(out, F.sha2(F.to_json(F.struct(*natural)), 256))


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Both tables' rows; columns that one lacks are null there. No rows change nothing."""
    return table.unionByName(rows, allowMissingColumns=True)


def _first(rows: DataFrame, key: list[str]) -> DataFrame:
    """The first row of each key by all columns, so that it doesn't depend on partitions."""
    return first_by_key(rows, [F.col(k) for k in key], [F.col(c) for c in rows.columns])


def _beside(rows: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """Rows with the other columns of others of their key, or nulls; null keys are equal."""
    named = others.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(key)})
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    return rows.join(named, same, "left").drop(*(f"_k{i}" for i in range(len(key))))


def without(rows: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not among those of others; null keys are equal."""
    keys = others.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key))).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    return rows.join(keys, same, "left_anti")


def insert_ignore(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Adds rows whose key isn't there yet, the first of each key by all their columns in
    order; null keys are equal."""
    return append(table, without(_first(rows, key), table, key))


def upsert(table: DataFrame, rows: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows replace those of their key; of several with one key the latest by order, or, with
    no order, the first by all their columns. Null keys are equal."""
    new = latest_per_key(rows, key, order) if order else _first(rows, key)
    return append(without(table, new, key), new)


def upsert_keep_id(table: DataFrame, rows: DataFrame, key: list[str], id_col: str = "id") -> DataFrame:
    """As upsert, but a row that was there keeps its id, with a null key too; of several rows
    with one key in the table the smallest id."""
    old = table.groupBy(*key).agg(F.min(id_col).alias("_old"))
    new = _beside(_first(rows, key), old, key).withColumn(id_col, F.coalesce("_old", id_col)).drop("_old")
    return upsert(table, new, key)


def replace_by_key(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """All rows of the keys in `rows` go, then rows are added."""
    return append(without(table, rows, key), rows)


def set_where(table: DataFrame, match: Column, values: dict[str, Column]) -> DataFrame:
    return table.withColumns({c: F.when(match, v).otherwise(F.col(c)) for c, v in values.items()})


def patch(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Non-null values of changes replace those of the rows with the key, null keys too; nulls
    change nothing. Of several changes with one key the first by all columns counts."""
    cols = [c for c in changes.columns if c not in key]
    joined = _beside(table, _first(changes, key).select(*key, *(F.col(c).alias(f"_{c}") for c in cols)), key)
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in table.columns))


def delete_where(table: DataFrame, match: Column) -> DataFrame:
    """Rows where match doesn't hold; null isn't a match."""
    return table.where(~F.coalesce(match, F.lit(False)))


def cascade_delete(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], root: str, match: Column) -> dict[str, DataFrame]:
    """Deletes from tables[root] and, link by link (child, foreign key, parent, key), what
    refers to deleted rows. Tables not named in a link keep their orphans."""
    gone = {root: tables[root].where(match)}
    out = dict(tables)
    out[root] = delete_where(tables[root], match)
    for child, fk, parent, key in links:
        ids = gone[parent].select(F.col(key).alias(fk)).distinct()
        gone[child] = tables[child].join(ids, fk, "left_semi").unionByName(gone[child]).distinct() if child in gone else tables[child].join(ids, fk, "left_semi")
        out[child] = out[child].join(ids, fk, "left_anti")
    return out
