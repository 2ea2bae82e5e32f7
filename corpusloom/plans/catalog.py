"""Tables of the session's catalog: made, extended and described. Doing it twice is as once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.schemas import ADDED, TABLES


def _value(value: object) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def create(spark: SparkSession, name: str, columns: str) -> None:
    """Makes a table with these columns, unless it is there."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")


def columns(spark: SparkSession, name: str) -> DataFrame:
    """(position, column, type) of a table, in order."""
    told = [(i, c.name, c.dataType) for i, c in enumerate(spark.catalog.listColumns(name), 1)]
    return spark.createDataFrame(told, "position int, column string, type string")


def add_columns(spark: SparkSession, name: str, added: list[tuple[str, str, object]]) -> list[str]:
    """Adds the columns (name, type, default) that the table hasn't got; rows that are there
    read the default, and files are not written again. The names that were added."""
    have = {c.name.lower() for c in spark.catalog.listColumns(name)}
    new = [a for a in added if a[0].lower() not in have]
    if new:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'`{c}` {kind} DEFAULT {_value(v)}' for c, kind, v in new)})")
    return [c for c, _, _ in new]


def initialize(spark: SparkSession, database: str) -> dict[str, list[str]]:
    """All tables of the schema, with the columns that came later; what was added, by table."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for table, cols in TABLES.items():
        create(spark, f"{database}.{table}", cols)
    return {table: add_columns(spark, f"{database}.{table}", [(c, kind, v) for t, c, kind, v in ADDED if t == table]) for table in TABLES}


def described(spark: SparkSession, database: str) -> DataFrame:
    """(table, position, column, type) of all tables of a database."""
    each = [columns(spark, f"{database}.{t.name}").select(F.lit(t.name).alias("table"), "*") for t in spark.catalog.listTables(database) if not t.isTemporary]
    empty = spark.createDataFrame([], "table string, position int, column string, type string")
    for e in each:
        empty = empty.unionByName(e)
    return empty
