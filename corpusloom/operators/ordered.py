"""Values of the rows before or after a row, in groups of any size.

A window sorts a whole group in one task. Here a large group is dealt over all tasks: rows are
range-partitioned by group and order and written once, each (partition, group) is summed up
in one row, what comes before (or after) a partition is put together from these rows, and
windows within a partition are completed by it. A partition shares a group with the one
before it at most once, so what is carried over is at most a row a partition, and is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from corpusloom.tables import written

#: Rows of a group from which on it is dealt over the tasks.
LARGE_GROUP = 2_000_000
_PART = "_part"


@dataclass
class Step:
    """One value a row: `kind` is sum or max (of all rows before), last (the last non-null
    value before) or next (the first non-null value after)."""

    kind: str
    value: Column

    def near(self, w: WindowSpec, back: WindowSpec) -> Column:
        """Within the rows of a window; `back` is the window from the end."""
        rows = (back if self.kind == "next" else w).rowsBetween(Window.unboundedPreceding, -1)
        return self._over(self.value, rows)

    def _over(self, value: Column, rows: WindowSpec) -> Column:
        made = {"sum": F.sum, "max": F.max}.get(self.kind)
        return (made(value) if made else F.last(value, ignorenulls=True)).over(rows)

    def whole(self, order: list[Column]) -> Column:
        """Of all rows of a partition, as an aggregate: a struct that isn't null if it says
        something."""
        if self.kind in ("sum", "max"):
            return F.struct((F.sum if self.kind == "sum" else F.max)(self.value).alias("v"))
        keyed = F.when(self.value.isNotNull(), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), self.value.alias("v")))
        return F.max(keyed) if self.kind == "last" else F.min(keyed)

    def carried(self, c: str, parts: WindowSpec, back: WindowSpec) -> Column:
        rows = (back if self.kind == "next" else parts).rowsBetween(Window.unboundedPreceding, -1)
        return self._over(F.col(f"{c}.v"), rows)

    def joined(self, here: Column, carry: Column) -> Column:
        if self.kind == "max":
            return F.greatest(here, carry)
        return F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0)) if self.kind == "sum" else F.coalesce(here, carry)


def sum_before(value: Column) -> Step:
    """The sum over all rows before; 0 for the first."""
    return Step("sum", value)


def max_before(value: Column) -> Step:
    """The greatest of all rows before; null for the first."""
    return Step("max", value)


def last_before(value: Column) -> Step:
    return Step("last", value)


def next_after(value: Column) -> Step:
    return Step("next", value)


def previous(value: Column) -> Step:
    """The value of the row before, null or not, as a struct v; null for the first row."""
    return Step("last", F.struct(value.alias("v")))


def following(value: Column) -> Step:
    """The value of the row after, null or not, as a struct v; null for the last row."""
    return Step("next", F.struct(value.alias("v")))


def has_large_group(df: DataFrame, group: list[str], most: int | None = None) -> bool:
    """Whether a group has more rows than `most`; only counts are looked at."""
    n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (n or 0) > (LARGE_GROUP if most is None else most)


class Ordered:
    """A table in order within its groups. `rows` has the values added so far.

    order: columns of a total order, ascending, nulls first. spread: whether groups are dealt
    over the tasks; if None, they are where a group has more than LARGE_GROUP rows.
    """

    def __init__(self, df: DataFrame, group: list[str], order: list[str], spread: bool | None = None):
        self.group, self.order = group, order
        self.spread = has_large_group(df, group) if spread is None else spread
        self.rows = df
        if self.spread:
            self.rows = written(df.repartitionByRange(*group, *order).withColumn(_PART, F.spark_partition_id()), "ordered")

    def add(self, **steps: Step) -> Ordered:
        """The steps' values as columns. Steps may use columns that were added before."""
        key = [*self.group, *([_PART] if self.spread else [])]
        w = Window.partitionBy(*key).orderBy(*self.order)
        back = Window.partitionBy(*key).orderBy(*map(F.desc, self.order))
        near = {name: s.near(w, back) for name, s in steps.items()}
        if not self.spread:
            self.rows = self.rows.withColumns({n: s.joined(near[n], F.lit(None)) for n, s in steps.items()})
            return self
        sums = self.rows.groupBy(*key).agg(*(s.whole([F.col(o) for o in self.order]).alias(f"_sum_{n}") for n, s in steps.items()))
        parts = Window.partitionBy(*self.group).orderBy(_PART)
        parts_back = Window.partitionBy(*self.group).orderBy(F.desc(_PART))
        carry = sums.withColumn("_spans", F.count(F.lit(1)).over(Window.partitionBy(*self.group))).select(*(F.col(c).alias(f"_c_{c}") for c in key), "_spans", *(s.carried(f"_sum_{n}", parts, parts_back).alias(f"_c_{n}") for n, s in steps.items()))
        # groups of one partition carry nothing over; a partition holds two others at most,
        # the one that goes on from before and the one that goes on after
        carry = F.broadcast(carry.where("_spans > 1").drop("_spans"))
        on = [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in key]
        both = self.rows.withColumns({f"_near_{n}": c for n, c in near.items()}).join(carry, on, "left")
        kept = [c for c in self.rows.columns if c not in steps]
        self.rows = both.select(*kept, *(s.joined(F.col(f"_near_{n}"), F.col(f"_c_{n}")).alias(n) for n, s in steps.items()))
        return self

    def done(self, *drop: str) -> DataFrame:
        return self.rows.drop(_PART, *drop)
