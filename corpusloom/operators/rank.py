"""Rankings, thresholds, budgets and first- or latest-of-key choices.

Every order ends in a column that makes it total, so results don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ordered import Ordered, sum_before

from corpusloom.operators.ordered import Ordered, sum_before


def first_by_key(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key; partial limits apply before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def latest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order."""
    return first_by_key(df, [F.col(k) for k in key], [F.desc(o) for o in order])


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, out: str = "position") -> DataFrame:
    """The first n rows of each group, with their position from 1."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col(out) <= n)


def top_k_or_threshold(df: DataFrame, group: list[str], score: str, tie: str, k: int = 5, least: float = 0.4) -> DataFrame:
    """Rows that reach the threshold or are among the k best of their group."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), tie))
    return df.withColumn("_n", n).where((F.col("_n") <= k) | (F.col(score) >= least)).drop("_n")


def funnel(levels: list[DataFrame], group: list[str], key: str, parent: str, score: str, k: int = 5, least: float = 0.4) -> list[DataFrame]:
    """Scored levels, each pruned to rows under a parent that qualified on the level above
    (top k of the whole group, or over the threshold)."""
    out = [levels[0]]
    for below in levels[1:]:
        kept = top_k_or_threshold(out[-1], group, score, key, k, least).select(*group, F.col(key).alias(parent))
        out.append(below.join(kept, [*group, parent], "left_semi"))
    return out


def _keyed(df: DataFrame, group: list[str], order: list[Column], spread: bool | None) -> Ordered:
    """df in order; what it is ordered by becomes columns _o0, _o1 and so on."""
    return Ordered(df.withColumns({f"_o{i}": o for i, o in enumerate(order)}), group, [f"_o{i}" for i in range(len(order))], spread)


def budget_take(df: DataFrame, group: list[str], order: list[Column], text: str, budget: int, head: str | None = None, least: int = 500, marker: str = "\n[...truncated...]", spread: bool | None = None) -> DataFrame:
    """Rows in order until heads and texts fill the budget of characters. The first that
    doesn't fit is cut so that it fills the budget with its head and a marker, if more than
    `least` of it are left; then no more. Empty texts are passed over."""
    above = F.length(head) if head else F.lit(0)
    n = above + F.length(text)
    rows = _keyed(df.where(F.length(text) > 0), group, order, spread).add(_before=sum_before(n))
    # the first overflow ends the list, so a later short text can't slip in
    rows = rows.add(_over=sum_before(F.when(F.col("_before") + n > budget, 1).otherwise(0))).done(*(f"_o{i}" for i in range(len(order))))
    held = rows.where(F.col("_over") == 0)
    fits = F.col("_before") + n <= budget
    left = budget - F.col("_before") - above - len(marker)
    return held.where(fits | (left > least)).withColumn(text, F.when(fits, F.col(text)).otherwise(F.concat(F.substring(text, F.lit(1), left.cast("int")), F.lit(marker)))).drop("_before", "_over")


def prefix_budget(df: DataFrame, group: list[str], order: list[Column], text: str, budget: int, out: str = "text", spread: bool | None = None) -> DataFrame:
    """Texts of a group joined by newlines until the budget is passed, then cut to it: the
    text that crosses is still read."""
    rows = _keyed(df, group, order, spread).add(_before=sum_before(F.length(text)), _n=sum_before(F.lit(1))).done().where(F.col("_before") < budget)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(text).alias("t")))), lambda x: x["t"]), "\n")
    return rows.groupBy(*group).agg(F.substring(joined, 1, budget).alias(out))


def recent_distinct(df: DataFrame, group: list[str], key: str, order: list[str], n: int = 10) -> DataFrame:
    """The n keys of each group seen last, newest first, with their position."""
    last = latest_per_key(df, [*group, key], order)
    return top_n(last, group, [F.desc(o) for o in order], n)


def rank_classified(df: DataFrame, label: str, confidence: str, tie: str, first: str = "EXPLAINS", least: float = 0.3, group: list[str] | None = None) -> DataFrame:
    """Rows of enough confidence, those of the first class in front, then by confidence;
    with their position (within each group, if any is named)."""
    # the greatest confidence has the least number, NaN above all
    falling = F.when(F.isnan(confidence), F.lit(float("-inf"))).otherwise(-F.col(confidence))
    rows = df.where(F.col(confidence) >= least).withColumns({"_class": F.when(F.col(label) == first, 0).otherwise(1), "_falling": falling})
    placed = Ordered(rows, group or [], ["_class", "_falling", tie]).add(_before=sum_before(F.lit(1))).done("_class", "_falling")
    return placed.withColumn("position", (F.col("_before") + 1).cast("long")).drop("_before")


def score_bands(df: DataFrame, group: list[str], score: str, high: float = 0.7, low: float = 0.4) -> DataFrame:
    """Counts over high, from low to high, and between 0 and low, both left out."""
    s = F.col(score)
    return df.groupBy(*group).agg(F.count_if(s > high).alias("high"), F.count_if((s >= low) & (s <= high)).alias("partial"), F.count_if((s > 0) & (s < low)).alias("low"))


def badge(score: Column, high: float = 0.7, low: float = 0.4) -> Column:
    return F.when(score > high, "High").when(score >= low, "Medium").otherwise("Low")
