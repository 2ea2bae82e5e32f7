"""Intervals of any width, groups of any size and trees of any depth, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph, interval, islands, ordered, rank, search, tree


@pytest.fixture
def many_partitions(spark):
    """Small partitions stay apart, so that groups do cross them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def cells(spark, spans):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "i int, lo long, hi long").select("i", interval.dyadic_cells(F.col("lo"), F.col("hi")).alias("c"))
    return {r["i"]: [(c["level"], c["cell"]) for c in r["c"] or []] for r in df.collect()}


def test_cells_tile_an_interval(spark):
    r = random.Random(1)
    spans = [(a, a + r.randint(-2, 70)) for a in (r.randint(-90, 90) for _ in range(200))]
    spans += [(0, 2**61), (-(2**61), 2**61 - 1), (-7, -7), (-(10**12), 10**12), (5, None), (None, 5)]
    for (lo, hi), found in zip(spans, cells(spark, spans).values(), strict=True):
        if lo is None or hi is None or lo > hi:
            assert found == []
            continue
        parts = sorted((c << k, ((c + 1) << k) - 1) for k, c in found)
        assert parts[0][0] == lo and parts[-1][1] == hi and all(x[1] + 1 == y[0] for x, y in zip(parts, parts[1:], strict=False))
        assert len(parts) <= 2 * (hi - lo + 1).bit_length()


@pytest.mark.parametrize("top", [60, 10**12])
def test_interval_joins(spark, top):
    r = random.Random(top)
    spans = [(r.randrange(2), lo, lo + r.choice([0, r.randrange(top), -1]), f"k{i:02}", r.randint(1, 3)) for i, lo in enumerate(r.randrange(-top, top) for _ in range(40))]
    spans += [(0, None, 5, "n1", 1), (1, 3, None, "n2", 2)]
    pages = [(i, r.randrange(3), r.choice([None, *(r.choice([s[1], s[2], r.randrange(-top, top)]) for s in r.sample(spans, 3))])) for i in range(150)]
    pts, sec = spark.createDataFrame(pages, "id int, g int, page long"), spark.createDataFrame(spans, "g int, lo long, hi long, k string, level int")
    first = {i: min(((lo, k) for h, lo, hi, k, _ in spans if h == g and None not in (p, lo, hi) and lo <= p <= hi), default=None) for i, g, p in pages}
    assert {x["id"]: x["k"] for x in interval.assign_first(pts, sec, ["g"], "page", "lo", "hi", "k", "left").collect()} == {i: w and w[1] for i, w in first.items()}
    deep = {}
    for i, g, p in pages:
        have = [(-lv, lo or 0, k) for h, lo, hi, k, lv in spans if h == g and p is not None and (lo or 0) <= p <= max(lo or 0, lo or 0 if hi is None else hi)]
        deep[i] = min(have)[2] if have else None
    assert {x["id"]: x["k"] for x in interval.assign_deepest(pts, sec, ["g"], "page", "lo", "hi", "level", "k").collect()} == deep
    want = sorted((i, k) for i, g, p in pages for h, lo, hi, k, _ in spans if h == g and None not in (p, lo, hi) and lo <= p <= hi)
    for width in (1, 1000):
        assert sorted((x["id"], x["k"]) for x in interval.range_children(sec, pts, ["g"], "lo", "hi", "page", "k", width).collect()) == want
    for spread in (True, False):
        near = interval.assign_or_nearest(pts, sec, ["g"], "page", "lo", "hi", "k", spread).collect()
        far = lambda lo: interval.FAR if lo is None else lo
        best = {}
        for i, g, p in pages:
            mine = [(lo is not None, lo or 0, k, lo) for h, lo, _, k, _ in spans if h == g]
            if mine:
                best[i] = min(mine)[2] if p is None else first[i][1] if first[i] else min((abs(p - far(m[3])), m[0], m[1], m[2]) for m in mine)[3]
        assert {x["id"]: x["k"] for x in near} == best


def test_pairs_of_large_cells_go_in_blocks(spark, monkeypatch):
    for name, n in (("PARENTS", 6), ("CHILDREN", 4), ("PAIRS_A_TASK", 500), ("ROWS_TO_CUT", 25)):
        monkeypatch.setattr(interval, name, n)
    r = random.Random(8)
    ups = [(r.choice(["a", "b", None]), i, *r.choice([(1, 3), (2, 2), (0, 9), (4, 1), (None, 3)])) for i in range(90)]
    lows = [(r.choice(["a", "a", "b", None]), r.choice([1, 2, 2, 7, None]), {"m": 1}) for _ in range(120)]  # equal rows too
    got = interval.range_children(spark.createDataFrame(ups, "g string, k int, lo int, hi int"), spark.createDataFrame(lows, "g string, page int, m map<string, int>"), ["g"], "lo", "hi", "page", "k")
    want = sorted((g, p, k) for g, k, lo, hi in ups for h, p, _ in lows if g and g == h and None not in (p, lo, hi) and lo <= p <= hi)
    assert got.columns == ["g", "page", "m", "k"] and sorted((x["g"], x["page"], x["k"]) for x in got.collect()) == want
    assert all(x["m"] == {"m": 1} for x in got.collect()) and got.rdd.getNumPartitions() >= -(-len(want) // 500) > 2


def test_ordered_steps_across_partitions(spark, many_partitions):
    r = random.Random(3)
    rows = [(g, i, r.choice([None, r.randint(-3, 9)])) for g in ("a", None) for i in range(400)] + [(f"s{i}", 1, i) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, o int, x int").repartition(7)
    want = {}
    for g in {x[0] for x in rows}:
        mine = sorted((o, x) for h, o, x in rows if h == g)
        for i, (o, _) in enumerate(mine):
            before, after = [x for _, x in mine[:i]], [x for _, x in mine[i + 1 :]]
            known, ahead = [x for x in before if x is not None], [x for x in after if x is not None]
            want[g, o] = (sum(known), known[-1] if known else None, ahead[0] if ahead else None, (before[-1],) if before else None, (after[0],) if after else None, i)
    for spread in (True, False, None):
        made = ordered.Ordered(df, ["g"], ["o"], spread)
        made.add(s=ordered.sum_before(F.col("x")), la=ordered.last_before(F.col("x")), ne=ordered.next_after(F.col("x")), p=ordered.previous(F.col("x")), f=ordered.following(F.col("x")))
        made.add(n=ordered.sum_before(F.when(F.col("s").isNotNull(), 1)))
        got = made.done().collect()
        assert {(t["g"], t["o"]): (t["s"], t["la"], t["ne"], t["p"] and tuple(t["p"]), t["f"] and tuple(t["f"]), t["n"]) for t in got} == want
        if spread:
            assert made.rows.select("_part").distinct().count() > 2 and made.rows.where("g = 'a'").select("_part").distinct().count() > 1
    assert ordered.has_large_group(df, ["g"], 399) and not ordered.has_large_group(df, ["g"], 400) and not ordered.has_large_group(df.limit(0), ["g"])


def test_spread_operators_equal_windows(spark, many_partitions):
    r = random.Random(4)
    e = spark.createDataFrame([(r.randrange(2), i, r.choice(["text", "text", "image"]), r.randrange(9), r.choice(["1.2 Head", "body", " ", "S"]), r.choice(["S", "T", None])) for i in range(500)], "g int, pos int, type string, page int, text string, section string")
    e = e.withColumns({"title": F.col("section"), "level": F.col("page") % 3 + 1}).repartition(5)
    makers = [
        lambda s: islands.backfill_positive(e.withColumn("page", F.col("page") - 4), ["g"], ["pos"], "page", spread=s),
        lambda s: islands.key_islands(e, ["g"], ["pos"], "section", s),
        lambda s: islands.contiguous_batches(e.withColumn("hi", F.col("pos") + F.col("page") % 2), ["g"], "pos", "hi", "pos", s),
        lambda s: islands.merge_by_section(e, ["g"], "pos", s),
        lambda s: islands.carry_heading(e, ["g"], "pos", s),
        lambda s: interval.lead_intervals(e, ["g"], "pos", "page", F.lit(999), spread=s),
        lambda s: interval.next_qualifying_end(e, ["g"], "pos", "page", "level", spread=s),
        lambda s: rank.budget_take(e, ["g"], [F.col("pos")], "text", 300, "type", 5, "..", s),
        lambda s: rank.prefix_budget(e, ["g"], [F.col("pos")], "text", 200, spread=s),
    ]
    for i, make in enumerate(makers):
        got, want = (sorted(map(str, make(s).collect())) for s in (True, False))
        assert got == want and got, i


def test_paths_of_deep_trees_and_cycles(spark):
    r = random.Random(5)
    up = {i: (None if i == 0 else i - 1) for i in range(1500)}  # a chain
    up |= {i: r.randrange(1500, i) if i > 1500 and i % 40 else None for i in range(1500, 2500)}
    up |= {3000: 3001, 3001: 3002, 3002: 3000, 3003: 3001, 3004: 3004, 3005: 9999}
    df = spark.createDataFrame(list(up.items()), "id int, parent int").repartition(3)
    depth = {}

    def walk(i):
        seen = []
        while i is not None and i in up and i not in seen:
            seen.append(i)
            i = up[i]
        return None if i in seen else seen[::-1]

    want = {i: walk(i) for i in up}
    got = {x["id"]: (x["path"], x["depth"]) for x in tree.paths(df, "id", "parent", F.col("id")).collect()}
    assert got == {i: ("/".join(map(str, w)), len(w)) for i, w in want.items() if w}
    depth = {x["id"]: x["depth"] for x in tree.depths(df, "id", "parent").collect()}
    assert depth == {i: w and len(w) for i, w in want.items()}
    assert {x["id"] for x in tree.cycles(df, "id", "parent").collect()} == {3000, 3001, 3002, 3003, 3004}
    assert tree.paths(df.limit(0), "id", "parent", F.col("id")).collect() == []
    odd = spark.createDataFrame([("a", None, "x"), ("a", None, "w"), (None, "a", "n"), ("b", "a", None)], "id string, parent string, l string")
    assert {x["id"]: (x["path"], x["depth"]) for x in tree.paths(odd, "id", "parent", F.col("l")).collect()} == {"a": ("w", 1), None: ("w/n", 2), "b": ("w/", 2)}


def test_layers(spark):
    r = random.Random(6)
    edges = [(a, b) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(90)) if a < b] + [(70, 71), (71, 72), (72, 70), (72, 73), (74, 74), (0, 99), (None, 3), (5, 6), (5, 6)]
    names = [*range(60), *range(70, 75), None]
    layer = {}
    for v in range(60):
        layer[v] = max((layer[a] + 1 for a, b in edges if b == v and a is not None), default=0)
    layer |= {v: None for v in range(70, 75)}
    got = tree.layers(spark.createDataFrame([(v,) for v in names], "id int"), spark.createDataFrame(edges, "a int, b int"), "id", "a", "b").collect()
    assert {x["id"]: x["layer"] for x in got} == layer


def test_a_long_list_is_not_squared_in_one_task(spark):
    """One thing shared by 600 items, many by few: blocks of 50 give what no blocks give."""
    rng = random.Random(12)
    rows = [(i, 0) for i in range(600)] + [(rng.randrange(700), rng.randrange(1, 200)) for _ in range(900)] + [(1, None), (None, 1), (5, 0), (5, 0)]
    df = spark.createDataFrame(rows, "b long, n long")
    want = Counter()
    by = {}
    for i, s in set(rows):
        if i is not None and s is not None:
            by.setdefault(s, []).append(i)
    for items in by.values():
        want.update((x, y) for x in items for y in items if x < y)
    for block in (50, 2048):
        pairs = graph.co_occurrence(df, "b", "n", block)
        assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == want
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert graph.co_occurrence(df.limit(0), "b", "n").collect() == []


def test_first_interval_takes_no_row_a_level(spark):
    """Each page and each interval comes once, however wide intervals are, and none is broadcast."""
    r = random.Random(4)
    i = [(g, n, lo, lo + r.choice([0, 3, 10**6, 10**12, -5])) for g in (1, 2, None) for n, lo in enumerate(r.choices(range(-50, 400), k=80))] + [(1, 900, None, 5), (1, 901, 5, None)]
    p = [(g, x) for g in (1, 2, 3, None) for x in [*range(-60, 420, 7), 10**11, None]]
    points, intervals = spark.createDataFrame(p, "g int, page long"), spark.createDataFrame(i, "g int, sec long, lo long, hi long")
    want = []
    for g, x in p:
        holds = [(lo, n) for h, n, lo, hi in i if g is not None and h == g and None not in (x, lo, hi) and lo <= x <= hi]
        want += [(g, x, min(holds)[1])] if holds else []
    for spread in (False, True):
        found = interval.assign_first(points, intervals, ["g"], "page", "lo", "hi", "sec", spread=spread)
        assert sorted(tuple(x) for x in found.select("g", "page", "sec").collect()) == sorted(want)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan


def test_range_children_are_dealt_to_as_many_tasks_as_the_pairs_need(spark, monkeypatch):
    monkeypatch.setattr("corpusloom.tables.ROWS_A_TASK", 5_000)
    monkeypatch.setattr(interval, "BLOCK", 16)
    up = spark.createDataFrame([(0, n, n % 7, n % 7 + 4) for n in range(200)], "g int, parent long, lo long, hi long")
    low = spark.createDataFrame([(0, n, n % 9) for n in range(300)] + [(0, 1, 1)], "g int, child long, page long")
    found = interval.range_children(up, low, ["g"], "lo", "hi", "page", "parent")
    pairs = found.select("parent", "child", F.spark_partition_id().alias("at")).collect()
    want = sorted((a, b) for a in range(200) for b in [*range(300), 1] if a % 7 <= b % 9 <= a % 7 + 4)
    assert sorted((x["parent"], x["child"]) for x in pairs) == want
    sizes = Counter(x["at"] for x in pairs)
    assert len(sizes) > 3 and max(sizes.values()) < len(want) / 2


def test_co_occurrence_is_dealt_to_as_many_tasks_as_the_meetings_need(spark, monkeypatch):
    monkeypatch.setattr("corpusloom.tables.ROWS_A_TASK", 2_000)
    lists = {s: random.Random(s).sample(range(3000), 30) for s in range(60)}
    m = spark.createDataFrame([(i, s) for s, xs in lists.items() for i in xs], "i int, s int")
    rows = graph.co_occurrence(m, "i", "s").withColumn("at", F.spark_partition_id()).collect()
    want = Counter((a, b) for xs in lists.values() for a in xs for b in xs if a < b)
    assert {(r["a"], r["b"]): r["n"] for r in rows} == want
    sizes = Counter(r["at"] for r in rows)
    assert len(sizes) > 10 and max(sizes.values()) < 3_000


def test_keyword_hits_send_lower_cased_texts_alone(spark):
    docs = spark.createDataFrame([(1, "The THE\nq"), (2, None), (3, "")], "d int, text string")
    kw = spark.createDataFrame([("the",), ("",), ("q",), ("zz",)], "keyword string")
    found = search.keyword_hits(docs, kw, "text").select("d", "keyword")
    assert sorted(tuple(x) for x in found.collect()) == [(1, ""), (1, "q"), (1, "the"), (3, "")]
    assert "snippet" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_classified_rows_are_ranked_across_tasks(spark, monkeypatch, many_partitions):
    monkeypatch.setattr(ordered, "LARGE_GROUP", 50)
    r = random.Random(9)
    rows = [("k", i, r.choice(["EXPLAINS", "USES"]), r.choice([0.1, 0.3, 0.5, 0.9, float("nan")])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, id int, label string, c double")
    found = rank.rank_classified(df, "label", "c", "id", group=["g"])
    most = lambda c: float("inf") if c != c else c
    want = sorted((x for x in rows if most(x[3]) >= 0.3), key=lambda x: (x[2] != "EXPLAINS", -most(x[3]), x[1]))
    assert [x["id"] for x in found.orderBy("position").collect()] == [x[1] for x in want]
    assert [x["position"] for x in found.orderBy("position").collect()] == list(range(1, len(want) + 1))
    assert "_part" in found._jdf.queryExecution().optimizedPlan().toString()
