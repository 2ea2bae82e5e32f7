"""Keyed streaming state and the keyword automaton, against plain Python."""

import random
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import search
from corpusloom.streaming import state
from corpusloom.tables import written


def test_chunks_once_and_in_order(spark):
    r = random.Random(1)
    sent, want = [], {}
    for k in range(12):
        n = r.randint(0, 9)
        sent += [(k, i, f"{k}.{i};") for i in range(n)] + [(k, n, "[DONE]")] + [(k, n + 1, "late")]
        sent += r.sample(sent[-n - 2 :], 2)  # again
        want[k] = [(i, f"{k}.{i};", False) for i in range(n)] + [(n, None, True)]
    sent += [(50, 1, "b"), (50, 0, "a"), (50, 3, "d"), (51, 0, "[ERROR] x"), (51, 1, "y"), (None, 0, "z"), (52, None, "z"), (52, 0, None)]
    want |= {50: [(0, "a", False), (1, "b", False)], 51: [(0, None, True)]}
    r.shuffle(sent)
    df = spark.createDataFrame(sent, "s int, i long, t string")
    got = {}
    for x in state.drained(state.in_order(state.replayed(df, 5), "s", "i", "t")).collect():
        got.setdefault(x["s"], []).append((x["i"], x["t"], x["closed"]))
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()} == want


def test_idle_streams_close(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "a"), (1, 2, "c")], "s int, i long, t string")
    run = state.in_order(state.replayed(df, 1), "s", "i", "t", idle_ms=500).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").start(f"{tmp_path}/o")
    try:
        for _ in range(60):
            time.sleep(0.5)
            got = [] if not run.lastProgress else [tuple(x) for x in spark.read.schema("s int, i long, t string, closed boolean").parquet(f"{tmp_path}/o").collect()]
            if len(got) >= 3:
                break
    finally:
        run.stop()
    assert sorted(got, key=str) == sorted([(1, 0, "a", False), (1, 2, "c", False), (1, None, None, True)], key=str)


def test_ring_buffer_over_batches(spark):
    r = random.Random(2)
    rows = [(r.choice([None, *range(6)]), r.randint(0, 30), i, f"p{i}") for i in range(200)]
    df = spark.createDataFrame([*rows, rows[0]], "k int, a long, i long, p string")
    want = {}
    for k in {x[0] for x in rows}:
        last = sorted(((a, i, p) for h, a, i, p in rows if h == k), reverse=True)[:4]
        want |= {(k, n + 1): x for n, x in enumerate(last)}
    for files in (1, 4):
        kept = state.ring(state.replayed(df, files), "k", F.col("a"), F.col("i"), F.col("p"), 4)
        got = state.newest(state.drained(kept), "k").collect()
        assert {(x["k"], x["position"]): (x["at"], x["tie"], x["payload"]) for x in got} == want


def test_ring_keys_share_states(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    rows = [(f"k{r.randint(0, 2000)}", r.randint(0, 9), i, r.choice([None, f"p{i}"])) for i in range(9000)]
    df = spark.createDataFrame([*rows, *rows[:500], (None, 1, 2, "n")], "k string, a long, i long, p string")
    want = {(None, 1): (1, 2, "n")}
    for k in {x[0] for x in rows}:
        last = sorted(((a, i, p) for h, a, i, p in rows if h == k), key=lambda x: x[:2], reverse=True)[:3]
        want |= {(k, n + 1): x for n, x in enumerate(last)}
    for cut in (state.CUT_ROWS, 5):
        monkeypatch.setattr(state, "CUT_ROWS", cut)
        run = state.ring(state.replayed(df, 3), "k", F.col("a"), F.col("i"), F.col("p"), 3).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c{cut}").trigger(availableNow=True).start(f"{tmp_path}/o{cut}")
        run.awaitTermination()
        # not a state, and so a call of Python, for each of 2,001 keys
        assert 1 < run.lastProgress["stateOperators"][0]["numRowsTotal"] <= state.STATES + 1
        got = state.newest(spark.read.parquet(f"{tmp_path}/o{cut}"), "k").collect()
        assert {(x["k"], x["position"]): (x["at"], x["tie"], x["payload"]) for x in got} == want and len(got) == len(want)


def test_replayed_lots_have_files_for_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    seen = []
    run = state.replayed(spark.range(1000), 4).writeStream.foreachBatch(lambda df, n: seen.append((df.select(F.input_file_name()).distinct().count(), df.count()))).trigger(availableNow=True).start()
    run.awaitTermination()
    assert cores > 1 and [x for x, _ in seen] == [cores] * 4 and sum(x for _, x in seen) == 1000


def test_streams_share_states(spark, tmp_path):
    r = random.Random(5)
    sent, want = [], set()
    for k in range(1500):
        n = r.randint(0, 4)
        sent += [(f"s{k}", i, f"{k}.{i};") for i in range(n)] + [(f"s{k}", n, "[DONE]"), (f"s{k}", n + 1, "late")]
        want |= {(f"s{k}", i, f"{k}.{i};", False) for i in range(n)} | {(f"s{k}", n, None, True)}
    sent += r.sample(sent, 700)
    r.shuffle(sent)
    df = spark.createDataFrame(sent, "s string, i long, t string")
    run = state.in_order(state.replayed(df, 3), "s", "i", "t").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/o")
    run.awaitTermination()
    # not a state, and so a call of Python, for each of 1,500 streams
    assert 1 < run.lastProgress["stateOperators"][0]["numRowsTotal"] <= state.STATES
    got = [tuple(x) for x in spark.read.parquet(f"{tmp_path}/o").collect()]
    assert set(got) == want and len(got) == len(want)


def test_streams_of_one_state(spark):
    """Of texts under one number the least goes out, if none went out before; numbers below 0 don't count."""
    sent = [(1, 1, "y"), (1, 1, "x"), (1, 1, "x"), (1, 0, "b"), (1, 0, "a"), (1, 3, "d"), (1, -1, "n"), (2, 1, "[DONE]"), (2, 0, "c"), (2, 0, "c"), (3, 1, "[DONE]"), (4, 0, "[ERROR]"), (4, 0, "[DONE]"), (4, 1, "e")]
    df = spark.createDataFrame(sent, "s int, i long, t string").coalesce(1)
    for states in (1, 2):
        got = [tuple(x) for x in state.drained(state.in_order(state.replayed(df, 1), "s", "i", "t", states=states)).collect()]
        assert sorted(got, key=str) == sorted([(1, 0, "a", False), (1, 1, "x", False), (2, 0, "c", False), (2, 1, None, True), (4, 0, None, True)], key=str)


def test_idle_streams_of_one_state(spark, tmp_path):
    folder = f"{tmp_path}/in"
    put = lambda rows: spark.createDataFrame(rows, "s int, i long, t string").coalesce(1).write.mode("append").parquet(folder)
    put([(1, 0, "a"), (1, 2, "c"), (2, 0, "x"), (2, 1, "[DONE]"), (3, 0, "p"), (3, 2, "r")])
    chunks = spark.readStream.schema("s int, i long, t string").parquet(folder)
    run = state.in_order(chunks, "s", "i", "t", idle_ms=8000, states=1).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").start(f"{tmp_path}/o")
    read = lambda: [] if not run.lastProgress else [tuple(x) for x in spark.read.schema("s int, i long, t string, closed boolean").parquet(f"{tmp_path}/o").collect()]

    def wait(n):
        for _ in range(80):
            if len(got := read()) >= n:
                break
            time.sleep(0.5)
        return sorted(got, key=str)

    first = [(1, 0, "a", False), (2, 0, "x", False), (2, 1, None, True), (3, 0, "p", False)]
    try:
        assert wait(4) == sorted(first, key=str)
        put([(3, 1, "q")])  # 3 goes on and waits anew; 1 runs out
        second = first + [(3, 1, "q", False), (3, 2, "r", False)]
        assert set(wait(6)) >= set(second)
        last = second + [(1, 2, "c", False), (1, None, None, True), (3, None, None, True)]
        assert wait(9) == sorted(last, key=str)
        put([(1, 0, "again"), (2, 0, "anew")])  # their state went
        assert wait(11) == sorted([*last, (1, 0, "again", False), (2, 0, "anew", False)], key=str)
    finally:
        run.stop()


def test_keys_of_many_types_share_a_state(spark):
    kinds = {"DOUBLE": "IF(g = 1, -0.0D, IF(g = 2, 0.0D, g / 3))", "STRUCT": "IF(g = 0, NULL, struct(g % 3 AS x, array('a', CAST(g AS STRING)) AS y))", "DATE": "IF(g = 0, NULL, DATE'2024-01-01' + CAST(g AS INT))", "LONG": "IF(g = 0, NULL, 9007199254740993 + g)"}
    base = spark.range(200).selectExpr("id % 7 AS g", "id % 5 AS a", "id", "concat('p', id) AS p")
    for kind in kinds.values():
        rows = base.select(F.expr(kind).alias("k"), "a", "id", "p")
        got = state.newest(state.drained(state.ring(state.replayed(rows, 2), "k", F.col("a"), F.col("id"), F.col("p"), 4, states=2)), "k").select("k", "position", "at", "tie", "payload")
        want = rows.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("a"), F.desc("id"))).cast("long")).where("r <= 4").select("k", "r", "a", "id", "p")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        parts = rows.where("k IS NOT NULL").select("k", (F.row_number().over(Window.partitionBy("k").orderBy("id")) - 1).cast("long").alias("nr"), "p")
        out = state.drained(state.in_order(state.replayed(parts.union(parts), 2), "k", "nr", "p", states=2)).select("k", "nr", "p")
        assert out.exceptAll(parts).isEmpty() and parts.exceptAll(out).isEmpty()


def test_keyword_automaton(spark, monkeypatch):
    r = random.Random(3)
    words = ["ab", "b", "abc", "", "É", "x\ny", "c b", "ABC", None, "zzz"]
    texts = [(i, "".join(r.choice("abcé \nxyABC") for _ in range(r.choice([0, 3, 40])))) for i in range(60)] + [(99, None)]
    docs, kw = spark.createDataFrame([(i, t, 7) for i, t in texts], "id int, t string, line int"), spark.createDataFrame([(w,) for w in words], "keyword string").select(F.lower("keyword").alias("keyword"))
    want = {}
    for i, t in texts:
        for w in {w.lower() for w in words if w is not None}:
            if t is not None and w in t.lower():
                n, lines = t.lower()[: t.lower().index(w)].count("\n") + 1, t.split("\n")
                want[i, w] = (n, None if "\n" in w else "\n".join(lines[max(n - 3, 0) : n + 2]))
    for chars in (10**6, 8):
        monkeypatch.setattr(search, "BLOCK_CHARS", chars)
        got = search.keyword_lines(docs, kw, "t").collect()
        assert {(x["id"], x["keyword"]): (x["line"], x["snippet"]) for x in got} == want and len(got) == len(want)
    assert search.keyword_hits(docs, kw.limit(0), "t").collect() == []


def test_very_many_keywords(spark):
    kw = spark.range(100_000).select(F.concat(F.lit("word"), F.col("id"), F.lit(".")).alias("keyword"))
    docs = written(spark.range(300).select("id", F.concat(F.lit("a WORD"), F.col("id") * 331, F.lit(". and word"), F.col("id") + 100_000, F.lit(".")).alias("t")), "many")
    got = {(x["id"], x["keyword"]) for x in search.keyword_hits(docs, kw, "t").collect()}
    assert got == {(i, f"word{i * 331}.") for i in range(300)}
