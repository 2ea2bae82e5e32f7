import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from corpusloom.llm import ann_forest as A


def exact(ids, x, q, v, k):
    d = np.sqrt(((x - v) ** 2).sum(axis=1))
    best = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return [(int(ids[i]), d[i]) for i in best]


def test_recall_on_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    t = rows.toPandas()
    x, ids = np.array(t["embedding"].tolist(), np.float64), t["vec_id"].to_numpy()
    got = A.nearest(rows, rows.where("vec_id % 100 = 0")).toPandas()
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        want = {i for i, _ in exact(ids, x, q, x[ids == q][0], 10)}
        hit += len(want & set(got[got.query_id == q].vec_id))
        total += len(want)
    assert hit / total >= 0.9


def test_ties_copies_and_bad_vectors(spark):
    same = [1.0, 2.0]
    rows = [(i, same, 1) for i in range(300)] + [(1000, None, 1), (1001, [0.0, 0.0], 1), (1002, [float("nan"), 1.0], 1), (1003, [1.0], 1), (1004, [None, 1.0], 1), (1005, [1.0, 2.5], 1), (None, same, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = A.nearest(df, df.where("vec_id in (0, 200, 1005, 1001)"), k=3).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert by == {0: [(1, 0.0), (2, 0.0), (3, 0.0)], 200: [(0, 0.0), (1, 0.0), (2, 0.0)], 1005: [(0, 0.5), (1, 0.5), (2, 0.5)]}
    assert A.nearest(df.where("vec_id = 5"), df.where("vec_id = 5")).collect() == []
    assert A.nearest(df.where("vec_id < 0"), df.where("vec_id < 0")).collect() == []


def test_deep_forest_finds_all_near(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = A.nearest(df, df.where("vec_id % 100 = 0"), search_share=0.8).toPandas()
    hit = sum(len({i for i, _ in exact(np.arange(3000), x.astype(float), q, x[q].astype(float), 10)} & set(got[got.query_id == q].vec_id)) for q in range(0, 3000, 100))
    assert hit / 300 >= 0.9
    # a share of all trees is exact, also in several blocks
    every = A.nearest(df, df.where("vec_id % 500 = 0"), search_share=A.TREES).collect()
    for q in range(0, 3000, 500):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in every if r["query_id"] == q)
        assert [m[1:] for m in mine] == exact(np.arange(3000), x.astype(float), q, x[q].astype(float), 10)


def test_blocks_change_nothing(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    one = {tuple(r) for r in A.nearest(rows, rows.where("vec_id % 50 = 0")).collect()}
    monkeypatch.setattr(A, "ROW_BLOCK", 70)
    monkeypatch.setattr(A, "QUERY_BLOCK", 4)
    assert {tuple(r) for r in A.nearest(rows, rows.where("vec_id % 50 = 0")).collect()} == one


def test_trees_have_depth_and_cells_out_of_reach_are_left_out(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 16)) * 20
    x = (centres[r.integers(0, 40, 4000)] + r.normal(size=(4000, 16))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    f = A.fit(rows, 4000)
    assert f.depth >= 7
    leaf, met = A.leaves(f, x.astype(float)), []
    for q in range(0, 4000, 200):
        entered = A.probe(f, x[q].astype(float), A.SEARCH_SHARE * 4000, 10)
        hit = entered[np.arange(A.TREES), leaf].any(axis=1)
        met.append(hit.mean())
        assert hit[[i for i, _ in exact(np.arange(4000), x.astype(float), q, x[q].astype(float), 10)]].all()
    assert np.mean(met) < 0.25


def test_lengths_are_searched_apart(spark):
    rows = [(i, [float(i + 1)] * (1 + i % 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = A.nearest(df, df.where("vec_id < 2"), k=2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 2), (0, 2, 4), (1, 1, 3), (1, 2, 5)]
    repeated = df.unionByName(df.where("vec_id = 2")).unionByName(df.where("vec_id = 2"))
    assert sorted((r["rank"], r["vec_id"]) for r in A.nearest(repeated, df.where("vec_id = 0"), k=2).collect()) == [(1, 2), (2, 4)]


def test_recall_holds_as_the_table_grows(spark, tmp_path):
    for n in (30_000, 120_000):
        x = np.random.default_rng(1).normal(size=(n, 64)).astype(np.float32)
        pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float32()))}), f"{tmp_path}/{n}.parquet")
        df = spark.read.parquet(f"{tmp_path}/{n}.parquet")
        asked = range(0, n, n // 40)
        got = A.nearest(df, df.where(f"vec_id % {n // 40} = 0")).toPandas()
        hit = sum(len({i for i, _ in exact(np.arange(n), x.astype(float), q, x[q].astype(float), 10)} & set(got[got.query_id == q].vec_id)) for q in asked)
        print(n, hit / (10 * len(asked)))
        assert hit / (10 * len(asked)) >= 0.9


def test_any_number_of_lengths(spark, monkeypatch):
    """Lengths beyond the commonest are searched too, exactly."""
    monkeypatch.setattr(A, "MOST_LENGTHS", 2)
    monkeypatch.setattr(A, "ROW_BLOCK", 3)
    monkeypatch.setattr(A, "QUERY_BLOCK", 2)
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=1 + i % 19).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = A.nearest(df, df.where("vec_id < 60"), k=4, search_share=A.TREES).collect()
    for q in range(60):
        like = [i for i in range(200) if i % 19 == q % 19]
        x = np.array([rows[i][1] for i in like])
        assert sorted((m["rank"], m["vec_id"]) for m in got if m["query_id"] == q) == [(n + 1, i) for n, (i, _) in enumerate(exact(np.array(like), x, q, np.array(rows[q][1]), 4))]


def test_repeated_queries_and_ids_with_several_vectors(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 5.0]), (2, [9.0, 9.0]), (3, [8.0, 9.0]), (4, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id in (1, 2)")
    got = A.nearest(df, asked.unionByName(asked), k=2).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 4, 2.0), (1, 2, 2, 4.0), (2, 1, 3, 1.0), (2, 2, 4, 2.0)]


def test_rows_travel_only_to_leaves_that_are_reached(spark, monkeypatch):
    """Queries from one of 40 clusters: few of the other clusters' rows are dealt out."""
    r = np.random.default_rng(6)
    centres = r.normal(size=(40, 16)) * 20
    x = centres[np.arange(4000) % 40] + r.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    met = []
    meet = A._meet

    def counted(rows, asked, *more, **named):
        met.append(rows.join(asked.select("cell").distinct(), "cell").count() / rows.count())
        return meet(rows, asked, *more, **named)

    monkeypatch.setattr(A, "_meet", counted)
    got = A.nearest(df, df.where("vec_id % 400 = 0"), k=5).toPandas()
    assert met[0] < 0.5
    hit = sum(len({i for i, _ in exact(np.arange(4000), x, q, x[q], 5)} & set(got[got.query_id == q].vec_id)) for q in range(0, 4000, 400))
    assert hit / 50 >= 0.9
