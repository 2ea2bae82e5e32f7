import hashlib
import math
import random

import numpy as np

from corpusloom.llm import centroids as C


def brute(rows, k, rounds, seed, dims, scale):
    """Plain Python integers, every vector against every centroid."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    by = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    cs = [v for _, v in by[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cs = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(cs)]
    told = [(i, *near(v)) for i, v in kept]
    each = {}
    for _, d, j in told:
        each[j] = each.get(j, 0) + d
    return sorted((str(i), j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, d, j in told)


def mine(df, **kw):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in C.cluster(df, **kw).collect())


def test_search_is_exact_with_ties():
    r = np.random.default_rng(1)
    for k, dims, top in ((1, 3, 5), (4, 2, 2), (5, 1, 3), (40, 2, 4), (200, 3, 6), (60, 16, 400), (50, 64, 300_000)):
        c, x = r.integers(-top, top, (k, dims)), r.integers(-top, top, (300, dims))
        c[k // 2] = c[0]
        for leaf in (1, 4):
            who, best = C.search(C.build(c, leaf), x)
            want = C.squared(x, c)
            assert (best == want.min(axis=1)).all() and (who == want.argmin(axis=1)).all()


def test_far_branches_are_left_out(monkeypatch):
    """Vectors near one of 256 centroids in a plane are compared with few of them."""
    r = np.random.default_rng(4)
    c = r.integers(-100_000, 100_000, (256, 2))
    compared, plain = [], C.squared
    tree = C.build(c)
    monkeypatch.setattr(C, "squared", lambda x, y: compared.append(len(x) * len(y)) or plain(x, y))
    who, _ = C.search(tree, c + r.integers(-50, 50, c.shape))
    assert (who == np.arange(256)).mean() > 0.99 and sum(compared) < 256 * 64


def test_against_brute_force(spark):
    r = random.Random(7)
    for dims, k, top in ((3, 5, 2), (2, 12, 1), (4, 40, 3)):
        rows = [(i, [r.randint(-4 * top, 4 * top) / 4 + r.choice([0, 0, 1 / 512]) for _ in range(dims)]) for i in range(120)]
        rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, rows[8][1]), (500, None), (501, []), (502, [1.0] * (dims + 1)), (503, [None] + [0.0] * (dims - 1)), (504, [float("nan")] * dims), (505, [float("-inf")] + [0.0] * (dims - 1))]
        df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance int").repartition(5)
        assert mine(df, k=k, dims=dims, rounds=3, scale=4) == brute(rows, k, 3, 2, dims, 4)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5, 0.25]), (2, [-0.3, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert mine(df, dims=2) == brute(rows, 40, 5, 2, 2, 256)
    assert mine(df.limit(0), dims=2) == [] and mine(df, dims=3) == []
    most = C.largest_component(2) / 256
    big = spark.createDataFrame([(1, [most, -most]), (2, [-most, most]), (3, [most * 1.01, 0.0]), (4, [1e300, 0.0])], "vec_id long, embedding array<double>")
    got = C.cluster(big, k=1, dims=2, rounds=0).collect()
    assert {x["vec_id"] for x in got} == {1, 2} and max(x["distance"] for x in got) > 1 << 61


def test_one_large_group_of_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(400)] + [(400 + i, [float(i), 0.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert mine(df, k=9, dims=2) == brute(rows, 9, 5, 2, 2, 256)


def test_query_on_the_given_table(spark, sf):
    from corpusloom.llm.queries import op12_centroids

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in op12_centroids(spark, sf).collect())
    assert got == brute(rows, 40, 5, 2, 64, 256)
