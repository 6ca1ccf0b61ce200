import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import nearest


def brute(rows, k, every):
    use = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and None not in v and np.all(np.isfinite(np.array(v, float))) and any(v)]
    table = np.array([v for _, v in use])
    out = {}
    for n, (i, v) in enumerate(use):
        if i % every == 0:
            score = table @ v
            out.setdefault(i, []).append(sorted((-s, j) for m, (s, (j, _)) in enumerate(zip(score, use)) if m != n)[:k])
    return out


def recall(got, want, k):
    hits = total = 0
    for i, lists in want.items():
        mine = [r for r in got if r["query_id"] == i]
        for one in lists:
            total += len(one)
            hits += sum(any(abs(r["score"] + s) < 1e-9 for r in mine) for s, _ in one)
    return hits / max(1, total)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    rows += [(100, None), (120, []), (140, [0.0] * 6), (160, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (180, [float("nan")] * 6), (200, [float("inf")] + [0.0] * 5),
             (None, [1.0] * 6), rows[20], rows[7], (220, [9.0] * 6), (240, [1.0, 2.0])]  # the last is alone of its length
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("rank", F.lit(1))
    got = nearest.search(df, k=5, every=20).collect()
    want = brute([r for r in rows if r[0] != 240], 5, 20)
    assert {r["query_id"] for r in got} == set(want) == {0, 20, 40, 220}
    assert recall(got, want, 5) >= 0.9
    for i in want:
        ranks = [r["rank"] for r in got if r["query_id"] == i]
        assert sorted(ranks) == sorted(list(range(1, 6)) * len(want[i]))
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert sorted(r["vec_id"] for r in nearest.search(few, k=5, every=20).collect()) == [1, 2, 3]
    assert nearest.search(few.where("false")).collect() == []


def test_ties_and_equal_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 50)] + [(i, [0.5, 0.5]) for i in range(50, 60)]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4, every=20).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 1), (0, 2), (0, 3), (0, 4), (20, 0), (20, 1), (20, 2), (20, 3), (40, 0), (40, 1), (40, 2), (40, 3)]


def exact(rows, k, every):
    """By hand, each query among the vectors of its own length."""
    out = []
    for i, v in rows:
        if i % every == 0:
            with np.errstate(all="ignore"):
                scored = [(float(np.array(w) @ np.array(v)), j) for j, w in rows if j != i and len(w) == len(v)]
            out += [(i, n + 1, j, s) for n, (s, j) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


def same(got, want):
    got = sorted(map(tuple, got))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12, atol=0)


@pytest.mark.parametrize("sizes", [(1e-200, 1.0), (1.0, 1e200), (1e-320, 1e-310), (1e307, 1e308)])
def test_components_of_any_size(spark, sizes):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) * s for x in rng.uniform(0.1, 1, 3)]) for i, s in enumerate(sizes * 10)]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=19, every=5).collect()
    same(got, exact(rows, 19, 5))
    mixed = [(1, [1e200, 0.0]), (20, [1.0, 0.0]), (40, [1e-200, 0.0]), (60, [2e200, 0.0])]
    got = nearest.search(spark.createDataFrame(mixed, "vec_id long, embedding array<double>"), k=3).collect()
    same(got, exact(mixed, 3, 20))
    assert len(got) == 9


def test_several_lengths(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=1 + i % 4)]) for i in range(0, 120)] + [(999, [1.0] * 9), (1000, [2.0] * 10)]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=40, every=5).collect()
    found, want = {tuple(r)[0::2] for r in got}, {t[0::2] for t in exact(rows, 40, 5)}
    assert found == want and not any(r["query_id"] == 1000 for r in got)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_recall(spark, spread):
    rng = np.random.default_rng(2)
    table = rng.normal(size=(6000, 24)) * np.exp(spread * rng.normal(size=(6000, 1)))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(table)]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=300).collect()
    assert recall(got, brute(rows, 20, 300), 20) >= 0.9


def test_query_on_table(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = nearest.op10_nearest(spark, "/root/testdata/sf0.01").collect()
    assert recall(got, brute(rows, 20, 20), 20) >= 0.9


def test_recall_of_the_defaults_on_near_uniform_vectors(spark):
    table = np.random.default_rng(4).normal(size=(20000, 64))
    table /= np.sqrt((table ** 2).sum(1, keepdims=True))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(table)]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4, "vec_id"), every=50).collect()
    worst = {}
    for i in range(0, 20000, 50):
        score = table @ table[i]
        score[i] = -np.inf
        worst[i] = np.partition(score, -20)[-20]
    found = sum(r["score"] >= worst[r["query_id"]] - 1e-9 for r in got) / (20 * len(worst))
    assert found >= 0.985
