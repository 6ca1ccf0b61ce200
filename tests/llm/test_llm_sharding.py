import hashlib
import random

from pyspark.sql import functions as F

from tidewatch.llm import sharding


def brute(rows, limit):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    items = [(i, len((t or "").encode()), format(int(md5(f"{'' if i is None else i}:{md5(t or '')}")[:15], 16), "060b")) for i, t in rows]

    def split(some, prefix):
        if sum(n for _, n, _ in some) <= limit:
            return [(i, n, len(prefix), prefix) for i, n, _ in some]
        if len(prefix) == 60:
            return [(i, n, 60, prefix + "/") for i, n, _ in some]
        halves = [(bit, [s for s in some if s[2][len(prefix)] == bit]) for bit in "01"]
        return [x for bit, half in halves if half for x in split(half, prefix + bit)]
    return sorted(split(items, ""), key=str) if items else []


def run(spark, rows, limit):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("x")).withColumn("depth", F.lit(7)).withColumn("shard", F.lit(None).cast("int"))
    got = [tuple(r) for r in sharding.shard(docs, limit).collect()]
    carried = sharding.shard(docs, limit, carry=True)
    assert sorted(map(str, got)) == sorted(str(tuple(r)[:4]) for r in carried.collect())
    assert sorted(str(tuple(r["row"])[:2]) for r in carried.collect()) == sorted(str(tuple(r)) for r in rows)
    return got, carried


def test_equals_recursive_splitting(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randint(0, 60)) for i in range(300)] + [(None, "a"), (1, None), (5, "q" * 60)]
    for limit in (120, 1000, 10 ** 9):
        got, carried = run(spark, rows, limit)
        assert sorted(got, key=str) == brute(rows, limit)
    sharding.write_shards(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 1000, carry=True), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_equal_rows_and_oversized_rows(spark):
    rows = [(7, "x" * 10)] * 55 + [(8, "y" * 500), (9, ""), (9, "")] + [(i, "z" * 9) for i in range(100, 120)]
    got, _ = run(spark, rows, 100)
    assert sorted((*r[:3], r[3].split("/")[0]) for r in got) == sorted((*r[:3], r[3].split("/")[0]) for r in brute(rows, 100))
    sizes = {}
    for _, n, _, s in got:
        sizes.setdefault(s, []).append(n)
    assert all(sum(n) <= 100 or len(n) == 1 for n in sizes.values())
    assert sum(n == [10] * 10 for n in sizes.values()) == 5 and [10] * 5 in sizes.values()


def test_empty_table_and_empty_texts(spark):
    assert run(spark, [], 10)[0] == []
    assert sorted(run(spark, [(1, None), (2, "")], 10)[0]) == [(1, 0, 0, ""), (2, 0, 0, "")]
