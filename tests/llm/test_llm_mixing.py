import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import mixing

WORD = re.compile("[^\x20\x09-\x0D]+")


def goals(sizes):
    """Sources in order of their names with their targets, by refilling until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        share = {s: weight[s] * (total - sum(full.values())) / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            return share | full
        full |= {s: 3 * sizes[s] for s in over}
        if len(full) == len(names):
            return full


def seats(target, sizes, block):
    """Blocks one after the other to the highest quotient."""
    names = [s for s in sorted(sizes, key=lambda s: (s is None, (s or "").encode()))]
    won = dict.fromkeys(names, 0)
    for _ in range((2 * sum(sizes.values()) + block) // (2 * block)):
        free = [s for s in names if target[s] > 0 and won[s] < -(-3 * sizes[s] // block)]
        if free:
            won[max(free, key=lambda s: (target[s] / (2 * won[s] + 1), -names.index(s)))] += 1
    return won


@pytest.mark.parametrize("seed,block", [(1, 5), (2, 1), (3, 32)])
def test_targets_blocks_and_documents(spark, seed, block):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "a", "a", "b", "É", "z", None, "Z"])) for i in range(200)]
    rows += [(1000 + i, "x y\tz", f"s{i}") for i in range(5)] + [(2000, "u " * 3000, "big"), (None, "null id", "a"), (3000, None, "a"),
             (3001, "", None), (3002, None, "empty"), rows[3], rows[3], (rows[4][0], "another text", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("rank", F.lit(1))
    got = [r.asDict() for r in mixing.mix(docs, block_words=block, shard_blocks=7).collect()]
    again = [r.asDict() for r in mixing.mix(docs.repartition(5), block_words=block, shard_blocks=7).collect()]
    key = lambda r: str(sorted(r.items()))
    assert sorted(got, key=key) == sorted(again, key=key)
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len(WORD.findall(t or ""))) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    target = goals(sizes)
    won = seats(target, sizes, block)
    carried = mixing.mix(docs, block_words=block, carry=True)
    by = {r["s"]: r for r in carried.groupBy(F.col("row.source").alias("s")).agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("z")).collect()}
    for s in sizes:
        assert by[s]["z"] == sizes[s] and by[s]["target"] == pytest.approx(target[s])
        assert by[s]["taken"] == min(won[s] * block, 3 * sizes[s])
        assert abs(by[s]["taken"] - target[s]) <= 2 * block
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    texts = carried.select("size", "taken", mixing.taken_texts(carried, F.col("row.text")).alias("t")).collect()
    assert all(sum(len(WORD.findall(t or "")) for t in r["t"]) == r["taken"] for r in texts)


def test_shard_quotas_follow_the_targets(spark):
    docs = spark.createDataFrame([(i, "w " * 50, f"s{i % 4}") for i in range(400)], "doc_id long, text string, source string")
    sizes = docs.select("source", F.lit(50).alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    aims = mixing.targets(sizes)
    quotas = mixing.awards(aims, block_words=10, shard_blocks=100).collect()
    per_shard = {}
    for q in quotas:
        per_shard.setdefault(q["shard"], {})[q["rank"]] = q["blocks"]
    assert len(per_shard) == 20 and all(sum(x.values()) == 100 for x in per_shard.values())
    share = {r["rank"]: r["target"] / 20000 * 100 for r in aims.collect()}
    running = dict.fromkeys(share, 0)
    for n in sorted(per_shard):
        for r in share:
            running[r] += per_shard[n].get(r, 0)
            assert abs(running[r] - share[r] * (n + 1)) <= 2


def by_hand(rows, block, shard_blocks):
    """Per row: words taken and shards, word by word from the quotas on."""
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    count = lambda t: len(WORD.findall(t or ""))
    sizes = {s: sum(count(t) for _, t, x in rows if x == s) for s in names}
    target = goals(sizes)
    order = sorted(((-target[s] / (2 * j - 1), i, s) for i, s in enumerate(names) if target[s] > 0 for j in range(1, -(-3 * sizes[s] // block) + 1)),
                   key=lambda x: x[:2])[:(2 * sum(sizes.values()) + block) // (2 * block)]
    taken, shards = {}, {}
    for rank, s in enumerate(names, 1):
        line = [n for n in sorted((n for n, r in enumerate(rows) if r[2] == s), key=lambda n: hashlib.md5(f"mix:{rows[n][0]}".encode()).hexdigest())
                for _ in range(count(rows[n][1]))]
        quotas = Counter(n // shard_blocks for n, seat in enumerate(order) if seat[2] == s)
        words = min(sum(quotas.values()) * block, 3 * sizes[s])
        passes, part = divmod(words, max(1, sizes[s]))
        done = 0
        for shard in sorted(quotas):
            until = min(done + quotas[shard] * block, words)
            chosen = list(range(done, min(until, passes * sizes[s])))
            first = max(done, passes * sizes[s])
            if until > first:
                lo, hi = ((x - passes * sizes[s]) * sizes[s] // part for x in (first, until))
                places = (hi - lo - (until - first)) // block + 1
                at = lo + block * (int(hashlib.md5(f"mix:{rank}:{shard}".encode()).hexdigest()[:8], 16) % places)
                assert at + until - first <= hi
                chosen += range(at, at + until - first)
            for x in chosen:
                n = line[x % sizes[s]]
                taken[n] = taken.get(n, 0) + 1
                shards.setdefault(n, set()).add(shard)
            done = until
    return sorted((i, count(t), taken.get(n, 0), min(shards[n]) if n in shards else -1, len(shards.get(n, ()))) for n, (i, t, _) in enumerate(rows))


@pytest.mark.parametrize("seed,block,shard_blocks", [(1, 4, 10), (2, 1, 50), (3, 32, 3), (4, 7, 1), (5, 5, 4096)])
def test_blocks_by_hand(spark, seed, block, shard_blocks):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(120)]
    rows += [(500, "u " * 2500, "big"), (501, "x y", "tiny"), (502, "", "empty"), (503, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("uid", F.lit(1)).withColumn("shard", F.lit("x"))
    got = mixing.mix(docs, block_words=block, shard_blocks=shard_blocks)
    flat = lambda d: sorted(map(tuple, d.select("doc_id", "size", "taken", F.coalesce("first_shard", F.lit(-1)), "n_shards").collect()))
    assert flat(got) == by_hand(rows, block, shard_blocks)
    carried = mixing.mix(docs, block_words=block, shard_blocks=shard_blocks, carry=True)
    assert flat(carried) == flat(got)
    texts = carried.select("size", "taken", mixing.taken_texts(carried, F.col("row.text")).alias("t")).collect()
    assert all(sum(len(WORD.findall(t or "")) for t in r["t"]) == r["taken"] <= 3 * r["size"] for r in texts)


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
