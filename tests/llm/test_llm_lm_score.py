import collections
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import lm_score

WORD = re.compile("[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def discounts(counts):
    n = [0] + [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    d = [0, *(min(k, max(0, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else k / 2 for k in (1, 2, 3))]
    return lambda c: d[min(c, 3)]


def brute(train, rows):
    one, two = collections.Counter(), collections.Counter()
    for t in map(tokens, train):
        one.update(t)
        two.update(zip(["<s>", *t], t))
    total, follows, after = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for (v, w), c in two.items():
        total[v] += c
        follows[w] += 1
        after[v].append(c)
    d, dl = discounts(list(two.values())), discounts(list(follows.values()))
    n, types, pairs = sum(one.values()), len(one), len(two)
    rest = sum(dl(c) for c in follows.values()) / pairs if pairs else 1

    def p(v, w):
        low = (max(follows[w] - dl(follows[w]), 0) / pairs if pairs else 0) + rest / (types + 1)
        if not total[v]:
            return low
        return max(two[v, w] - d(two[v, w]), 0) / total[v] + sum(map(d, after[v])) / total[v] * low
    out = []
    for i, t in rows:
        t = tokens(t)
        out.append((i, len(t), sum(one[w] > 0 for w in t), sum(math.log10((one[w] + 0.1) / (n + 0.1 * (types + 1))) for w in t),
                    sum(math.log10(p(v, w)) for v, w in zip(["<s>", *t], t))))
    contexts = ["<s>", *[w for w in one if w], "never seen"]
    sums = [sum(p(v, w) for w in [*one, "unseen"]) for v in contexts[:20]]
    return n, sorted(out, key=str), sums


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], rel=1e-9, abs=1e-9)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "É-é", "#"]
    rows = [(i, " ".join(rng.choice(words[:rng.randint(1, 63)]) for _ in range(rng.randint(0, 60))).replace("w3", rng.choice(["W3", "w3"]))) for i in range(80)]
    rows += [(200, "hot pair " * 700), (201, None), (202, ""), (203, " \n"), (None, "w1 w2"), rows[5], rows[5], (204, "never before seen")]
    train = [t for i, t in rows if i != 204 and i not in (7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("id", F.lit(1))
    model = lm_score.train(docs.where("doc_id IS NULL OR doc_id NOT IN (204, 7, 8, 9)"))
    n, want, sums = brute(train, rows)
    assert model.tokens == n and sums == pytest.approx([1] * len(sums))
    close(sorted(map(tuple, lm_score.score(docs, model).collect()), key=str), want)


def test_empty_training(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = lm_score.train(docs.where("false"))
    close(sorted(map(tuple, lm_score.score(docs, model).collect())), [(1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)])
    assert lm_score.score(docs.where("false"), model).collect() == []


def test_query_on_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    n, want, _ = brute([t for i, t in rows if i not in held], rows)
    got = lm_score.op4_lm_score(spark, "/root/testdata/sf0.001").collect()
    assert {r["train_tokens"] for r in got} == {n} and {r["doc_id"] for r in got if r["held_out"]} == held
    close(sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got), key=str), want)


def brute_of_order(train, rows, order):
    pad = ["<s>"] * (order - 1)
    counts = [None] * order + [collections.Counter()]
    for t in map(tokens, train):
        t = [*pad, *t]
        counts[order].update(tuple(t[i - order + 1:i + 1]) for i in range(order - 1, len(t)))
    for k in range(order - 1, 0, -1):
        grams = {g[-k - 1:] for g in counts[k + 1]}
        counts[k] = collections.Counter(g[1:] for g in grams)
    after = [collections.defaultdict(list) for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            after[k][g[:-1]].append(c)
    d = [None] + [discounts(list(c.values())) for c in counts[1:]]
    sums = [None] + [{g: (sum(x), sum(map(d[k], x))) for g, x in after[k].items()} for k in range(1, order + 1)]

    def p(context, w, k):
        low = 1 / (len(counts[1]) + 1) if k == 1 else p(context[1:], w, k - 1)
        if context not in sums[k]:
            return low
        total, rest = sums[k][context]
        c = counts[k][(*context, w)]
        return max(c - d[k](c), 0) / total + rest / total * low
    out = {}
    for i, t in rows:
        t = [*pad, *tokens(t)]
        out[i] = sum(math.log10(p(tuple(t[j - order + 1:j]), t[j], order)) for j in range(order - 1, len(t)))
    one = [g[0] for g in counts[1]]
    contexts = [*list(after[order])[:5], ("never", *pad[1:])]
    return out, [sum(p(c, w, order) for w in [*one, "unseen"]) for c in contexts]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_orders_equal_brute_force(spark, order):
    rng = random.Random(order)
    words = [f"w{i}" for i in range(25)]
    rows = [(i, " ".join(rng.choice(words[:rng.randint(1, 25)]) for _ in range(rng.randint(0, 50)))) for i in range(60)]
    rows += [(200, "hot pair of " * 700), (201, None), (202, ""), (203, "w1 never w2 seen w3 w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm_score.train(docs.where("doc_id <> 203 AND doc_id > 4"), order=order)
    want, sums = brute_of_order([t for i, t in rows if i != 203 and i > 4], rows, order)
    assert sums == pytest.approx([1] * len(sums))
    assert {r["doc_id"]: r["score"] for r in lm_score.score(docs, model).collect()} == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_trigram_query_on_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want, _ = brute_of_order([t for i, t in rows if zlib.crc32(str(i).encode()) % 10], rows, 3)
    got = {r["doc_id"]: r["score"] for r in lm_score.op4_lm_score_trigram(spark, "/root/testdata/sf0.001").collect()}
    assert got == pytest.approx(want, rel=1e-9, abs=1e-9)
