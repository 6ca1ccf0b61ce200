import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.llm import toxicity, words


def table(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [f"w{int(rng.expovariate(0.01))}" for _ in range(rng.randint(5, 150))]
        rude, dull = rng.random() < 0.2, rng.random() < 0.3
        for _ in range(rng.randint(2, 6)):
            if rude:
                w.insert(rng.randrange(len(w)), rng.choice(["Idiot", "moron!", "scum"]))
            if dull:
                w.insert(rng.randrange(len(w)), "buy")
        docs.append((i, " ".join(w)))
        labels.append((i, int(dull), int(rude)))
    return docs, labels


def test_finds_toxic_and_leaves_clean(spark):
    docs, labels = table(900, 1)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame(labels[:600] + [(None, 1, 1), (5, None, 1), labels[3], (100000, 0, 1)], "doc_id long, junk int, toxic int").withColumn("text", F.lit("x"))
    chain = toxicity.train(d, y, ["junk", "toxic"])
    got = {r["doc_id"]: r for r in toxicity.predict(d, chain).collect()}
    new = [(got[i]["toxic"], bool(t)) for i, _, t in labels[600:]]
    assert sum(a for a, t in new if t) >= 0.9 * sum(t for _, t in new)
    assert sum(a for a, t in new if not t) <= 0.03 * sum(not t for _, t in new)
    assert all(len(r["probabilities"]) == 2 and all(0 <= p <= 1 for p in r["probabilities"]) for r in got.values())
    again = toxicity.train(d.repartition(3), y.repartition(5), ["junk", "toxic"])
    assert again.threshold == chain.threshold and all((a == b).all() for a, b in zip(again.weights, chain.weights))


def test_odd_rows_and_carried_columns(spark):
    docs, labels = table(60, 2)
    docs += [(900, None), (901, ""), (902, " \n"), (None, "idiot moron! scum"), docs[0], docs[0], (903, "é " * 50_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("toxic", F.lit("x")).withColumn("id", F.lit(3)).withColumn("_text", F.lit(4.0))
    chain = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, junk int, toxic int"), ["junk", "toxic"], sample=40)
    got = toxicity.predict(d, chain, carry=True).collect()
    assert sorted(str((r["row"]["doc_id"], r["row"]["text"])) for r in got) == sorted(str(r) for r in docs)
    assert not any(r["toxic"] for r in got if not (r["row"]["text"] or "").strip())


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, junk int, toxic int")
    chain = toxicity.train(docs, labels, ["junk", "toxic"])
    assert [tuple(r) for r in toxicity.predict(docs, chain).collect()] == [(1, [0.5, 0.5], False)]
    one_class = toxicity.train(docs, spark.createDataFrame([(1, 0, 0)], "doc_id long, junk int, toxic int"), ["junk", "toxic"])
    assert not toxicity.predict(docs, one_class).collect()[0]["toxic"]
    assert toxicity.predict(docs.where("false"), chain).collect() == []


def test_chain_equals_a_plain_one_fit_by_fit(spark):
    """The same features, folds and order, fitted one after another in this process."""
    sf, folds = "/root/testdata/sf0.001", toxicity.FOLDS
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    table = docs.join(labels, "doc_id").select("doc_id", "text", "junk", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)).alias("fold"))
    rows = sorted(map(tuple, table.collect()))

    def cells_of(texts):
        return [toxicity._features(next(words.slices(pa.RecordBatch.from_pydict({"text": [t]}), "text")))[0] if t else np.zeros(0, np.int32) for t in texts]

    cells, fold = cells_of([r[1] for r in rows]), np.array([r[4] for r in rows])
    earlier, models = np.zeros((len(rows), 0)), []
    for k in (2, 3):
        y, given, p = np.array([r[k] for r in rows], dtype=float), toxicity._logit(earlier), np.zeros(len(rows))
        for f in range(folds):
            held = np.flatnonzero(fold == f)
            rest = np.flatnonzero(fold != f)
            weights = toxicity._fit([cells[i] for i in rest], given[rest], y[rest])
            for i in held:  # out of fold
                p[i] = toxicity._squash(toxicity._margins(weights, cells[i], np.zeros(len(cells[i]), np.int64), 1, given[[i]]))[0]
        models.append(toxicity._fit(cells, given, y).astype(np.float32).astype(float))
        earlier = np.column_stack([earlier, p])
    chain = toxicity.train(docs, labels, ["junk", "toxic"])
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(chain.weights, models))
    assert abs(chain.threshold - toxicity._best_threshold(earlier[:, 1], np.array([r[3] for r in rows]))) < 1e-6
    got = {r.doc_id: r.probabilities for r in toxicity.predict(docs, chain).collect()}
    for r, own in list(zip(rows, cells))[:60]:
        first = 1 / (1 + math.exp(-(sum(models[0][c] for c in own) + models[0][-1])))
        second = toxicity._squash(toxicity._margins(models[1], own, np.zeros(len(own), np.int64), 1, toxicity._logit(np.array([[first]]))))[0]
        assert abs(got[r[0]][1] - second) < 1e-4
