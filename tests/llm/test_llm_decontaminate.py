import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}, len(w)


def brute(docs, items, k, percent):
    out = set()
    for j, t in items:
        n = shingles(t, k)[1]
        if n:
            want = shingles(t, min(n, k))[0]
            for i, x in docs:
                c = len(want & shingles(x, min(n, k))[0])
                if 100 * c >= percent * len(want):
                    out.add((i, j, c, len(want)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,k,percent,rows", [(1, 5, 80, 10 ** 6), (2, 3, 60, 0)])
def test_equals_brute_force(spark, monkeypatch, seed, k, percent, rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "c", "É", "é", "x-", "of"])
    items = [(j, " ".join(word() for _ in range(rng.randint(0, 40)))) for j in range(25)] + [(90, None), (91, ""), (92, "one"), (93, "One two"), (3, "same id other text here ok")]
    docs = []
    for i in range(60):
        body = [word() for _ in range(rng.randint(0, 60))]
        if i % 2:
            w = rng.choice(items[:25])[1].split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = word()
            body[len(body) // 2:len(body) // 2] = w
        docs.append((i, "\n ".join(body)))
    docs += [(200, None), (201, " "), (202, "one"), (203, "zero one two three"), (None, items[0][1]), docs[1], docs[1], (docs[1][0], "quite another"), (204, "same id OTHER text here ok")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("value", F.lit(1)).withColumn("item", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("key", F.lit("x"))
    got = decontaminate.contaminated(d, b, k, percent).drop("text_hash").distinct().collect()
    want = brute(docs, items, k, percent)
    assert sorted(map(tuple, got), key=str) == want
    bad = {(i, x) for i, x in docs for r in brute([(i, x)], items, k, percent)}
    assert sorted(map(str, decontaminate.clean(d, b, k, percent).select("doc_id", "text").collect())) == sorted(str(r) for r in spark.createDataFrame([x for x in docs if x not in bad], "doc_id long, text string").collect())


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(none, some).collect() == []
    docs = some.withColumnRenamed("item_id", "doc_id")
    assert decontaminate.contaminated(docs, some.where("false")).collect() == []
    assert decontaminate.clean(docs, some.where("false")).count() == 1


def test_clean_keeps_columns_of_any_name_and_very_long_texts(spark):
    item = " ".join(f"i{k}" for k in range(12))
    rows = [(1, "x " + item + " y"), (2, "clean"), (None, item), (3, None), (4, " ".join(f"w{k}" for k in range(60_000)) + " " + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("_id", "_hash", "id", "hash", "row", "own_id", "own_hash", "item", "text_hash", "a.b"):
        docs = docs.withColumn(c, F.lit("kept"))
    left = decontaminate.clean(docs, spark.createDataFrame([("a", item)], "item_id string, text string"))
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.hash, r["a.b"]) for r in left.collect()) == [(2, "kept", "kept"), (3, "kept", "kept")]
