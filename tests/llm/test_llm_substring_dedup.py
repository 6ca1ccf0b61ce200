import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import substring_dedup

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows, window):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = collections.Counter(tuple(w[k:k + window]) for _, w in docs for k in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, window, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("n_words", "kept", "id", "shard"):
        docs = docs.withColumn(c, F.lit("x"))
    got = substring_dedup.remove_repeated(docs, window, **more).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    return sorted(map(tuple, got), key=str)


@pytest.mark.parametrize("bits", [None, 4])
def test_equals_brute_force(spark, bits):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "É", "été", "x y", "#", "Zz q"])
    passage = " ".join(word() for _ in range(30))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(100 + i, f"q{i}\t {passage}\n r{i}") for i in range(20)]
    rows += [(7, rows[7][1]), (None, passage), (None, None), (300, ""), (301, " \n\t "), (302, "one"), (303, "k " * 500)]
    assert run(spark, rows, 5, bits=bits) == brute(rows, 5)


def test_empty_table(spark):
    assert run(spark, [], 5) == []


def test_a_window_repeated_in_one_text_only(spark):
    rows = [(1, "a b c d e f a b c d e"), (2, "b c d"), (3, "A B C D E")]
    assert run(spark, rows, 5) == brute(rows, 5)
    assert [r[2] for r in run(spark, rows, 5)] == [10, 0, 0]


def test_query_on_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = substring_dedup.op9_substring_dedup(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 35)
