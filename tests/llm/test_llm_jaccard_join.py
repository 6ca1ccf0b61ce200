import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import graph, jaccard_join

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows, k, percent):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            n = len(s & sets[j])
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows, k, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("node", "label", "id", "fa"):
        docs = docs.withColumn(c, F.lit(None).cast("string"))
    return sorted(map(tuple, jaccard_join.near_duplicates(docs, k, percent).select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize("k,percent,seed", [(3, 90, 1), (5, 80, 2), (2, 50, 3)])
def test_equals_brute_force(spark, k, percent, seed):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.expovariate(0.02))}"
    rows, i = [], 0
    for _ in range(15):
        base = [word() for _ in range(rng.randint(1, 160))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4, 6])):
                at = rng.randrange(len(copy))
                copy[at:at + 1] = rng.choice([[word()], [], [copy[at], word()]])
                copy = copy or ["w"]
            rows.append((i, " ".join(copy).replace("w1", rng.choice(["w1", "W1"]))))
            i += 1
    rng.shuffle(rows)
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "a"), (5004, "a"), (5005, "a b"), (None, rows[0][1]),
             (5006, rows[0][1]), rows[1], rows[1], (5007, "é É"), (5008, "É é")]
    assert run(spark, rows, k, percent) == brute(rows, k, percent)


def test_keeps_one_of_each_component(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(3, base), (1, base + " end"), (2, base), (1, base + " end"), (7, "quite different words stand here"), (None, "w1 w2"), (7, "a"),
            (8, None), (8, None), (9, ""), (1, "another text under the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("fa", F.lit(2))
    got = jaccard_join.keep_one(docs, 5, 80)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == sorted((str(i), str(t)) for i, t in [rows[1], *rows[4:]])


def test_keep_one_takes_texts_of_repeated_ids_alone_to_python(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(3, base), (1, base + " end"), (2, "quite different words stand here"), (4, None), (5, ""), (6, base + " END")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.lit("x"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    got = jaccard_join.keep_one(docs, 5, 80)
    assert got.columns == docs.columns and "MapInArrow" not in plan(got)
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2, 4, 5]

    rows += [(6, "another text"), (6, "another text"), (None, base), (None, "w1 w2"), (4, None), (4, " "), (2, "quite different words stand  HERE")]
    got = jaccard_join.keep_one(docs.sparkSession.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.lit("x")), 5, 80)
    assert "MapInArrow" in plan(got)
    kept = sorted((str(r["doc_id"]), (r["text"] or "").lower().split()) for r in got.collect())
    assert kept == sorted((str(i), (t or "").lower().split()) for i, t in [*rows[1:5], rows[6], rows[9], *rows[10:12]])


def test_empty_table(spark):
    assert run(spark, [], 3, 90) == []


def test_query_on_table_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = jaccard_join.op5_jaccard_join(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 3, 90)


def test_components_of_few_links_take_no_rounds(spark, monkeypatch):
    rng = random.Random(4)
    links = [(rng.randrange(900), rng.randrange(900)) for _ in range(700)] + [(i, i + 1) for i in range(2000, 2400)] + [(5000 - i, 4000) for i in range(300)]
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for first in sorted(near):
        todo = [] if first in want else [first]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = first
                todo += near[x]
    steps, kept = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df, name: steps.append(name) or kept(df, name))
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = graph.components(df).collect()
    assert len(got) == len(want) and {r["node"]: r["label"] for r in got} == want
    assert steps == ["edges", "labels"]
    monkeypatch.setattr(graph, "LINKS_A_TASK", 100)  # several tasks: rounds of stars
    got = graph.components(df).collect()
    assert len(got) == len(want) and {r["node"]: r["label"] for r in got} == want and len(steps) > 4


@pytest.mark.parametrize("pairs", [0, 4, 1 << 40])
def test_same_components_whether_stars_are_linked_first_or_not(spark, monkeypatch, pairs):
    monkeypatch.setattr(jaccard_join, "PAIRS_AN_ENTRY", pairs)
    rng, rows = random.Random(pairs), []
    for size in (1, 2, 40):
        base = [f"{size}w{i}" for i in range(60)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(60)] = f"x{rng.randrange(9)}"
            rows.append((len(rows), " ".join(copy)))
    assert run(spark, rows, 3, 80) == brute(rows, 3, 80)
