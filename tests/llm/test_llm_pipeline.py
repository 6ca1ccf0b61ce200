import random
from collections import Counter

import pytest

import corpus_pipeline
from test_llm_decontaminate import brute as brute_items
from test_llm_jaccard_join import brute as brute_components
from test_llm_mixing import goals
from tidewatch.llm import toxicity

RUDE = ["idiot", "moron", "scum", "trash"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean, toxic, copied, contaminated and odd documents, with their labels and items."""
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{int(rng.expovariate(0.004))}" for _ in range(n))
    items = [(j, words(30)) for j in range(6)]
    docs, labels = [], []
    for i in range(500):
        rude = rng.random() < 0.25
        w = words(rng.randint(20, 120)).split()
        for _ in range(rng.randint(4, 8) if rude else 0):
            w.insert(rng.randrange(len(w)), rng.choice(RUDE))
        docs.append((i, " ".join(w), "en", f"src{i % 3}"))
        labels.append((i, 1, int(rude)))
    for i in range(500, 560):
        text = docs[rng.randrange(500)][1]
        docs.append((i, text if i % 2 else text + " tail", "en", "copies"))
    docs += [(600 + j, f"{words(40)} {t.upper()} {words(10)}", "en", "leaks") for j, t in items]
    docs += [(700, None, None, None), (701, "", "en", "src0"), (702, "one", "en", None), (None, words(50), "en", "src1"), docs[9], docs[9], (703, words(6000), "en", "long")]
    docs = [(i, t, lang, s, len(t or "")) for i, t, lang, s in docs]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_each_stage_against_brute_force(spark, folder, tmp_path):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        out.write.parquet(str(tmp_path / name))
        kept[name] = docs, spark.read.parquet(str(tmp_path / name))
        docs = kept[name][1]
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]

    before, after = map(rows_of, kept["toxicity"])
    toxic = lambda r: sum(w in RUDE for w in (r[1] or "").split()) >= 3
    assert sum(toxic(r) for r in after) <= 0.1 * sum(map(toxic, before))
    assert sum(not toxic(r) for r in after) >= 0.97 * sum(not toxic(r) for r in before)
    chain = toxicity.fitted(spark, path, kept["toxicity"][0])
    said = Counter(str(r["row"]["doc_id"]) for r in toxicity.predict(kept["toxicity"][0], chain, carry=True).where("NOT toxic").collect())
    assert Counter(str(r[0]) for r in after) == said

    before, after = map(rows_of, kept["near_duplicates"])
    component = {i: c for i, n, c in brute_components([r[:2] for r in before], 5, 80) if n}
    want = {r for r in before if r[0] == component.get(r[0])} | {r for r in before if not (r[1] or "").split()}
    assert sorted(map(str, after)) == sorted(map(str, want))

    before, after = map(rows_of, kept["decontamination"])
    bad = {i for i, *_ in brute_items([r[:2] for r in before], items, 5, 80)}
    assert bad >= {600, 601, 602, 603, 604, 605} and sorted(map(str, after)) == sorted(str(r) for r in before if r[0] not in bad)

    before, after = map(rows_of, kept["mixing"])
    size = lambda rows: {s: sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    took, want = size(after), goals(size(before))
    assert all(abs(took.get(s, 0) - want[s]) <= 64 for s in want)
    whole = {r[0]: r for r in before}
    assert all(r == whole[r[0]] or (f" {r[1]} " in f" {' '.join(whole[r[0]][1].split())} " and r[4] == len(r[1])) for r in after)
    assert max(Counter(r[0] for r in after).values()) <= 3

    before, after = map(rows_of, kept["sharding"])
    assert Counter(map(str, before)) == Counter(str(r[:5]) for r in after)
    sizes = Counter()
    for r in after:
        sizes[r[5]] += len(r[1].encode())
    assert max(sizes.values()) <= corpus_pipeline.SHARD_BYTES


def test_run_is_its_stages(spark, folder):
    path, _ = folder
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard"] and got.count() > 100


def test_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
