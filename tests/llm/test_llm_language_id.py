import collections
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import language_id

SCHEMA = "doc_id long, text string, lang string"


def test_languages_and_odd_rows(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "tori", "mu", "ne"], "bb": ["sch", "ung", "tz", "ä"], "cc": ["ção", "lh", "ou", "es"]}
    text = lambda s: " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(40))
    rows = [(i, text(s), lang) for i, (lang, s) in enumerate(list(syllables.items()) * 40)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 34 --", "cc"), (903, "unknown language", None), (None, "katori mune", "aa"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("key", F.lit(1)).withColumn("rate", F.lit(1))
    model = language_id.train(docs.where("doc_id < 90"))
    assert set(model.languages) == {"aa", "bb", "cc"} and len(model.languages) == 12
    got = language_id.predict(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == lang for i, t, lang in rows[:120])
    assert {by[i]["lang_pred"] for i in (900, 901, 902)} == {"und"} and by[None]["lang_pred"] == "aa"
    assert sum(by[i]["rejected"] for i in range(90)) <= 12
    odd = spark.createDataFrame([(1, "русский текст", None), (2, "é", None), (3, "☃ 1", None)], SCHEMA)
    odd = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert odd[1]["rejected"] and odd[1]["lang_pred"] != "und" and odd[2]["lang_pred"] != "und" and odd[3]["lang_pred"] == "und"


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "abc", "aa")], SCHEMA)
    nothing = language_id.train(docs.where("false"))
    assert [tuple(r)[1:3] for r in language_id.predict(docs, nothing).collect()] == [("und", 0.0)]
    assert language_id.predict(docs.where("false"), nothing).collect() == []


def test_held_out_accuracy_on_table(spark):
    got = language_id.op6_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = got.join(docs, "doc_id").select("doc_id", "held_out", "lang", "lang_pred").collect()
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_copies_count_once_in_the_sample(spark):
    rng = random.Random(3)
    texts = lambda letters, n: [" ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(20)) for _ in range(n)]
    few = {lang: texts(letters, 3) for lang, letters in (("aa", "abcde"), ("bb", "fghij"), ("cc", "klmno"))}
    rows = [(i, few[lang][i % 3], lang) for lang in few for i in range(1500)] + [(i, t, "dd") for i, t in enumerate(texts("pqrst", 300))]
    rows += [(i, t, "dd") for i in range(500) for t in (rows[-1][1], "12 34")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language_id.train(docs, sample=10)
    assert set(model.languages) == {"aa", "bb", "cc", "dd"}
    got = language_id.predict(spark.createDataFrame([(i, t, "") for i, t in enumerate(t for lang in few for t in few[lang])], SCHEMA), model)
    assert [r["lang_pred"] for r in sorted(got.collect(), key=lambda r: r["doc_id"])] == ["aa"] * 3 + ["bb"] * 3 + ["cc"] * 3
    kept = language_id.sample_texts(docs.select("text", "lang"), 10).collect()
    assert {lang: len({r["text"] for r in kept if r["lang"] == lang}) for lang in model.languages} == {"aa": 3, "bb": 3, "cc": 3, "dd": 10}
    assert len(kept) == 19 and all(r["text"] != "12 34" for r in kept)


def plain_buckets(text):
    """Buckets of all 1- to 3-grams of bytes: letters in lower case, other ASCII a blank."""
    folded = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
    out = collections.Counter()
    for n in (1, 2, 3):
        for i in range(len(folded) - n + 1):
            code = 0
            for b in folded[i:i + n]:
                code = code * 257 + b
            out[(code + ((n - 1) << 40)) * 0x9E3779B97F4A7C15 % 2 ** 64 >> 52] += 1
    return out


def test_frequencies_and_predictions_equal_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 3000").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    model = language_id.train(docs.where("doc_id % 3 <> 0"))
    learned = [t for i, t, lang in rows if i % 3 and lang is not None and t is not None]
    frequency = collections.Counter(b for t in learned for b in plain_buckets(t))
    idf = [math.log((1 + len(learned)) / (1 + frequency[d])) + 1 for d in range(language_id.DIMS)]
    assert np.allclose(idf, model.idf, rtol=1e-12)
    asked = rows + [(-1, "", None), (-2, "123 !?", None), (-3, None, None), (-4, "Ж", None), (-5, "the and of " * 20_000, None)]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model).collect()}
    centroids = [list(map(float, c)) for c in model.centroids]
    for i, text, _ in asked:
        if text is None or not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        weights = {d: math.log1p(n) * idf[d] for d, n in plain_buckets(text).items()}
        length = math.sqrt(sum(w * w for w in weights.values()))
        cosines = [sum(w * c[d] for d, w in weights.items()) / length for c in centroids]
        best = max(cosines)
        near = {model.languages[k] for k, c in enumerate(cosines) if c > best - 1e-5}
        assert got[i].lang_pred in near and abs(got[i].score - min(1, max(0, best))) < 1e-5
        edge = model.limits[cosines.index(best)]
        assert abs(1 - best - edge) < 1e-5 or got[i].rejected == (1 - best > edge)
