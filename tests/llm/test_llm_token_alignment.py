import collections
import hashlib
import json
import random
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import perfect_hash, token_alignment as ta


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(ta.BYTE_BPE)
    a.encode_special_tokens = True
    with open(ta.BYTE_BPE, encoding="utf-8") as file:
        names = {i: t for t, i in json.load(file)["model"]["vocab"].items()}
    return a, names, sentencepiece.SentencePieceProcessor(model_file=ta.PIECES)


def spans(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(rows, tokenizers):
    """Every pair of tokens of a text compared."""
    a, names, b = tokenizers
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in plain}
    letters |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}

    def piece(i):
        text = b.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", text) else text.replace("▁", " ").encode()
    per, counts = [], collections.Counter()
    for key, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xs, ys = [bytes(letters[c] for c in names[i]) for i in x], [piece(i) for i in y]
        if not text or b"".join(xs) != (" " + text).encode() or b"".join(ys) != (" " + text).encode():
            x, y, xs, ys = [], [], [], []
        sx, sy = spans(xs), spans(ys)
        links = [(x[i], y[j]) for i, (p, q) in enumerate(sx) for j, (r, s) in enumerate(sy) if max(p, r) < min(q, s)]
        counts.update(links)
        cuts = sorted({q for _, q in sx} & {s for _, s in sy})
        groups, low = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, (p, _) in zip(x, sx) if low <= p < cut) + "|" + ",".join(str(i) for i, (p, _) in zip(y, sy) if low <= p < cut))
            low = cut
        per.append((key, x, y, groups, links))
    best = collections.defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return counts, sorted(((key, len(x), len(y), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
                            hashlib.sha256(";".join(groups).encode()).hexdigest() if x else "") for key, x, y, groups, links in per), key=str)


TEXTS = [None, "", " ", "\n", "a", "Hello, world!", "  two  spaces ", "tab\tand\r\nline", "naïve café – 10 €", "日本語のテキスト", "🙂🙂 emoji", "é combining",
         "<|endoftext|> and <s> </s> <unk>", "▁ is a mark", "<0x41> as text", "x" * 3000, "the the the the", "the the the the", "\x00 zero", "ﬁ ligature"]


def test_faster_encoder_gives_the_same_ids(tokenizers):
    two, rng = ta.Tokenizers.read(), random.Random(1)
    letters = [chr(i) for i in range(1, 127)] + list("éèüßñ漢字🙂\u200d\u0301\u00a0\u2028") + ["'"] * 9 + [" "] * 20
    texts = [" " + "".join(rng.choice(letters) for _ in range(rng.randint(1, 50))) for _ in range(5000)]
    texts += [" " + "".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(20)) for _ in range(5000)]
    texts += [" " * 3_000_000, " a" + "\n" * 2_000_000 + "b", " " + "x" * 500_000]
    assert two._a_ranks is not None
    for text in texts:
        assert two.encode_a(text).tolist() == tokenizers[0].encode(text, add_special_tokens=False).ids
    other = json.loads(two.a_json)
    other["model"]["merges"][:2] = other["model"]["merges"][1::-1]
    assert ta.Tokenizers(json.dumps(other), two.b_model)._a_ranks is None


def run(spark, rows, tmp_path, monkeypatch, **small):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "a", "b", "n_a", "key", "part"):
        docs = docs.withColumn(c, F.lit("x"))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, ta.op12_token_alignment(spark, str(tmp_path)).collect()), key=str)


def test_equals_all_pairs_compared(spark, tokenizers, tmp_path, monkeypatch):
    rows = list(enumerate(TEXTS)) + [(None, "the same id"), (5, "again 5"), (5, "again 5")]
    counts, want = brute(rows, tokenizers)
    assert run(spark, rows, tmp_path, monkeypatch) == want
    docs = spark.createDataFrame(rows, "k long, text string").repartition(5)
    out, found = ta.align(docs, id_col="k", part_keys=16)  # many parts
    assert len(found.hashed.sizes) >= 8
    assert {(r.a_id, r.b_id): r.n for r in found.table(spark).collect()} == dict(counts)
    assert sorted((r.k, r.n_links, r.count_sum) for r in out.where("k IS NOT NULL").collect()) == sorted((w[0], w[4], w[6]) for w in want if w[0] is not None)
    assert found.counts(np.array([0, 10 ** 9], dtype=np.int64)).tolist()[1] == 0


def test_whole_table(spark, tokenizers):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 1500")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    out, _ = ta.align(docs)
    got = out.withColumn("groups", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, tokenizers)[1]


def test_very_long_text_and_small_pieces(spark, tmp_path):
    text = "a long text, " * 60_000
    out, found = ta.align(spark.createDataFrame([(1, text), (2, "a long text, ")], "doc_id long, text string"))
    one, two = sorted(out.collect())
    assert one.n_links == one.n_a + one.n_b - one.n_groups and one.n_links > 40_000 * two.n_links
    assert found.table(spark).agg(F.sum("n")).first()[0] == one.n_links + two.n_links


def test_empty_table_and_texts_without_tokens(spark):
    out, found = ta.align(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and found.table(spark).count() == 0
    out, _ = ta.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert [tuple(r)[1:] for r in out.collect()] == [(0,) * 6 + ("",)] * 2


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_numbers_each_key_once(n):
    keys = np.random.default_rng(n).choice(10 ** 9, n, replace=False).astype(np.int64)
    sizes, bits, before, own = perfect_hash.build_part(keys)
    at = perfect_hash.look_up(keys, sizes, bits, before)
    assert sorted(at.tolist()) == list(range(n)) and (own[at] == keys).all()
    assert len(bits) * 64 <= 5 * n + 1000


def test_perfect_hash_tells_other_keys(spark):
    keys = spark.range(0, 3000, 3)
    hashed = perfect_hash.build(keys, 1000, part_keys=100)
    asked = np.arange(3000)
    found = np.zeros(3000, dtype=bool)
    for part, some, at in hashed.spans(asked):
        found[some] = at >= 0
        assert len(set(at[at >= 0].tolist())) == hashed.sizes[part]
    assert (found == (asked % 3 == 0)).all()
