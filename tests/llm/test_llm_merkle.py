import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """Levels of a tree from its leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([H(*now[i:i + 16]) for i in range(0, len(now), 16)])
    return levels


def way(levels, i):
    """(left siblings, right siblings) of a leaf, level by level."""
    out = []
    for level in levels[:-1]:
        run = level[i // 16 * 16:i // 16 * 16 + 16]
        out.append(("".join(run[:i % 16]), "".join(run[i % 16 + 1:])))
        i //= 16
    return out


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in by_source[s]]) for s in names}
    whole = tree([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, r in enumerate(by_source[s]):
            path = way(trees[s], i) + way(whole, at)
            now = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                now = leaf((*r[:4], lower(r[4])))
            for left, right in path:
                now = H(left, now, right)
            out.append((r[0], leaf(r), trees[s][-1][0], whole[-1][0], H(*(x for p in path for x in p)), now, now == whole[-1][0]))
    return sorted(out, key=str)


def run(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for c in ("tree", "place", "digest", "path", "row.x", "n"):
        docs = docs.withColumn(c, F.lit("x"))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


def text(rng):
    return rng.choice([None, "", "ABC def", "é É", "x" * 200, "Zz\n"])


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1], [0]])
def test_small_tables(spark, tmp_path, sizes):
    rng = random.Random(1)
    rows = [(i + 100 * s, f"s{s}", "en", i, text(rng)) for s, n in enumerate(sizes) for i in range(n)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_several_rounds_hot_source_ties_and_nulls(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "hot", rng.choice(["en", None]), len(str(i)), text(rng)) for i in range(4_400)]
    for s, n in enumerate([1, 2, 15, 16, 17, 255, 256, 257, 272, 1, 1, 1, 1, 1, 1, 1, 1, 1]):
        rows += [(10_000 * (s + 1) + i, f"{'ÄZa'[s % 3]}{s}", "de", None, text(rng)) for i in range(n)]
    rows += [(5, "hot", "en", 1, "again"), (None, None, None, None, None), (None, "hot", "en", 3, "a"), (None, "hot", "en", 3, "B")]
    rows += [(7, "", "en", 1, "A")] * 20  # an empty name is not NULL; equal rows are leaves each
    got = run(spark, rows, tmp_path)
    assert got == brute(rows)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_very_long_text(spark, tmp_path):
    rows = [(i, "s", "en", 1, ("Ab é " * 400_000) if i == 2 else "x") for i in range(4)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_path_proves_a_row(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", f"t{i}") for i in range(60)], "k long, source string, text string")
    rows = merkle.manifest(docs, ["k", "text"], id_col="k").collect()
    for r in rows:
        now = r.leaf
        assert now == H(f"{len(str(r.k))}:{r.k}", f"{len(f't{r.k}')}:t{r.k}")
        for step in r.path:
            now = H(step.left, now, step.right)
        assert now == r.root == r.folded_root
