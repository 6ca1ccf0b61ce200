import os
import random
import shutil

import numpy as np
import pytest

from tidewatch.llm import countmin, jaccard_join, lm_score, shared, substring_dedup


@pytest.fixture
def docs(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"w{rng.randint(0, 300)}" for _ in range(60)) + (" " + passage if i % 9 == 0 else "")) for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def gone(folder, name):
    os.remove(f"{shared.local(folder)}/{name}")
    shared._held.clear()


def test_missing_and_short_files_are_errors(tmp_path):
    path = f"file:{tmp_path}/a"
    shared.write_array(path, np.arange(5))
    assert shared.read_array(path, np.int64).tolist() == [0, 1, 2, 3, 4]
    shared.write_array(f"{path}-none", np.zeros(0, np.int64))
    assert len(shared.read_array(f"{path}-none", np.int64)) == 0
    with open(f"{tmp_path}/a", "r+b") as file:
        file.truncate(30)
    with pytest.raises(OSError, match="cut short"):
        shared.read_array(path, np.int64)
    with pytest.raises(FileNotFoundError):
        shared.read_array(f"{path}-other", np.int64)
    with pytest.raises(ValueError, match="no scheme"):
        shared.read_array(f"{tmp_path}/a", np.int64)


def test_folder_is_qualified_by_the_default_file_system(spark, monkeypatch):
    assert shared.array_folder(spark, "x").startswith("file:/")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    monkeypatch.setattr(shared, "fresh_folder", lambda spark, name: f"/ckpt/{name}")
    try:
        conf.set("fs.viewfs.mounttable.cluster.link./ckpt", "file:///tmp")
        conf.set("fs.defaultFS", "viewfs://cluster/")
        with pytest.raises(ValueError, match="viewfs://cluster/ckpt"):
            shared.array_folder(spark, "x")
    finally:
        conf.set("fs.defaultFS", before)


def test_worker_keeps_a_bounded_number(tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "KEPT_MAPS", 3)
    shared._held.clear()
    for i in range(10):
        shared.write_array(f"file:{tmp_path}/{i}", np.full(3, i))
        assert shared.array(f"file:{tmp_path}/{i}", np.int64).tolist() == [i] * 3
    assert len(shared._held) == 3


@pytest.mark.parametrize("name", ["0-a", "sketch"])
def test_lost_window_range_or_sketch_chunk_fails(spark, docs, name):
    found = substring_dedup.repeated_windows(docs, 35)
    parts = docs.toArrow().combine_chunks().to_batches()
    from tidewatch.llm import words
    marks = lambda: sum(found.covered(p).sum() for b in parts for p in words.slices(b, "text", lower=False))
    assert marks() == 14 * 40
    for r in range(1 << (64 - found.shift)):
        gone(found.folder, f"{r}-a") if name == "0-a" else None
    if name == "sketch":
        gone(found.sketch.folder, "0-0")
    with pytest.raises(FileNotFoundError):
        marks()


def test_lost_model_array_fails(spark, docs, tmp_path):
    model = lm_score.train(docs)
    shutil.copytree(shared.local(model.folder), tmp_path / "model")  # a folder that no worker has mapped yet
    model.folder = f"file:{tmp_path}/model"
    for r in range(1 << (64 - model.shift)):
        gone(model.folder, f"word-hash-{r}")
    with pytest.raises(Exception, match="FileNotFoundError"):
        lm_score.score(docs, model).collect()


def test_small_chunks_and_ranges_give_equal_results(spark, docs, monkeypatch):
    def results():
        cleaned = sorted(map(tuple, substring_dedup.remove_repeated(docs, 10).collect()))
        scored = sorted(map(tuple, lm_score.score(docs, lm_score.train(docs, order=3)).collect()))
        linked = sorted(map(tuple, jaccard_join.near_duplicates(docs, 3, 60).select("doc_id", "n_shingles", "component_id").collect()))
        return cleaned, scored, linked
    whole = results()
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 40)
    monkeypatch.setattr(countmin, "CHUNK_BITS", 9)
    monkeypatch.setattr(substring_dedup, "FLUSH_WINDOWS", 50)
    monkeypatch.setattr(lm_score, "RANGE_WORDS", 100)
    assert countmin.range_bits(docs, "text", 40) > 7 and countmin.width_bits(docs) > 11
    cut = results()
    assert cut[0] == whole[0] and cut[2] == whole[2]
    assert [r[:3] for r in cut[1]] == [r[:3] for r in whole[1]]
    assert np.allclose([r[3:] for r in cut[1]], [r[3:] for r in whole[1]], rtol=1e-12)
