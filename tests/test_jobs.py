"""Scans, the content index, and what they keep."""

import csv
import io
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from siftspark import jobs, providers, schemas
from siftspark.engine import Engine
from siftspark.operators import semantic
from siftspark.sources import logs
from siftspark.store import Busy, Store, save_settings, settings_of


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/index")


@pytest.fixture
def disk(tmp_path):
    top = tmp_path / "disk"
    top.mkdir()
    for name, text in (("a.txt", "alpha cats"), ("b.md", "beta dogs " * 200), ("c.bin", "no text"), ("d.pdf", "not a pdf"), ("e.txt", "")):
        (top / name).write_text(text)
    return top


def rows(df, key):
    return {r[key]: r for r in df.collect()}


def test_scan_and_index(spark, store, disk):
    now = time.time() + 10
    report = jobs.scan(store, [str(disk)], now)
    assert report.finished and report.processed == 5 and report.counts["file_count"] == 5
    ids = {n: r["id"] for n, r in rows(store.read("files"), "name").items()}
    report = jobs.index_contents(store, now)
    assert (report.finished, report.processed, report.errors, report.embedded) == (True, 4, 1, 0)
    assert "d.pdf" in report.last_error and store.logged("content_errors").first()["kind"] == "extract"
    content = rows(store.read("content"), "file_id")
    assert content[ids["a.txt"]]["text"] == "alpha cats" and content[ids["d.pdf"]]["error"] and ids["c.bin"] not in content
    # With an embedder the kept texts are embedded; the failed file isn't tried again.
    os.remove(disk / "b.md")
    report = jobs.index_contents(store, now + 1, providers.HashEmbedder, size=2)
    assert (report.processed, report.errors, report.embedded) == (3, 0, 3)
    chunks = store.read("chunks")
    assert rows(chunks.groupBy("file_id").count(), "file_id")[ids["b.md"]]["count"] == 3
    assert chunks.count() == chunks.select("id").distinct().count() == 4
    assert jobs.index_contents(store, now + 2, providers.HashEmbedder).processed == 0
    # A changed file is read again and loses its old chunks; a file that is gone is marked.
    (disk / "a.txt").write_text("gamma")
    os.utime(disk / "a.txt", (now + 20, now + 20))
    assert jobs.scan(store, [str(disk)], now + 30).counts["file_count"] == 4
    files = rows(store.read("files"), "name")
    assert files["b.md"]["is_deleted"] == 1 and {n: r["id"] for n, r in files.items()} == ids
    assert jobs.index_contents(store, now + 40, providers.HashEmbedder).processed == 1
    assert [r["chunk_text"] for r in store.read("chunks").filter(F.col("file_id") == ids["a.txt"]).collect()] == ["gamma"]
    store.without_deleted(store.read("files").filter("is_deleted = 0"))
    assert store.read("chunks").filter(F.col("file_id") == ids["b.md"]).count() == 0
    engine = Engine(store.read("files"), store.read("content"), store.read("chunks"))
    assert [r["name"] for r in engine.search_local(["gamma"]).collect()] == ["a.txt"]


def test_cancelled_scan_marks_nothing(spark, store, disk):
    now = time.time()
    jobs.scan(store, [str(disk)], now)
    (disk / "new.txt").write_text("x")
    os.remove(disk / "a.txt")
    asked = iter([False, True, True])
    report = jobs.scan(store, [str(disk)], now + 1, cancelled=lambda: next(asked))
    files = rows(store.read("files"), "name")
    assert not report.finished and "new.txt" in files and files["a.txt"]["is_deleted"] == 0


def test_one_run_at_a_time(store, disk):
    now = time.time()
    with store.claim("scan", now):
        assert store.running("scan")
        with pytest.raises(Busy):
            jobs.scan(store, [str(disk)], now)
        assert jobs.scan_if_due(store, [str(disk)], now) is None
        with store.claim("scan", now + 100_000):  # the first has died
            pass
    assert not store.running("scan")
    assert jobs.scan_if_due(store, [str(disk)], now).finished
    assert jobs.scan_if_due(store, [str(disk)], now + 60) is None and jobs.scan_if_due(store, [str(disk)], now + 601).finished
    assert jobs.after_scan(store, now, True, None) is None
    jobs.index_contents(store, now)
    assert jobs.after_scan(store, now + 1, True, None).finished and jobs.after_scan(store, now, False, None) is None


def test_build_is_published_last(spark, store, monkeypatch):
    monkeypatch.setattr(semantic, "LEAST_CHUNKS", 100)
    rng = np.random.default_rng(1)
    data = rng.normal(size=(200, 8)).astype(np.float32)
    chunks = spark.createDataFrame([(i, i, 0, "t", v.tolist(), None) for i, v in enumerate(data)], schemas.CHUNKS)
    store.publish("chunks", chunks)
    assert jobs.published_centroids(store) is None
    assert not jobs.build_if_due(store, 1.0, cancelled=lambda: True) and store.read("chunks").filter("cluster_id is not null").count() == 0
    asked = iter([False, True])
    assert not jobs.build_if_due(store, 1.0, cancelled=lambda: next(asked)) and jobs.published_centroids(store) is None
    assert jobs.build_if_due(store, 2.0)
    centroids = jobs.published_centroids(store)
    assert len(centroids) == semantic.choose_k(200) and store.read("chunks").filter("cluster_id is null").count() == 0
    assert store.read("index_meta").first()["probes"] >= semantic.nprobe_for(len(centroids))
    assert not jobs.build_if_due(store, 3.0)
    assert semantic.load_centroids(store.read("centroids").filter("cluster_id > 0"), store.read("index_meta"), 8) is None


def test_preview(spark, disk):
    path = str(disk / "a.txt")
    at = os.path.getmtime(path)
    files = spark.createDataFrame([(1, path, "a.txt", ".txt", "", 1, at, 0, 0.0), (2, "/gone.txt", "gone.txt", ".txt", "", 1, at, 0, 0.0), (3, str(disk / "c.bin"), "c.bin", ".bin", "", 1, at, 0, 0.0), (4, path, "x", ".txt", "", 1, at, 1, 0.0)], schemas.FILES)
    held = lambda when: spark.createDataFrame([(1, "indexed", 7, when, 1, None, None)], schemas.CONTENT)
    assert Engine(files, held(at + 1)).preview(1)["source"] == "index"
    fresh = Engine(files, held(at - 1))
    assert (fresh.preview(1)["source"], fresh.preview(1)["text"]) == ("live", "alpha cats")
    assert [fresh.preview(i)["available"] for i in (2, 3)] == [False, False] and fresh.preview(4) is None


def test_pooling():
    def encode(texts, most):
        size = min(most, max(len(t.split()) for t in texts))
        mask = np.array([[int(k < len(t.split())) for k in range(size)] for t in texts])
        return np.array([[len(w) for w in (t.split() + [""] * size)[:size]] for t in texts]), mask

    seen = []

    def run(ids, mask):
        seen.append(ids.shape)
        return np.stack([ids, np.ones_like(ids), 7 * (1 - mask)], 2).astype(np.float32)

    texts = ["a bb", "ccc", *["w"] * 20, "x " * 600]
    got = providers.Pooled(encode, run)(texts)
    assert [s[0] for s in seen] == [16, 7] and seen[1][1] == 512
    assert np.allclose(got[0], np.array([1.5, 1, 0]) / np.hypot(1.5, 1)) and np.allclose(np.linalg.norm(got, axis=1), 1)


def test_logs_and_settings(spark, tmp_path):
    path = f"file://{tmp_path}/usage"
    for k in (2, 1):
        logs.append_usage(spark.createDataFrame([(f"2024-01-0{k} 10:00:00", 'a "q", b', 3, 4, k == 1)], "time string, query string, keyword_count int, hit_count int, opened boolean").withColumn("time", F.to_timestamp("time")), path)
    text = "".join(logs.usage_csv(spark, path))
    assert text.startswith("﻿") and text.count("﻿") == 1
    lines = list(csv.reader(io.StringIO(text.removeprefix("﻿"))))
    assert lines == [["検索日時", "入力クエリ", "展開語数", "ヒット件数", "開いたファイルの有無"], ["2024-01-01T10:00:00", 'a "q", b', "3", "4", "あり"], ["2024-01-02T10:00:00", 'a "q", b', "3", "4", "なし"]]
    where = f"file://{tmp_path}/config.json"
    assert settings_of(spark, where) == {}
    for raw in ({"scan": {"x": 1}}, {"scan": {"x": "é"}}):
        save_settings(spark, where, raw)
        assert settings_of(spark, where) == raw
    assert [n for n in os.listdir(tmp_path) if n.startswith("config.json-")] == []
