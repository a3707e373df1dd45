import os
import sqlite3
import time
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from siftspark import providers
from siftspark.engine import Engine, Settings
from siftspark.functions import text
from siftspark.operators import catalog, content, match, semantic, stats
from siftspark.sources import extract
from siftspark.sources.walk import Walk, listed, roots_of

FILES = "id long, path string, name string, ext string, dir string, size long, mtime double, is_deleted int, last_seen_at double"


def files(spark, names):
    return spark.createDataFrame([(i, f"/d/{n}", n, os.path.splitext(n)[1], "/d", 1, float(i), 0, 0.0) for i, n in enumerate(names)], FILES)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_chunk_lengths(spark):
    for n, expected in ((0, 0), (800, 1), (801, 2), (1500, 2), (1501, 3)):
        assert len(one(spark, "a" * n, text.chunks)) == expected
    body = "".join(chr(97 + i % 26) for i in range(2345))
    parts = one(spark, f"　{body} ", text.chunks)
    assert parts[0] + "".join(p[100:] for p in parts[1:]) == body


def test_snippet_and_strip(spark):
    assert one(spark, "　a\nb　", text.snippet) == "a b"
    assert one(spark, "x" * 240, text.snippet) == "x" * 240
    assert one(spark, "x" * 241, text.snippet) == "x" * 240 + "…"


def test_matches_follow_a_trigram_table(spark):
    """Long keywords match as a stock SQLite trigram index does, short ones as LIKE does."""
    names = ["Àbc.txt", "àBC", "ΣΑΣ ς", "сЛОво", "a_b", "aXb", "İx", "straße", "é e", "フクスポ大会", "abc%d"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(name, tokenize='trigram')")
    con.executemany("INSERT INTO t(rowid, name) VALUES (?, ?)", list(enumerate(names)))
    table = files(spark, names).withColumn("path", F.col("name"))
    for keyword in ("ÀBC", "àbc", "σας", "СЛО", "a_b", "bc%", "traß", "スポ大"):
        want = {r[0] for r in con.execute("SELECT rowid FROM t WHERE name MATCH ?", (f'"{keyword}"',))}
        got = {r["id"] for r in table.filter(text.contains(F.col("name"), keyword)).collect()}
        assert got == want, keyword
    for keyword in ("É", "A_", "_", "e"):
        like = "%" + keyword.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        want = {r[0] for r in con.execute("SELECT rowid FROM t WHERE name LIKE ? ESCAPE '\\'", (like,))}
        assert {r["id"] for r in table.filter(text.contains(F.col("name"), keyword)).collect()} == want, keyword


def test_relaxation_is_for_keywords_only(spark):
    table = files(spark, ["alpha.txt", "alpha.md", "beta.md"])
    assert match.search_files(table, ["alpha"], [".pdf"]).count() == 2
    assert [r["name"] for r in match.search_files(table, ["alpha"], [".md"]).collect()] == ["alpha.md"]
    assert match.search_files(table, [" ", ""]).count() == 0
    assert match.search_files(table, ["alpha"], None, 0, now=1.0).count() == 1


def test_engine(spark):
    table = files(spark, ["cats.txt", "dogs.md", "birds.md"])
    body = spark.createDataFrame([(0, "cats purr loudly"), (1, "dogs bark"), (2, "birds sing")], "file_id long, text string")
    parts = content.chunked(body).withColumn("id", F.col("file_id"))
    parts = content.embedded(parts, providers.passages(providers.HashEmbedder)).withColumn("cluster_id", F.lit(None).cast("int"))
    engine = Engine(table, body.withColumn("error", F.lit(None).cast("string")), parts, settings=Settings.of({"min_score": -1.0, "other": 1}))
    found = engine.search("purr", 0.0, embedder=providers.HashEmbedder()).orderBy("rank").collect()
    assert [r["name"] for r in found][0] == "cats.txt" and len(found) == 3 and found[1]["semantic_score"] is not None
    assert engine.search_local(["bark"]).first()["matched_in_content"]
    assert engine.search("purr", 0.0, expander=lambda q: "broken").count() == 1
    assert engine.preview(1)["text"] == "dogs bark" and engine.preview(9) is None


def test_expansion():
    got = text.parse_expansion('```json\n{"keywords": [" a ", ""], "recency_days": true}\n```')
    assert got.keywords == ["a"] and got.recency_days == 1
    assert providers.expand("a　b\x1cc", lambda q: '{"recency_days": Infinity, "keywords": ["x"]}').keywords == ["a", "b", "c"]


def test_merge_is_idempotent_and_numbers_new_paths(spark):
    table = files(spark, ["a", "b"])
    seen = spark.createDataFrame([(f"/d/{n}", n, "", "/d", 9, 5.0, 7.0) for n in ("b", "z", "c")], "path string, name string, ext string, dir string, size long, mtime double, scan_started_at double")
    once = catalog.merged(table, seen, ["/d"], 7.0)
    rows = {r["path"]: r for r in once.collect()}
    assert {p: r["id"] for p, r in rows.items()} == {"/d/a": 0, "/d/b": 1, "/d/c": 2, "/d/z": 3}
    assert rows["/d/a"]["is_deleted"] == 1 and rows["/d/b"]["size"] == 9
    assert sorted(catalog.merged(once, seen, ["/d"], 7.0).collect()) == sorted(once.collect())
    sibling = catalog.merged(table.withColumn("path", F.concat(F.lit("/a/bc/"), "name")), seen.limit(0), ["/a/b"], 7.0)
    assert sibling.filter("is_deleted = 1").count() == 2


def test_walk(spark, tmp_path):
    for name in ("_x.txt", "empty.bin", ".hid", "skip.tmp", "Sub/y.md", "node_modules/z"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("" if "empty" in name else "t")
    (tmp_path / "link").symlink_to(tmp_path / "_x.txt")
    (tmp_path / "loop").symlink_to(tmp_path)
    spark.dataSource.register(Walk)
    import json

    rows = spark.read.format("walk").options(roots=json.dumps([str(tmp_path), "/nowhere"]), exclude_folders='["node_modules"]', exclude_extensions='[".tmp"]', started="3").load().collect()
    assert sorted(r["name"] for r in rows if not r["error"]) == ["_x.txt", "empty.bin", "y.md"]
    assert [r["path"] for r in rows if r["error"]] == ["/nowhere"]
    assert list(roots_of(False, [str(tmp_path), "/nowhere"])) == [(str(tmp_path), True), ("/nowhere", False)]


def test_extract(spark):
    data = [(1, ".txt", bytearray(b"\x93\xfa\x96\x7b")), (2, ".md", bytearray(b"a\r\nb")), (3, ".bin", bytearray(b"x")), (4, ".pdf", bytearray(b"no pdf"))]
    rows = {r["file_id"]: r for r in extract.extracted(spark.createDataFrame(data, "file_id long, ext string, data binary"), 1.0).collect()}
    assert rows[1]["text"] == "日本" and rows[2]["text"] == "a\nb" and rows[3]["text"] == "" and rows[4]["error"]


def test_semantic_edges(spark):
    chunks = spark.createDataFrame([(1, 0, 0, "x", [1.0, 0.0], 0), (2, 0, 1, "y", [1.0, 0.0], 5), (3, 1, 0, "z", [0.8, 0.6], None), (4, 2, 0, "w", [1.0], 0)], "id long, file_id long, chunk_index int, chunk_text string, embedding array<float>, cluster_id int")
    table = files(spark, ["a", "b", "c"])
    rows = {r["file_id"]: r for r in semantic.semantic_search(chunks, table, [1.0, 0.0], min_score=0.5).collect()}
    assert rows[0]["snippet"] == "x" and set(rows) == {0, 1}
    assert {r["file_id"] for r in semantic.semantic_search(chunks, table, [1.0, 0.0], min_score=0.5, clusters=[9]).collect()} == {1}
    assert semantic.dominant_dim(chunks) == 2
    centroids, placed = semantic.build(chunks, 2)
    assert placed.filter("cluster_id is null").count() == 1 and np.allclose([np.linalg.norm(c) for _, c in centroids], 1)
    assert semantic.choose_k(10) == 8 and semantic.choose_k(10**9) == 1024 and semantic.nprobe_for(64) == 8
    assert stats.due(0, None, 0) and not stats.due(5, 0.0, 10.0) and stats.scan_due(None, 10, 0, False)


def test_hybrid_full_bodies(spark, monkeypatch):
    """A document with a keyword only in its text is a keyword result."""
    from siftspark.plans import queries, tables

    bodies = tables.bodies
    monkeypatch.setattr(tables, "bodies", lambda spark, sf_dir: bodies(spark, sf_dir).withColumn("text", F.when(F.col("file_id") == 32, "see doc_12").otherwise(F.col("text"))))
    rows = {r["id"]: r for r in queries.QUERIES["hybrid_full"](spark, "/root/testdata/sf0.001").collect()}
    assert 12 in rows and rows[12]["matched_keywords"] == "doc_12"
    assert 32 in rows and rows[32]["matched_keywords"] == "doc_12"


def test_numbers_of_many_new_paths(spark):
    """Ids of 600,000 new paths are 1 to n in their order, and the same the second time, with all columns read."""
    seen = spark.range(600_000).select(
        F.concat(F.lit("/d/"), F.sha2(F.col("id").cast("string").cast("binary"), 224)).alias("path"), F.col("id").cast("string").alias("name"), F.lit(".x").alias("ext"), F.lit("/d").alias("dir"),
        F.col("id").alias("size"), F.col("id").cast("double").alias("mtime"), F.lit(7.0).alias("scan_started_at"),
    )
    sums = []
    for _ in range(2):
        rows = catalog.merged(files(spark, []), seen)
        one = rows.agg(F.count("id"), F.countDistinct("id"), F.min("id"), F.max("id"), F.bit_xor(F.xxhash64("id", "path", "name", "size", "mtime"))).first()
        assert tuple(one)[:4] == (600_000, 600_000, 1, 600_000)
        sums.append(one[4])
    assert sums[0] == sums[1]
    ordered = [r["path"] for r in rows.orderBy("id").limit(1_000).collect()]
    assert ordered == sorted(ordered)


def test_plain_extensions():
    fixed = ".txt .md .csv .json .xml .html .htm .log .ini .yaml .yml .py .js .ts .css .java .c .cpp .h .hpp .cs .go .rb .php .sh .bat .ps1 .sql .rtf"
    assert set(extract.PLAIN) == set(fixed.split()) and len(extract.PLAIN) == 29
    assert set(extract.extractable()) - set(extract.PLAIN) == {".pdf", ".docx", ".xlsx", ".pptx"}


def test_limits_of_time_hold(tmp_path):
    """A lister or a reader that hangs is left behind, and what comes after it is read."""
    began = time.time()
    rows = list(listed(str(tmp_path), set(), set(), 1.0, scan=lambda p: time.sleep(20) or [], seconds=0.5))
    assert len(rows) == 1 and "TimeoutError" in rows[0][-1]
    guard = extract.Guard()
    assert guard(lambda: time.sleep(20), 0.5) == ("", "timeout after 0.5 s")
    assert guard(lambda: "next", 5) == ("next", None)
    assert time.time() - began < 5


def test_documents_of_office_formats(monkeypatch):
    """Readers, with libraries that are stood in for: paragraphs before cells, cells of tables, values without empty ones."""
    cell = lambda t: SimpleNamespace(text=t)
    table = SimpleNamespace(rows=[SimpleNamespace(cells=[cell("c1"), cell("c2")])])
    shape = lambda **k: SimpleNamespace(**{"has_text_frame": False, "has_table": False} | k)
    paragraph = SimpleNamespace(runs=[SimpleNamespace(text="a"), SimpleNamespace(text="b")])
    stands = {
        "docx": SimpleNamespace(Document=lambda f: SimpleNamespace(paragraphs=[cell("p1"), cell("p2")], tables=[table])),
        "openpyxl": SimpleNamespace(load_workbook=lambda f, **k: SimpleNamespace(worksheets=[SimpleNamespace(values=[(1, None, "x"), (True, 2.5)])])),
        "pptx": SimpleNamespace(Presentation=lambda f: SimpleNamespace(slides=[SimpleNamespace(shapes=[shape(has_text_frame=True, text_frame=SimpleNamespace(paragraphs=[paragraph])), shape(has_table=True, table=table)])])),
        "pypdf": SimpleNamespace(PdfReader=lambda f: SimpleNamespace(is_encrypted=True, decrypt=lambda p: 0, pages=[])),
    }
    monkeypatch.setattr(extract.importlib, "import_module", lambda name: stands[name])
    got = {e: extract.text_of(b"", e) for e in (".docx", ".xlsx", ".pptx", ".pdf")}
    assert got == {".docx": ("p1\np2\nc1\nc2", None), ".xlsx": ("1\nx\nTrue\n2.5", None), ".pptx": ("ab\nc1\nc2", None), ".pdf": ("", "encrypted with a password")}


def test_published_versions(spark, tmp_path):
    """Readers see complete versions only; a version that broke off is passed over, and old ones are deleted."""
    base = f"file://{tmp_path}/t"
    assert catalog.current(spark, base) is None
    for n in range(1, 5):
        catalog.publish(spark.range(n), base)
        assert catalog.current(spark, base).count() == n
    assert sorted(os.listdir(tmp_path / "t")) == ["v-000000000003", "v-000000000004"]
    (tmp_path / "t" / "v-000000000005").mkdir()
    assert catalog.current(spark, base).count() == 4
    catalog.publish(spark.range(9), base)
    assert catalog.current(spark, base).count() == 9


def test_matches_by_brute_force(spark):
    """Names, paths and bodies with keywords of every kind, also empty, with the separator, and across name and path."""
    names = ["Alpha.txt", "beta.md", "b", "フクスポ.txt", "", "x.y"]
    bodies = ["no word", None, "ALPHA and ふくすぽ", "Ab", "", "txt/d/x"]
    table = files(spark, names)
    body = spark.createDataFrame(list(enumerate(bodies)), "file_id long, text string")
    words = ["alpha", "ab", "フクスポ", " ", "t/d", "x.y", "a\0b", "txt"]
    fold = lambda k, x: x.lower() if len(k) >= 3 else x.translate(str.maketrans(text.UPPER, text.LOWER))
    has = lambda k, x: x is not None and any(fold(v, v) in fold(v, x) for v in text.variants(k))
    want = {}
    for i, (n, b) in enumerate(zip(names, bodies)):
        named = [w for w in words if w.strip() and (has(w, n) or has(w, f"/d/{n}"))]
        inside = [w for w in words if w.strip() and has(w, b)]
        if named or inside:
            want[i] = (sorted({*named, *inside}), bool(named), bool(inside))
    got = {r["id"]: (r["matched_keywords"], r["matched_in_name"], r["matched_in_content"]) for r in match.matches(table, body, words).collect()}
    assert got == want
    assert {r["id"] for r in match.matches(table, None, words).collect()} == {i for i, w in want.items() if w[1]}
    assert match.matches(table, body, [""]).count() == 0


def test_many_keywords_in_turns(spark, monkeypatch):
    table = files(spark, ["a", "b", "c"])
    body = spark.createDataFrame([(0, "one TWO three"), (1, None), (2, "twofold")], "file_id long, text string")
    words = spark.createDataFrame([("two",), ("one",), (" ",), ("ee",), ("EE",), ("none",)], "keyword string")
    for size in (match.TURN_BYTES, 4):
        monkeypatch.setattr(match, "TURN_BYTES", size)
        assert {r["id"]: r["matched_keywords"] for r in match.match_many(table, body, words).collect()} == {0: ["EE", "ee", "one", "two"], 2: ["two"]}
    assert match.match_many(table, body, words.limit(0)).count() == 0


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(300, 8)).astype(np.float32)
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, embedding array<float>")
    centroids, placed = semantic.build(chunks)
    sample = semantic.sampled(chunks, 8)
    assert sample.shape == (300, 8)
    probes = semantic.probes_for(sample, np.array([c for _, c in centroids], np.float64))
    rows = {r["qid"]: r for r in semantic.nearest_of(placed, chunks.filter("id % 20 = 0"), centroids, probes, block=4).collect()}
    scores = data.astype(np.float64) @ data.astype(np.float64).T
    for i in range(0, 300, 20):
        assert [x["id"] for x in rows[i]["near"]] == np.argsort(-scores[i], kind="stable")[:10].tolist()
    assert np.mean([x["seen"] for r in rows.values() for x in r["near"]]) >= 0.85


def test_nearest_in_bounded_memory():
    """4,096 vectors against a batch of 10,000 rows and 40 probes took over 2 GB."""
    rng = np.random.default_rng(5)
    data, asked = rng.normal(size=(10_000, 8)).astype(np.float32), rng.normal(size=(4_096, 8))
    cluster = rng.integers(0, 300, 10_000).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.FixedSizeListArray.from_arrays(pa.array(data.ravel()), 8).cast(pa.list_(pa.float32())), pa.array(cluster)], ["id", "embedding", "cluster_id"])
    seen_in = np.concatenate([rng.random((4_096, 300)) < 40 / 300, np.zeros((4_096, 1), bool)], 1)
    tracemalloc.start()
    d, ids, seen = semantic.nearest_in(iter([batch]), asked, seen_in, np.arange(300), 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    scores = asked[:50] @ data.astype(np.float64).T
    assert (ids[:50] == np.argsort(-scores, 1, kind="stable")[:, :10]).all()
    assert (seen == seen_in[np.arange(4_096)[:, None], cluster[ids]]).all()


def test_nearest_of_equal_vectors(spark):
    """Of copies those with the least ids are the nearest, in whatever order they come; scanned counts rows of probed clusters."""
    rng = np.random.default_rng(6)
    data = np.repeat(rng.integers(-2, 3, size=(12, 4)), 25, 0).astype(np.float32)
    order = rng.permutation(len(data))
    chunks = spark.createDataFrame([(int(i), data[i].tolist(), int(i) % 3 if i % 7 else None) for i in order], "id long, embedding array<float>, cluster_id int")
    centroids = [(0, [1.0, 0, 0, 0]), (1, [0, 1.0, 0, 0]), (2, [-1.0, 0, 0, 0])]
    rows = {r["qid"]: r for r in semantic.nearest_of(chunks, chunks.filter("id % 20 = 0"), centroids, 2, block=8).collect()}
    scores = data.astype(np.float64) @ data.astype(np.float64).T
    assert set(rows) == set(range(0, 300, 20))
    for i, r in rows.items():
        want = np.argsort(-scores[i], kind="stable")[:10].tolist()
        probed = set(np.argsort(-(data[i] @ np.array([c for _, c in centroids]).T), kind="stable")[:2].tolist())
        assert [x["id"] for x in r["near"]] == want
        assert [x["seen"] for x in r["near"]] == [j % 7 > 0 and j % 3 in probed for j in want]
        assert abs(r["scanned"] - sum(j % 7 > 0 and j % 3 in probed for j in range(300)) / 300) < 1e-9
    assert semantic.nearest_of(chunks, chunks.limit(0), centroids, 2).count() == 0
