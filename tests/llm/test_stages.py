"""Every stage of corpus_pipeline against a brute-force version, on rows with copies, null ids, one id twice and repeated rows."""

import os
import re
import time
import tracemalloc
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from siftspark.llm import jaccard, resampling, substrings, textbytes
from siftspark.llm.difference_cover import anchors_of, unpacked
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string"
GOOD = "quality = 1 and toxic = 0"


def prose(seed, n, words=4_000):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, words, n))


def lone(texts):
    """(id, text, lang, source) of texts, with ids in order."""
    return [(i, t, "en", "s") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    base = [prose(s, 120 + 7 * s) for s in range(24)]
    near = [" ".join([*b.split(" ")[:60], "changed", *b.split(" ")[61:]]) for b in base[:6]]
    shared = prose(99, 70, 10**6)
    passages = [f"{prose(200 + s, 40)} {shared} {prose(300 + s, 40)}" for s in range(5)]
    junk = [" ".join(f"{w}###" for w in prose(500 + s, 60).split()) for s in range(8)]
    out = lone([*base, *near, *passages, *junk, "", None, " \n", "a b", "A  B", base[3].replace(" ", "\t "), base[4]])
    n = len(out)
    out += [(None, base[5], "en", "s"), (None, base[5], "en", "s"), (None, junk[0], "en", "s"), (None, near[1] + " tail", "en", "s"), (None, prose(901, 90), None, None)]
    out += [(n, prose(902, 90), "de", "t"), (n, base[7] + " end", "de", "t"), (n + 1, prose(903, 200), "de", "t"), (n + 1, prose(903, 200), "de", "t"), (n + 2, base[8], "fr", None), (n + 2, base[9], "fr", None)]
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    bad = {r[0] for r in rows if r[1] and "###" in r[1]}
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(0, 40)], "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    return path


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "clash") for i, t, lang, s in rows], SCHEMA)


def shown(df):
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect())


def late(key):
    return (key is None, key or 0)


def exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r)
    return [min(g, key=lambda r: late(r[0])) for g in groups.values()]


def shingled(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def classes(rows, n, percent):
    """For each row the numbers of the rows it is connected with."""
    sets, of = [shingled(r[1], n) for r in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and of[i] != of[j] and 100 * len(a & b) >= percent * len(a | b):
                of = [of[j] if x == of[i] else x for x in of]
    return of


def cut(rows, length=200):
    bodies = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for r, b in zip(rows, bodies):
        keep = np.ones(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                keep[k : k + length] = False
        out.append((r[0], np.frombuffer(b, np.uint8)[keep].tobytes().decode("utf-8", "ignore"), *r[2:]))
    return out


def features(text):
    """Buckets of a text's n-grams, token by token."""
    found = re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\x20\x09-\x0D]+", (text or "").encode())
    of = lambda b: textbytes.slice_hashes(textbytes.prefix_hashes(x := np.frombuffer(b, np.uint8)), np.array([0]), np.array([len(x)]))
    one = [of(re.sub(rb"[A-Z]", lambda m: m[0].lower(), b)) for b in found]
    two = [textbytes.mix(a * textbytes.MULTIPLIER + b) for a, b in zip(one, one[1:])]
    return [int(x[0] & np.uint64(resampling.BUCKETS - 1)) for x in (*one, *two)]


def test_resampling_by_brute_force(spark, rows, folder):
    """Count tables, weights, k and the draw, from the texts; repeated rows have equal keys, and all rows with the k-th key are drawn."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    role = {r["doc_id"]: r["role"] for r in resampling.labelled(labels, F.expr(GOOD)).collect()}
    assert set(role) == {r["doc_id"] for r in labels.filter(F.expr(GOOD)).collect()} and set(role.values()) == {0, 1}
    found = {r: features(r[1]) for r in set(rows)}
    target, every = np.zeros(resampling.BUCKETS), np.zeros(resampling.BUCKETS)
    for r in rows:
        np.add.at(every, found[r], 1)
        if role.get(r[0]) == 0:
            np.add.at(target, found[r], 1)
    ratio = np.log((target + 1) / (target.sum() + len(target))) - np.log((every + 1) / (every.sum() + len(every)))
    want = Counter((r[0], len(found[r]), round(ratio[found[r]].sum(), 6)) for r in rows)
    got = resampling.resample(frame(spark, rows), labels, F.expr(GOOD)).collect()
    assert Counter((r["doc_id"], r["n_features"], round(r["log_weight"], 6)) for r in got) == want
    mean = lambda r: ratio[found[r]].sum() / max(1, len(found[r]))
    least = np.quantile([mean(r) for r in rows if role.get(r[0]) == 1], resampling.MISS)
    k = sum(mean(r) >= least - 1e-12 for r in rows)
    last = sorted((r["key"] for r in got), reverse=True)[k - 1]
    assert all(r["kept"] == (r["key"] >= last) for r in got) and sum(r["kept"] for r in got) >= k
    keys = defaultdict(set)
    for r in got:
        keys[r["doc_id"], r["row"]].add(r["key"])
    assert all(len(x) == 1 for x in keys.values())


def test_quality(spark, rows, folder):
    docs = frame(spark, rows)
    scored = resampling.resample(docs, spark.read.parquet(f"{folder}/labels.parquet"), F.expr(GOOD))
    kept = {(r["doc_id"], r["row"]) for r in scored.filter("kept").collect()}
    marked = docs.withColumn("row", F.xxhash64("doc_id", "text")).collect()
    want = Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in marked if (r["doc_id"], r["row"]) in kept)
    assert shown(corpus_pipeline.quality(spark, docs, folder)) == want and sum(want.values()) < len(rows)
    assert not any("###" in (t or "") for _, t, _, _ in want)


def test_exact(spark, rows, folder):
    got = shown(corpus_pipeline.exact(spark, frame(spark, rows), folder))
    key = lambda rows: Counter((r[0], re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")) for r in rows)
    assert key(got.elements()) == key(exact(rows))


def test_near(spark, rows, folder):
    of, place = classes(rows, 5, 80), lambda r: late(r[0])
    got = shown(corpus_pipeline.near(spark, frame(spark, rows), folder))
    for c in set(of):
        group = [r for r, x in zip(rows, of) if x == c]
        left = [r for r in set(group) for _ in range(got[r])]
        if not shingled(group[0][1], 5):
            assert len(left) == len(group)
        else:  # one row, or a repeated row as often as it is there, and it is among those that come first
            assert len(set(left)) == 1 and len(left) == group.count(left[0]) and place(left[0]) == min(map(place, group))
    assert sum(got.values()) == sum(got[r] for r in set(rows))


def test_passages(spark, rows, folder):
    assert shown(corpus_pipeline.passages(spark, frame(spark, rows), folder)) == Counter(cut(rows))


def test_packed(spark, rows, folder):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.packed(spark, frame(spark, rows), folder).collect()
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == Counter((r[0], size(r[1])) for r in rows)
    assert sum(r["length"] for r in got) == sum(size(r[1]) for r in rows)


def test_run(spark, rows, folder):
    """All stages one after another: brute force from what the first stage keeps."""
    kept = list(shown(corpus_pipeline.quality(spark, frame(spark, rows), folder)).elements())
    kept = exact(kept)
    of = classes(kept, 5, 80)
    kept = [r for i, r in enumerate(kept) if not shingled(r[1], 5) or r == min((x for x, c in zip(kept, of) if c == of[i]), key=lambda r: late(r[0]))]
    kept = cut(kept)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == Counter((r[0], len(library.encode(r[1], add_special_tokens=False).ids) + 1) for r in kept)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_empty_tables(spark, folder, name, stage):
    assert stage(spark, frame(spark, []), folder).count() == 0


def test_jaccard_clusters(spark):
    """Clusters of 2, of 300 and of some thousand sets, of which each links with the next but not with all, against a sweep over neighbours."""
    rng = np.random.default_rng(8)
    texts, want = [], []
    for size, words in ((2, 100), (300, 120), (2_000, 40)):
        w = [f"c{size}x{k}" for k in range(words)]
        for i in range(size):
            if i:
                w[int(rng.integers(0, words))] = f"c{size}n{i}"
            texts.append(" ".join(w))
    sets = [shingled(t, 3) for t in texts]
    index, of = defaultdict(list), list(range(len(sets)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in index[x]).items():
            if 100 * both >= 90 * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                of[b] = a
        for x in s:
            index[x].append(i)
    want = [root(i) for i in range(len(sets))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(frame(spark, lone(texts)), 3, 90).collect()}
    assert [got[i] for i in range(len(sets))] == want


def test_anchors_do_not_depend_on_what_stands_around():
    rng = np.random.default_rng(3)
    inner = rng.integers(97, 101, 400).astype(np.uint8)
    seen = []
    for front, back in ((0, 0), (13, 50), (200, 300)):
        data = np.concatenate([rng.integers(97, 101, front).astype(np.uint8), inner, rng.integers(97, 101, back).astype(np.uint8)])
        found = anchors_of(data, np.array([len(data)]), 200)
        of = {s: int(at) - s for at, a, b in found for s in range(a, b + 1)}
        assert sorted(of) == list(range(len(data) - 199)) and all(0 <= d < 64 for d in of.values())
        seen.append([of[front + s] for s in range(201)])
    assert seen[0] == seen[1] == seen[2]


def test_samples_and_pieces_in_blocks(monkeypatch):
    """Blocks of any size cover the same windows, with the same samples."""
    rng = np.random.default_rng(9)
    data = rng.integers(97, 105, 3_000).astype(np.uint8)
    ends = np.array([0, 700, 850, 850, 3_000])
    per = lambda found: {w: h for a, b, h in found.tolist() for w in range(a, b + 1)}
    whole = per(substrings.samples(data, ends, 200))
    assert set(whole) == {w for a, b in zip([0, *ends], ends) for w in range(a, b - 199)}
    for size in (1, 64, 333):
        monkeypatch.setattr(substrings, "BLOCK", size)
        assert per(substrings.samples(data, ends, 200)) == whole
        begin, end = substrings.pieces(np.array([0, 850]), np.array([700, 3_000]), 200)
        assert sorted(w for a, b in zip(begin, end) for w in range(a, b - 199)) == [*range(501), *range(850, 2_801)]


def test_workers_hand_back_what_they_freed(spark):
    """A worker that has freed 96 MB below an object that stays kept them for good."""

    def worker(free):
        def run(batches):
            rows = sum(b.num_rows for b in batches)
            if rows and not free:
                found = [np.ones(12_000) for _ in range(1_000)]
                textbytes.kept = found[-1]
                del found
            if rows:
                held = sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
                time.sleep(0.5)  # so that every task has a worker of its own
                yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "marked": [hasattr(textbytes, "kept")], "mb": [held]})

        return {r["pid"]: r["mb"] for r in spark.range(0, 4, 1, 4).mapInArrow(run, "pid long, marked boolean, mb double").collect() if r["marked"]}

    begun, then = worker(False), worker(True)
    both = begun.keys() & then.keys()
    assert both and all(then[pid] < begun[pid] - 60 for pid in both)


def test_dealing_holds_few_copies_of_shingles():
    """A million shingles of a place took 95 bytes each beside the sets."""
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)) for _ in range(20)]
    sets += [np.unique(np.concatenate([sets[0][:10], s[20 + j : 25 + j]])) for s in sets for j in range(4)]
    tracemalloc.start()
    got = jaccard.asked(0, sets, 48)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * sum(map(len, sets))
    want = Counter(int(x) >> 64 - jaccard.BITS for s in sets for x in s)
    found = Counter()
    for blob in got.column(2).drop_null().to_pylist():
        key, owner, many = unpacked(blob, 3).T
        for x, o, m in zip(np.cumsum(key).tolist(), owner.tolist(), many.tolist()):
            found[x] += m
            assert (o < 0) == (want[x] >= jaccard.COMMON) and (m == want[x] if o < 0 else m == 1)
    assert found == want and max(want.values()) >= jaccard.COMMON
