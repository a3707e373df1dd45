"""The training-data operators against brute force, on small tables with edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from siftspark.llm import exact_dedup, jaccard, license_scan, outlier_rules, packing, perspectives, resampling, substrings, tokens, url_filter
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int, host string"
ODD = ["", None, " \n\t ", "a", "A  b\nc", "Ünïcode ß Straße 日本語 \U0001f600 x", "<|endoftext|> a<|startoftext|>b 12 3x don't I'LL", "x" * 9_000, "tab\x0bform\x0cfeed\x1csep end"]


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, ["en", None, "de"][i % 3], "s", 0, "clash", 1, "h") for i, t in enumerate(texts)], SCHEMA)


def prose(seed, n, words=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, words, n))


@pytest.fixture(scope="module")
def corpus():
    base = [prose(s, 150, 5_000) for s in range(12)]
    near = [b.replace(b.split(" ")[70], "changed", 1) for b in base[:6]]
    shared = prose(99, 60, 10**6)
    passage = [f"{prose(200 + s, 30)} {shared} {prose(300 + s, 30)}" for s in range(6)]
    return [*ODD, *base, *near, *passage, base[0], base[0].replace(" ", "  "), *ODD[:4]]


def test_exact_dedup(spark, corpus):
    rows = {r["doc_id"]: r for r in exact_dedup.exact_groups(frame(spark, corpus)).collect()}
    key = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in corpus]
    for i, k in enumerate(key):
        same = [j for j, x in enumerate(key) if x == k]
        assert (rows[i]["keep_id"], rows[i]["group_size"], rows[i]["kept"]) == (same[0], len(same), i == same[0])
        assert rows[i]["text_sha256"] == hashlib.sha256(k.encode()).hexdigest()
    assert exact_dedup.exact_groups(frame(spark, corpus).limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a", 0), (1, "a", 0), (None, "a", 0)], "doc_id long, text string, kept int")
    assert exact_dedup.exact_groups(twice).filter("kept").count() == 1


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard(spark, corpus, n, percent):
    sets = []
    for t in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    rows = {r["doc_id"]: r for r in jaccard.jaccard_components(frame(spark, corpus), n, percent).collect()}
    assert [(rows[i]["n_shingles"], rows[i]["component_id"]) for i in range(len(sets))] == [(len(s), x) for s, x in zip(sets, label)]
    assert jaccard.jaccard_components(frame(spark, corpus).limit(0), n, percent).count() == 0


def test_jaccard_blocks(spark, monkeypatch):
    """Clusters of several blocks give the same components."""
    rng = np.random.default_rng(5)
    base = prose(1, 200, 10**6).split()
    texts = []
    for _ in range(60):
        w = list(base)
        for k in rng.integers(0, 200, rng.integers(0, 6)):
            w[k] = f"v{rng.integers(10**9)}"
        texts.append(" ".join(w))
    want = jaccard.jaccard_components(frame(spark, texts), 3, 90).collect()
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    assert sorted(jaccard.jaccard_components(frame(spark, texts), 3, 90).collect()) == sorted(want)


def hold(rows, texts):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in bodies for i in range(len(b) - 199))
    for i, b in enumerate(bodies):
        keep = np.ones(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                keep[k : k + 200] = False
        left = np.frombuffer(b, np.uint8)[keep].tobytes()
        spans = int((np.diff(np.concatenate([[0], ~keep]).astype(int)) == 1).sum())
        assert (rows[i]["n_bytes"], rows[i]["n_removed"], rows[i]["n_spans"], rows[i]["kept_sha256"]) == (len(b), len(b) - len(left), spans, hashlib.sha256(left).hexdigest())


def test_substrings(spark, corpus):
    hold({r["doc_id"]: r for r in substrings.without_repeats(frame(spark, corpus), keep_text=True, carry=("lang",)).collect()}, corpus)
    assert substrings.without_repeats(frame(spark, corpus).limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "ab" * 200), (1, "ab" * 200), (None, None)], "doc_id long, text string")
    assert [r["n_removed"] for r in substrings.without_repeats(twice).orderBy("n_bytes").collect()] == [0, 400, 400]


def test_hot_samples(spark):
    """Samples that many texts of a worker share are settled there; the result is the same."""
    shared = prose(777, 60, 10**6)
    texts = [f"{prose(s, 40, 10**6)} {shared} {prose(50 + s, 40, 10**6)}" for s in range(20)]
    rows = {r["doc_id"]: r for r in substrings.without_repeats(frame(spark, texts)).collect()}
    assert all(r["n_removed"] >= len(shared) for r in rows.values())
    hold(rows, texts)


def test_bpe(spark, corpus):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*corpus, "aaaaaaaaa     z", "՘꟎9࢏"]
    rows = {r["doc_id"]: r for r in tokens.round_trip(frame(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = tokens.decode_documents(tokens.encode_documents(frame(spark, texts), path), path)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_packing(spark, corpus):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [*corpus, prose(1, 9_000), "A" * 50 + " É É don't <|ENDOFTEXT|> 'LL x1y22"]
    rows = packing.pack_documents(frame(spark, texts), path, keep_ids=True).cache()
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        parts = rows.filter(F.col("doc_id") == i).orderBy("start").collect()
        assert [x for p in parts for x in p["ids"]] == ids and all(p["doc_tokens"] == len(ids) for p in parts)
        assert all(p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for p in parts)
    for s in rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("x"), F.max("padded_length").alias("p")).collect():
        at = 0
        for o, n in s["x"]:
            assert o == at
            at += n
        assert at <= 4096 and s["p"] == (at if at & (at - 1) == 0 else 4096)
    assert packing.sequences(rows).agg(F.sum(F.size("ids"))).first()[0] == rows.agg(F.sum("length")).first()[0]
    assert packing.pack_documents(frame(spark, texts).limit(0), path).count() == 0


def test_resampling(spark):
    good = [prose(s, 60) for s in range(80)]
    junk = [" ".join(f"{w}###" for w in prose(s, 60).split()) for s in range(100, 120)]
    docs = frame(spark, [*good, *junk, "", None])
    labels = spark.createDataFrame([(i, 1 if i < 80 else 0) for i in range(0, 100, 2)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in resampling.resample(docs, labels, F.col("quality") == 1).collect()}
    # Twenty good rows fit the model, so weights are small against the noise of the draw.
    assert sum(rows[i]["kept"] for i in range(80)) >= 70 and not any(rows[i]["kept"] for i in range(80, 100))
    assert rows[100]["log_weight"] == 0
    half = resampling.resample(docs, labels, F.col("quality") == 1, share=0.5)
    assert half.filter("kept").count() == 51 and half.orderBy(F.desc("key")).limit(51).filter("not kept").count() == 0
    assert resampling.resample(docs, labels.limit(0), F.col("quality") == 1).filter("kept").count() == 102
    assert resampling.resample(docs.limit(0), labels, F.col("quality") == 1).count() == 0


def test_resampling_length(spark):
    """A few long good rows with many odd words, and so a low sum, don't let short bad rows in."""
    bad = lambda s, n: " ".join(f"{w}###" for w in prose(s, n).split())
    good = [prose(s, 300) for s in range(190)] + [f"{prose(s, 4_000)} {bad(s, 150)}" for s in range(190, 200)]
    docs = frame(spark, [*good, *[bad(s, 6) for s in range(300, 340)], *[bad(s, 300) for s in range(400, 440)]])
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in resampling.resample(docs, labels, F.col("quality") == 1).collect()}
    low = min(rows[i]["log_weight"] for i in range(190, 200))
    assert all(rows[i]["log_weight"] > low for i in range(200, 240))
    assert sum(r["kept"] for r in rows.values()) <= 202


def test_outliers(spark):
    texts = [prose(s, 80) for s in range(120)] + ["### $$$ %%% " * 40 + prose(s, 100) for s in range(6)] + ["same line here\n" * 30, "", None, "short"]
    docs = frame(spark, texts).withColumn("lang", F.lit("en"))
    rows = {r["doc_id"]: r for r in outlier_rules.outliers(docs).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (rows[i]["n_words"], rows[i]["word_chars"], rows[i]["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""))
        assert (rows[i]["n_dup_lines"], rows[i]["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert rows[i]["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert all(rows[i]["kept"] for i in range(120)) and not any(rows[i]["kept"] for i in range(120, len(texts)))
    assert outlier_rules.outliers(docs.limit(0)).count() == 0


def test_outliers_each_statistic(spark):
    """Repeated lines alone, and repeated words alone within the base rule, make an outlier."""
    unique = [f"u{10_000 + k}" for k in range(400)]
    lines = "\n".join(" ".join([*unique[6 * k : 6 * k + 6], "\nsame"]) for k in range(40))
    words = " ".join([*unique[:41], *unique[100:109], *unique[200:241], *unique[100:109]])
    docs = frame(spark, [*[prose(s, 80) for s in range(120)], lines, words]).withColumn("lang", F.lit("en"))
    rows = {r["doc_id"]: r for r in outlier_rules.outliers(docs).collect()}
    assert (rows[120]["n_dup_lines"], rows[120]["n_repeat_words"], rows[121]["n_repeat_words"]) == (39, 0, 18)
    assert [i for i in range(122) if not rows[i]["kept"]] == [120, 121] and not any(r["base_failed"] for r in rows.values())


def test_outliers_small_groups(spark):
    """A rare source beside a large one, and a rare language, are judged too."""
    bad = "### $$$ %%% " * 40
    texts = [prose(s, 80) for s in range(60)] + [prose(60, 80), f"{prose(61, 200)} {' '.join(f'#{k}' for k in range(150))}"] * 2
    rows = [(i, t, "en" if i < 62 else "xx", "big" if i < 60 else "rare") for i, t in enumerate(texts)] + [(64, bad, "xx", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    rows = {r["doc_id"]: r for r in outlier_rules.outliers(docs).collect()}
    assert [i for i in range(65) if not rows[i]["kept"]] == [61, 63, 64] and [i for i in rows if rows[i]["base_failed"]] == [64]
    assert all(r["distance"] is not None for r in rows.values())
    few = {r["doc_id"]: r["kept"] for r in outlier_rules.outliers(docs.filter("doc_id between 40 and 61")).collect()}
    assert [i for i in few if not few[i]] == [61]


def test_url_filter(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.b", "/x", "block")], "host string, path string, verdict string")
    urls = ["http://WWW.Example.net/en/1?q#f", "http://example.net", "ftp://notnet/", "http://x.net/en/", None, "no scheme/net/", "http://c.a.b/xyz/1", "http://a.b/X", "://net/", "http://net:80/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).orderBy("page_id").collect()]
    assert got == [
        ("www.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "", None, "allow"), ("notnet", "/", None, "allow"), ("x.net", "/en/", "net/", "block"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("c.a.b", "/xyz/1", "a.b/x", "block"), ("a.b", "/X", None, "allow"), ("net", "/", "net/", "block"), ("net:80", "/", None, "allow"),
    ]
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0 and url_filter.judge_urls(pages, rules.limit(0)).filter("verdict = 'allow'").count() == len(urls)


def test_license_scan(spark):
    texts = ["x. Released under the MIT License.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "All rights under some licence of mine!", "nothing", None, "Licensed under CC BY 4.0.\nUnknown license here."]
    rows = [(r["sentence_ids"], r["licenses"], r["status"]) for r in license_scan.scan_licenses(frame(spark, texts)).orderBy("doc_id").collect()]
    assert rows[0] == ("mit-ref", "MIT", "known") and rows[2] == ("unknown", "", "unknown") and rows[3] == rows[4] == ("", "", "none") and rows[5] == ("cc-by-4,unknown", "CC-BY-4.0", "partial")
    assert license_scan.scan_licenses(frame(spark, texts).limit(0)).count() == 0


MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program{}
"""
GPL3 = GPL.format(":", ",", 3, ".  If not, see <https://www.gnu.org/licenses/>.")
GPL2 = GPL.format(";", ";", 2, "; if not, write to the Free Software\nFoundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.")
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION).
"""
BSD3 = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def test_license_texts(spark):
    """The standard texts, wrapped, with a line end a sentence, and in one line."""
    want = {"MIT": MIT, "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL2, "BSD-2-Clause": BSD.format(""), "BSD-3-Clause": BSD.format(BSD3), "Apache-2.0": APACHE}
    texts = [f(t) for t in want.values() for f in (str, lambda t: re.sub(r"(?<!\n)\n(?!\n)", " ", t), lambda t: " ".join(t.split()).removeprefix("MIT License "), lambda t: "a heading\n" + t.replace("\n", "\r\n"))]
    rows = license_scan.scan_licenses(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r["licenses"], r["status"]) for r in rows] == [(name, "known") for name in want for _ in range(4)]


def test_perspectives(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 2, "bob", "yo"), (1, 3, "cy", None), (2, None, None, "?"), (None, 5, "ann", "é\U0001f600")], "conv_id long, turn long, role string, text string")
    rows = {(r["conv_id"], r["speaker"]): r for r in perspectives.rotate(turns).collect()}
    assert set(rows) == {(1, "ann"), (1, "bob"), (1, "cy"), (2, ""), (None, "ann")}
    bob = rows[1, "bob"]
    assert bob["text"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user name=cy\n<|im_end|>\n"
    assert [bob["text"][a:b] for a, b in bob["spans"]] == ["yo<|im_end|>"] and bob["n_target_chars"] == 12
    assert perspectives.rotate(turns.limit(0)).count() == 0


def test_perspectives_long(spark):
    """A dialogue of more than 1,000 turn numbers is rendered whole for everyone, its system turn too."""
    turns = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), *[(1, k, "bob", f"b{k}") for k in range(2, 2_500)]]
    rows = {r["speaker"]: r for r in perspectives.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert set(rows) == {"ann", "bob"} and {r["n_turns"] for r in rows.values()} == {2_500}
    ann, bob = rows["ann"], rows["bob"]
    assert ann["text"].startswith("<|im_start|>system\ns<|im_end|>\n<|im_start|>assistant\nhi") and ann["text"].endswith("<|im_start|>user name=bob\nb2499<|im_end|>\n")
    assert [bob["text"][a:b] for a, b in bob["spans"]] == [f"b{k}<|im_end|>" for k in range(2, 2_500)]


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 100
