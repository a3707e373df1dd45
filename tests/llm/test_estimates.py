"""op6's estimate, distance and verdict against numpy; very long texts, ties and repeated rows of the other operators."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from siftspark.llm import exact_dedup, jaccard, license_scan, outlier_rules, packing, perspectives, resampling, substrings, tokens, url_filter
from tokenizers import Tokenizer


def prose(seed, n, words=4_000):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, words, n))


def statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    repeated = len({k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)})
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars = sum(map(len, w))
    share = lambda a, b: math.sqrt(a / max(b, 1))
    upper = sum(c.isupper() for c in text)
    x = [math.log(max(chars / max(len(w), 1), 1)), share(sum(c in "#*$%&|<>" for c in text), chars), share(len(lines) - len(set(lines)), len(lines)), share(repeated, len(w)), share(upper, chars)]
    return x, len(w) < 10 or 100 * repeated > 20 * len(w)


def squared(x, centre, cov):
    d = x - centre
    return np.einsum("ij,ij->i", d, np.linalg.solve(cov, d.T).T)


def estimate(x):
    """Centre and covariance: concentration from quartiles until the determinant stands still, then the reweighting step."""
    floor = np.diag(np.square(outlier_rules.FLOOR))
    at = lambda p: np.sort(x, 0)[math.ceil(p * len(x)) - 1]
    centre, cov, last = at(0.5), np.diag(((at(0.75) - at(0.25)) / 1.349) ** 2) + floor, None
    for _ in range(outlier_rules.STEPS):
        bins = np.floor(np.log(squared(x, centre, cov) + 1e-9) * outlier_rules.BINS)
        cut = min(b for b in bins if (bins <= b).sum() >= outlier_rules.H * len(x))
        near = x[bins <= cut]
        before = np.linalg.slogdet(cov)[1] / 2
        centre, cov = near.mean(0), np.cov(near.T, bias=True) * outlier_rules.FACTOR + floor
        if abs(np.linalg.slogdet(cov)[1] / 2 - before) <= 1e-9:
            break
    near = x[squared(x, centre, cov) <= outlier_rules.INNER]
    return near.mean(0), np.cov(near.T, bias=True) * outlier_rules.INNER_FACTOR + floor


def test_estimate_follows_numpy(spark):
    rng = np.random.default_rng(2)
    rows = []
    for lang, source, n in (("en", "a", 90), ("en", None, 70), ("en", "", 10), ("de", "b", 60), ("de", "c", 20), ("xx", None, 12), (None, "z", 55), ("xx", "y", 3)):
        for _ in range(n):
            words = [f"{'W' if rng.random() < 0.1 else 'w'}{rng.integers(10 ** rng.integers(2, 7))}" for _ in range(rng.integers(20, 120))]
            words += ["#"] * int(rng.integers(0, 40) * (rng.random() < 0.15))
            rows.append((len(rows), " ".join(words) + "\nsame line" * int(rng.integers(0, 12) * (rng.random() < 0.2)), lang, source))
    rows += [(len(rows), None, "en", "a"), (rows[0]), (len(rows) + 1, "", None, None)]
    found = [statistics(r[1] or "") for r in rows]
    x, failed = np.array([f[0] for f in found]), np.array([f[1] for f in found])
    group = np.array([f"{r[2] or ''}/{r[3] or ''}" for r in rows])
    lang = np.array([r[2] or "" for r in rows])
    want = {}
    for i, r in enumerate(rows):
        mine = ~failed & (group == group[i])
        if mine.sum() < outlier_rules.LEAST:
            mine = ~failed & (lang == lang[i])
        if mine.sum() < outlier_rules.LEAST:
            mine = ~failed
        d2 = squared(x[i : i + 1], *estimate(x[mine]))[0]
        want[r[0]] = (d2, bool(not failed[i] and d2 <= outlier_rules.CUTOFF))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("distance", F.lit("clash")).repartition(3)
    got = outlier_rules.outliers(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r["distance"] - want[r["doc_id"]][0]) <= 1e-6 * max(1, r["distance"]) and r["kept"] == want[r["doc_id"]][1], r
    assert 0 < sum(not k for _, k in want.values()) < len(rows) / 2


def test_very_long_texts(spark):
    """A text of some MB beside short ones, for every operator."""
    long = "\n".join(prose(s, 1_000, 10**6) for s in range(500))
    texts = [long, "short text of a few words", long[1_000_000:1_000_500], "x" * 3_000_000]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    by = lambda df, key="doc_id": {r[key]: r for r in df.collect()}
    rows = by(substrings.without_repeats(docs))
    assert (rows[2]["n_removed"], rows[1]["n_removed"], rows[0]["n_removed"], rows[3]["n_removed"]) == (500, 0, 500, 3_000_000)
    assert rows[0]["kept_sha256"] == hashlib.sha256((long[:1_000_000] + long[1_000_500:]).encode()).hexdigest()
    rows = by(jaccard.jaccard_components(docs, 3, 90))
    words = long.split()
    assert rows[0]["n_shingles"] == len({tuple(words[i : i + 3]) for i in range(len(words) - 2)}) and all(r["component_id"] == r["doc_id"] for r in rows.values())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {i: r["doc_tokens"] for i, r in by(packing.pack_documents(docs.filter("doc_id < 3"), public_tokenizers.path("word_bpe_49k.json"))).items()}
    assert sizes == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts[:3])}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = by(tokens.round_trip(docs.filter("doc_id < 3"), public_tokenizers.path("byte_bpe_50k.json")))
    assert all(rows[i]["ids_sha256"] == hashlib.sha256(np.array(library.encode(texts[i]).ids, "<u4").tobytes()).hexdigest() for i in rows)
    rows = by(outlier_rules.outliers(docs))
    assert rows[0]["n_words"] == 500_000 and rows[3]["word_chars"] == 3_000_000
    assert by(license_scan.scan_licenses(docs))[0]["status"] == "none"
    assert by(exact_dedup.exact_groups(docs))[3]["text_sha256"] == hashlib.sha256(texts[3].encode()).hexdigest()
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality long")
    assert by(resampling.resample(docs, labels, F.col("quality") == 1))[0]["n_features"] == 999_999
    turns = docs.select(F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.concat(F.lit("r"), "doc_id").alias("role"), "text")
    assert all(r["n_target_chars"] > 10 for r in perspectives.rotate(turns).collect())
    pages = spark.createDataFrame([(1, "http://a.net/" + "p/" * 100_000), (1, "http://a.net/" + "p/" * 100_000)], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    assert [r["verdict"] for r in url_filter.judge_urls(pages, rules).collect()] == ["block"] * 2


def test_exact_dedup_without_winners(spark):
    """Groups under the winners' bound take the ordinary shuffle; larger ones are settled where they lie."""
    texts = [f"text {i // 2}" for i in range(1_000)] + ["hot  text"] * 300 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs).collect()}
    assert all((rows[i]["keep_id"], rows[i]["group_size"], rows[i]["kept"]) == (i - i % 2, 2, i % 2 == 0) for i in range(1_000))
    assert all((rows[i]["keep_id"], rows[i]["group_size"], rows[i]["kept"]) == (1_000, 300, i == 1_000) for i in range(1_000, 1_300))
    assert (rows[1_300]["keep_id"], rows[1_301]["keep_id"]) == (1_300, 1_300)


def test_repeated_rows_and_null_ids(spark):
    """Rows with one id and text, and rows without id, of the operators that return a row each."""
    text = prose(1, 60)
    docs = spark.createDataFrame([(1, text, "clash")] * 2 + [(None, text, "clash"), (None, None, "clash"), (2, prose(2, 60), "clash")], "doc_id long, text string, tokens string")
    rows = jaccard.jaccard_components(docs, 3, 90).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in rows) == Counter({(1, 1): 2, (None, 1): 1, (None, None): 1, (2, 2): 1})
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = tokens.round_trip(docs, path).collect()
    assert Counter((r["doc_id"], r["n_tokens"] > 0) for r in rows) == Counter({(1, True): 2, (None, True): 1, (None, False): 1, (2, True): 1})
    assert tokens.round_trip(docs.limit(0), path).count() == 0
    rows = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter({1: 2, None: 2, 2: 1})
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 5
    rows = license_scan.scan_licenses(docs.withColumn("text", F.lit("Licensed under the Apache License, Version 2.0.\nLicensed under CC BY 4.0."))).collect()
    assert Counter((r["doc_id"], r["licenses"]) for r in rows) == Counter({(1, "Apache-2.0,CC-BY-4.0"): 2, (None, "Apache-2.0,CC-BY-4.0"): 2, (2, "Apache-2.0,CC-BY-4.0"): 1})


MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Copyright (c) 2004-2010 by Some Consortium, Inc.

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""


def test_more_license_texts(spark):
    """Expected results that don't come from the lists: notices with comment signs, with a copyright line, and rules in order."""
    mit = "MIT License\n\nCopyright (c) 2020 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    texts = [MPL, ISC, mit, "Licensed under the Mozilla Public License, version 2.0.", "Copyright 1999 Nobody. All rights reserved under a license of our own."]
    rows = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["licenses"], r["status"]) for r in rows] == [("MPL-2.0", "known"), ("ISC", "known"), ("MIT", "known"), ("MPL-2.0", "known"), ("", "unknown")]


def test_ties_of_url_rules(spark):
    """Equally long rules: the longer host, then block before allow; repeated urls and null ids are judged each."""
    rules = spark.createDataFrame([("a.bc", "/x", "allow"), ("a.bc", "/x", "block"), ("bc", "/x/yz", "allow"), ("", "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.bc/x/yz"), (1, "http://a.bc/x/yz"), (None, "http://a.bc/x"), (2, None)], "page_id long, url string")
    rows = Counter((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect())
    assert rows == Counter({(1, "bc/x/yz", "allow"): 2, (None, "a.bc/x", "block"): 1, (2, None, "allow"): 1})
