"""Registered queries of the search engine, each with its DuckDB SQL where SQL can tell it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark import schemas, shared
from siftspark.functions import text, vectors
from siftspark.operators import catalog, content, hybrid, match, semantic, stats
from siftspark.plans import tables
from siftspark.plans.tables import CHUNKS_SQL, CONTENT_SQL, EPOCH, FILES_SQL, NOW
from siftspark.sources import extract, logs
from siftspark.streaming import snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LONG_WORDS, SHORT_WORDS = ["DOC_12", "src7", "_3"], ["1.", "C1", "7"]
BODY_LONG, BODY_SHORT = ["Thinks", "THE EREA", "licen"], ["Wh", "ñ"]
MIXED = ["there", "doc_1", "ion", "Zu"]
KANA = ["ふくすぽ", "フクスポ", "ａｂｃ", "abc", "Éa", "a_"]
KANA_NAMES = ["フクスポ大会管理表.xlsx", "ふくすぽ.txt", "ＡＢＣ.md", "éa.txt", "aXb", "ﾌｸｽﾎﾟ.txt", "A_b"]
DAYS, MIN_SCORE = 20, 0.15


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def has_sql(x: str, keyword: str) -> str:
    out = []
    for v in text.variants(keyword):
        if len(v) >= text.LONG:
            out.append(f"contains(translate(lower({x}), 'ς', 'σ'), {q(v.lower().replace('ς', 'σ'))})")
        else:
            out.append(f"contains(translate({x}, '{text.UPPER}', '{text.LOWER}'), {q(v.translate(str.maketrans(text.UPPER, text.LOWER)))})")
    return "(" + " OR ".join(out) + ")"


def found_sql(words: list[str], body: bool) -> str:
    """CTE found: files, and body x.text if asked for, with kws (a sorted list), in_name, in_body."""
    name = {w: f"({has_sql('f.name', w)} OR {has_sql('f.path', w)})" for w in words}
    inside = {w: f"coalesce({has_sql('x.text', w)}, false)" if body else "false" for w in words}
    kws = ", ".join(f"CASE WHEN {name[w]} OR {inside[w]} THEN {q(w)} END" for w in sorted(words))
    join = " LEFT JOIN documents x ON x.doc_id = f.id" if body else ""
    return f"""found AS (SELECT * FROM (SELECT f.*, list_filter([{kws}], lambda k: k IS NOT NULL) AS kws, {" OR ".join(name.values())} AS in_name, {" OR ".join(inside.values())} AS in_body
  FROM files f{join} WHERE f.is_deleted = 0) WHERE len(kws) > 0)"""


def pass_sql(extensions: list[str] | None, days: int | None) -> str:
    parts = ["true"] + ([f"ext IN ({', '.join(map(q, extensions))})"] if extensions else []) + ([f"mtime >= {NOW - days * 86400}"] if days is not None else [])
    return " AND ".join(parts)


def ranked_sql(extensions: list[str] | None = None, days: int | None = None) -> str:
    return f"""p AS (SELECT *, {pass_sql(extensions, days)} AS ok FROM found),
ranked AS (SELECT *, row_number() OVER (ORDER BY len(kws) DESC, mtime DESC, id)::INTEGER AS rank FROM p WHERE ok OR NOT (SELECT coalesce(bool_or(ok), false) FROM p) ORDER BY rank LIMIT 50)"""


SHOWN = "SELECT id, path, ext, size, mtime, array_to_string(kws, ',') AS matched_keywords, in_name AS matched_in_name, in_body AS matched_in_content, rank FROM ranked"


def shown(df: DataFrame) -> DataFrame:
    return df.select("id", "path", "ext", "size", "mtime", F.array_join("matched_keywords", ",").alias("matched_keywords"), "matched_in_name", "matched_in_content", "rank")


def matched(df: DataFrame) -> DataFrame:
    return df.select("id", F.array_join("matched_keywords", ",").alias("matched_keywords"), "matched_in_name", "matched_in_content")


MATCHED = "SELECT id, array_to_string(kws, ',') AS matched_keywords, in_name AS matched_in_name, in_body AS matched_in_content FROM found"

for _name, _words in (("name_match_long", LONG_WORDS), ("name_match_short", SHORT_WORDS)):
    register(_name, f"WITH {FILES_SQL}, {found_sql(_words, False)} {MATCHED}")(lambda spark, d, w=_words: matched(match.matches(tables.files(spark, d), None, w)))
for _name, _words in (("content_match_long", BODY_LONG), ("content_match_short", BODY_SHORT)):
    register(_name, f"WITH {FILES_SQL}, {found_sql(_words, True)} {MATCHED}")(lambda spark, d, w=_words: matched(match.matches(tables.files(spark, d), tables.bodies(spark, d), w)))

_KANA_ROWS = ", ".join(f"({i}, {q(n)})" for i, n in enumerate(KANA_NAMES))


@register("keyword_variants_kana", f"WITH files AS (SELECT id, name, name AS path, 0 AS is_deleted FROM (VALUES {_KANA_ROWS}) v(id, name)), {found_sql(KANA, False)} SELECT id::BIGINT AS id, name, array_to_string(kws, ',') AS matched_keywords FROM found")
def keyword_variants_kana(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(KANA_NAMES)), "id long, name string").select("id", "name", F.col("name").alias("path"), F.lit(0).alias("is_deleted"))
    return match.matches(rows, None, KANA).select("id", "name", F.array_join("matched_keywords", ",").alias("matched_keywords"))


@register("content_match_many_keywords", f"""WITH {FILES_SQL}, words AS (SELECT DISTINCT trim(text, ' ' || chr(10)) AS keyword FROM benchmark)
SELECT f.id, string_agg(keyword, '|' ORDER BY keyword) AS matched_keywords FROM files f JOIN documents d ON d.doc_id = f.id JOIN words ON contains(translate(lower(d.text), 'ς', 'σ'), translate(lower(keyword), 'ς', 'σ'))
WHERE f.is_deleted = 0 GROUP BY f.id""")
def content_match_many_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tables.table(spark, sf_dir, "benchmark").select(F.col("text").alias("keyword"))
    found = match.match_many(tables.files(spark, sf_dir), tables.bodies(spark, sf_dir), words)
    return found.select("id", F.array_join("matched_keywords", "|").alias("matched_keywords"))


@register("search_files_by_name", f"WITH {FILES_SQL}, {found_sql(LONG_WORDS, False)}, {ranked_sql()} {SHOWN}")
def search_files_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(match.search_files(tables.files(spark, sf_dir), LONG_WORDS))


def _hybrid(words, extensions=None, days=None):
    return lambda spark, d: shown(hybrid.hybrid_search(tables.files(spark, d), tables.bodies(spark, d), words, extensions, days, NOW))


for _name, _ext, _days in (("hybrid_keyword_rank", None, None), ("filter_ext_recency", [".txt", ".pdf"], DAYS), ("filter_relaxation", [".none"], DAYS), ("filter_no_relaxation", [".md"], None)):
    register(_name, f"WITH {FILES_SQL}, {found_sql(MIXED, True)}, {ranked_sql(_ext, _days)} {SHOWN}")(_hybrid(MIXED, _ext, _days))

_DOT = "list_sum(list_transform(list_zip(c.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_Q = "q AS (SELECT embedding FROM embeddings WHERE vec_id = 0)"


def near_sql(exclude: str = "", clusters: str = "", limit: int = 10) -> str:
    return f"""scores AS (SELECT c.id, c.file_id, {_DOT} AS score FROM chunks c, q JOIN files f ON true WHERE f.id = c.file_id AND f.is_deleted = 0{clusters}),
best AS (SELECT file_id, max(score) AS score, arg_min(id, (-score, id)) AS chunk_id FROM scores WHERE score >= {MIN_SCORE} GROUP BY file_id),
near AS (SELECT b.file_id, b.score, replace(trim(k.chunk_text), chr(10), ' ') AS snippet FROM best b JOIN chunks k ON k.id = b.chunk_id{exclude} ORDER BY b.score DESC, b.file_id LIMIT {limit})"""


@register("semantic_topk_exact", f"WITH {FILES_SQL}, {CHUNKS_SQL}, {_Q}, {near_sql()} SELECT file_id, round(score, 6) AS semantic_score, snippet FROM near")
def semantic_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.semantic_search(tables.chunks(spark, sf_dir), tables.files(spark, sf_dir), tables.query_vector(spark, sf_dir), min_score=MIN_SCORE)


@register("semantic_exclusion", f"WITH {FILES_SQL}, {CHUNKS_SQL}, {_Q}, {found_sql(['doc_1'], False)}, {near_sql(' WHERE b.file_id NOT IN (SELECT id FROM found)')} SELECT file_id, round(score, 6) AS semantic_score, snippet FROM near")
def semantic_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.files(spark, sf_dir)
    return semantic.semantic_search(tables.chunks(spark, sf_dir), files, tables.query_vector(spark, sf_dir), match.matches(files, None, ["doc_1"]), min_score=MIN_SCORE)


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster_id, centroid): the normalised mean of each label."""
    parts = tables.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("v"))
    return mean.select(F.col("label").cast("int").alias("cluster_id"), vectors.unit(F.transform("v", lambda s: s["m"])).alias("centroid"))


def _centroids(spark: SparkSession, sf_dir: str) -> list[tuple[int, list[float]]]:
    return sorted((r["cluster_id"], list(r["centroid"])) for r in label_means(spark, sf_dir).collect())


_MEANS = """m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY label, i),
cent AS (SELECT label AS cluster_id, list(((x / n))::FLOAT ORDER BY i) AS centroid FROM m JOIN (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label) USING (label) GROUP BY label)"""
_CDOT = "list_sum(list_transform(list_zip(t.centroid, e.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@register("semantic_ivf_probe", f"""WITH {FILES_SQL}, {CHUNKS_SQL}, {_Q}, {_MEANS}, probed AS (SELECT t.cluster_id FROM cent t, q e ORDER BY {_CDOT} DESC, t.cluster_id LIMIT 4),
{near_sql(clusters=" AND (c.cluster_id IS NULL OR c.cluster_id IN (SELECT cluster_id FROM probed))")} SELECT file_id, round(score, 6) AS semantic_score, snippet FROM near""")
def semantic_ivf_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = tables.query_vector(spark, sf_dir)
    probed = semantic.top_clusters(_centroids(spark, sf_dir), query)
    return semantic.semantic_search(tables.chunks(spark, sf_dir), tables.files(spark, sf_dir), query, min_score=MIN_SCORE, clusters=probed)


@register("cluster_assign", f"WITH {_MEANS} SELECT e.vec_id AS id, arg_min(t.cluster_id, (-round({_CDOT}, 9), t.cluster_id))::INTEGER AS cluster_id FROM embeddings e, cent t GROUP BY e.vec_id")
def cluster_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.assigned(tables.chunks(spark, sf_dir), _centroids(spark, sf_dir)).select("id", "cluster_id")


@register("kmeans_build")
def kmeans_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroids, chunks = semantic.build(tables.chunks(spark, sf_dir))
    sizes = chunks.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("chunks"))
    return spark.createDataFrame(centroids, schemas.CENTROIDS).join(sizes, "cluster_id", "left").select("cluster_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.size("centroid").alias("dim"))


@register("ivf_recall")
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the ten nearest chunks of every twentieth chunk: the share that probing finds, and the share of rows scanned."""
    rows = tables.chunks(spark, sf_dir)
    centroids, chunks = semantic.build(rows)
    sample = semantic.sampled(rows, len(centroids[0][1]))
    probes = semantic.probes_for(sample, np.array([c for _, c in centroids], np.float64))
    per = semantic.nearest_of(chunks, rows.filter("id % 20 = 0"), centroids, probes)
    return per.agg(F.round(F.avg(F.size(F.filter("near", lambda x: x["seen"])) / F.size("near")), 6).alias("recall_at_10"), F.round(F.avg("scanned"), 6).alias("scanned_share"), F.first(F.lit(probes)).alias("probes"))


@register("hybrid_full", f"""WITH {FILES_SQL}, {CHUNKS_SQL}, {_Q}, {found_sql(['doc_12', 'doc_9', 'THE EREA'], True)}, {ranked_sql(['.txt', '.md', '.pdf'])}, {near_sql(' WHERE b.file_id NOT IN (SELECT id FROM found)')},
both_parts AS (SELECT id, path, kws, NULL::DOUBLE AS score, NULL AS snippet, 0 AS part, rank AS at_rank FROM ranked
  UNION ALL SELECT f.id, f.path, [], n.score, n.snippet, 1, NULL FROM near n JOIN files f ON f.id = n.file_id WHERE {pass_sql(['.txt', '.md', '.pdf'], None)})
SELECT id, path, array_to_string(kws, ',') AS matched_keywords, round(score, 6) AS semantic_score, snippet, row_number() OVER (ORDER BY part, at_rank, score DESC, id)::INTEGER AS rank FROM both_parts ORDER BY rank LIMIT 50""")
def hybrid_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hybrid.hybrid_search(tables.files(spark, sf_dir), tables.bodies(spark, sf_dir), ["doc_12", "doc_9", "THE EREA"], [".txt", ".md", ".pdf"], None, NOW, chunks=tables.chunks(spark, sf_dir), query=tables.query_vector(spark, sf_dir), min_score=MIN_SCORE)
    return found.select("id", "path", F.array_join("matched_keywords", ",").alias("matched_keywords"), "semantic_score", "snippet", "rank")


_ODD = [(10_000_001, [1.0, 0.0]), (10_000_002, [0.0, 1.0]), (10_000_003, [1.0, 0.0, 0.0])]
_ODD_SQL = "SELECT vec_id AS id, embedding FROM embeddings UNION ALL " + " UNION ALL ".join(f"SELECT {i}, {v}::FLOAT[]" for i, v in _ODD)


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.chunks(spark, sf_dir).select("id", "embedding").unionByName(spark.createDataFrame(_ODD, "id long, embedding array<float>"))


@register("dim_guard", f"SELECT count(*) AS chunks FROM ({_ODD_SQL}) WHERE len(embedding) = (SELECT len(embedding) FROM embeddings WHERE vec_id = 0)")
def dim_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _odd(spark, sf_dir).filter(F.size("embedding") == len(tables.query_vector(spark, sf_dir))).agg(F.count(F.lit(1)).alias("chunks"))


@register("dominant_dim", f"SELECT len(embedding)::INTEGER AS dim FROM ({_ODD_SQL}) GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1")
def dominant_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(semantic.dominant_dim(_odd(spark, sf_dir)),)], "dim int")


@register("chunk_documents", f"""WITH s AS (SELECT doc_id AS file_id, trim(text, {q(text.STRIPPED)}) AS t FROM documents),
n AS (SELECT *, CASE WHEN length(t) = 0 THEN 0 WHEN length(t) <= 800 THEN 1 ELSE 1 + ceil((length(t) - 800) / 700.0)::INTEGER END AS n FROM s)
SELECT file_id, i::INTEGER AS chunk_index, substr(t, (i * 700 + 1)::BIGINT, 800) AS chunk_text FROM n, unnest(range(n)) r(i)""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.chunked(tables.bodies(spark, sf_dir))


@register("snippet", f"WITH s AS (SELECT doc_id AS file_id, replace(trim(text, {q(text.STRIPPED)}), chr(10), ' ') AS t FROM documents) SELECT file_id, CASE WHEN length(t) <= 240 THEN t ELSE substr(t, 1, 240) || '…' END AS snippet FROM s")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bodies(spark, sf_dir).select("file_id", text.snippet(F.col("text")).alias("snippet"))


@register("preview", "SELECT doc_id AS file_id, substr(text, 1, 4000) AS text, length(text) > 4000 AS truncated, length(text)::BIGINT AS char_count FROM documents")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bodies(spark, sf_dir).select("file_id", text.preview(F.col("text")).alias("p")).select("file_id", "p.*")


@register("preview_freshness", f"WITH {CONTENT_SQL} SELECT file_id, error IS NULL AND (file_id % 7 = 0 OR extracted_at >= {EPOCH} + file_id * 3600) AS use_index FROM content")
def preview_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk = tables.files(spark, sf_dir).select(F.col("id").alias("file_id"), F.when(F.col("id") % 7 != 0, F.col("mtime")).alias("disk_mtime"))
    return content.freshness(tables.content(spark, sf_dir), disk)


@register("tokenize_query", r"SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''), '|') AS words FROM conversations")
def tokenize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.keywords_of(F.col("text")), "|").alias("words"))


@register("path_parts", r"""WITH n AS (SELECT page_id, url, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages)
SELECT page_id, name, CASE WHEN regexp_matches(name, '^\.*[^.].*\.') THEN lower(regexp_extract(name, '(\.[^.]*)$', 1)) ELSE '' END AS ext, regexp_replace(regexp_extract(url, '^(.*/)?', 0), '/+$', '') AS dir FROM n""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return tables.table(spark, sf_dir, "pages").select("page_id", text.name_of(url).alias("name"), text.ext_of(text.name_of(url)).alias("ext"), text.dir_of(url).alias("dir"))


@register("stats_counts", f"""WITH {FILES_SQL}, {CONTENT_SQL}, {CHUNKS_SQL}
SELECT (SELECT count(*) FROM files WHERE is_deleted = 0) AS file_count, (SELECT count(*) FROM content WHERE error IS NULL) AS content_count,
       (SELECT count(DISTINCT file_id) FROM chunks) AS chunked_files, (SELECT count(*) FROM chunks) AS chunk_count""")
def stats_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counts(tables.files(spark, sf_dir), tables.content(spark, sf_dir), tables.chunks(spark, sf_dir))


#: Fixed values, as SQL has them of its own.
_PLAIN = "'.txt', '.md', '.csv', '.json', '.xml', '.html', '.htm', '.log', '.ini', '.yaml', '.yml', '.py', '.js', '.ts', '.css', '.java', '.c', '.cpp', '.h', '.hpp', '.cs', '.go', '.rb', '.php', '.sh', '.bat', '.ps1', '.sql', '.rtf'"
_RATIO = f"CASE WHEN ext IN ({_PLAIN}) THEN 1.0 WHEN ext IN ('.docx', '.xlsx', '.pptx') THEN 0.06 WHEN ext = '.pdf' THEN 0.10 ELSE 0 END::DOUBLE"
_CALIBRATED = "calib AS (SELECT f.ext, count(*) AS n, sum(f.size)::BIGINT AS src_bytes, sum(strlen(c.text))::BIGINT AS text_bytes, sum(strlen(c.text)) / sum(f.size) AS ratio FROM files f JOIN content c ON c.file_id = f.id WHERE c.error IS NULL GROUP BY f.ext HAVING count(*) >= 5 AND sum(f.size) > 0)"


@register("estimate_uncalibrated", f"WITH {FILES_SQL}, s AS (SELECT ext, sum(size)::DOUBLE AS b FROM files WHERE is_deleted = 0 GROUP BY ext) SELECT floor(sum(b * {_RATIO}) * 2.5)::BIGINT AS estimate_bytes FROM s")
def estimate_uncalibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.estimate(tables.files(spark, sf_dir), extract.PLAIN)


@register("calibration_by_ext", f"WITH {FILES_SQL}, {CONTENT_SQL}, {_CALIBRATED} SELECT ext, n, src_bytes, text_bytes, round(ratio, 9) AS ratio FROM calib")
def calibration_by_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.calibration(tables.files(spark, sf_dir), tables.content(spark, sf_dir)).withColumn("ratio", F.round("ratio", 9))


@register("estimate_calibrated", f"WITH {FILES_SQL}, {CONTENT_SQL}, {_CALIBRATED}, s AS (SELECT ext, sum(size)::DOUBLE AS b FROM files WHERE is_deleted = 0 GROUP BY ext) SELECT floor(sum(b * coalesce(ratio, {_RATIO})) * 1.75)::BIGINT AS estimate_bytes FROM s LEFT JOIN calib USING (ext)")
def estimate_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.files(spark, sf_dir)
    return stats.estimate(files, extract.PLAIN, stats.calibration(files, tables.content(spark, sf_dir)), 0.75)


@register("overhead_ratio", f"WITH {CONTENT_SQL}, {CHUNKS_SQL}, b AS (SELECT sum(strlen(text)) AS t FROM content WHERE error IS NULL), c AS (SELECT sum(strlen(chunk_text) + 4 * len(embedding)) AS k FROM chunks) SELECT round((k + 1.5 * t) / t, 9) AS overhead_ratio FROM b, c")
def overhead_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.overhead_ratio(tables.content(spark, sf_dir), tables.chunks(spark, sf_dir)).select(F.round("overhead_ratio", 9).alias("overhead_ratio"))


_EXTRACTABLE = f"{_PLAIN}, '.pdf', '.docx', '.xlsx', '.pptx'"
_ACTIONS = f"""joined AS (SELECT f.id, f.mtime, c.file_id, c.extracted_at, c.error, c.embedded_at FROM files f LEFT JOIN content c ON c.file_id = f.id WHERE f.is_deleted = 0 AND f.ext IN ({_EXTRACTABLE})),
acted AS (SELECT id, CASE WHEN file_id IS NULL OR extracted_at < mtime OR error IS NOT NULL THEN 'extract' ELSE 'embed' END AS action FROM joined"""


@register("index_candidates", f"WITH {FILES_SQL}, {CONTENT_SQL}, {_ACTIONS} WHERE file_id IS NULL OR extracted_at < mtime) SELECT id, action FROM acted")
def index_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.candidates(tables.files(spark, sf_dir), tables.content(spark, sf_dir), extract.extractable(), False).select("id", "action")


@register("index_action", f"WITH {FILES_SQL}, {CONTENT_SQL}, {_ACTIONS} WHERE file_id IS NULL OR extracted_at < mtime OR (error IS NULL AND embedded_at IS NULL)) SELECT id, action FROM acted")
def index_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.candidates(tables.files(spark, sf_dir), tables.content(spark, sf_dir), extract.extractable(), True).select("id", "action")


STARTED = float(EPOCH + 1_000)


def _scan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The catalogue without every third file, and a later scan that finds all but every fourth."""
    files = tables.files(spark, sf_dir)
    seen = files.filter("id % 4 <> 0").select("path", "name", "ext", "dir", (F.col("size") + 1).alias("size"), (F.col("mtime") + 60).alias("mtime"), F.lit(STARTED).alias("scan_started_at"))
    return files.filter("id % 3 <> 0"), seen


_MERGE = f"""old AS (SELECT * FROM files WHERE id % 3 <> 0), seen AS (SELECT path, name, ext, dir, size + 1 AS size, mtime + 60 AS mtime FROM files WHERE id % 4 <> 0),
kept AS (SELECT o.id, o.path, coalesce(s.size, o.size)::BIGINT AS size, coalesce(s.mtime, o.mtime) AS mtime, CASE WHEN s.path IS NOT NULL THEN 0 ELSE o.is_deleted END AS is_deleted, CASE WHEN s.path IS NOT NULL THEN {STARTED} ELSE o.last_seen_at END AS last_seen_at FROM old o LEFT JOIN seen s USING (path)),
fresh AS (SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY path) AS id, path, size, mtime, 0, {STARTED} FROM seen WHERE path NOT IN (SELECT path FROM old)),
every AS (SELECT * FROM kept UNION ALL SELECT * FROM fresh)"""


@register("upsert_catalog", f"WITH {FILES_SQL}, {_MERGE} SELECT id::BIGINT AS id, path, size::BIGINT AS size, mtime, is_deleted FROM every")
def upsert_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.merged(*_scan(spark, sf_dir)).select("id", "path", "size", "mtime", "is_deleted")


@register("soft_delete", f"WITH {FILES_SQL}, {_MERGE} SELECT id::BIGINT AS id, path, CASE WHEN starts_with(path, '/en/src1') AND last_seen_at < {STARTED} THEN 1 ELSE is_deleted END AS is_deleted FROM every")
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.merged(*_scan(spark, sf_dir), ["/en/src1"], STARTED).select("id", "path", "is_deleted")


@register("replace_chunks", f"WITH {CHUNKS_SQL} SELECT id, file_id, chunk_text FROM chunks WHERE file_id % 7 <> 0 UNION ALL SELECT id + 1000000000, file_id, 'new' FROM chunks WHERE file_id % 7 = 0 AND chunk_index < 2")
def replace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.chunks(spark, sf_dir).select("id", "file_id", "chunk_text", "chunk_index")
    new = rows.filter("file_id % 7 = 0 and chunk_index < 2").withColumns({"id": F.col("id") + 1_000_000_000, "chunk_text": F.lit("new")})
    return catalog.replaced(rows, new).select("id", "file_id", "chunk_text")


@register("rebuild_decision", f"WITH {CHUNKS_SQL}, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE cluster_id IS NULL) AS nulls FROM chunks) SELECT total, nulls, 300::BIGINT AS indexed, total >= 5000 AND (nulls > 0.3 * total OR total > 1.5 * 300) AS rebuild FROM c")
def rebuild_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.rebuild_decision(tables.chunks(spark, sf_dir), spark.createDataFrame([(300,)], "indexed_chunk_count long"))


_LATEST = "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id"


def _events(df: DataFrame) -> DataFrame:
    return df.select("user_id", "ts", "event_id")


@register("latest_observation", _LATEST)
def latest_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest(_events(tables.table(spark, sf_dir, "events")), "user_id", ("ts", "event_id"))


@register("stream_upsert", _LATEST)
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream, merged batch by batch into a published table."""
    base = f"{shared.folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = tables.table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    snapshots.drained(snapshots.keep_up(_events(source), f"{base}/table", f"{base}/checkpoint", "user_id", ("ts", "event_id")))
    return catalog.current(spark, f"{base}/table")


@register("usage_log_summary", f"SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS time, event_type AS query, (event_id % 5)::BIGINT AS keyword_count, (event_id % 50)::BIGINT AS hit_count, CASE WHEN event_id % 2 = 0 THEN '{logs.OPENED}' ELSE '{logs.UNOPENED}' END AS opened FROM events")
def usage_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "events").select(F.col("ts").alias("time"), F.col("event_type").alias("query"), (F.col("event_id") % 5).alias("keyword_count"), (F.col("event_id") % 50).alias("hit_count"), (F.col("event_id") % 2 == 0).alias("opened"))
    return logs.usage_rows(rows).toDF("time", "query", "keyword_count", "hit_count", "opened")


REPLIES = ['```json\n{"keywords": [" a ", "", "b"], "extensions": [".PDF"], "recency_days": 7.9}\n```', '{"keywords": [], "extensions": []}', "no json", json.dumps({"keywords": [f"k{i}" for i in range(20)]})]
_TOLD = [(0, "a,b", ".PDF", 7), (1, None, "", None), (2, None, "", None), (3, ",".join(f"k{i}" for i in range(15)), "", None)]


@register("expansion_json", "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {q(k) if k else 'NULL'}, {q(e)}, {d if d is not None else 'NULL'}::INTEGER)" for i, k, e, d in _TOLD) + ") v(id, keywords, extensions, recency_days)")
def expansion_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(REPLIES)), "id long, reply string").select("id", *text.expansion_columns(F.col("reply")))
    return rows.select("id", F.array_join("keywords", ",").alias("keywords"), F.array_join("extensions", ",").alias("extensions"), "recency_days")
