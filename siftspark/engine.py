"""The search service over catalogue, content and chunks: what a front end calls."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark import schemas
from siftspark.functions import text
from siftspark.operators import hybrid, semantic, stats
from siftspark.providers import Embedder, Expander, expand, query_vector
from siftspark.sources import extract


@dataclass(frozen=True)
class Settings:
    min_score: float = semantic.MIN_SCORE
    most_semantic: int = semantic.MOST
    limit: int = 50
    scan_interval_minutes: int = 10
    exclude_folders: list[str] = field(default_factory=list)
    exclude_extensions: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, raw: dict) -> Settings:
        """Known fields of a stored configuration over the defaults."""
        return cls(**{k: v for k, v in raw.items() if k in cls.__dataclass_fields__})


@dataclass
class Engine:
    files: DataFrame
    content: DataFrame
    chunks: DataFrame | None = None
    centroids: list[tuple[int, list[float]]] | None = None
    settings: Settings = Settings()
    #: Clusters to probe; None: the fixed rule.
    probes: int | None = None

    def _search(self, keywords: list[str], extensions: list[str] | None, recency_days: int | None, now: float, vector: list[float] | None) -> DataFrame:
        clusters = semantic.top_clusters(self.centroids, vector, self.probes) if self.centroids and vector else None
        s = self.settings
        return hybrid.hybrid_search(self.files, self.content, keywords, extensions, recency_days, now, s.limit, self.chunks, vector, s.min_score, s.most_semantic, clusters)

    def search(self, query: str, now: float, expander: Expander | None = None, embedder: Embedder | None = None) -> DataFrame:
        found = expand(query, expander)
        return self._search(found.keywords, found.extensions, found.recency_days, now, query_vector(query, embedder))

    def search_local(self, keywords: list[str], extensions: list[str] | None = None, recency_days: int | None = None, now: float = 0.0) -> DataFrame:
        """Edited keywords again, without any model."""
        return self._search(keywords, extensions, recency_days, now, None)

    def preview(self, file_id: int, live: bool = True) -> dict | None:
        """The start of a live file's text: from the index if the file on disk isn't newer, else read now; None for a file that isn't in the catalogue.

        With available False, reason says why there is none. Nothing is written.
        """
        rows = self.files.filter((F.col("id") == file_id) & (F.col("is_deleted") == 0)).join(schemas.conformed(self.content, schemas.CONTENT).filter(F.col("file_id") == file_id), F.col("id") == F.col("file_id"), "left")
        row = rows.select("name", "path", "ext", "file_id", "extracted_at", "error", text.preview(F.col("text")).alias("p")).first()
        if row is None:
            return None
        base = {"name": row["name"], "path": row["path"]}
        try:
            changed = os.path.getmtime(row["path"])
        except OSError:
            changed = None
        if row["file_id"] is not None and row["error"] is None and (changed is None or not live or (row["extracted_at"] or 0) >= changed):
            return base | {"available": True, "source": "index"} | row["p"].asDict()
        if row["ext"] not in extract.READERS:
            return base | {"available": False, "reason": "no preview of this kind of file"}
        if changed is None or not live:
            return base | {"available": False, "reason": "the file is not there"}
        body, error = extract.file_text(row["path"], row["ext"])
        if error:
            return base | {"available": False, "reason": error}
        return base | {"available": True, "source": "live", "text": body[: text.PREVIEW], "truncated": len(body) > text.PREVIEW, "char_count": len(body)}

    def stats(self) -> DataFrame:
        return stats.counts(self.files, self.content, self.chunks)
