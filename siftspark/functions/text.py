"""Folding, variants, stripping, chunking, snippets and the like. Lengths count code points."""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that is stripped and splits queries: Unicode's, and the four separators U+001C-001F.
STRIPPED = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPLIT = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in STRIPPED) + "]+"
#: Below so many code points a keyword is matched with ASCII-only folding.
LONG = 3
CHUNK, STRIDE = 800, 700
SNIPPET, PREVIEW, LONGEST_TEXT = 240, 4_000, 300_000
RATIOS = {"office": 0.06, ".pdf": 0.10}
MAX_KEYWORDS = 15


def fold(x: Column) -> Column:
    """Case folding of long keywords: Unicode lower case, final sigma as sigma."""
    return F.translate(F.lower(x), "ς", "σ")


def ascii_fold(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def contains(x: Column, keyword: str) -> Column:
    """Substring test: a long keyword ignores case, a short one the case of A-Z only; wildcards are literal."""
    if len(keyword) >= LONG:
        return F.contains(fold(x), F.lit(keyword.lower().replace("ς", "σ")))
    return F.contains(ascii_fold(x), F.lit(keyword.translate(str.maketrans(UPPER, LOWER))))


def holds(folded: Column, keyword: str) -> Column:
    """Whether a struct of both foldings (long, short) contains any variant of the keyword: see contains()."""
    out = None
    for v in variants(keyword):
        if len(v) >= LONG:
            one = F.contains(folded["long"], F.lit(v.lower().replace("ς", "σ")))
        else:
            one = F.contains(folded["short"], F.lit(v.translate(str.maketrans(UPPER, LOWER))))
        out = one if out is None else out | one
    return F.coalesce(out, F.lit(False))


def stripped(x: Column) -> Column:
    return F.btrim(x, F.lit(STRIPPED))


def variants(keyword: str) -> list[str]:
    """The keyword and its compatibility form, each also in full-width ASCII, and each of these in either kana."""
    shift = lambda first, last, by: {c: c + by for c in range(first, last + 1)}
    found = [keyword, unicodedata.normalize("NFKC", keyword)]
    found += [x.translate(shift(0x21, 0x7E, 0xFEE0)) for x in found]
    return list(dict.fromkeys([*found, *(x.translate(shift(*kana)) for x in found for kana in ((0x3041, 0x3096, 0x60), (0x30A1, 0x30F6, -0x60)))]))


def keywords_of(query: Column) -> Column:
    return F.filter(F.split(query, SPLIT), lambda w: w != "")


def chunks(text: Column) -> Column:
    """Windows of CHUNK code points of the stripped text, STRIDE apart, to the one that reaches its end; none if it is empty."""
    count = lambda n: F.when(n == 0, 0).when(n <= CHUNK, 1).otherwise(1 + F.ceil((n - CHUNK) / STRIDE).cast("int"))
    cut = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(0), count(F.length(s)) - 1), lambda i: F.substring(s, i * STRIDE + 1, F.lit(CHUNK)))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.transform(F.array(stripped(text)), cut)[0]


def snippet(text: Column) -> Column:
    line = F.replace(stripped(text), F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) <= SNIPPET, line).otherwise(F.concat(F.substring(line, 1, SNIPPET), F.lit("…")))


def preview(text: Column) -> Column:
    return F.struct(F.substring(text, 1, PREVIEW).alias("text"), (F.length(text) > PREVIEW).alias("truncated"), F.length(text).cast("long").alias("char_count"))


def ext_of(name: Column) -> Column:
    """Lower-cased from the last dot on, if something other than dots stands before it."""
    return F.lower(F.regexp_extract(name, r"(?s)^\.*[^.].*?(\.[^.]*)$", 1))


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)$", 1)


def dir_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"(?s)^(.*/)?", 0), "(?<=[^/])/+$", "")


def extraction_ratio(ext: Column, plain: list[str]) -> Column:
    """Expected text bytes per file byte."""
    return F.when(ext.isin(plain), 1.0).when(ext.isin(".docx", ".xlsx", ".pptx"), RATIOS["office"]).when(ext == ".pdf", RATIOS[".pdf"]).otherwise(0.0)


def list_of(text: Column, separator: str) -> Column:
    """Edited lists: split, trimmed, without empty items."""
    return F.filter(F.transform(F.split(text, separator), stripped), lambda x: x != "")


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.round(100 * done / F.nullif(total, F.lit(0))).cast("int"))).otherwise(0)


@dataclass(frozen=True)
class Expansion:
    keywords: list[str]
    extensions: list[str]
    recency_days: int | None


def parse_expansion(reply: str) -> Expansion:
    """A model's reply: JSON, perhaps in a code fence, with at least one keyword."""
    body = re.sub(r"\s*```$", "", re.sub(r"^```[A-Za-z]*\s*", "", reply.strip()))
    data = json.loads(body)
    clean = lambda xs: [s for s in (str(x).strip() for x in xs or []) if s]
    words, days = clean(data.get("keywords"))[:MAX_KEYWORDS], data.get("recency_days")
    if not words:
        raise ValueError("no keywords")
    return Expansion(words, clean(data.get("extensions")), int(days) if isinstance(days, (int, float)) else None)


def expansion_columns(reply: Column) -> list[Column]:
    """The same for a column of replies: keywords, extensions, recency_days; null keywords if a reply can't be used."""
    body = F.regexp_replace(F.regexp_replace(stripped(reply), "^```[A-Za-z]*\\s*", ""), "\\s*```$", "")
    data = F.from_json(body, "keywords array<string>, extensions array<string>, recency_days double")
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.expr("cast(array() as array<string>)")), stripped), lambda x: x != "")
    words = F.slice(clean(data["keywords"]), 1, MAX_KEYWORDS)
    return [F.when(F.size(words) > 0, words).alias("keywords"), clean(data["extensions"]).alias("extensions"), data["recency_days"].cast("int").alias("recency_days")]
