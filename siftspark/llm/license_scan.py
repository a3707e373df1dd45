"""Licence scans: known licence sentences to identifiers, identifier sequences against ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.llm.common import let

#: Normalised sentence -> identifier. At most MAX_SENTENCES, held in the plan as a literal.
SENTENCES = {
    "released under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind": "as-is",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "mit license": "mit-title",
    "the mit license mit": "mit-title",
    "licensed under the apache license version 2 0": "apache2-ref",
    "licensed under the apache license version 2 0 the license": "apache2-ref",
    "you may not use this file except in compliance with the license": "apache2-terms",
    "you may obtain a copy of the license at": "apache2-copy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2-copy",
    "http www apache org licenses license 2 0": "apache2-url",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-as-is",
    "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-copy",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "this work is licensed under the gnu general public license version 2": "gpl2-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-terms-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-terms-later",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-fitness",
    "see the gnu general public license for more details": "gpl-see",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "if not see https www gnu org licenses": "gpl-url",
    "if not see http www gnu org licenses": "gpl-url",
    "either version 3 of the license or at your option any later version": "gpl3-later",
    "either version 2 of the license or at your option any later version": "gpl2-later",
    "licensed under cc by nc 4 0": "cc-by-nc-4",
    "licensed under cc by 4 0": "cc-by-4",
    "licensed under cc by sa 4 0": "cc-by-sa-4",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-as-is",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "bsd-liability",
    "in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "bsd-liability",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-terms",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "licensed under the mozilla public license version 2 0": "mpl2-ref",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-terms-later",
    "either version 2 1 of the license or at your option any later version": "lgpl21-later",
    "this library is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "see the gnu lesser general public license for more details": "gpl-see",
    "you should have received a copy of the gnu lesser general public license along with this library": "gpl-copy",
}
#: (licence, identifiers in this order and next to each other). Earlier rules win; what they match is used up.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("GPL-3.0-or-later", ["gpl3-terms-later"]),
    ("GPL-2.0-or-later", ["gpl2-terms-later"]),
    ("GPL-3.0-or-later", ["gpl-terms", "gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl-terms", "gpl2-later"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache2-ref", "apache2-terms", "apache2-copy"]),
    ("Apache-2.0", ["apache2-ref"]),
    ("MIT", ["mit-ref"]),
    ("GPL-3.0", ["gpl3-ref"]),
    ("GPL-2.0", ["gpl2-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("MPL-2.0", ["mpl-terms", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-ref"]),
    ("ISC", ["isc-grant"]),
    ("LGPL-2.1-or-later", ["lgpl21-terms-later"]),
    ("LGPL-2.1-or-later", ["lgpl-terms", "lgpl21-later"]),
]
MAX_SENTENCES = 10_000
#: A sentence without one of these is not about licences: it is not looked up.
CRITICAL = "licen|permission|redistribut|warranty|copyright|version [0-9]+ of the|the mpl "
#: Normalised sentences that only name a holder of rights: not licence sentences unless known, so they aren't unknown ones either.
NOTICE = "^(the )?copyright (c )?[0-9]{4}( |$)|^(c )?copyright (c )?(by )?the [a-z ]* authors$"
#: Sentences end at . ; : ! ? before white space or the end of the text, and at blank lines. Single line ends may be wraps:
#: they end a sentence only if its lines, joined, aren't known.
PIECE = r"[.;:!?]+(?:[\x20\x09-\x0D]+|\z)|\x0D?\x0A[\x20\x09\x0D]*\x0A[\x20\x09-\x0D]*"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(sentence, "[^a-z0-9]+", " "))


def identifiers(text: Column, known: dict[str, str]) -> Column:
    """Identifiers in order, 'unknown' for a sentence that has a critical word and isn't known, none for a copyright notice.

    Sentences are in lower case, each run of other characters than a-z and 0-9 as one space. Of the lines up to a
    sentence's end, the longest tail that is a known sentence is one; the lines before it stand by themselves.
    """
    if len(known) > MAX_SENTENCES:
        raise ValueError(f"more than {MAX_SENTENCES} sentences")
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    # A line that counts has a word at least, so longer tails than this aren't known.
    longest = max((len(s.split()) for s in known), default=0)
    none = F.expr("cast(array() as array<string>)")

    def alone(lines: Column) -> Column:
        named = F.transform(F.filter(lines, lambda s: s.rlike(CRITICAL)), lambda s: let(normalised(s), lambda x: F.coalesce(F.element_at(table, x), F.when(x.rlike(NOTICE), "notice").otherwise("unknown"))))
        return F.filter(named, lambda x: x != "notice")

    def of(piece: Column) -> Column:
        lines = F.filter(F.split(piece, r"[\x0A\x0D]+", -1), lambda s: s.rlike("[a-z0-9]"))
        return let(lines, lambda x: F.when(F.size(x) <= 1, alone(x)).otherwise(let(tail(x), lambda i: F.when(i.isNull(), alone(x)).otherwise(F.concat(alone(F.slice(x, 1, i - 1)), F.array(F.element_at(table, joined(x, i))))))))

    def joined(x: Column, i: Column) -> Column:
        return normalised(F.array_join(F.slice(x, i, F.size(x)), " "))

    def tail(x: Column) -> Column:
        first = F.greatest(F.lit(1), F.size(x) - longest + 1)
        return F.get(F.filter(F.sequence(first, F.size(x)), lambda i: F.element_at(table, joined(x, i)).isNotNull()), F.lit(0))

    pieces = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), PIECE, -1), lambda s: s.rlike(CRITICAL))
    return F.when(F.size(pieces) == 0, none).otherwise(F.flatten(F.transform(pieces, of)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_sentences (with a critical word), sentence_ids, licenses, n_unknown, status.

    sentence_ids and licenses are comma-separated, the latter distinct and in the order of the rules.
    status: none (no such sentence), known (a rule matched, nothing unknown is left), partial (a rule matched beside
    unknown sentences) or unknown (no rule matched). A null text counts as empty; repeated rows are scanned each;
    other columns are ignored.
    """
    known, rules = SENTENCES if known is None else known, RULES if rules is None else rules
    rows = docs.select(F.col(id_col).alias("doc_id"), identifiers(F.col(text_col), known).alias("ids"))
    rows = rows.withColumn("rest", F.concat(F.lit(","), F.array_join(F.transform("ids", lambda x: F.concat(x, F.lit(","))), ",")))
    columns = []
    for k, (_, ids) in enumerate(rules):
        # Identifiers stand between commas of their own (",a,,b,"), so that neighbours don't share one.
        pattern = "," + ",,".join(ids) + ","
        rows = rows.withColumns({f"m{k}": F.contains(F.col("rest"), F.lit(pattern)), "rest": F.replace(F.col("rest"), F.lit(pattern), F.lit(",-,"))})
        columns.append(f"m{k}")
    names = list(dict.fromkeys(name for name, _ in rules))
    found = F.array_compact(F.array(*[F.when(F.greatest(F.lit(False), F.lit(False), *[F.col(c) for c, (n, _) in zip(columns, rules) if n == name]), F.lit(name)) for name in names]))
    unknown = F.size(F.filter("ids", lambda x: x == "unknown")).cast("long")
    status = F.when(F.size("ids") == 0, "none").when(F.size(found) == 0, "unknown").when(unknown > 0, "partial").otherwise("known")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(found, ",").alias("licenses"), unknown.alias("n_unknown"), status.alias("status"))
