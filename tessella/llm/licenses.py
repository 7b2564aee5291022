"""License scans by sentence rules, in DataFrame functions only.

Texts are normalised and cut into sentences and lines. What stands between any two cuts, with
no sentence's end or blank line between, is looked up among the known sentences of license
notices, so that a sentence may be broken over lines, indented or commented; the sequence of the numbers found is then compared with each license's own
sequence. A license is found where its sentences follow each other, with no other known
sentence between.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty

#: The sentences of notices and short license texts, in order, by SPDX-like name.
NOTICES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("apache-2.0-line", ("Licensed under the Apache License, Version 2.0",)),
    (
        "apache-2.0",
        (
            'Licensed under the Apache License, Version 2.0 (the "License")',
            "you may not use this file except in compliance with the License",
            "You may obtain a copy of the License at",
        ),
    ),
    ("mit-line", ("Released under the MIT License",)),
    (
        "mit",
        (
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        ),
    ),
    ("gpl-3.0-line", ("This work is licensed under the GNU General Public License, version 3",)),
    (
        "gpl-3.0-or-later",
        (
            "This program is free software",
            "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
        ),
    ),
    ("cc-by-nc-4.0-line", ("Licensed under CC BY-NC 4.0",)),
    ("cc-by-4.0-line", ("This work is licensed under a Creative Commons Attribution 4.0 International License",)),
    (
        "bsd-3-clause",
        (
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ),
    ),
    (
        "isc",
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    ),
    ("all-rights-reserved", ("All rights reserved",)),
)
#: Further ones, numbered after those.
SPDX_IDS = (
    *("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Unlicense", "0BSD", "Zlib", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0"),
    *(f"{k}{how}" for k in ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for how in ("", "-only", "-or-later")),
)
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation"
_LATER = "either version {} of the License, or (at your option) any later version"
_BSD = NOTICES[8][1]
MORE_NOTICES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("gpl-2.0-or-later", ("This program is free software", _GNU.format("General Public License"), _LATER.format("2"))),
    ("gpl-2.0-only", ("This program is free software", _GNU.format("General Public License version 2"))),
    ("gpl-2.0-only", ("This program is free software", _GNU.format("General Public License"), "version 2 of the License")),
    ("gpl-3.0-or-later", ("This program is free software", _GNU.format("General Public License"), _LATER.format("3"))),
    ("lgpl-2.0-or-later", ("This library is free software", _GNU.format("Library General Public License"), _LATER.format("2"))),
    ("lgpl-2.1-or-later", ("This library is free software", _GNU.format("Lesser General Public License"), _LATER.format("2.1"))),
    *(("lgpl-3.0-or-later", (f"This {what} is free software", _GNU.format("Lesser General Public License") + x)) for what in ("library", "program") for x in (", " + _LATER.format("3"),)),
    *(("lgpl-3.0-or-later", (f"This {what} is free software", _GNU.format("Lesser General Public License"), _LATER.format("3"))) for what in ("library", "program")),
    ("agpl-3.0-or-later", ("This program is free software", _GNU.format("Affero General Public License") + ", " + _LATER.format("3"))),
    ("agpl-3.0-or-later", ("This program is free software", _GNU.format("Affero General Public License"), _LATER.format("3"))),
    ("mpl-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v",)),
    ("unlicense", ("This is free and unencumbered software released into the public domain",)),
    (
        "bsd-2-clause",
        (
            *_BSD[:3],
            'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
        ),
    ),
    ("isc", ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",)),
    *((f"spdx:{k}", (f"SPDX-License-Identifier {k}",)) for k in SPDX_IDS),
)
#: What ends a sentence; comment marks that read as one, or as a word, at a line's start.
END, MARK, OTHER = r"(?<![.;:!?])[.;:!?]++[ \n]", r"(?m)^ *(?:[;!]+|dnl|rem)(?=[ \n])", "[^a-z0-9]+"


def normalised(sentence: str) -> str:
    return re.sub(OTHER, " ", sentence.lower()).strip(" ")


def rules(notices: tuple[tuple[str, tuple[str, ...]], ...] = NOTICES) -> tuple[dict[str, int], list[tuple[str, list[int]]]]:
    """Number of each normalised sentence, and each license's sequence of numbers."""
    numbers: dict[str, int] = {}
    out = []
    for name, sentences in notices:
        out.append((name, [numbers.setdefault(normalised(s), len(numbers)) for s in sentences]))
    return numbers, out


def _known(text: Column) -> Column:
    numbers, _ = rules(NOTICES + MORE_NOTICES)
    table_ = F.create_map(*[x for s, k in numbers.items() for x in (F.lit(s), F.lit(k))])
    # a vertical tab ends a sentence; a tab is a line's end within one, two are a blank line
    lowered = F.replace(F.lower(text), F.lit("spdx-license-identifier:"), F.lit("spdx-license-identifier "))
    lines = F.regexp_replace(F.translate(lowered, "\t\r\v", "   "), MARK, "")
    ended = F.regexp_replace(lines, END, "\v")
    plain = F.regexp_replace(F.translate(ended, "\n", "\t"), r"[^a-z0-9\t\x0b]+", " ")
    cut = F.regexp_replace(F.concat(F.lit("\v"), plain, F.lit("\v")), r" ?([\t\x0b]) ?", "$1")
    # longest first; the words of a sentence may stand on two lines
    any_of = "|".join(s.replace(" ", "[ \\t]") for s in sorted(numbers, key=len, reverse=True))
    found = F.regexp_extract_all(cut, F.lit(rf"(?<=[\t\x0b])(?:{any_of})(?=[\t\x0b])"), F.lit(0))
    return F.transform(found, lambda p: F.try_element_at(table_, F.translate(p, "\t", " ")))


def scan_licenses(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds sentence_ids (array, in order) and licenses (array, in the order of NOTICES, then MORE_NOTICES).

    A null or empty text has none. Null ids, repeated rows and further columns (`carry`,
    default all) pass as they are; columns named like the new ones are replaced.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("sentence_ids", "licenses")]
    rows = docs.select(*carry, _known(text_or_empty(text_col)).alias("_known"))
    path = F.concat(F.lit(","), F.array_join(F.transform("_known", lambda k: k.cast("string")), ","), F.lit(","))
    named = F.array(*[F.when(F.contains("_path", F.lit("," + ",".join(map(str, sequence)) + ",")), F.lit(name)) for name, sequence in rules(NOTICES + MORE_NOTICES)[1]])
    return rows.withColumn("_path", path).select(*carry, F.col("_known").alias("sentence_ids"), F.array_distinct(F.array_compact(named)).alias("licenses"))


def op10_licenses(spark, sf_dir):
    found = scan_licenses(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join(F.transform("sentence_ids", lambda k: k.cast("string")), ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def _sql() -> str:
    numbers, licenses = rules()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    sentences = ", ".join(f"({quote(s)}, {k})" for s, k in numbers.items())
    names = ", ".join(f"({quote(n)}, {k}, ',{','.join(map(str, s))},')" for k, (n, s) in enumerate(licenses))
    return f"""
WITH sentences(s, k) AS (VALUES {sentences}), notices(name, number, path) AS (VALUES {names}),
docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
pieces AS (
  SELECT row, unnest(p) AS piece, generate_subscripts(p, 1) AS i
  FROM (SELECT row, string_split(regexp_replace(regexp_replace(t, '([^.;:!?\\n])\\n([a-z])', '\\1 \\2', 'g'), '[.;:!?]+[ \\t\\r\\n]', chr(10), 'g'), chr(10)) AS p FROM docs)
), found AS (
  SELECT row, i, k FROM pieces JOIN sentences ON trim(regexp_replace(lower(piece), '[^a-z0-9]+', ' ', 'g')) = s
), per AS (SELECT row, count(*) AS n, string_agg(CAST(k AS VARCHAR), ',' ORDER BY i) AS ids FROM found GROUP BY row),
hits AS (SELECT row, string_agg(name, ',' ORDER BY number) AS names FROM per, notices WHERE contains(',' || ids || ',', path) GROUP BY row)
SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(names, '') AS licenses
FROM docs LEFT JOIN per USING (row) LEFT JOIN hits USING (row)
"""


OP10_SQL = _sql()
