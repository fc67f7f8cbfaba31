"""Licence scan: sentences to identifiers, identifier sequences to rules.

A text is cut into sentences twice, by lines and by running text (so that wrapped
sentences are found too).  Each normalised sentence is looked up in a table of
known licence sentences, alone and with those after it, for some known sentences
hold a sentence's end inside; what is found, in order, is the text's sequence of
identifiers.  Rules are tried in their order; a rule matches where its identifiers
follow one another, and takes them out, so a full notice wins over its parts.
All of it happens inside the row, in DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.quality import let

# Sentences of public licences and notices, by identifier.
SENTENCES: dict[str, str] = {
    "apache.under": "Licensed under the Apache License, Version 2.0",
    "apache.under-the-license": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache.compliance": "you may not use this file except in compliance with the License",
    "apache.copy": "You may obtain a copy of the License at",
    "apache.copy-url": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache.warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache.see": "See the License for the specific language governing permissions and limitations under the License",
    "mit.released": "Released under the MIT License",
    "mit.licensed": "Licensed under the MIT License",
    "mit.distributed": "Distributed under the MIT License",
    "mit.grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit.warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd.endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "gpl3.work": "This work is licensed under the GNU General Public License, version 3",
    "gpl3.licensed": "Licensed under the GNU General Public License, version 3",
    "gpl.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2.free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl.hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl.received": "You should have received a copy of the GNU General Public License along with this program",
    "mpl2.form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by4.under": "Licensed under CC BY 4.0",
    "cc-by-sa4.under": "Licensed under CC BY-SA 4.0",
    "cc-by-nc4.under": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-sa4.under": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-nd4.under": "Licensed under CC BY-ND 4.0",
    "cc0.waived": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work, under the CC0 license",
    "spdx.apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx.mit": "SPDX-License-Identifier: MIT",
    "spdx.gpl3": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx.dual": "SPDX-License-Identifier: MIT OR Apache-2.0",
    "rights.reserved": "All rights reserved under the copyright licence",
}

# Rules in order, with the licence and the identifiers that must follow one another.
RULES: list[tuple[str, str, list[str]]] = [
    ("apache-2.0.notice", "Apache-2.0", ["apache.under-the-license", "apache.compliance", "apache.copy-url", "apache.warranty", "apache.see"]),
    ("apache-2.0.notice-lines", "Apache-2.0", ["apache.under-the-license", "apache.compliance", "apache.copy", "apache.warranty", "apache.see"]),
    ("mit.text", "MIT", ["mit.grant", "mit.notice", "mit.warranty"]),
    ("bsd-3.text", "BSD-3-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse"]),
    ("bsd-2.text", "BSD-2-Clause", ["bsd.grant", "bsd.source", "bsd.binary"]),
    ("gpl-3.notice", "GPL-3.0-or-later", ["gpl.free", "gpl.hope", "gpl.received"]),
    ("gpl-2.notice", "GPL-2.0-or-later", ["gpl2.free", "gpl.hope", "gpl.received"]),
    ("dual.reference", "MIT OR Apache-2.0", ["mit.licensed", "apache.under"]),
    ("dual.tag", "MIT OR Apache-2.0", ["spdx.dual"]),
    ("apache-2.0.reference", "Apache-2.0", ["apache.under"]),
    ("apache-2.0.reference-named", "Apache-2.0", ["apache.under-the-license"]),
    ("apache-2.0.tag", "Apache-2.0", ["spdx.apache"]),
    ("mit.reference", "MIT", ["mit.released"]),
    ("mit.reference-licensed", "MIT", ["mit.licensed"]),
    ("mit.reference-distributed", "MIT", ["mit.distributed"]),
    ("mit.grant-alone", "MIT", ["mit.grant"]),
    ("mit.tag", "MIT", ["spdx.mit"]),
    ("isc.grant", "ISC", ["isc.grant"]),
    ("gpl-3.reference", "GPL-3.0-only", ["gpl3.work"]),
    ("gpl-3.reference-licensed", "GPL-3.0-only", ["gpl3.licensed"]),
    ("gpl-3.grant-alone", "GPL-3.0-or-later", ["gpl.free"]),
    ("gpl-2.grant-alone", "GPL-2.0-or-later", ["gpl2.free"]),
    ("gpl-3.tag", "GPL-3.0-only", ["spdx.gpl3"]),
    ("mpl-2.0.notice", "MPL-2.0", ["mpl2.form"]),
    ("cc-by-4.0.reference", "CC-BY-4.0", ["cc-by4.under"]),
    ("cc-by-sa-4.0.reference", "CC-BY-SA-4.0", ["cc-by-sa4.under"]),
    ("cc-by-nc-4.0.reference", "CC-BY-NC-4.0", ["cc-by-nc4.under"]),
    ("cc-by-nc-sa-4.0.reference", "CC-BY-NC-SA-4.0", ["cc-by-nc-sa4.under"]),
    ("cc-by-nd-4.0.reference", "CC-BY-ND-4.0", ["cc-by-nd4.under"]),
    ("cc0.waiver", "CC0-1.0", ["cc0.waived"]),
]

#: Begins a part that was cut off inside a line or paragraph.
SAME = "\x1e"
#: Every known sentence has one of these words; others need no normalising.
KEYWORD = "(?i)licen[sc]e|permission|redistribut|warranty|copyright|general public"


def normalise(sentence: str) -> str:
    out = "".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower())
    return " ".join(out.split())


def known(sentences: dict[str, str]) -> dict[str, str]:
    import re

    assert all(re.search(KEYWORD, s) for s in sentences.values())
    return {normalise(s): k for k, s in sentences.items()}


def starts(sentences: dict[str, str]) -> tuple[str, int]:
    """What the first part of every known sentence has, and the most parts that one is cut into."""
    import re

    cut = [re.split(r"(?<=[.;:!?]) ", s) for s in sentences.values()]
    more = {normalise(c[0]).replace(" ", "[^a-z0-9]+") for c in cut if not re.search(KEYWORD, c[0])}
    return "|".join([KEYWORD, *sorted(more)]), max(map(len, cut), default=1)


def identifiers(parts: Column, table: Column, start: str, most: int) -> Column:
    """Identifiers of known sentences, in order: parts, or runs of parts (those after the first begin with SAME)."""

    def found(all_: Column) -> Column:
        def name(s: Column, i: Column) -> Column:
            whole = lambda n: F.trim(F.regexp_replace(F.lower(F.array_join(F.slice(all_, i + 1, n), " ")), "[^a-z0-9]+", " "))
            got, goes_on = [F.element_at(table, whole(1))], F.lit(True)
            for n in range(2, most + 1):
                goes_on = goes_on & F.startswith(F.get(all_, i + (n - 1)), F.lit(SAME))
                got.append(F.when(goes_on, F.element_at(table, whole(n))))
            return F.when(s.rlike(start), F.coalesce(*reversed(got)))

        return F.filter(F.transform(all_, name), lambda x: x.isNotNull())

    return let(parts, found)


def matched(sequence: Column, rules: Column) -> Column:
    """Rules found in a sequence <a><b>..., each taking out what it matched."""

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state.getField("left"), rule.getField("pattern"))
        taken = F.struct(
            F.replace(state.getField("left"), rule.getField("pattern"), F.lit(".")).alias("left"),
            F.concat(state.getField("rules"), F.array(rule.getField("rule"))).alias("rules"),
            F.concat(state.getField("licenses"), F.array(rule.getField("license"))).alias("licenses"),
        )
        return F.when(hit, taken).otherwise(state)

    none = F.array().cast("array<string>")
    return F.aggregate(rules, F.struct(sequence.alias("left"), none.alias("rules"), none.alias("licenses")), step)


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, str, list[str]]] = RULES) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, rules, licenses) for every row of docs; lists are comma-joined strings.

    Line sentences and running sentences are matched apart; rules and licences
    are the sorted distinct names of both, identifiers those of the longer
    sequence (of the lines, if equal).  Null and empty texts have none; repeated
    sentences stay in the sequence; no rows give no rows; other columns are not read.
    """
    pairs = [F.lit(x) for kv in known(sentences).items() for x in kv]
    table = F.create_map(*pairs)
    all_rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(x).alias("license"), F.lit("".join(f"<{i}>" for i in ids)).alias("pattern")) for n, x, ids in rules])
    text = F.coalesce(F.col("text"), F.lit(""))
    start, most = starts(sentences)
    lines = F.split(F.regexp_replace(text, r"([.;:!?]) ", f"$1\n{SAME}"), "\n")
    # running text ends at blank lines, other line ends are spaces
    paragraphs = F.regexp_replace(text, r"[ \t\r]*\n[ \t\r]*(\n[ \t\r]*)+", "\x1d")
    flow = F.split(F.regexp_replace(F.regexp_replace(paragraphs, r"[ \t\r\n]+", " "), r"([.;:!?]) ", f"$1\n{SAME}"), "[\n\x1d]")
    none = F.array().cast("array<string>")
    found = F.when(text.rlike(KEYWORD), F.struct(identifiers(lines, table, start, most).alias("by_line"), identifiers(flow, table, start, most).alias("by_flow"))).otherwise(F.struct(none.alias("by_line"), none.alias("by_flow")))

    def result(f: Column) -> Column:
        a, b = f.getField("by_line"), f.getField("by_flow")
        longer = F.when(F.size(b) > F.size(a), b).otherwise(a)
        as_text = lambda ids: F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")

        def both(m: Column) -> Column:
            join = lambda name: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(m, lambda x: x.getField(name))))), ",")
            return F.struct(F.size(longer).cast("long").alias("n_sentences"), F.array_join(longer, ",").alias("sentence_ids"), join("rules").alias("rules"), join("licenses").alias("licenses"))

        some = let(F.transform(F.array(as_text(a), as_text(b)), lambda s: matched(s, all_rules)), both)
        empty = F.struct(F.lit(0).cast("long").alias("n_sentences"), F.lit("").alias("sentence_ids"), F.lit("").alias("rules"), F.lit("").alias("licenses"))
        return F.when((F.size(a) > 0) | (F.size(b) > 0), some).otherwise(empty)

    return docs.select("doc_id", let(found, result).alias("_f")).select("doc_id", "_f.*")


def oracle(sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, str, list[str]]] = RULES) -> str:
    """The same as DuckDB SQL over `documents`."""
    names = ", ".join(f"('{k}', '{v}')" for k, v in known(sentences).items())
    steps = []
    for i, (_, _, ids) in enumerate(rules):
        pattern = "".join(f"<{x}>" for x in ids)
        steps.append(f"r{i + 1} AS (SELECT * REPLACE (replace(s, '{pattern}', '.') AS s, CASE WHEN contains(s, '{pattern}') THEN list_append(hit, {i + 1}) ELSE hit END AS hit) FROM r{i})")
    rule_names = "[" + ", ".join(f"'{n}'" for n, _, _ in rules) + "]"
    license_names = "[" + ", ".join(f"'{x}'" for _, x, _ in rules) + "]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
known(sentence, id) AS (VALUES {names}),
parts AS (SELECT rid, 'line' AS way, string_split(regexp_replace(t, '([.;:!?]) ', '\1' || chr(10), 'g'), chr(10)) AS p FROM d
          UNION ALL SELECT rid, 'flow', string_split(replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r]*\n[ \t\r]*(\n[ \t\r]*)+', chr(29), 'g'), '[ \t\r\n]+', ' ', 'g'), '([.;:!?]) ', '\1' || chr(10), 'g'), chr(29), chr(10)), chr(10)) FROM d),
each AS (SELECT rid, way, i, trim(regexp_replace(lower(p[i]), '[^a-z0-9]+', ' ', 'g')) AS sentence
         FROM (SELECT rid, way, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
seqs AS (SELECT rid, way, list(id ORDER BY i) AS ids FROM each JOIN known USING (sentence) GROUP BY rid, way),
r0 AS (SELECT rid, way, array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '') AS s, CAST([] AS INTEGER[]) AS hit FROM seqs),
{", ".join(steps)},
hits AS (SELECT rid, unnest(hit) AS h FROM r{len(rules)}),
names AS (SELECT rid, array_to_string(list_sort(list_distinct(list(({rule_names})[h]))), ',') AS rules,
                 array_to_string(list_sort(list_distinct(list(({license_names})[h]))), ',') AS licenses FROM hits GROUP BY rid),
longest AS (SELECT rid, arg_max(ids, len(ids) * 2 + CASE WHEN way = 'line' THEN 1 ELSE 0 END) AS ids FROM seqs GROUP BY rid)
SELECT doc_id, coalesce(len(ids), 0)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN longest USING (rid) LEFT JOIN names USING (rid)
"""
