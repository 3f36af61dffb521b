"""License scans: sentences become identifiers, and identifier sequences are matched against ordered rules; DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

# Known license sentences in normal form (lower case, words and numbers with single spaces).
SENTENCES = {
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind",
    "apache2-licensed": "licensed under the apache license version 2 0",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-obtain": "you may obtain a copy of the license at",
    "gpl3-licensed": "this work is licensed under the gnu general public license version 3",
    "gpl2-licensed": "this work is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-version3": "either version 3 of the license or at your option any later version",
    "gpl-version2": "either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "lgpl3-licensed": "this work is licensed under the gnu lesser general public license version 3",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc4-licensed": "licensed under cc by nc 4 0",
    "cc-by4-licensed": "licensed under cc by 4 0",
    "cc-by-sa4-licensed": "licensed under cc by sa 4 0",
    "cc0-dedicated": "this work is dedicated to the public domain under cc0 1 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
}

# Rules in order, the more special first: name, identifiers that must follow each other in this order.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache2-licensed", "apache2-comply", "apache2-obtain")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-version3", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-version3")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-version2")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("Apache-2.0", ("apache2-licensed",)),
    ("GPL-3.0-only", ("gpl3-licensed",)),
    ("GPL-2.0-only", ("gpl2-licensed",)),
    ("LGPL-3.0-only", ("lgpl3-licensed",)),
    ("MPL-2.0", ("mpl2-subject",)),
    ("CC-BY-NC-4.0", ("cc-by-nc4-licensed",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4-licensed",)),
    ("CC-BY-4.0", ("cc-by4-licensed",)),
    ("CC0-1.0", ("cc0-dedicated",)),
    ("ISC", ("isc-grant",)),
)

# Sentences of whole license texts beyond the table above, which ORACLE holds as well, and rules tried after RULES.
TEXT_SENTENCES = {
    "lgpl-free": "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl-version21": "either version 2 1 of the license or at your option any later version",
}
TEXT_RULES = (
    ("LGPL-3.0-or-later", ("lgpl-free", "gpl-version3")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-version21")),
)

#: Sentences that are found wherever they stand, as license texts go on after them or hold stops inside them. The others
#: ("licensed under ...") must be whole sentences, as more words may change what they say.
ANYWHERE = {
    "mit-grant", "mit-notice", "as-is", "apache2-comply", "apache2-obtain", "gpl-free", "gpl-version3", "gpl-version2", "gpl-hope", "mpl2-subject",
    "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "isc-grant", "lgpl-free", "lgpl-version21",
}

# Other wordings in license texts, and the sentence that each stands for; * is up to 12 words, a last ! forbids "or" after it.
WORDINGS = (
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache2-licensed", "apache2-comply")),
    ("licenses this file to you under the apache license version 2 0 the license", ("apache2-licensed",)),
    ("under the terms of the gnu general public license version 2 as published by the free software foundation !", ("gpl2-licensed",)),
    ("under the terms of the gnu general public license version 3 as published by the free software foundation !", ("gpl3-licensed",)),
    ("under the terms of the gnu general public license as published by the free software foundation version 2 of the license !", ("gpl2-licensed",)),
    ("under the terms of the gnu general public license as published by the free software foundation version 3 of the license !", ("gpl3-licensed",)),
    ("is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gpl-free",)),
    ("gnu lesser general public license version 3 29 june 2007", ("lgpl3-licensed",)),
    ("neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("bsd-endorse",)),
    ("the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission", ("bsd-endorse",)),
    ("permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("isc-grant",)),
    ("you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public license", ("cc-by4-licensed",)),
    ("you accept and agree to be bound by the terms and conditions of this creative commons attribution sharealike 4 0 international public license", ("cc-by-sa4-licensed",)),
    ("you accept and agree to be bound by the terms and conditions of this creative commons attribution noncommercial 4 0 international public license", ("cc-by-nc4-licensed",)),
    ("affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright and related rights", ("cc0-dedicated",)),
)

#: A sentence ends at a line's end, or at a full stop and the like before white space.
SENTENCE_END = r"[\r\n]+|[.!?;:][ \t]+"
#: Words one of which each known sentence holds, with any signs between them; other sentences needn't be normalised.
TELLING = r"(?i)licens|permi|copyright|warrant|redistribut|compliance|free[^a-z0-9]+software|any[^a-z0-9]+later[^a-z0-9]+version|public[^a-z0-9]+domain|endorse"


def normal(sentence):
    """Lower case with one space between words and numbers."""
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^a-z0-9]+", " "))


#: Between two words: anything; and, inside a sentence that must be whole, no sentence's end but one line break.
GAP, LINE_GAP = "[^a-z0-9]++", r"(?![a-z0-9])[^a-z0-9\r\n.!?;:]*+(?:[.!?;:](?![ \t\r\n])[^a-z0-9\r\n.!?;:]*+)?(?:\r?\n[^a-z0-9\r\n.!?;:]*+)?"


def anywhere(wording: str) -> str:
    """A pattern of the wording's words, whatever stands between them: wraps, comment signs, quotes, stops."""
    found = "(?i)(?<![a-z0-9])"
    for k, word in enumerate(wording.split()):
        found += f"(?!{GAP}or(?![a-z0-9]))" if word == "!" else f"(?:{GAP}[a-z0-9]++){{1,12}}?" if word == "*" else (GAP if k else "") + word
    return found + "(?![a-z0-9])"


def whole(sentence: str) -> str:
    """A pattern of the sentence where it is a whole one, which may be wrapped at single line breaks."""
    return r"(?i)(^|[\r\n]|[.!?;:][ \t])[^a-z0-9\r\n.!?;:]*+" + LINE_GAP.join(sentence.split()) + r"(?=[^a-z0-9\r\n]*?(?:[\r\n]|$|[.!?;:][ \t]))"


def isolated(text, known: dict[str, str]):
    """The text with each known sentence, as wrapped and punctuated as it may be, in normal form on a line of its own."""
    for wording, names in WORDINGS:
        if set(names) <= set(known):
            text = F.regexp_replace(text, anywhere(wording), "\n" + "\n".join(known[n] for n in names) + "\n")
    for name, sentence in known.items():
        words = " ".join(re.findall("[a-z0-9]+", sentence))
        if words:
            text = F.regexp_replace(text, anywhere(words), f"\n{sentence}\n") if name in ANYWHERE else F.regexp_replace(text, whole(words), f"$1\n{sentence}\n")
    return text


def scan_licenses(docs: DataFrame, *, sentences=None, rules=RULES + TEXT_RULES) -> DataFrame:
    """Finds licenses of whole texts. docs: doc_id, text, others are ignored; returns a row per row:
    doc_id, n_sentences (known ones), sentence_ids (in order, repeats kept), rule_numbers, licenses, license.

    Known sentences are first put on lines of their own, so wrapped license texts with comment signs are read as well. Then
    each sentence's normal form is looked up; unknown sentences don't break a sequence. A rule matches if its
    identifiers follow each other in the document's sequence; rules are tried in order and one that matches
    takes its identifiers away, all places of them at once, so that a special rule hides the general ones it holds.
    licenses: names of matched rules in the order of rules, each once; license: the first, else null. Null and
    empty texts have no sentences. A row is judged alone: no shuffle, no join.
    """
    known = sentences or SENTENCES | TEXT_SENTENCES
    parts = F.split(isolated(text_or_empty(), known), SENTENCE_END)
    lookup = F.create_map(*(F.lit(x) for name, sentence in known.items() for x in (sentence, name)))
    told = F.filter(parts, lambda s: s.rlike(TELLING)) if sentences is None else parts
    ids = F.filter(F.transform(told, lambda s: F.try_element_at(lookup, normal(s))), lambda i: i.isNotNull())
    df = docs.select("doc_id", F.when(F.lit(sentences is not None) | text_or_empty().rlike(TELLING), ids).otherwise(F.array().cast("array<string>")).alias("sentence_ids"))
    df = df.withColumn("rest", F.concat(F.lit("|"), F.array_join("sentence_ids", "||"), F.lit("|")))
    hit = []
    for i, (_, ids_of) in enumerate(rules):
        wanted = "|" + "||".join(ids_of) + "|"
        df = df.withColumn(f"hit{i}", F.contains("rest", F.lit(wanted))) if len(ids_of) else df.withColumn(f"hit{i}", F.lit(False))
        if any(len(r[1]) and set(r[1]) & set(ids_of) for r in rules[i + 1 :]):
            df = df.withColumn("rest", F.when(F.col(f"hit{i}"), F.replace("rest", F.lit(wanted), F.lit("#"))).otherwise(F.col("rest")))
        hit.append(F.when(F.col(f"hit{i}"), F.lit(i + 1)))
    numbers = F.filter(F.array(*hit), lambda x: x.isNotNull())
    names = F.array(*(F.lit(name) for name, _ in rules))
    df = df.withColumn("rule_numbers", numbers).withColumn("licenses", F.array_distinct(F.transform("rule_numbers", lambda i: F.element_at(names, i))))
    return df.select("doc_id", F.size("sentence_ids").alias("n_sentences"), "sentence_ids", "rule_numbers", "licenses", F.try_element_at("licenses", F.lit(1)).alias("license"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licenses", " ").alias("licenses"), "license")


def _oracle() -> str:
    values = ", ".join(f"('{s}', '{n}')" for n, s in SENTENCES.items())
    rest, steps = "rest0", []
    for i, (_, ids) in enumerate(RULES):
        wanted = "|" + "||".join(ids) + "|"
        steps.append(f"s{i + 1} AS (SELECT *, contains(rest{i}, '{wanted}') AS hit{i + 1}, replace(rest{i}, '{wanted}', '#') AS rest{i + 1} FROM s{i})")
    rest = ", ".join(f"CASE WHEN hit{i + 1} THEN '{name}' END" for i, (name, _) in enumerate(RULES))
    return f"""
WITH known(sentence, name) AS (VALUES {values}),
parts AS (SELECT rowid AS r, unnest(regexp_split_to_array(coalesce(text, ''), '[\\r\\n]+|[.!?;:][ \\t]+')) AS sentence, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '[\\r\\n]+|[.!?;:][ \\t]+'), 1) AS pos FROM (SELECT row_number() OVER () AS rowid, text FROM documents)),
ids AS (SELECT r, list(name ORDER BY pos) AS ids FROM parts JOIN known ON known.sentence = trim(regexp_replace(lower(parts.sentence), '[^a-z0-9]+', ' ', 'g')) GROUP BY r),
s0 AS (SELECT d.doc_id, coalesce(ids, []) AS ids, '|' || array_to_string(coalesce(ids, []), '||') || '|' AS rest0 FROM (SELECT row_number() OVER () AS rowid, doc_id FROM documents) d LEFT JOIN ids ON d.rowid = ids.r),
{', '.join(steps)},
f AS (SELECT doc_id, ids, list_filter([{rest}], lambda x: x IS NOT NULL) AS names FROM s{len(RULES)}),
g AS (SELECT *, list_filter(names, lambda x, i: list_position(names, x) = i) AS licenses FROM f)
SELECT doc_id, len(ids)::INTEGER AS n_sentences, array_to_string(ids, ' ') AS sentence_ids, array_to_string(licenses, ' ') AS licenses, licenses[1] AS license FROM g
"""


ORACLE = _oracle()
