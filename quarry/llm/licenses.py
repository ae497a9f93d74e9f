"""Operator 5: licence recognition by sentence identifiers and ordered rules. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import read

#: Known licence sentences, normalised, by identifier (fixed values from the public licence texts).
SENTENCES = {
    "mit-title": ["the mit license", "mit license", "the mit license mit"],
    "mit-ref": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license", "spdx license identifier mit"],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    ],
    "no-liability": [
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ],
    "isc-grant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
    ],
    "isc-as-is": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": [
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ],
    "bsd-binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "bsd-names": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "bsd3-ref": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license", "spdx license identifier bsd 3 clause"],
    "apache-ref": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license",
        "released under the apache license version 2 0",
        "this project is licensed under the apache license 2 0",
        "spdx license identifier apache 2 0",
    ],
    "apache-comply": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "gpl3-ref": [
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
        "released under the gnu general public license version 3",
        "spdx license identifier gpl 3 0 only",
    ],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl-hope": [
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
    ],
    "mpl-ref": ["this source code form is subject to the terms of the mozilla public license v 2 0", "spdx license identifier mpl 2 0"],
    "cc-by-ref": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa-ref": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc-ref": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc0-ref": ["licensed under cc0 1 0", "released under cc0 1 0"],
    "public-domain": ["this is free and unencumbered software released into the public domain"],
    "unlicense-any": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "reserved": ["all rights reserved"],
}

#: Rules in the order they are tried: (licence, its sentences in order). What a rule matches is used up.
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "as-is", "no-liability")),
    ("MIT", ("mit-grant", "mit-notice", "as-is", "no-liability")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-ref", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-ref",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("MPL-2.0", ("mpl-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("Unlicense", ("public-domain", "unlicense-any")),
    ("Unlicense", ("public-domain",)),
    ("BSD-3-Clause", ("bsd3-ref",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-title",)),
    ("Proprietary", ("reserved",)),
)

#: Where a sentence ends in the SQL: at a stop before white space, or at the end of a line. marked() has these breaks too, and lets a known sentence go on over them.
SPLIT = r"[.!?:]+[ \t\r\n]+|[\r\n]+"
#: Every known sentence has one of these; other texts are not split.
MARK = r"(?i)licen|spdx|permission|redistribution|copyright|warrant|liable|mozilla|public[^a-z0-9]+domain|anyone[^a-z0-9]+is[^a-z0-9]+free|rights[^a-z0-9]+reserved|released[^a-z0-9]+under"


def _ids() -> dict[str, str]:
    return {s: name for name, sentences in SENTENCES.items() for s in sentences}


def _sentences() -> str:
    """A pattern of all known sentences, longest first, in texts as marked() leaves them: from one break to another, over soft breaks inside."""
    return r"(?<=[|/] )(?:" + "|".join(x.replace(" ", r" (?:\| )?") for x in sorted(_ids(), key=lambda x: (-len(x), x))) + r")(?= [|/])"


def marked(text: Column) -> Column:
    """The text as lower-case words with its breaks: / for a blank line (or one of comment marks only), | where a sentence or a line ends."""
    lines = F.regexp_replace(F.regexp_replace(text, "[\u0001\u0002]", " "), "\r\n?", "\n")
    hard = F.regexp_replace(lines, r"\n[^A-Za-z0-9\n]*+\n[^A-Za-z0-9]*+", "\u0001")
    soft = F.regexp_replace(hard, r"\n|[.!?:;]+(?=[ \t\u0001])", "\u0002")
    words = F.regexp_replace(soft, "[^A-Za-z0-9\u0001\u0002]+", " ")
    breaks = F.regexp_replace(words, "[ \u0002]*\u0001[ \u0001\u0002]*", " / ")
    return F.concat(F.lit("/ "), F.trim(F.lower(F.regexp_replace(breaks, " *\u0002[ \u0002]*", " | "))), F.lit(" /"))


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of the text, in their order."""
    known = F.create_map(*[F.lit(x) for pair in sorted(_ids().items()) for x in pair])
    runs = F.regexp_extract_all(marked(text), F.lit(_sentences()), F.lit(0))
    ids = F.transform(runs, lambda s: F.try_element_at(known, F.replace(s, F.lit(" |"), F.lit(""))))
    return F.when(text.rlike(MARK), F.filter(ids, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def recognise_licences(docs: DataFrame) -> DataFrame:
    """Adds sentence_ids (in order), licences (distinct, sorted) and leftover (identifiers no rule used) to docs (text, ...).

    Texts are normalised to lower-case words, and known sentences of a fixed table are found from one break (a stop, colon, semicolon, line or paragraph end) to another; lines that were wrapped and stops inside a
    known sentence do not cut it, blank lines do; the identifiers form one sequence, unknown sentences left out. Rules are tried in order; each takes
    every place where its identifiers follow one another and uses them up, so a full text is not also reported as the shorter notice inside it. All in one pass, without a shuffle. Null and empty texts
    have no sentences and no licences. Columns of the added names are replaced.
    """
    out = docs.drop("sentence_ids", "licences", "leftover", "_seq", "_found").withColumn("sentence_ids", F.coalesce(sentence_ids(F.col("text")), F.array().cast("array<string>")))
    seq, found = F.concat(F.lit(";"), F.array_join("sentence_ids", ";;"), F.lit(";")), []
    out = out.withColumn("_seq", F.when(F.size("sentence_ids") > 0, seq).otherwise(F.lit("")))
    rest = F.col("_seq")
    marks = []
    for licence, ids in RULES:
        pattern = F.lit("".join(f";{i};" for i in ids))
        marks.append((licence, pattern))
    # One replacement for each rule; what it takes becomes the rule's number, which no later pattern contains.
    for number, (_, pattern) in enumerate(marks):
        rest = F.replace(rest, pattern, F.lit(f"<{number}>"))
    out = out.withColumn("_found", F.when(F.col("_seq") != "", rest).otherwise(F.lit("")))
    for number, (licence, _) in enumerate(marks):
        found.append(F.when(F.contains("_found", F.lit(f"<{number}>")), F.lit(licence)))
    licences = F.when(F.col("_seq") != "", F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))).otherwise(F.array().cast("array<string>"))
    left = F.filter(F.split(F.regexp_replace("_found", r"<\d+>", ""), ";+"), lambda x: x != "")
    return out.withColumn("licences", licences).withColumn("leftover", left).drop("_seq", "_found")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return recognise_licences(docs).select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licences"),
        F.array_join("leftover", ",").alias("leftover"),
    )


def _sql() -> str:
    known = ", ".join(f"('{s}', '{name}')" for s, name in sorted(_ids().items()))
    rest = "seq"
    for number, (_, ids) in enumerate(RULES):
        rest = f"replace({rest}, '{''.join(f';{i};' for i in ids)}', '<{number}>')"
    rules = ", ".join(f"({number}, '{licence}')" for number, (licence, _) in enumerate(RULES))
    return f"""
WITH known(sentence, id) AS (VALUES {known}), rules(number, licence) AS (VALUES {rules}), s AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS part
  FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{SPLIT}') AS parts FROM documents)
), n AS (
  SELECT doc_id, i, id FROM s JOIN known ON known.sentence = lower(trim(regexp_replace(part, '[^A-Za-z0-9]+', ' ', 'g')))
), q AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY i) AS ids, ';' || string_agg(id, ';;' ORDER BY i) || ';' AS seq FROM n GROUP BY doc_id
), f AS (
  SELECT *, {rest} AS found FROM q
), l AS (
  SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM f JOIN rules ON contains(found, '<' || number || '>') GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licences, '') AS licences,
       coalesce(array_to_string(list_filter(regexp_split_to_array(regexp_replace(found, '<[0-9]+>', '', 'g'), ';+'), lambda x: x <> ''), ','), '') AS leftover
FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN l USING (doc_id)
"""


OP5_SQL = _sql()
