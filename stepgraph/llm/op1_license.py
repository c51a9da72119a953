"""Licence scans by sentence rules.

Each text is cut into sentences, a normalised sentence is looked up among known licence sentences, and the sequence
of identifiers found is matched against an ordered list of licence rules: the first rule takes the identifiers that
it matches, later rules see what is left. All of it is a chain of column functions on one row: no shuffle, no
Python, and a hot source or a repeated text costs no more than any other row.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

# Known licence sentences in normal form (lower case, letters and digits, single spaces) and their ids.
SENTENCES = {
    "licensed under the apache license version 2 0": "ApacheRef",
    "licensed under the apache license version 2 0 the license": "ApacheRef",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "this software is released under the mit license": "MitRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied": "AsIs",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdNames",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "IscGrant",
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "licensed under the gnu general public license version 3": "Gpl3Ref",
    "this work is licensed under the gnu general public license version 2": "Gpl2Ref",
    "licensed under the gnu general public license version 2": "Gpl2Ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GplGrant",
    "either version 3 of the license or at your option any later version": "Gpl3Later",
    "either version 2 of the license or at your option any later version": "Gpl2Later",
    "licensed under the gnu lesser general public license version 2 1": "Lgpl21Ref",
    "licensed under the gnu lesser general public license version 3": "Lgpl3Ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "Mpl2Ref",
    "licensed under cc by 4 0": "CcByRef",
    "licensed under cc by sa 4 0": "CcBySaRef",
    "licensed under cc by nc 4 0": "CcByNcRef",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcByRef",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CcBySaRef",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "this work is dedicated to the public domain": "PublicDomain",
    "all rights reserved": "Reserved",
}

# The rules in their order; a rule is a sequence of identifiers that stand one after the other.
RULES = (
    ("Apache-2.0", ("ApacheRef", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("ApacheRef",)),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNames", "AsIs")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNames")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "AsIs")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("MIT", ("MitGrant", "MitNotice", "AsIs")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("MIT", ("MitRef",)),
    ("ISC", ("IscGrant", "AsIs")),
    ("ISC", ("IscGrant",)),
    ("GPL-3.0-or-later", ("GplGrant", "Gpl3Later")),
    ("GPL-2.0-or-later", ("GplGrant", "Gpl2Later")),
    ("GPL-3.0", ("Gpl3Ref",)),
    ("GPL-2.0", ("Gpl2Ref",)),
    ("LGPL-2.1", ("Lgpl21Ref",)),
    ("LGPL-3.0", ("Lgpl3Ref",)),
    ("MPL-2.0", ("Mpl2Ref",)),
    ("CC-BY-4.0", ("CcByRef",)),
    ("CC-BY-SA-4.0", ("CcBySaRef",)),
    ("CC-BY-NC-4.0", ("CcByNcRef",)),
    ("Unlicense", ("Unlicense",)),
    ("Public-Domain", ("PublicDomain",)),
    ("All-Rights-Reserved", ("Reserved",)),
)

# Full sentences of licence texts as they stand in files, beside those above; a scan of whole licences knows both.
_GNU = "this {} is free software you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation"
WHOLE_SENTENCES = SENTENCES | {
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "ApacheHead",
    "the asf licenses this file to you under the apache license version 2 0 the license you may not use this file except in compliance with the license": "ApacheHead",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "AsIs",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "AsIs",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "AsIs",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    f"{_GNU.format('program', '')} either version 3 of the license or at your option any later version": "Gpl3Grant",
    f"{_GNU.format('program', '')} either version 2 of the license or at your option any later version": "Gpl2Grant",
    f"{_GNU.format('program', '')} version 2 of the license": "Gpl2Ref",
    f"{_GNU.format('program', '')} version 3 of the license": "Gpl3Ref",
    f"{_GNU.format('library', 'lesser ')} either version 2 1 of the license or at your option any later version": "Lgpl21Grant",
    f"{_GNU.format('library', 'lesser ')} either version 3 of the license or at your option any later version": "Lgpl3Grant",
}

WHOLE_RULES = (
    ("Apache-2.0", ("ApacheHead", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("ApacheHead",)),
    ("GPL-3.0-or-later", ("Gpl3Grant",)),
    ("GPL-2.0-or-later", ("Gpl2Grant",)),
    ("LGPL-2.1-or-later", ("Lgpl21Grant",)),
    ("LGPL-3.0-or-later", ("Lgpl3Grant",)),
    *RULES,
)

#: A sentence ends at a line break, or at . ! ? ; or : before white space or the end of the text; a run of marks is
#: looked at once.
BREAK = r"[\r\n]+|(?<![.!?;:])[.!?;:]++(?:[ \t\r\n]++|$)"


#: From a lower-case text to words with P for blank lines and L for other breaks, step by step; each step takes time in
#: proportion to the text, whatever it repeats.
TO_BREAKS = (
    (r"\r\n?", "\n"),
    (r"\n[^a-z0-9\n]*\n", " P "),
    (r"\n+|[.!?;:]([ \t\n]|\z)", " L "),
    (r"[^a-z0-9PL]+", " "),
    (r"L[L ]*", "L"),
    (r"P[PL ]*", "P"),
    (r" ?L? ?P", "P"),
    (r" ?L", "L"),
    (r"^ | \z", ""),
)


def normalised(text: Column) -> Column:
    """Sentences of a text in normal form, in their order, with empty ones left out."""
    plain = F.transform(F.split(F.lower(text), BREAK), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    return F.filter(plain, lambda s: F.length(s) > 0)


def known_in_whole(text: Column, sentences: dict[str, str]) -> Column:
    """Known sentences of a text in their order, wherever its lines are broken.

    A known sentence begins and ends at a break (BREAK or a blank line) and may go on over breaks that are not blank
    lines, so it is found wrapped, behind comment marks, and with ; : or 'v.' inside. Of several the longest counts.
    """
    if not sentences:
        return F.array().cast("array<string>")
    plain = F.lower(text)
    for pattern, by in TO_BREAKS:
        plain = F.regexp_replace(plain, pattern, by)
    some = "|".join(s.replace(" ", "[ L]") for s in _longest(sentences))
    found = F.regexp_extract_all(plain, F.lit(f"(?<![a-z0-9 ])(?:[0-9a-z] )?({some})(?![a-z0-9 ])"), 1)
    none = F.array().cast("array<string>")
    known = F.coalesce(F.transform(found, lambda s: F.replace(s, F.lit("L"), F.lit(" "))), none)
    # a text that lacks all of these words holds no known sentence
    lower = F.lower(text)
    some_word = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in words_of_all(sentences)])
    return F.when(some_word, known).otherwise(none)


def words_of_all(sentences: dict[str, str]) -> list[str]:
    """Some long words of which every sentence holds one: again and again the word that most of the others hold."""
    left, out = [{w for w in s.split() if len(w) >= min(7, max(map(len, s.split())))} for s in sentences], []
    while left:
        counts = Counter(w for s in left for w in s)
        out.append(max(counts, key=lambda w: (counts[w], len(w), w)))
        left = [s for s in left if out[-1] not in s]
    return out


def _longest(sentences: dict[str, str]) -> list[str]:
    return sorted(sentences, key=lambda s: (-len(s), s))


def scan(docs: DataFrame, text: str = "text", sentences: dict[str, str] | None = None, rules=None, whole: bool = False) -> DataFrame:
    """docs with what the rules recognise.

    Adds n_sentences, sentence_ids (identifiers of the known sentences in order), n_unmatched (identifiers that no
    rule takes) and licenses (names in the rules' order, each once). A null or empty text has no sentences and no
    licences; repeated rows give repeated results; other columns stay as they are, and columns of docs with one of
    the four names are replaced. Identifiers follow each other when no other known sentence stands between them.

    whole: known sentences may go on over line breaks and over ; and : (known_in_whole), and full licence texts are
    known; n_sentences stays the number of pieces between breaks. The query scans so.
    """
    if sentences is None:
        sentences = WHOLE_SENTENCES if whole else SENTENCES
    if rules is None:
        rules = WHOLE_RULES if whole else RULES
    table = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    known = known_in_whole(F.col(text), sentences) if whole else F.filter(F.col("_sentences"), lambda s: s.isin(*sentences))
    out = docs.withColumn("_sentences", F.coalesce(normalised(F.col(text)), F.array().cast("array<string>")))
    out = out.withColumn("n_sentences", F.size("_sentences").cast("long"))
    out = out.withColumn("sentence_ids", F.transform(known, lambda s: F.element_at(table, s)))
    # The fold over the rules runs on texts of identifiers: ",A,,B," so that neighbours never share a comma.
    left = F.concat(F.lit(""), F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit(","), i, F.lit(","))), ""))
    out = out.withColumn("_left", left)
    names: list[Column] = []
    for k, (name, ids) in enumerate(rules):
        want = "".join(f",{i}," for i in ids)
        names.append(F.when(F.contains(F.col(f"_left{k - 1}" if k else "_left"), F.lit(want)), F.lit(name)))
        out = out.withColumn(f"_left{k}", F.replace(F.col(f"_left{k - 1}" if k else "_left"), F.lit(want), F.lit("|")))
    last = f"_left{len(rules) - 1}" if rules else "_left"
    out = out.withColumn("licenses", F.array_distinct(F.filter(F.array(*names), lambda n: n.isNotNull())) if names else F.array().cast("array<string>"))
    out = out.withColumn("n_unmatched", F.regexp_count(F.col(last), F.lit(",[A-Za-z0-9]+,")).cast("long"))
    return out.drop("_sentences", "_left", *[f"_left{k}" for k in range(len(rules))])


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document: doc_id, n_sentences, sentence_ids and licenses (comma-joined), n_unmatched."""
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), whole=True)
    return found.select("doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "n_unmatched")


def _oracle() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in WHOLE_SENTENCES.items())
    plain = "lower(coalesce(text, ''))"
    for pattern, by in TO_BREAKS:
        plain = f"regexp_replace({plain}, E'{pattern.replace(chr(92), chr(92) * 2)}', E'{by.replace(chr(10), chr(92) + 'n')}', 'g')"
    # each break stands twice, so that one ends a sentence and one begins the next
    some = "|".join(s.replace(" ", "(?: |LL)") for s in _longest(WHOLE_SENTENCES))
    ctes = ["r0 AS (SELECT doc_id, n_sentences, sentence_ids, l0, [] :: VARCHAR[] AS found FROM ids)"]
    for n, (name, ids) in enumerate(WHOLE_RULES):
        want = "".join(f",{i}," for i in ids)
        ctes.append(f"r{n + 1} AS (SELECT doc_id, n_sentences, sentence_ids, replace(l{n}, '{want}', '|') AS l{n + 1}, CASE WHEN contains(l{n}, '{want}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM r{n})")
    last = len(WHOLE_RULES)
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
cut AS (SELECT rid, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[\\r\\n]+|[.!?;:]+(?:[ \\t\\r\\n]+|$)')) AS part FROM docs),
norm AS (SELECT rid, count(*) FILTER (WHERE length(trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g'))) > 0) AS n_sentences FROM cut GROUP BY rid),
marked AS (SELECT rid, 'L' || regexp_replace({plain}, '([PL])', '\\1\\1', 'g') || 'L' AS plain FROM docs),
hits AS (SELECT rid, regexp_extract_all(plain, '[PL](?:[0-9a-z] )?({some})[PL]', 1) AS hits FROM marked),
hit AS (SELECT rid, replace(unnest(hits), 'LL', ' ') AS s, generate_subscripts(hits, 1) AS pos FROM hits),
found AS (SELECT rid, string_agg(k.id, ',' ORDER BY pos) AS sentence_ids, string_agg(',' || k.id || ',', '' ORDER BY pos) AS l0 FROM hit JOIN known k ON s = k.sentence GROUP BY rid),
ids AS (SELECT doc_id, n_sentences, coalesce(sentence_ids, '') AS sentence_ids, coalesce(l0, '') AS l0 FROM docs JOIN norm USING (rid) LEFT JOIN found USING (rid)),
{", ".join(ctes)}
SELECT doc_id, n_sentences, sentence_ids, array_to_string(found, ',') AS licenses,
  CAST(len(regexp_extract_all(l{last}, ',[A-Za-z0-9]+,')) AS BIGINT) AS n_unmatched FROM r{last}"""


ORACLE_SQL = _oracle()
