"""Operator 2: licence scans by sentence rules.

A text is cut into sentences, each is normalised (lower case, only letters,
digits and dots inside numbers), and a sentence gets the identifiers of all known
licence sentences in it. What stands behind an SPDX tag is a sentence of its own
and read as an expression: names parted by OR, AND and WITH, brackets, "+". What
is left of the text is the sequence of these identifiers; ordered rules, most
specific first, turn stretches of identifiers into licences and use them up.
Identifiers that no rule uses are reported as unmatched parts, so an incomplete
notice or an unknown SPDX name is visible. "All rights reserved" supports a
notice; it is a licence (Proprietary) only where the text has no other.

Everything is a projection: no shuffle, one row in, one row out. Texts without
any licence word are not cut up. Patterns have neither look-around nor repeated
groups, so they mean the same in SQL and never recurse on long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from progscan.llm.common import let, table, text_or_empty
from progscan.llm.registry import job

# Sentences of public licence notices, normalised, as patterns. One identifier per sentence.
SENTENCES = [
    ("Agpl3Work", "licensed under the (?:gnu )?(?:agpl|affero general public license)(?: version| v)? ?3(?:.0)?"),
    ("Lgpl3Work", "licensed under the (?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? ?3(?:.0)?"),
    ("Lgpl21Work", "licensed under the (?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? ?2.1"),
    ("Gpl3Work", "licensed under the (?:gnu )?(?:gpl|general public license)(?: version| v)? ?3(?:.0)?"),
    ("Gpl2Work", "licensed under the (?:gnu )?(?:gpl|general public license)(?: version| v)? ?2(?:.0)?"),
    ("Gpl3Later", "redistribute it and or modify it under the terms of the gnu general public license as published by "
                  "the free software foundation either version 3 of the license or at your option any later version"),
    ("Gpl2Later", "redistribute it and or modify it under the terms of the gnu general public license as published by "
                  "the free software foundation either version 2 of the license or at your option any later version"),
    ("Lgpl21Later", "redistribute it and or modify it under the terms of the gnu lesser general public license as "
                    "published by the free software foundation either version 2.1 of the license or at your option "
                    "any later version"),
    ("GplNoWarranty", "distributed in the hope that it will be useful but without any warranty without even the implied "
                      "warranty of merchantability or fitness for a particular purpose"),
    ("GplHope", "distributed in the hope that it will be useful but without any warranty"),
    ("GplFitness", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GplSee", "see the gnu (?:lesser )?general public license for more details"),
    ("GplCopy", "you should have received a copy of the gnu (?:lesser )?general public license along with this"),
    ("GplAddress", "if not see (?:http|https) www.gnu.org licenses"),
    ("Apache2", "licensed under the apache license version 2.0"),
    ("ApacheUse", "you may not use this file except in compliance with the license"),
    ("ApacheCopy", "you may obtain a copy of the license at"),
    ("ApacheWarranty", "unless required by applicable law or agreed to in writing software distributed under the license "
                       "is distributed on an as is basis without warranties or conditions of any kind either express "
                       "or implied"),
    ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
    ("MitRef", "(?:released|licensed|available|distributed) under the (?:terms of the )?mit license"),
    ("MitGrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                 "associated documentation files the software to deal in the software without restriction"),
    ("MitNotice", "the above copyright notice and this permission notice shall be included in all copies or substantial "
                  "portions of the software"),
    ("AsIsKind", "the software is provided as is without warranty of any kind express or implied"),
    ("MitLiable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("IscGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                 "hereby granted"),
    ("BsdRef", "(?:released|licensed|available|distributed) under the (?:terms of the )?(?:3 clause |new |modified )?bsd "
               "license"),
    ("BsdGrant", "redistribution and use in source and binary forms with or without modification are permitted provided "
                 "that the following conditions are met"),
    ("BsdSource", "redistributions of source code must retain the above copyright notice this list of conditions and the "
                  "following disclaimer"),
    ("BsdBinary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and "
                  "the following disclaimer"),
    ("BsdEndorse", "neither the name of .* nor the names of its contributors may be used to endorse or promote products"),
    ("BsdWarranty", "this software is provided by the copyright holders and contributors as is and any express or "
                    "implied warranties"),
    ("BsdLiable", "in no event shall the copyright holder or contributors be liable for any direct indirect"),
    ("Mpl2", "subject to the terms of the mozilla public license v(?:ersion)? ?2.0"),
    ("MplCopy", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("Epl2", "terms of the eclipse public license v(?:ersion)? ?2.0"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("Cc0", "(?:licensed|released|dedicated) (?:under|to) (?:the )?(?:cc0|creative commons zero)"),
    ("AllRights", "all rights reserved"),
]
_CC = [f"by{nc}{end}" for nc in ("", "-nc") for end in ("-nd", "-sa", "")][::-1]
CC_VERSIONS = ("4.0", "3.0", "2.5", "2.0")
_CC_WORDS = {"by": "attribution", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
# the Creative Commons family, by its rule of parts and versions; more parts first
SENTENCES += [
    (f"Cc-{kind}-{v}", "(?:licensed|released|available) under (?:a |the )?(?:cc|creative commons) (?:"
     + kind.replace("-", " ") + "|" + " ".join(_CC_WORDS[p] for p in kind.split("-")) + ")"
     + f" (?:license )?(?:version |v )?{v}")
    for v in CC_VERSIONS for kind in sorted(_CC, key=len, reverse=True)]
# Names of the public SPDX licence list.
SPDX = ["Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only",
        "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only",
        "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "Unlicense", "CC0-1.0", "0BSD", "AFL-3.0", "Artistic-2.0", "BSL-1.0",
        "CDDL-1.0", "EUPL-1.2", "MIT-0", "MPL-1.1", "MS-PL", "NCSA", "OFL-1.1", "PostgreSQL", "PSF-2.0", "WTFPL", "X11",
        "Zlib"]
SPDX += [f"CC-{kind.upper()}-{v}" for v in CC_VERSIONS for kind in _CC]
#: Lower-case name -> name; GNU names also in their older forms, without "-only" and with "+".
SPDX_NAMES = {x.lower(): x for x in SPDX}
SPDX_NAMES |= {x[:-len("-only")].lower(): x for x in SPDX if x.endswith("-only")}
SPDX_NAMES |= {x[:-len("-or-later")].lower() + "+": x for x in SPDX if x.endswith("-or-later")}

_GPL_REST = [["GplNoWarranty", "GplSee", "GplCopy", "GplAddress"], ["GplHope", "GplFitness", "GplSee", "GplCopy", "GplAddress"],
             ["GplNoWarranty", "GplSee", "GplCopy"], ["GplHope", "GplFitness", "GplSee", "GplCopy"],
             ["GplNoWarranty", "GplSee"], ["GplNoWarranty"], []]
_BSD2 = ["BsdGrant", "BsdSource", "BsdBinary"]
_BSD_REST = [["BsdWarranty", "BsdLiable"], ["BsdWarranty"], []]
#: Licence, identifier sequence; the first rule that fits takes its identifiers. Longer rules of a licence come first.
RULES = [
    *[(lic, [first, *rest]) for lic, first in (("GPL-3.0-or-later", "Gpl3Later"), ("GPL-2.0-or-later", "Gpl2Later"),
                                               ("LGPL-2.1-or-later", "Lgpl21Later")) for rest in _GPL_REST],
    *[("Apache-2.0", ["Apache2", "ApacheUse", "ApacheCopy", "ApacheWarranty", "ApacheSee"][:n]) for n in (5, 4, 3, 2, 1)],
    *[("BSD-3-Clause", [*_BSD2, "BsdEndorse", *rest]) for rest in _BSD_REST],
    *[("BSD-2-Clause", [*_BSD2, *rest]) for rest in _BSD_REST],
    ("BSD-3-Clause", ["BsdRef"]),
    ("MIT", ["MitRef", "MitGrant", "MitNotice", "AsIsKind", "MitLiable"]),
    *[("MIT", ["MitGrant", "MitNotice", "AsIsKind", "MitLiable"][:n]) for n in (4, 3, 2)],
    ("MIT", ["MitRef"]),
    ("ISC", ["IscGrant"]),
    ("MPL-2.0", ["Mpl2", "MplCopy"]), ("MPL-2.0", ["Mpl2"]), ("EPL-2.0", ["Epl2"]),
    ("AGPL-3.0-only", ["Agpl3Work"]), ("LGPL-3.0-only", ["Lgpl3Work"]), ("LGPL-2.1-only", ["Lgpl21Work"]),
    ("GPL-3.0-only", ["Gpl3Work"]), ("GPL-2.0-only", ["Gpl2Work"]),
    ("Unlicense", ["Unlicense"]), ("CC0-1.0", ["Cc0"]),
    *[(f"CC-{kind.upper()}-{v}", [f"Cc-{kind}-{v}"]) for v in CC_VERSIONS for kind in _CC],
    *[(x, [f"Spdx-{x}"]) for x in SPDX],
]
#: A sentence that is a licence only in texts without any other.
SUPPORT, SUPPORT_ALONE = "AllRights", "Proprietary"
#: Every sentence above has one of these words.
HINT = "(?i)licen[cs]e|permission|redistribut|warrant|unencumbered|reserved|copyright|mpl|endorse|licensed|released|dedicated"

_SPACE = "[\\x20\\x09-\\x0D]"
_BREAK = f"([.!?;]){_SPACE}+|\\n{_SPACE}*\\n"
#: A sentence also ends at a line of nothing but comment marks.
_COMMENT_LINE = "\\n[\\x20\\x09]*(?:[*#;%]+|//+|--+)[\\x20\\x09\\x0D]*\\n"
#: The rest of the line behind an SPDX tag is a sentence; U+0002 marks it.
_SPDX_TAG = "(?i)spdx-license-identifier:([^\\n]*)"
_SPDX_TOKEN = "[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
_OPERATORS = ("or", "and", "with")


def _spaced(pattern: str) -> str:
    """The pattern for sentences whose words have a space of their own on either side."""
    return " (?:" + pattern.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?") + ") "


_ANY = "|".join(_spaced(p) for _, p in SENTENCES)


def _normalised(sentence: Column) -> Column:
    """Lower case; letters, digits and dots between them, parted by single spaces."""
    plain = F.regexp_replace(F.lower(sentence), "[^a-z0-9.]+", " ")
    return F.trim(F.regexp_replace(plain, "\\.+( |$)|(^| )\\.+", " "))


def spdx_names(expression: Column) -> Column:
    """array<string>: the names in an SPDX expression; those in the list as they stand there.

    The expression ends before the first word that no operator joins to it. What follows WITH is an exception, no name.
    """
    known = F.create_map(*[F.lit(x) for pair in SPDX_NAMES.items() for x in pair])

    def names(t: Column) -> Column:
        joined = lambda i: F.lower(F.get(t, i)).isin(*_OPERATORS)
        broken = F.filter(F.transform(t, lambda x, i: F.when((i % 2 == 1) & ~joined(i), i)), lambda i: i.isNotNull())
        own = let(F.coalesce(F.get(broken, F.lit(0)), F.size(t)), lambda end: F.transform(t, lambda x, i: F.when(
            (i < end) & (i % 2 == 0) & ((i == 0) | (F.lower(F.get(t, i - 1)) != "with")),
            F.coalesce(F.try_element_at(known, F.lower(x)), x))))
        return F.filter(own, lambda x: x.isNotNull())

    return let(F.regexp_extract_all(expression, F.lit(_SPDX_TOKEN), F.lit(0)), names)


def identifiers(text: Column) -> Column:
    """array<struct<pos int, id string>>: the licence sentences of a text in order; pos counts its sentences.

    A sentence that holds several has all of them, in order of their place; where two begin alike or overlap, the
    first one stands, then the first of the list. SPDX names are "Spdx-" and the name.
    """
    def name(raw: Column) -> Column:
        found = F.when(F.lit(False), "")
        for i, pattern in SENTENCES:
            found = found.when(raw.rlike(f"^{_spaced(pattern)}$"), i)
        return found

    def all_of(s: Column, i: Column) -> Column:
        placed = lambda id_: F.struct(i.cast("int").alias("pos"), id_.alias("id"))

        def named(n: Column) -> Column:
            raws = F.regexp_extract_all(F.concat(F.lit(" "), F.replace(n, F.lit(" "), F.lit("  ")), F.lit(" ")),
                                        F.lit(_ANY), F.lit(0))
            return F.when(n.rlike(HINT), F.transform(raws, lambda r: placed(name(r)))).otherwise(none)

        return (F.when(s.startswith("\u0002"), F.transform(spdx_names(s), lambda x: placed(F.concat(F.lit("Spdx-"), x))))
                .otherwise(let(_normalised(s), named)))

    none = F.array().cast("array<struct<pos:int,id:string>>")
    tags = F.regexp_replace(F.translate(text, "\u0001\u0002", "  "), _SPDX_TAG, "\u0001\u0002$1\u0001")
    sentences = F.split(F.regexp_replace(F.regexp_replace(tags, _COMMENT_LINE, "\u0001\n"), _BREAK, "$1\u0001"), "\u0001")
    return F.when(text.rlike(HINT), F.flatten(F.transform(sentences, all_of))).otherwise(none)


def recognise(ids: Column) -> Column:
    """struct<licenses array<string>, unmatched array<string>> of a sequence of identifiers."""
    def by_rules(seq: Column) -> Column:
        for licence, rule in RULES:
            seq = F.replace(seq, F.lit("".join(f"<{x}>" for x in rule)), F.lit(f"[{licence}]"))
        return seq

    seq = F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    support = f"<{SUPPORT}>"
    chosen = let(seq, lambda q: let(by_rules(F.replace(q, F.lit(support), F.lit(""))), lambda r: F.when(
        r.contains("["), r).otherwise(F.replace(q, F.lit(support), F.lit(f"[{SUPPORT_ALONE}]")))))
    return let(chosen, lambda s: F.struct(F.regexp_extract_all(s, F.lit("\\[([^\\]]+)\\]"), F.lit(1)).alias("licenses"),
                                          F.regexp_extract_all(s, F.lit("<([^>]+)>"), F.lit(1)).alias("unmatched")))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentences array<struct<pos, id>>, licenses, unmatched) of every row of docs.

    licenses are in order of the text and repeat if the text repeats them. Null,
    empty and licence-free texts have three empty arrays. Other columns are
    ignored; an empty table gives an empty result.
    """
    found = docs.select(F.col(key).alias("k"), identifiers(text_or_empty(text)).alias("sentences"))
    return (found.withColumn("r", recognise(F.col("sentences")["id"]))
            .select(F.col("k").alias(key), "sentences", "r.licenses", "r.unmatched"))


def _oracle() -> str:
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    cases = "\n".join(f"WHEN regexp_full_match(raw, {lit(_spaced(p))}) THEN {lit(i)}" for i, p in SENTENCES)
    known = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in SPDX_NAMES.items())
    ops = ", ".join(map(lit, _OPERATORS))
    seq = f"replace(seq, '<{SUPPORT}>', '')"
    for licence, rule in RULES:
        seq = f"replace({seq}, {lit(''.join(f'<{x}>' for x in rule))}, {lit(f'[{licence}]')})"
    return f"""
WITH t AS (
  SELECT doc_id, regexp_replace(translate(text, chr(1) || chr(2), '  '), {lit(_SPDX_TAG)},
                                chr(1) || chr(2) || '\\1' || chr(1), 'g') AS t
  FROM documents WHERE regexp_matches(text, {lit(HINT)})),
c AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(t, {lit(_COMMENT_LINE)}, chr(1) || chr(10), 'g'),
                                             {lit(_BREAK)}, '\\1' || chr(1), 'g'), chr(1)) AS c FROM t),
s AS (SELECT doc_id, unnest(c) AS s, generate_subscripts(c, 1) AS pos FROM c),
n AS (
  SELECT doc_id, pos, trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'),
         '\\.+( |$)|(^| )\\.+', ' ', 'g')) AS n FROM s WHERE NOT starts_with(s, chr(2))),
m AS (
  SELECT doc_id, pos, regexp_extract_all(' ' || replace(n, ' ', '  ') || ' ', {lit(_ANY)}) AS m FROM n
  WHERE regexp_matches(n, {lit(HINT)})),
raws AS (SELECT doc_id, pos, unnest(m) AS raw, generate_subscripts(m, 1) AS place FROM m),
tokens AS (
  SELECT doc_id, pos, regexp_extract_all(s, {lit(_SPDX_TOKEN)}) AS k FROM s WHERE starts_with(s, chr(2))),
token AS (SELECT doc_id, pos, unnest(k) AS k, generate_subscripts(k, 1) AS place FROM tokens),
joined AS (
  SELECT *, lag(lower(k)) OVER w AS before,
         sum((place % 2 = 0 AND lower(k) NOT IN ({ops}))::INT) OVER w AS broken
  FROM token WINDOW w AS (PARTITION BY doc_id, pos ORDER BY place)),
i AS (
  SELECT doc_id, pos, place, CASE {cases} END AS id FROM raws
  UNION ALL
  SELECT doc_id, pos, place, 'Spdx-' || coalesce(CASE lower(k) {known} END, k) FROM joined
  WHERE place % 2 = 1 AND broken = 0 AND before IS DISTINCT FROM 'with'),
q AS (
  SELECT doc_id, string_agg('<' || id || '>', '' ORDER BY pos, place) AS seq,
         string_agg(id, ',' ORDER BY pos, place) AS ids, count(*) AS n FROM i GROUP BY doc_id),
r AS (SELECT *, {seq} AS by_rules FROM q),
f AS (
  SELECT doc_id, ids, n, CASE WHEN contains(by_rules, '[') THEN by_rules
                              ELSE replace(seq, '<{SUPPORT}>', '[{SUPPORT_ALONE}]') END AS f FROM r)
SELECT d.doc_id, coalesce(array_to_string(regexp_extract_all(f, '\\[([^\\]]+)\\]', 1), ','), '') AS licenses,
       coalesce(ids, '') AS identifiers, coalesce(n, 0) AS n_sentences,
       coalesce(array_to_string(regexp_extract_all(f, '<([^>]+)>', 1), ','), '') AS unmatched,
       coalesce(len(regexp_extract_all(f, '<([^>]+)>', 1)), 0) AS n_unmatched
FROM documents d LEFT JOIN f USING (doc_id)"""


@job("op2_license_sentences", _oracle())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"),
                        F.array_join("sentences.id", ",").alias("identifiers"),
                        F.size("sentences").cast("long").alias("n_sentences"),
                        F.array_join("unmatched", ",").alias("unmatched"),
                        F.size("unmatched").cast("long").alias("n_unmatched"))
