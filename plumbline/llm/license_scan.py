"""License scan by ordered signature rules (DataFrame functions only).

A text is lower-cased (A-Z) and reduced to its words.  A rule has a label, keywords, a regular
expression over words with one blank between them, and a priority (its place in the list, the
first wins).  Every match of a rule holds one of its keywords as a word, so a rule runs only on
texts that do: one intersection of the text's words with all keywords.  All places of all rules
are sorted by first word, longest first, then priority; a place that lies inside an earlier one is
suppressed.  The labels of the places left, and of the base phrases, are the result.

In the form that rules run on, words have two blanks between them, so that a match takes its own
blanks on either side and no look-around is needed: the same expressions run in any engine.

Null and empty texts have no words: zero counts, null places, empty label strings, score 0.
Every row is judged by itself, so repeated rows give repeated results and nothing is shuffled;
only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, read

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: License family -> (keywords, regex of its name).
FAMILIES: dict[str, tuple[str, str]] = {
    "mit-0": ("mit", "mit (?:0|no attribution)"),
    "mit": ("mit expat", "(?:mit|expat|mit expat)"),
    "apache-2": ("apache", "apache(?: software)?(?: license)?(?: version)? v?2(?: 0)?"),
    "apache-1.1": ("apache", "apache(?: software)?(?: license)?(?: version)? v?1 1"),
    "apache-1.0": ("apache", "apache(?: software)?(?: license)?(?: version)? v?1 0"),
    "agpl-3": ("agpl agpl3 agplv3", "(?:gnu )?agpl(?: version)? ?v?3(?: 0)?"),
    "lgpl-3": ("lgpl lgpl3 lgplv3", "(?:gnu )?lgpl(?: version)? ?v?3(?: 0)?"),
    "lgpl-2.1": ("lgpl lgpl2 lgplv2", "(?:gnu )?lgpl(?: version)? ?v?2 1"),
    "lgpl-2": ("lgpl lgpl2 lgplv2", "(?:gnu )?lgpl(?: version)? ?v?2(?: 0)?"),
    "gpl-3": ("gpl gpl3 gplv3", "(?:gnu )?gpl(?: version)? ?v?3(?: 0)?"),
    "gpl-2": ("gpl gpl2 gplv2", "(?:gnu )?gpl(?: version)? ?v?2(?: 0)?"),
    "gpl-1": ("gpl gpl1 gplv1", "(?:gnu )?gpl(?: version)? ?v?1(?: 0)?"),
    "agpl-3-long": ("affero", "gnu affero general public license(?: version)? v?3(?: 0)?"),
    "lgpl-3-long": ("lesser", "gnu lesser general public license(?: version)? v?3(?: 0)?"),
    "lgpl-2.1-long": ("lesser", "gnu lesser general public license(?: version)? v?2 1"),
    "lgpl-2-long": ("library", "gnu library general public license(?: version)? v?2(?: 0)?"),
    "gpl-3-long": ("gnu", "gnu general public license(?: version)? v?3(?: 0)?"),
    "gpl-2-long": ("gnu", "gnu general public license(?: version)? v?2(?: 0)?"),
    "gfdl": ("gnu", "gnu free documentation license(?: version)?(?: 1 [123])?"),
    "bsd-0": ("bsd 0bsd", "(?:bsd 0 clause|0bsd|zero clause bsd)"),
    "bsd-2": ("bsd freebsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    "bsd-3": ("bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd)"),
    "bsd-4": ("bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    "isc": ("isc", "isc"),
    "mpl-2": ("mpl mpl2 mplv2", "mpl(?: version)? ?v?2(?: 0)?"),
    "mpl-1.1": ("mpl mpl1 mplv1", "mpl(?: version)? ?v?1 1"),
    "mpl-2-long": ("mozilla", "mozilla public license(?: version)? v?2(?: 0)?"),
    "mpl-1.1-long": ("mozilla", "mozilla public license(?: version)? v?1 1"),
    "epl-2": ("eclipse", "eclipse public license(?: version)? v?2(?: 0)?"),
    "epl-1": ("eclipse", "eclipse public license(?: version)? v?1(?: 0)?"),
    "edl-1": ("eclipse", "eclipse distribution license(?: version)? v?1(?: 0)?"),
    "cddl-1.1": ("cddl cddl1 cddlv1", "cddl(?: version)? ?v?1 1"),
    "cddl-1": ("cddl cddl1 cddlv1", "cddl(?: version)? ?v?1(?: 0)?"),
    "cpl-1": ("common", "common public license(?: version)? v?1(?: 0)?"),
    "cpal-1": ("attribution", "common public attribution license(?: version)? v?1(?: 0)?"),
    "artistic-2": ("artistic", "artistic(?: license)?(?: version)? v?2(?: 0)?"),
    "artistic-1": ("artistic", "artistic(?: license)?(?: version)? v?1(?: 0)?"),
    "zlib": ("zlib", "zlib(?: libpng)?"),
    "libpng": ("libpng", "libpng"),
    "boost-1": ("boost", "boost software license(?: version)? 1(?: 0)?"),
    "unlicense": ("unlicense", "(?:the )?unlicense"),
    "wtfpl": ("wtfpl", "wtfpl"),
    "cc0-1": ("cc0", "(?:cc0|creative commons cc0)(?: 1 0)?"),
    "cc-by-nc-nd": ("cc", "cc by nc nd(?: [1234] [05])?"),
    "cc-by-nc-sa": ("cc", "cc by nc sa(?: [1234] [05])?"),
    "cc-by-nc": ("cc", "cc by nc(?: [1234] [05])?"),
    "cc-by-nd": ("cc", "cc by nd(?: [1234] [05])?"),
    "cc-by-sa": ("cc", "cc by sa(?: [1234] [05])?"),
    "cc-by": ("cc", "cc by(?: [1234] [05])?"),
    "cc-by-nc-nd-long": ("commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?"),
    "cc-by-nc-sa-long": ("commons", "creative commons attribution non ?commercial share ?alike"),
    "cc-by-nc-long": ("commons", "creative commons attribution non ?commercial"),
    "cc-by-nd-long": ("commons", "creative commons attribution no ?deriv(?:ative)?s?"),
    "cc-by-sa-long": ("commons", "creative commons attribution share ?alike"),
    "cc-by-long": ("commons", "creative commons attribution"),
    "ofl-1.1": ("sil", "sil open font license(?: version)?(?: 1 1)?"),
    "psf-2": ("python", "python software foundation license(?: version)?(?: 2)?"),
    "python-cnri": ("cnri", "cnri python"),
    "php-3": ("php", "php license(?: version)?(?: 3(?: 0[01]?)?)?"),
    "ruby": ("ruby", "ruby"),
    "vim": ("vim", "vim"),
    "openssl": ("openssl", "openssl"),
    "postgresql": ("postgresql", "postgresql"),
    "odbl-1": ("database", "open data ?commons open database license"),
    "odc-by-1": ("open", "open data ?commons attribution license"),
    "pddl-1": ("domain", "public domain dedication and license"),
    "ms-pl": ("microsoft", "microsoft public license"),
    "ms-rl": ("microsoft", "microsoft reciprocal license"),
    "eupl-1.2": ("union", "european union public licen[cs]e(?: version)? v?1 2"),
    "eupl-1.1": ("union", "european union public licen[cs]e(?: version)? v?1 1"),
    "osl-3": ("open", "open software license(?: version)? v?3(?: 0)?"),
    "afl-3": ("academic", "academic free license(?: version)? v?3(?: 0)?"),
    "ncsa": ("ncsa", "(?:university of illinois )?ncsa(?: open source)?"),
    "upl-1": ("upl permissive", "(?:universal permissive license|upl)(?: 1 0)?"),
    "bsl-1.1": ("business", "business source license(?: 1 1)?"),
    "sspl-1": ("server", "server side public license(?: version)?(?: 1)?"),
    "elastic-2": ("elastic", "elastic license(?: version)?(?: 2(?: 0)?)?"),
    "polyform-nc": ("polyform", "polyform non ?commercial(?: license)?"),
    "openrail": ("openrail openrailm", "(?:bigscience |creativeml )?openrail(?: ?m)?"),
    "beerware": ("beer beerware", "beer ?ware"),
}
#: Ways to grant a named license, most telling first: kind -> regex with the name at {}.
GRANTS = {
    "identifier": "spdx license identifier {}",
    "grant": "(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{}(?: licen[cs]e)?",
    "under": "under the {} licen[cs]e",
    "name": "(?:the )?{} licen[cs]e",
}
#: Sentences that stand for a license: label, keyword, regex.
SENTENCES = [
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "copyright", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "merchantability", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("isc", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", "the software is provided as is and the author disclaims all warranties"),
    ("bsd-3", "neither", "neither the name of(?: [^ ]+){1,20}? nor the names of its contributors"),
    ("bsd-2", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd-2", "contributors", "this software is provided by the (?:copyright holders|regents|author) and contributors as is"),
    ("bsd-4", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("zlib", "implied", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "misrepresented", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("apache-2", "apache", "apache license version 2(?: 0)?"),
    ("apache-2", "apache", "you may not use this file except in compliance with the license(?: [^ ]+){1,12}? apache"),
    ("apache-2", "conditions", "without warranties or conditions of any kind either express or implied"),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
    ("cc0-1", "dedicated", "dedicated to the public domain"),
    ("cc0-1", "waived", "has waived all copyright and related or neighbou?ring rights"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "jurisdictions", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate"),
    ("gpl-any", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-any", "gnu", "you should have received a copy of the gnu general public license"),
    ("gpl-any", "gnu", "gnu general public license"),
    ("gpl-2", "gnu", "gnu general public license(?: [^ ]+){0,8}? either version 2 of the license or"),
    ("gpl-3", "gnu", "gnu general public license(?: [^ ]+){0,8}? either version 3 of the license or"),
    ("lgpl-any", "lesser", "you should have received a copy of the gnu lesser general public license"),
    ("lgpl-any", "lesser", "gnu lesser general public license"),
    ("agpl-any", "affero", "you should have received a copy of the gnu affero general public license"),
    ("agpl-any", "affero", "gnu affero general public license"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1", "eclipse", "made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "eclipse", "made available under the terms of the eclipse public license(?: v)? 2 0"),
    ("boost-1", "boost", "distributed under the boost software license version 1 0"),
    ("boost-1", "derivative", "to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so"),
    ("artistic-2", "artistic", "the artistic license 2 0 applies to all software"),
    ("wtfpl", "public", "do what the fuck you want to public license"),
    ("beerware", "beer", "you can buy me a beer in return"),
    ("ofl-1.1", "reserved", "with reserved font name"),
    ("ofl-1.1", "font", "the fonts? (?:software|are|is) (?:are |is )?licensed under the sil open font license"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("php-3", "php", "this product includes php software freely available from"),
    ("psf-2", "python", "psf is making python available to licensee on an as is basis"),
    ("ncsa", "illinois", "developed by(?: [^ ]+){1,20}? university of illinois"),
    ("cc-by", "attribution", "this work is licensed under a creative commons attribution(?: [1234] 0)? (?:international|unported) license"),
    ("cc-by-sa", "sharealike", "this work is licensed under a creative commons attribution sharealike(?: [1234] 0)? (?:international|unported) license"),
    ("cc-by-nc", "noncommercial", "this work is licensed under a creative commons attribution noncommercial(?: [1234] 0)? (?:international|unported) license"),
    ("cc-by-nd", "noderivatives", "this work is licensed under a creative commons attribution noderivatives(?: [1234] 0)? (?:international|unported) license"),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("public-domain", "domain", "(?:is|are) (?:hereby )?(?:in|placed in|released into) the public domain"),
    ("proprietary", "reserved", "all rights reserved"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "permission", "may not be (?:reproduced|copied|distributed)(?: or (?:reproduced|copied|distributed))? without (?:the )?(?:prior |express |written )*permission"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution)(?: or [^ ]+)? (?:of this (?:file|software|material) )?(?:via any medium )?is strictly prohibited"),
    ("non-commercial", "commercial noncommercial", "for non ?commercial (?:use|purposes) only"),
    ("non-commercial", "personal", "for personal use only"),
    ("research-only", "research", "for research (?:use|purposes) only"),
]


def rules() -> list[tuple[str, str, str]]:
    """(label, keywords, regex) in order of priority: sentences, then each grant over all families, then bare names."""
    named = [(k.removesuffix("-long"), kws, g.format(f"(?:{name})")) for g in GRANTS.values() for k, (kws, name) in FAMILIES.items()]
    bare = [(k.removesuffix("-long"), kws, name) for k, (kws, name) in FAMILIES.items() if kws == "cc" or " license" in name]
    return [*SENTENCES, *named, *bare]


def spaced(regex: str) -> str:
    """A rule's regex for the form with two blanks between words and one at either end of the match."""
    return " " + regex.replace(" ?", "~").replace(" ", "  ").replace("~", "(?:  )?") + " "


def word_form(text) -> "F.Column":
    """The words of a text in lower case, each with a blank before and after it."""
    one = F.btrim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, " "))
    return F.when(one == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.replace(one, F.lit(" "), F.lit("  ")), F.lit(" ")))


def _n_words(piece):
    """Words of a piece of the form: two blanks lie between any two."""
    return F.when(piece == "", F.lit(0)).otherwise(F.length(piece) - F.length(F.replace(piece, F.lit("  "), F.lit(" "))) + 1)


def _places(form, regex):
    """First word, and first word after, of all places of a regex, from the words of matches and of the pieces between."""
    found = F.transform(F.regexp_extract_all(form, regex, F.lit(0)), _n_words)
    pieces = F.transform(F.split(form, regex), _n_words)
    both = F.zip_with(pieces, found, lambda b, n: F.struct(b.alias("b"), n.alias("n")))
    # running sums by slices: a text has few places of a rule
    return F.transform(F.sequence(F.lit(1), F.size(found)), lambda i: F.aggregate(F.slice(both, F.lit(1), i), F.struct(F.lit(0).alias("s"), F.lit(0).alias("e")), lambda a, x: F.struct((a["e"] + x["b"]).alias("s"), (a["e"] + x["b"] + x["n"]).alias("e"))))


_PLACES = "array<struct<s:int,e:int>>"


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``form``, ``n_words`` and ``found``: array of (label, s, e), suppressed places left out."""
    by_keys: dict[str, list] = {}
    for i, (label, kws, r) in enumerate(rules()):
        by_keys.setdefault(kws, []).append(F.struct(F.lit(label).alias("label"), F.lit(spaced(r)).alias("r"), F.lit(i).alias("p")))
    table = F.array(*[F.struct(F.split(F.lit(kws), " ").alias("k"), F.array(*rs).alias("rules")) for kws, rs in by_keys.items()])
    words = F.array(*[F.lit(w) for w in sorted({w for kws in by_keys for w in kws.split()})])
    d = docs.select(*keep, word_form(F.col(text)).alias("form"))
    d = d.select(*keep, "form", _n_words(F.col("form")).alias("n_words"), F.array_intersect(words, F.split(F.btrim("form"), "  ")).alias("_keys"))

    def of_rule(r):
        return F.when(F.regexp_like(F.col("form"), r["r"]), F.transform(_places(F.col("form"), r["r"]), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), r["p"].alias("p"), r["label"].alias("label")))).otherwise(F.array().cast("array<struct<s:int,e:int,p:int,label:string>>"))

    run = F.flatten(F.transform(F.filter(table, lambda r: F.arrays_overlap(r["k"], F.col("_keys"))), lambda r: r["rules"]))
    hits = F.sort_array(F.flatten(F.transform(run, of_rule)))
    kind = "array<struct<label:string,s:int,e:int>>"
    d = d.select("*", F.when(F.size("_keys") > 0, hits).alias("_hits"))
    # places in order: one is inside an earlier one when it ends no later than the furthest end so far
    ends = F.array_compact(F.transform("_hits", lambda x, i: F.when(-x["e"] > F.coalesce(F.array_max(F.transform(F.slice("_hits", F.lit(1), i), lambda y: -y["e"])), F.lit(-1)), F.struct(x["label"].alias("label"), x["s"].alias("s"), (-x["e"]).alias("e")))))
    return d.select(*keep, "form", "n_words", F.coalesce(ends, F.array().cast(kind)).alias("found"))


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    d = scan(read(spark, sf_dir, "documents"))
    empty = F.array().cast(_PLACES)
    here = {p: F.contains("form", F.lit(spaced(p))) for p in BASE}
    starts = F.transform(F.flatten(F.array(*[F.when(h, _places(F.col("form"), F.lit(spaced(p)))).otherwise(empty) for p, h in here.items()])), lambda x: x["s"])
    labels = F.array_compact(F.array(*[F.when(h, F.lit(BASE[p])) for p, h in here.items()]))
    d = d.select("doc_id", "n_words", "found", starts.alias("_starts"), labels.alias("_base"))
    covered = F.aggregate("found", F.lit(0), lambda a, x: a + x["e"] - x["s"])
    return d.select(
        "doc_id",
        F.col("n_words").cast("long"),
        F.size("_starts").cast("long").alias("n_base"),
        F.array_min("_starts").cast("long").alias("first_word"),
        F.array_max("_starts").cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct("_base")), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("_base", F.transform("found", lambda x: x["label"]))), ",").alias("labels"),
        F.when((F.size("found") == 0) & (F.size("_starts") == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.lit(0.5) + covered / F.lit(40.0))).alias("score"),
    )


def op6_sql() -> str:
    """All rules without their keywords: texts that match any rule at all are tried with each."""
    table = ", ".join(f"({i}, '{label}', '{spaced(r)}')" for i, (label, _, r) in enumerate(rules()))
    any_ = " (?:" + "|".join(dict.fromkeys(spaced(r)[1:-1] for _, _, r in rules())) + ") "
    base = ", ".join(f"('{spaced(p)}', '{label}')" for p, label in BASE.items())
    places = "SELECT rid, {0}, (list_sum([len(regexp_extract_all(x, '[^ ]+')) for x in pc[:i]]) + coalesce(list_sum([len(regexp_extract_all(x, '[^ ]+')) for x in m[:i - 1]]), 0))::BIGINT AS s, len(regexp_extract_all(m[i], '[^ ]+'))::BIGINT AS n FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM (SELECT rid, {0}, regexp_extract_all(form, re) AS m, string_split_regex(form, re) AS pc FROM {1}))"
    return rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
f AS MATERIALIZED (SELECT rid, doc_id, len(ws)::BIGINT AS n_words, CASE WHEN len(ws) > 0 THEN ' ' || array_to_string(ws, '  ') || ' ' ELSE '' END AS form FROM w),
r(p, label, re) AS (VALUES {table}), b(re, label) AS (VALUES {base}),
tried AS MATERIALIZED (SELECT rid, form FROM f WHERE regexp_matches(form, '{any_}')),
h AS ({places.format("p, label", "(SELECT * FROM tried, r WHERE regexp_matches(form, re))")}),
k AS (SELECT rid, label, n FROM (SELECT *, max(s + n) OVER (PARTITION BY rid ORDER BY s, s + n DESC, p, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h) WHERE before IS NULL OR s + n > before),
o AS ({places.format("label", "(SELECT * FROM f, b WHERE contains(form, re))")}),
bl AS (SELECT rid, count(*)::BIGINT AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM o GROUP BY rid),
al AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM k UNION SELECT rid, label FROM o) GROUP BY rid),
cv AS (SELECT rid, sum(n) AS covered FROM k GROUP BY rid)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
 CASE WHEN labels IS NULL THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, 0.5::DOUBLE + coalesce(covered, 0)::DOUBLE / 40.0::DOUBLE) END AS score
FROM f LEFT JOIN bl USING (rid) LEFT JOIN al USING (rid) LEFT JOIN cv USING (rid)"""
