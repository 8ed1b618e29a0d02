"""License scans [native]: ordered signature rules, gated by keywords, overlaps resolved.

Only DataFrame functions: a text is lower-cased (A-Z), a cheap test looks for
any of the keywords, and only the texts that have one meet the rules.  A rule is
a hand-written regular expression with a keyword, a label and a priority; its
expression runs only on texts that hold its keyword.  All places of all rules
are kept, then suppressed: a place inside another of higher priority goes, and
among equal priority the longer, then the earlier rule, stays.

Places are added up in blocks and compared in buckets at least as wide as the
longest of them, so that a text with very many costs about n ** 1.5, not n ** 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# label, keyword, what a license is called (a regular expression on lower-case text)
FAMILIES = (
    ("agpl-3.0", "affero", "gnu affero general public license(?:,? (?:version|v) ?3(?:\\.0)?)?"),
    ("lgpl-2.1", "lesser", "gnu lesser general public license,? (?:version|v) ?2\\.1"),
    ("lgpl-3.0", "lesser", "gnu lesser general public license,? (?:version|v) ?3(?:\\.0)?"),
    ("lgpl", "general public", "gnu (?:lesser|library) general public license"),
    ("gpl-2.0", "general public", "gnu general public license,? (?:version|v) ?2(?:\\.0)?"),
    ("gpl-3.0", "general public", "gnu general public license,? (?:version|v) ?3(?:\\.0)?"),
    ("gpl", "general public", "(?:gnu )?general public license"),
    ("gfdl", "free documentation", "gnu free documentation license(?:,? (?:version|v) ?1\\.[123])?"),
    ("apache-2.0", "apache", "apache (?:software )?license,? ?(?:version |v)?2(?:\\.0)?"),
    ("apache-1.1", "apache", "apache (?:software )?license,? ?(?:version |v)?1\\.1"),
    ("apache", "apache", "apache (?:software )?license"),
    ("mit", "mit license", "(?:the )?mit license"),
    ("mit", "mit/x11", "(?:the )?mit/x11 license"),
    ("mit", "expat", "(?:the )?expat license"),
    ("mit-0", "mit no attribution", "mit no attribution license"),
    ("x11", "x11 license", "x11 license"),
    ("bsd-2-clause", "bsd", "(?:2-clause|two-clause|simplified|freebsd) bsd license"),
    ("bsd-3-clause", "bsd", "(?:3-clause|three-clause|new|modified|revised) bsd license"),
    ("bsd-4-clause", "bsd", "(?:4-clause|four-clause|original|old) bsd license"),
    ("bsd", "bsd", "bsd(?:-style)? license"),
    ("isc", "isc license", "isc license"),
    ("zlib", "zlib", "zlib(?:/libpng)? license"),
    ("mpl-1.1", "mozilla", "mozilla public license,? ?(?:version |v)?1\\.1"),
    ("mpl-2.0", "mozilla", "mozilla public license,? ?(?:version |v)?2(?:\\.0)?"),
    ("mpl", "mozilla", "mozilla public license"),
    ("epl-1.0", "eclipse", "eclipse public license,? ?(?:-|version |v)? ?1(?:\\.0)?"),
    ("epl-2.0", "eclipse", "eclipse public license,? ?(?:-|version |v)? ?2(?:\\.0)?"),
    ("epl", "eclipse", "eclipse public license"),
    ("cddl", "common development", "common development and distribution license(?:,? (?:version|v) ?1\\.[01])?"),
    ("cpl", "common public", "common public license(?:,? (?:version|v) ?1\\.0)?"),
    ("eupl", "european union", "european union public licen[cs]e(?:,? (?:version|v)\\.? ?1\\.[12])?"),
    ("artistic-2.0", "artistic", "artistic license,? ?(?:version |v)?2(?:\\.0)?"),
    ("artistic", "artistic", "artistic license"),
    ("python", "python software", "python software foundation license(?: version 2)?"),
    ("php", "php license", "php license,? (?:version |v)?3\\.01?"),
    ("ruby", "ruby license", "ruby license"),
    ("wtfpl", "what the", "do what the f[*a-z]+ you want to public license"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("boost", "boost", "boost software license(?:,? ?-? ?(?:version|v) ?1\\.0)?"),
    ("openssl", "openssl", "openssl license"),
    ("ofl", "open font", "sil open font license(?:,? (?:version|v) ?1\\.[01])?"),
    ("odbl", "open database", "open database licen[cs]e(?: \\(odbl\\))?(?: v?1\\.0)?"),
    ("odc-by", "open data commons", "open data commons attribution license(?: v?1\\.0)?"),
    ("pddl", "open data commons", "open data commons public domain dedication"),
    ("ms-pl", "microsoft", "microsoft public license(?: \\(ms-pl\\))?"),
    ("ms-rl", "microsoft", "microsoft reciprocal license(?: \\(ms-rl\\))?"),
    ("bsl", "business source", "business source license(?: (?:version )?1\\.1)?"),
    ("sspl", "server side", "server side public license(?:,? (?:version |v)1)?"),
    ("elastic", "elastic", "elastic license(?: 2\\.0)?"),
    ("cc0", "cc0", "cc0(?: 1\\.0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc by", "cc by[ -]nc[ -]nd(?: [1-4]\\.[0-9])?"),
    ("cc-by-nc-nd", "cc-by", "cc-by[ -]nc[ -]nd(?: [1-4]\\.[0-9])?"),
    ("cc-by-nc-sa", "cc by", "cc by[ -]nc[ -]sa(?: [1-4]\\.[0-9])?"),
    ("cc-by-nc-sa", "cc-by", "cc-by[ -]nc[ -]sa(?: [1-4]\\.[0-9])?"),
    ("cc-by-nc", "cc by", "cc by[ -]nc(?: [1-4]\\.[0-9])?"),
    ("cc-by-nc", "cc-by", "cc-by[ -]nc(?: [1-4]\\.[0-9])?"),
    ("cc-by-nd", "cc by", "cc by[ -]nd(?: [1-4]\\.[0-9])?"),
    ("cc-by-nd", "cc-by", "cc-by[ -]nd(?: [1-4]\\.[0-9])?"),
    ("cc-by-sa", "cc by", "cc by[ -]sa(?: [1-4]\\.[0-9])?"),
    ("cc-by-sa", "cc-by", "cc-by[ -]sa(?: [1-4]\\.[0-9])?"),
    ("cc-by", "cc by", "cc by(?: [1-4]\\.[0-9])?"),
    ("cc-by", "cc-by", "cc-by(?: [1-4]\\.[0-9])?"),
    ("cc-by-nc", "creative commons", "creative commons attribution[ -]non-?commercial(?: [1-4]\\.[0-9])?"),
    ("cc-by-sa", "creative commons", "creative commons attribution[ -]share-?alike(?: [1-4]\\.[0-9])?"),
    ("cc-by", "creative commons", "creative commons attribution(?: [1-4]\\.[0-9])?"),
)
# priority, keyword besides the family's, how a license is spoken of; {} is what it is called
FORMS = (
    (90, "licen", "(?:this|the) (?:work|file|program|software|code|document|library|project)[a-z ]{{0,20}} is (?:dual-?)?licensed under (?:the )?(?:terms of )?(?:the )?{}"),
    (80, "licensed under", "licensed under (?:the )?(?:terms of )?(?:the )?{}"),
    (80, " under ", "(?:released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?{}"),
    (60, "licen", "licen[cs]e(?: type)?\\s?[:=]\\s?(?:the )?{}"),
    (40, "", "(?<![a-z0-9]){}(?![a-z0-9])"),
)
# label, keyword, priority, regular expression: those that no family has
SINGLES = (
    ("spdx", "spdx-license-identifier", 100, "spdx-license-identifier:\\s*\\(?[a-z0-9.+-]+(?: (?:and|or|with) [a-z0-9.+-]+)*\\)?"),
    ("reserved", "all rights reserved", 50, "all rights reserved"),
    ("reserved", "some rights reserved", 50, "some rights reserved"),
    ("copyright", "copyright", 30, "copyright (?:\\(c\\) |© ?)?(?:19|20)[0-9]{2}(?:\\s?[-,]\\s?(?:19|20)[0-9]{2})*"),
    ("copyright", "(c)", 30, "\\(c\\) (?:19|20)[0-9]{2}(?:\\s?[-,]\\s?(?:19|20)[0-9]{2})*"),
    ("public-domain", "public domain", 50, "(?:released|placed|dedicated|is) (?:in(?:to)?|to) the public domain"),
    ("public-domain", "public domain", 35, "public domain(?: dedication)?"),
    ("mit", "permission is hereby granted", 85, "permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("isc", "permission to use, copy", 85, "permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose"),
    ("bsd", "redistribution and use", 85, "redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("zlib", "as-is", 70, "this software is provided 'as-is', without any express or implied warranty"),
    ("warranty", "without warrant", 20, "without warrant(?:y|ies) (?:of any kind|or conditions of any kind)"),
    ("unlicense", "unencumbered", 85, "this is free and unencumbered software released into the public domain"),
    ("gpl", "free software foundation", 65, "as published by the free software foundation[;,]? ?(?:either )?version [23]"),
    ("cc-url", "creativecommons.org", 75, "creativecommons\\.org/(?:licenses|publicdomain)/[a-z-]+(?:/[0-9.]+)?"),
    ("apache-2.0", "apache.org/licenses", 75, "apache\\.org/licenses/license-2\\.0"),
    ("gpl", "gnu.org/licenses", 75, "gnu\\.org/licenses/[a-z0-9./-]+"),
    ("mit", "opensource.org", 75, "opensource\\.org/licenses/mit"),
    ("bsd", "opensource.org", 75, "opensource\\.org/licenses/bsd-[234]-clause"),
    ("proprietary", "proprietary", 45, "proprietary and confidential"),
    # what license texts and notices themselves say
    ("mit", "the above copyright notice", 80, "the above copyright notice and this permission notice (?:\\(including the next paragraph\\) )?shall be included in all copies"),
    ("mit", "without restriction", 78, "to deal in the software without restriction,? including without limitation the rights to use, copy, modify, merge, publish,? distribute,? sublicen[cs]e"),
    ("as-is", "without warrant", 60, "the (?:software|work|program|library) is provided \"?as is\"?,? without warrant(?:y|ies) of any kind"),
    ("apache-2.0", "you may not use this file", 85, "you may not use this file except in compliance with the license"),
    ("apache-2.0", "contributor license agreements", 82, "licensed to the apache software foundation \\(asf\\) under one or more contributor license agreements"),
    ("apache-2.0", "limitations under the license", 70, "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "you can redistribute it", 75, "this (?:program|library|file|software) is free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu (?:lesser |library |affero )?general public license"),
    ("gpl", "either version", 66, "either version [23](?:\\.[01])? of the license,? or \\(at your option\\) any later version"),
    ("gpl", "received a copy of the gnu", 68, "you should have received a copy of the gnu (?:lesser |library |affero )?general public license"),
    ("gpl", "gpl", 55, "(?<![a-z0-9])(?:gnu )?[al]?gplv?[ -]?[23](?:\\.[01])?(?:\\+|-or-later|-only)?(?![a-z0-9])"),
    ("warranty", "merchantability", 30, "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("warranty", "merchantability", 28, "including but not limited to the (?:implied )?warranties of merchantability"),
    ("bsd-3-clause", "endorse or promote", 86, "neither the name of [a-z0-9 ,.()-]{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-2-clause", "redistributions of source code", 84, "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-2-clause", "redistributions in binary form", 84, "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-4-clause", "advertising materials", 87, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("isc", "appear in all copies", 83, "provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "altered source versions", 80, "altered source versions must be plainly marked as such"),
    ("zlib", "misrepresented", 80, "the origin of this software must not be misrepresented"),
    ("mpl-2.0", "mozilla.org/mpl", 78, "mozilla\\.org/mpl/2\\.0"),
    ("mpl-2.0", "this source code form", 85, "this source code form is subject to the terms of the mozilla public license"),
    ("epl", "accompanying materials", 84, "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "common development", 82, "subject to the terms of the common development and distribution license"),
    ("boost", "boost.org/license", 78, "boost\\.org/license_1_0"),
    ("unlicense", "unlicense.org", 78, "unlicense\\.org"),
    ("cc0", "waived all copyright", 80, "has waived all copyright and related or neighbou?ring rights"),
    ("cc0", "no rights reserved", 60, "no rights reserved"),
    ("gfdl", "permission is granted to copy", 84, "permission is granted to copy, distribute and/or modify this document"),
    ("permissive", "is hereby granted", 50, "permission to use, copy, modify,? and distribute this (?:software|material)(?: and its documentation)? for any purpose(?: and)?(?: with or)?(?: without fee)? is hereby granted"),
    ("proprietary", "strictly prohibited", 55, "unauthori[sz]ed (?:copying|use|reproduction|distribution|disclosure)[a-z ,]{0,60} is strictly prohibited"),
    ("proprietary", "user licen", 50, "end[- ]user licen[cs]e agreement"),
    ("proprietary", "may not be reproduced", 52, "may not be reproduced,? (?:distributed|stored|transmitted|copied)[a-z ,]{0,80}without (?:the )?(?:prior )?(?:express )?written permission"),
    ("non-commercial", "non-commercial", 45, "(?:personal,? )?non-commercial (?:use|purposes) only"),
    ("public-domain", "no known copyright", 52, "no known copyright restrictions"),
    ("copyright", "©", 30, "© ?(?:19|20)[0-9]{2}(?:\\s?[-,]\\s?(?:19|20)[0-9]{2})*"),
    ("ofl", "reserved font name", 75, "with reserved font names?"),
    ("openssl", "openssl toolkit", 80, "developed by the openssl project for use in the openssl toolkit"),
    ("php", "php.net/license", 78, "php\\.net/license/[0-9]_[0-9]+"),
    ("python", "psf license", 70, "psf license agreement for python"),
    ("json", "not evil", 75, "the software shall be used for good, not evil"),
    ("beerware", "ware license", 70, "beer-?ware license"),
    ("eupl", "under the eupl", 70, "licen[cs]ed under the eupl"),
    ("ms-pl", "(ms-pl)", 72, "this license governs use of the accompanying software[a-z0-9 ,.]{0,40}\\(ms-pl\\)"),
    ("cc-by", "creative commons", 48, "some rights reserved[.,;]? under (?:a |the )?creative commons"),
    ("cc-by-sa", "by-sa", 46, "(?<![a-z0-9-])by-sa [1-4]\\.[0-9]"),
    ("dual", "dual", 44, "dual[- ]licensed"),
    ("no-patent", "patent", 20, "this license does not grant (?:any )?patent rights"),
)


def rules() -> list[tuple[str, str, str, int, str]]:
    """(label, keyword, second keyword, priority, expression) in order."""
    out = [(label, key, also, priority, form.format(name)) for priority, also, form in FORMS for label, key, name in FAMILIES]
    return [(label, key, "", priority, pattern) for label, key, priority, pattern in SINGLES] + out


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _places(words: Column, phrase: str) -> Column:
    """The word numbers at which the phrase's words stand one after another."""
    own = phrase.split()
    at = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: F.get(words, i) == own[0])
    return F.filter(at, lambda i: _all([F.get(words, i + k) == w for k, w in enumerate(own) if k]))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False))


_SPAN = "array<struct<start:int,end:int,priority:int,label:string,id:int>>"
_BLOCK = 64


def _bound(value: Column, use) -> Column:
    """use(value), the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, rule: Column) -> Column:
    """Every place of a rule: structs (start, end, priority, label, order); null of none."""
    sizes = F.transform(F.regexp_extract_all(text, rule["pattern"], F.lit(0)), F.length)
    gaps = lambda: F.transform(F.split(text, rule["pattern"], F.lit(-1)), F.length)
    return _bound(sizes, lambda s: F.when(F.size(s) > 0, _bound(gaps(), lambda g: _placed(g, s, rule))))


def _placed(gaps: Column, sizes: Column, rule: Column) -> Column:
    """The spans of finds of these sizes with these gaps before them, added up block by block."""

    def total(lo: Column) -> Column:
        add = lambda a, x: a + x
        return F.aggregate(F.slice(gaps, lo + 1, _BLOCK), F.lit(0), add) + F.aggregate(F.slice(sizes, lo + 1, _BLOCK), F.lit(0), add)

    def onward(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.get(gaps, i)
        end = start + F.get(sizes, i)
        span = F.struct(start.alias("start"), end.alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["id"].alias("id"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        lo = b * _BLOCK
        begin = F.struct(acc["at"].alias("at"), F.array().cast(_SPAN).alias("out"))
        own = F.aggregate(F.sequence(lo, F.least(lo + _BLOCK, F.size(sizes)) - 1), begin, onward, lambda a: a["out"])
        return F.struct((acc["at"] + total(lo)).alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int"))
    return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")), block, lambda a: a["out"]))


def detections(text: Column) -> Column:
    """All places of all rules in lower-case text, overlaps resolved; an array of structs."""
    own = rules()
    keys = F.array(*[F.lit(k) for k in sorted({key for _, key, *_ in own} | {also for _, _, also, *_ in own})])
    table = F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(key).alias("key"), F.lit(also).alias("also"), F.lit(priority).alias("priority"), F.lit(pattern).alias("pattern"), F.lit(i).alias("id"))
        for i, (label, key, also, priority, pattern) in enumerate(own)
    ])
    there = F.filter(keys, lambda k: F.contains(text, k))
    gated = F.filter(F.transform(F.array(there), lambda have: F.filter(table, lambda r: F.array_contains(have, r["key"]) & F.array_contains(have, r["also"])))[0], lambda r: F.lit(True))
    spans = F.flatten(F.filter(F.transform(gated, lambda r: _spans(text, r)), lambda s: s.isNotNull()))
    return _bound(spans, lambda s: _resolved(s, F.length(text)))


def _resolved(spans: Column, length: Column) -> Column:
    """Without the spans that lie inside one that outranks them.

    Buckets by start, as wide as the longest span at least: what holds a span
    starts in its bucket or in the one before.
    """

    def beats(t: Column, s: Column) -> Column:
        longer = (t["end"] - t["start"] > s["end"] - s["start"]) | ((t["end"] - t["start"] == s["end"] - s["start"]) & (t["id"] < s["id"]))
        return (t["start"] <= s["start"]) & (t["end"] >= s["end"]) & ((t["priority"] > s["priority"]) | ((t["priority"] == s["priority"]) & longer))

    def kept(own: Column, around: Column) -> Column:
        return F.filter(own, lambda s: ~F.exists(around, lambda t: beats(t, s)))

    def in_buckets(width: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor(length / width).cast("int"))
        buckets = F.transform(numbers, lambda b: F.filter(spans, lambda s: F.floor(s["start"] / width).cast("int") == b))
        none = F.array().cast(_SPAN)
        each = lambda all_: F.flatten(F.transform(all_, lambda own, i: F.when(F.size(own) == 0, own).otherwise(_bound(F.concat(F.coalesce(F.get(all_, i - 1), none), own), lambda around: kept(own, around)))))
        return _bound(buckets, each)

    longest = F.array_max(F.transform(spans, lambda s: s["end"] - s["start"]))
    width = F.greatest(longest, F.ceil(length / F.sqrt(F.size(spans))).cast("int"))
    return F.when(F.size(spans) < 2, spans).otherwise(_bound(width, in_buckets))


#: Every rule's text has one of these: the cheap test that a whole text meets first.
STEMS = ("licen", "cc by", "cc-by", "cc0", "creative", "reserved", "copyright", "(c)", "public domain", "permission", "redistribution", "as-is", "without warrant", "unencumbered", "free software", "proprietary", "merchantability", "endorse or promote", "advertising materials", "altered source", "misrepresented", "mozilla.org", "strictly prohibited", "may not be reproduced", "non-commercial", "©", "openssl", "not evil", "gpl", "by-sa")


def _base_possible(pieces: Column) -> Column:
    out = F.lit(False)
    for phrase, _ in BASE:
        out = out | _all([F.array_contains(pieces, w) for w in phrase.split()])
    return out


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections.

    Null and empty texts have no words and no labels (empty strings, score 0).
    score is 1 minus the product of 1 - priority/100 over the distinct labels'
    best places; base places without one count 0.5 each label.
    """
    text = F.col("low")
    docs = runtime.plain(documents, doc_id="long", text="string").select("doc_id", _lower(F.coalesce("text", F.lit(""))).alias("low"))
    gate = F.lit(False)
    for key in STEMS:
        gate = gate | F.contains(text, F.lit(key))
    pieces = F.col("pieces")  # empty ones only before the first and after the last word
    blanks = (F.element_at(pieces, 1) == "").cast("int") + (F.element_at(pieces, -1) == "").cast("int")
    n_words = F.greatest(F.size(pieces) - blanks, F.lit(0)).cast("long")
    docs = docs.select("doc_id", F.split(text, GAP, -1).alias("pieces"), F.when(gate, detections(text)).alias("found"))
    docs = docs.select("doc_id", n_words.alias("n_words"), F.when(_base_possible(pieces), F.filter(pieces, lambda x: x != "")).alias("words"), "found")
    places = [F.coalesce(F.when(F.col("words").isNotNull(), _places(F.col("words"), phrase)), F.array().cast("array<int>")) for phrase, _ in BASE]
    docs = docs.select("doc_id", "n_words", "found", *[p.alias(f"p{i}") for i, p in enumerate(places)])
    every = F.concat(*[F.col(f"p{i}") for i in range(len(BASE))])
    base = F.filter(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]), lambda x: x.isNotNull())
    found = F.coalesce(F.col("found"), F.array().cast("array<struct<start:int,end:int,priority:int,label:string,id:int>>"))
    docs = docs.select("doc_id", "n_words", every.alias("every"), base.alias("base"), found.alias("found"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("found", lambda s: s["label"]))))
    best = lambda x: F.coalesce(F.array_max(F.transform(F.filter("found", lambda s: s["label"] == x), lambda s: s["priority"])), F.lit(50))
    return docs.withColumn("l", labels).select(
        "doc_id", "n_words", F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join("l", ",").alias("labels"),
        F.aggregate("l", F.lit(1.0), lambda acc, x: acc * (1 - best(x) / 100.0), lambda acc: 1 - acc).alias("score"),
        F.size("found").cast("long").alias("n_detections"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License signs in every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
