"""License scans: ordered signature rules, native SQL expressions only.

A document whose text holds none of the gate strings or phrases is settled at once. The others test the
rules whose keyword the text contains, one word that every match of the rule holds; every match is a detection (start, end, rule). A detection lying inside an
earlier, at least as long one is suppressed; of two with the same interval the rule of higher priority stays, then the one with the longer name.
Nothing is shuffled: each row is judged alone, so copies, hot sources and long texts need no special care.

Defined results: null and empty texts have no words, null places, empty labels and score 0; repeated rows give
repeated results; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import ascii_lower, placed, texts

#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Fixed values: (label, keyword, how the text names it); a space stands for any separator (`SEP`), the keyword is one word of the name.
FAMILIES = (
    ("mit", "mit", "mit"), ("mit-0", "mit", "mit no attribution"), ("apache", "apache", "apache"),
    ("apache-1.1", "apache", "apache software license version 1\\.1"), ("gpl", "gnu", "gnu general public"),
    ("gpl", "gpl", "gpl"), ("agpl", "affero", "affero general public"), ("agpl", "agpl", "agpl"),
    ("lgpl", "lesser", "lesser general public"), ("lgpl", "lgpl", "lgpl"), ("gfdl", "documentation", "free documentation"),
    ("bsd", "bsd", "bsd"), ("bsd-2-clause", "clause", "2 clause bsd"), ("bsd-3-clause", "clause", "3 clause bsd"),
    ("isc", "isc", "isc"), ("mpl", "mozilla", "mozilla public"), ("mpl", "mpl", "mpl"), ("epl", "eclipse", "eclipse public"),
    ("cddl", "cddl", "cddl"), ("cddl", "development", "common development and distribution"),
    ("cpl", "common", "common public"), ("cc0", "cc0", "cc0"), ("cc-by-nc", "cc", "cc by nc"),
    ("cc-by-sa", "cc", "cc by sa"), ("cc-by-nd", "cc", "cc by nd"), ("cc-by", "cc", "cc by"),
    ("cc-by", "creative", "creative commons attribution"), ("artistic", "artistic", "artistic"),
    ("zlib", "zlib", "zlib"), ("boost", "boost", "boost software"), ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"), ("postgresql", "postgresql", "postgresql"), ("python", "python", "python software foundation"),
    ("openssl", "openssl", "openssl"), ("php", "php", "php"), ("ruby", "ruby", "ruby"), ("eupl", "european", "european union public"),
    ("ofl", "font", "sil open font"), ("odbl", "database", "open database"), ("ms-pl", "microsoft", "microsoft public"),
    ("ms-rl", "microsoft", "microsoft reciprocal"), ("afl", "academic", "academic free"), ("osl", "software", "open software"),
    ("ncsa", "ncsa", "university of illinois ncsa"), ("proprietary", "reserved", "all rights reserved"),
)
#: Fixed values: (name, template around the family's name, priority, weight).
FORMS = (
    ("grant", r"\b(?:licensed|released|distributed|available|published) under (?:the |an? )?(?:terms of (?:the )?)?{}(?: license| licence)?(?:,? (?:version |v)?[0-9][0-9.]{{0,5}}(?: or later)?)?", 5, 0.9),
    ("titled", r"\b(?:the )?{} licen[sc]e(?:,? (?:version |v)?[0-9][0-9.]{{0,5}})?", 4, 0.7),
    ("versioned", r"\b{}[ -](?:version |v)?[0-9][0-9.]{{0,5}}", 3, 0.6),
    ("spdx", r"\bspdx-license-identifier: ?{}[a-z0-9.+-]{{0,24}}", 6, 0.95),
    ("field", r"\blicen[sc]e ?[:=] ?[\"']?{}\b", 4, 0.8),
)
#: Hand-written signatures, sentences of license texts and notices (label, keyword, pattern, priority, weight).
SENTENCES = (
    ("mit", "hereby", r"permission is hereby granted,? free of charge,? to any person obtaining a copy", 9, 0.99),
    ("mit", "substantial", r"copyright notice and this permission notice shall be included in all copies or substantial portions", 9, 0.97),
    ("mit", "merge", r"without limitation the rights to use, copy, modify, merge, publish, distribute", 9, 0.97),
    ("mit", "noninfringement", r"merchantability, fitness for a particular purpose and noninfringement", 8, 0.7),
    ("mit", "software", r"whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software", 8, 0.85),
    ("mit-0", "restriction", r"to deal in the software without restriction.{0,200}to permit persons to whom the software is furnished to do so\.", 8, 0.6),
    ("mit", "expat", r"\bexpat licen[sc]e", 8, 0.95),
    ("mit", "x11", r"\bx11 licen[sc]e", 8, 0.9),
    ("isc", "permission", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose", 9, 0.99),
    ("isc", "disclaims", r"the author disclaims all warranties with regard to this software", 8, 0.9),
    ("0bsd", "0bsd", r"\b0bsd licen[sc]e", 8, 0.95),
    ("0bsd", "zero", r"zero clause bsd licen[sc]e", 8, 0.95),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms", 9, 0.99),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice", 9, 0.97),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 9, 0.97),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software", 9, 0.97),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software", 9, 0.98),
    ("bsd", "negligence", r"\(including negligence or otherwise\) arising in any way out of the use of this software", 8, 0.85),
    ("bsd", "bsd", r"\bbsd style licen[sc]e", 8, 0.9),
    ("bsd", "bsd", r"(?:new|modified|revised|simplified) bsd licen[sc]e", 8, 0.95),
    ("apache", "apache", r"licensed under the apache license, version 2", 9, 0.99),
    ("apache", "apache", r"apache\.org/licenses/license 2\.0", 9, 0.99),
    ("apache", "except", r"you may not use this file except in compliance with the license", 9, 0.95),
    ("apache", "distributed", r"software distributed under the license is distributed on an as is basis", 8, 0.9),
    ("apache", "contributor", r"each contributor hereby grants to you a perpetual, worldwide, non exclusive", 9, 0.95),
    ("apache", "foundation", r"licensed to the apache software foundation", 9, 0.97),
    ("apache-1.1", "foundation", r"this product includes software developed by the apache software foundation", 9, 0.97),
    ("gpl", "gnu", r"under the terms of the gnu general public license", 9, 0.99),
    ("gpl", "gnu", r"you should have received a copy of the gnu general public license", 9, 0.99),
    ("gpl", "gnu", r"see the gnu general public license for more details", 9, 0.97),
    ("gpl", "gpl", r"\bgpl compatible licen[sc]e", 7, 0.5),
    ("gpl", "copyleft", r"the gnu general public license is a free, copyleft license", 9, 0.98),
    ("gpl", "freedom", r"when we speak of free software, we are referring to freedom, not price", 8, 0.85),
    ("gpl", "merchantability", r"without even the implied warranty of merchantability or fitness", 8, 0.8),
    ("gpl", "boston", r"51 franklin st(?:reet|\.)?, fifth floor, boston, ma", 8, 0.8),
    ("gpl", "exception", r"as a special exception, the copyright holders of this library give you permission to link", 9, 0.9),
    ("lgpl", "lesser", r"under the terms of the gnu lesser general public license", 9, 0.99),
    ("lgpl", "lesser", r"you should have received a copy of the gnu lesser general public license", 9, 0.99),
    ("lgpl", "library", r"gnu library general public license", 9, 0.97),
    ("agpl", "affero", r"under the terms of the gnu affero general public license", 9, 0.99),
    ("agpl", "affero", r"you should have received a copy of the gnu affero general public license", 9, 0.99),
    ("agpl", "network", r"remote network interaction; use with the gnu general public license", 9, 0.97),
    ("gfdl", "invariant", r"with no invariant sections, no front cover texts,? and no back cover texts", 9, 0.97),
    ("gfdl", "document", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation", 9, 0.99),
    ("mpl", "mozilla", r"subject to the terms of the mozilla public license", 9, 0.99),
    ("mpl", "mozilla", r"mozilla\.org/mpl/", 9, 0.95),
    ("mpl", "incompatible", r"incompatible with secondary licenses, as defined by the mozilla public license", 9, 0.97),
    ("mpl", "alternatively", r"alternatively, the contents of this file may be used under the terms of either the gnu general public license", 8, 0.8),
    ("epl", "eclipse", r"accompanying materials are made available under the terms of the eclipse public license", 9, 0.99),
    ("epl", "eclipse", r"eclipse\.org/legal/epl", 9, 0.95),
    ("epl", "eclipse", r"eclipse distribution license", 8, 0.9),
    ("cddl", "common", r"subject to the terms of the common development and distribution license", 9, 0.99),
    ("cddl", "cddl", r"include this cddl header notice in each file", 9, 0.97),
    ("cpl", "common", r"made available under the terms of the common public license", 9, 0.98),
    ("ipl", "ibm", r"\bibm public license", 9, 0.97),
    ("cc0", "cc0", r"\bcc0 1\.0 universal", 9, 0.98),
    ("cc0", "waived", r"has waived all copyright and related or neighboring rights", 9, 0.97),
    ("cc0", "publicdomain", r"creativecommons\.org/publicdomain/zero", 9, 0.98),
    ("cc-by", "creativecommons", r"creativecommons\.org/licenses/by/", 9, 0.98),
    ("cc-by-sa", "creativecommons", r"creativecommons\.org/licenses/by sa/", 9, 0.98),
    ("cc-by-nc", "creativecommons", r"creativecommons\.org/licenses/by nc/", 9, 0.98),
    ("cc-by-nd", "creativecommons", r"creativecommons\.org/licenses/by nd/", 9, 0.98),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons\.org/licenses/by nc sa/", 9, 0.98),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons\.org/licenses/by nc nd/", 9, 0.98),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike", 9, 0.97),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial", 9, 0.97),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s", 9, 0.97),
    ("cc-by-nc-sa", "attribution", r"attribution non ?commercial share ?alike 4\.0 international", 9, 0.98),
    ("cc-by", "attribution", r"attribution 4\.0 international \(cc by 4\.0\)", 9, 0.98),
    ("cc-by-sa", "text", r"text is available under the creative commons attribution sharealike license", 9, 0.97),
    ("public-domain", "domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", 7, 0.9),
    ("public-domain", "domain", r"this (?:work|file|image|software|text) is in the public domain", 7, 0.9),
    ("public-domain", "domain", r"public domain mark 1\.0", 8, 0.95),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 9, 0.99),
    ("unlicense", "unlicense", r"unlicense\.org", 8, 0.95),
    ("zlib", "warranty", r"this software is provided 'as is', without any express or implied warranty", 9, 0.95),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 9, 0.98),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", 9, 0.97),
    ("libpng", "libpng", r"\blibpng licen[sc]e", 8, 0.95),
    ("boost", "boost", r"distributed under the boost software license", 9, 0.99),
    ("boost", "machine", r"solely in the form of machine executable object code generated by a source language processor", 9, 0.98),
    ("wtfpl", "what", r"do what the f\w{0,4} you want to public license", 9, 0.99),
    ("beerware", "beer", r"\bbeer ?ware licen[sc]e", 9, 0.97),
    ("artistic", "terms", r"under the (?:same terms as perl|terms of the artistic license)", 8, 0.9),
    ("artistic", "perl", r"free software; you can redistribute it and/or modify it under the same terms as perl itself", 9, 0.95),
    ("python", "python", r"python software foundation license", 9, 0.97),
    ("python", "beopen", r"\bbeopen python open source license", 9, 0.97),
    ("postgresql", "documentation", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee", 9, 0.95),
    ("openssl", "openssl", r"this product includes software developed by the openssl project", 9, 0.98),
    ("openssl", "cryptographic", r"this product includes cryptographic software written by eric young", 9, 0.97),
    ("php", "php", r"this source file is subject to version [0-9.]{1,5} of the php license", 9, 0.98),
    ("ruby", "ruby", r"distributed under the same license as ruby", 8, 0.9),
    ("eupl", "eupl", r"licensed under the eupl", 9, 0.98),
    ("ofl", "font", r"this font software is licensed under the sil open font license", 9, 0.99),
    ("ofl", "reserved", r"no modified version of the font software may use the reserved font name", 9, 0.97),
    ("odbl", "database", r"made available under the open database license", 9, 0.98),
    ("odc-by", "attribution", r"open data commons attribution license", 9, 0.97),
    ("pddl", "dedication", r"public domain dedication and license", 9, 0.95),
    ("ms-pl", "microsoft", r"microsoft public license \(ms pl\)", 9, 0.98),
    ("ms-rl", "microsoft", r"microsoft reciprocal license \(ms rl\)", 9, 0.98),
    ("afl", "academic", r"licensed under the academic free license", 9, 0.98),
    ("osl", "open", r"licensed under the open software license", 9, 0.98),
    ("ncsa", "illinois", r"university of illinois/ncsa open source license", 9, 0.98),
    ("w3c", "w3c", r"\bw3c software (?:notice and )?licen[sc]e", 9, 0.97),
    ("qpl", "public", r"\bq public license", 8, 0.95),
    ("sleepycat", "sleepycat", r"\bsleepycat licen[sc]e", 9, 0.97),
    ("vim", "vim", r"\bvim licen[sc]e", 8, 0.9),
    ("json", "software", r"the software shall be used for good, not evil", 9, 0.98),
    ("curl", "curl", r"\bcurl licen[sc]e", 8, 0.85),
    ("icu", "unicode", r"unicode,? inc\.? licen[sc]e agreement", 9, 0.95),
    ("busl", "business", r"\bbusiness source license", 9, 0.97),
    ("sspl", "side", r"\bserver side public license", 9, 0.98),
    ("elastic", "elastic", r"\belastic license", 9, 0.95),
    ("commons-clause", "commons", r"commons clause license condition", 9, 0.97),
    ("polyform", "polyform", r"\bpolyform (?:noncommercial|small business|shield|strict) license", 9, 0.97),
    ("llama", "llama", r"\bllama [0-9.]{1,4} community license", 9, 0.97),
    ("openrail", "openrail", r"\bopenrail(?:\+\+)? m? ?licen[sc]e", 9, 0.95),
    ("proprietary", "confidential", r"confidential and proprietary", 7, 0.8),
    ("proprietary", "trade", r"contains (?:confidential information and )?trade secrets", 7, 0.75),
    ("proprietary", "prohibited", r"unauthori[sz]ed (?:copying|reproduction|distribution|use) (?:of this (?:file|document|software|work),? .{0,40})?is (?:strictly )?prohibited", 8, 0.9),
    ("proprietary", "reproduced", r"no part of this (?:publication|book|work|document) may be reproduced", 8, 0.9),
    ("proprietary", "written", r"without (?:the )?(?:prior|express) written (?:permission|consent) of", 7, 0.6),
    ("proprietary", "agreement", r"end user license agreement", 7, 0.75),
    ("proprietary", "evaluation", r"for (?:internal )?evaluation purposes only", 7, 0.6),
    ("proprietary", "tous", r"tous droits r[ée]serv[ée]s", 7, 0.85),
    ("proprietary", "alle", r"alle rechte vorbehalten", 7, 0.85),
    ("proprietary", "todos", r"todos los derechos reservados", 7, 0.85),
    ("non-commercial", "commercial", r"for non ?commercial (?:use|purposes|research)(?: purposes)? only", 7, 0.7),
    ("research-only", "research", r"for research (?:use|purposes) only", 7, 0.6),
)
#: A text whose lower-cased form has none of these strings has no base phrase and no detection.
GATE = (
    "licens", "licenc", "permission", "redistribution", "proprietary", "as-is", "copyright", "warrant", "merchantability", "copyleft", "common", "domain", "reserved", "prohibited", "reproduced",
    "secrets", "consent", "vorbehalten", "droits", "derechos", "purposes", "perpetual", "negligence", "misrepresented", "altered", "invariant", "foundation", "eclipse", "mozilla", "franklin",
    "executable", "perl", "noncommercial", "commercial", "software", "freedom", "attribution", "incompatible", "research", "microsoft", "merge",
)
#: Phrases that pass the gate as well; a space stands for any separator.
GATE_PHRASES = ("(?:released|distributed|available|published) under", "cc by")
#: Of a versioned form ("GPL 3"), which needs no other gate string, only families whose name is unmistakable are scanned.
VERSIONED = ("agpl", "lgpl", "gpl", "mpl", "cddl", "cc0", "cc", "eclipse", "mozilla", "affero")
SEP = r"[\s,_-]+"
NON_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _spaced(rx: str) -> str:
    """rx with any separator for a space; optional spaces and those in character classes may be one or none."""
    return rx.replace(" ?", r"[\s,_-]*").replace("[ -]", SEP).replace(" ", SEP)


def rules() -> list[tuple[str, str, str, int, float]]:
    """(keyword, regex, label, priority, weight), highest priority first: forms times families, then sentences."""
    made = [
        (keyword, _spaced(form).format(_spaced(name)), label, 100 * priority + len(name), weight)
        for kind, form, priority, weight in FORMS
        for label, keyword, name in FAMILIES
        if kind != "versioned" or keyword in VERSIONED
    ]
    made += [(keyword, _spaced(rx), label, 100 * priority, weight) for label, keyword, rx, priority, weight in SENTENCES]
    return sorted(made, key=lambda r: -r[3])


def _rules_column() -> Column:
    return F.array(*[
        F.struct(F.lit(k).alias("kw"), F.lit(rf"\G((?s:.*?))({rx})").alias("rx"), F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(w).alias("weight"))
        for k, rx, label, p, w in rules()
    ])


def detections(low: str = "low") -> Column:
    """array<struct<start,end_neg,rank,label,weight>> of every rule match in the lower-cased column, sorted."""
    matches = f"zip_with(regexp_extract_all({low}, r.rx, 1), regexp_extract_all({low}, r.rx, 2), (a, b) -> named_struct('pre', a, 'hit', b))"
    span = "named_struct('start', y.start, 'end_neg', -y.end, 'rank', -r.priority, 'label', r.label, 'weight', r.weight)"
    return F.expr(f"sort_array(flatten(transform(filter(_rules, r -> contains({low}, r.kw)), r -> transform({placed(matches, {})}, y -> {span}))))")


def kept_detections(found: str = "found") -> Column:
    """Sweep by (start, longest first, priority): what ends within an earlier detection lies inside it and goes."""
    return F.expr(f"""aggregate({found},
      named_struct('reach', 0, 'labels', cast(array() AS array<string>), 'miss', 1.0D, 'n', 0L),
      (s, d) -> IF(-d.end_neg <= s.reach, s, named_struct('reach', -d.end_neg, 'labels', array_union(s.labels, array(d.label)),
                                                          'miss', s.miss * (1.0D - d.weight), 'n', s.n + 1L)))""")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections for each document."""
    # every word gets two spaces of its own, so neighbouring phrases never share one
    d = texts(docs).withColumn("w", F.trim(F.regexp_replace("text", NON_WORD, "  ")))
    d = d.withColumn("n_words", F.expr("IF(w = '', 0L, CAST((octet_length(w) - octet_length(replace(w, '  ', ''))) / 2 + 1 AS BIGINT))"))
    # only gated texts are folded and split; lower() can but add to what translate() gives, so the gate misses nothing
    gates = " OR ".join(f"contains(_l, '{g}')" for g in (*GATE, *VERSIONED) if g != "cc")
    gates += f" OR rlike(_l, r'{'|'.join(map(_spaced, GATE_PHRASES))}')"
    d = d.withColumn("_l", F.lower("text")).withColumn("low", F.expr(f"IF({gates}, text, NULL)"))
    d = d.withColumn("low", F.when(F.col("low").isNotNull(), ascii_lower(F.col("low")))).drop("text", "_l")
    d = d.withColumn("w", F.when(F.col("low").isNotNull(), F.concat(F.lit(" "), ascii_lower(F.col("w")), F.lit(" "))))
    spaces = "CAST((octet_length({0}) - octet_length(replace({0}, ' ', ''))) / 2 AS BIGINT)"
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES:
        p = f" {phrase.replace(' ', '  ')} "
        has = f"coalesce(contains(w, '{p}'), false)"
        counts.append(f"IF({has}, CAST((octet_length(w) - octet_length(replace(w, '{p}', ''))) / {len(p)} AS BIGINT), 0L)")
        head, tail = f"substring_index(w, '{p}', 1)", f"substring_index(w, '{p}', -1)"
        firsts.append(f"IF({has}, {spaces.format(head)}, NULL)")
        lasts.append(f"IF({has}, n_words - {len(phrase.split())} - {spaces.format(tail)}, NULL)")
        labels.append(f"IF({has}, '{label}', NULL)")
    d = d.withColumns({
        "n_base": F.expr(" + ".join(counts)),
        "first_word": F.expr(f"least({', '.join(firsts)})"),
        "last_word": F.expr(f"greatest({', '.join(lasts)})"),
        "base": F.expr(f"sort_array(array_compact(array({', '.join(labels)})))"),
    }).drop("w")
    d = d.withColumn("_rules", F.when(F.col("low").isNotNull(), _rules_column()))
    d = d.withColumn("found", F.when(F.col("low").isNotNull(), detections())).drop("_rules", "low")
    d = d.withColumn("k", F.when(F.size("found") > 0, kept_detections()))
    return d.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.expr("array_join(sort_array(array_union(base, coalesce(k.labels, cast(array() AS array<string>)))), ',')").alias("labels"),
        F.expr("IF(n_base > 0, greatest(0.5D, 1.0D - coalesce(k.miss, 1.0D)), 1.0D - coalesce(k.miss, 1.0D))").alias("score"),
        F.expr("coalesce(k.n, 0L)").alias("n_detections"),
    )
