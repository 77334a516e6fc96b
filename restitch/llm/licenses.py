"""License scans by sentence rules, with Spark SQL functions only.

A text is split into sentences, sentences are normalised to lower-case words, and known licence sentences are
replaced by their identifiers; a sentence that puts something under named licences gives one for each name, and so
does a tag with licence ids.  Ordered rules then say which licence an identifier sequence shows: a rule holds when
its identifiers follow each other in the text, whatever lies between.

The sentences below are as licences print them: they are cut and normalised by the splitter's own expressions.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GPL = {"gpl": "GNU General Public License", "lgpl": "GNU Lesser General Public License", "agpl": "GNU Affero General Public License"}
_VERSIONS = {"gpl": ("2", "3"), "lgpl": ("2.1", "3"), "agpl": ("3",)}
#: What public licences and their notices say, by what it shows.
SENTENCES = {
    "apache_head": ['Licensed under the Apache License, Version 2.0 (the "License")', 'licensed to you under the Apache License, Version 2.0 (the "License")', 'licenses this file to you under the Apache License, Version 2.0 (the "License")'],
    "apache_use": ["you may not use this file except in compliance with the License", "you may not use this work except in compliance with the License", "you may not use this software except in compliance with the License"],
    "apache_asis": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "apache_title": ["Apache License"],
    "mit_grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'],
    "mit_notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "bsd_grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd_source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd_binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd_names": ["nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc_grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "gpl_hope": ["is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "gpl_implied": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "mpl_form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "zlib_grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "zlib_origin": ["The origin of this software must not be misrepresented"],
    "boost_grant": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following'],
    "cc0_deed": ["The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law"],
    "cc0_waived": ["has waived all copyright and related or neighboring rights", "have waived all copyright and related or neighboring rights"],
    "cc0_title": ["CC0 1.0 Universal"],
    "wtfpl_title": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"], "wtfpl_terms": ["You just DO WHAT THE FUCK YOU WANT TO", "0. You just DO WHAT THE FUCK YOU WANT TO"],
    "cddl_form": ['The contents of this file are subject to the terms of the Common Development and Distribution License (the "License")', "The contents of this file are subject to the terms of the Common Development and Distribution License"],
    "cddl10_title": ["COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0"], "cddl11_title": ["COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.1"],
    "eupl_form": ['Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the "Licence")'],
    "reserved": ["All rights reserved"],
    "apache_date": ["Version 2.0, January 2004"], "gpl2_date": ["Version 2, June 1991"], "gpl3_date": ["Version 3, 29 June 2007"], "lgpl2_date": ["Version 2.1, February 1999"], "agpl3_date": ["Version 3, 19 November 2007"],
    "ref:MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ref:ISC": ["ISC License", "The ISC License"], "ref:BSD-3-Clause": ["BSD 3-Clause License"], "ref:BSD-2-Clause": ["BSD 2-Clause License"],
    "ref:MPL-2.0": ["Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"],
}
for _v in ("2", "2.1", "3"):
    SENTENCES[f"v{_v}_later"] = [f"either version {_v} of the License, or (at your option) any later version"]
    SENTENCES[f"v{_v}_this"] = [f"version {_v} of the License"]
for _k, _name in _GPL.items():
    _does = f"you can redistribute it and/or modify it under the terms of the {_name}"
    SENTENCES[f"{_k}_title"], SENTENCES[f"{_k}_terms"] = [_name], [f"{_does} as published by the Free Software Foundation"]
    for _v in _VERSIONS[_k]:
        SENTENCES[f"{_k}{_v}_whole"] = [f"{_does} as published by the Free Software Foundation, {SENTENCES[f'v{_v}_later'][0]}"]
        SENTENCES[f"{_k}{_v}_only"] = [f"{_does} version {_v} as published by the Free Software Foundation", f"{_does} as published by the Free Software Foundation, version {_v}", f"{_does} as published by the Free Software Foundation, version {_v} of the License"]
#: How licences are named in running text, as expressions over normalised words.
_2, _3, _LATER = "(?:version |v ?)?2(?: 0)?", "(?:version |v ?)?3(?: 0)?", " (?:or (?:any )?later|or newer|or at your option any later)"
_FREE, _LESSER, _AFFERO = "(?:(?:gnu|the|under|a|as|is) general public license|gpl|gnu gpl) ?", "(?:(?:lesser|library) general public license|lgpl) ?", "(?:affero general public license|agpl) ?"
NAMES = {
    "Apache-2.0": f"apache (?:software |public )?(?:license )?{_2}",
    "MIT": "(?:mit|expat) (?:x11 |open source |expat )?licen[sc]e|under (?:the )?(?:terms of )?(?:the )?mit",
    "BSD-3-Clause": "bsd 3 clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd",
    "BSD-2-Clause": "bsd 2 clause|(?:2|two) clause bsd|simplified bsd|freebsd license",
    "ISC": "isc licen[sc]e",
    "MPL-2.0": f"(?:mozilla public license|mpl) ?{_2}",
    "EPL-2.0": f"(?:eclipse public license|epl) ?{_2}",
    "BSL-1.0": "boost software license(?: version)?(?: 1 0)?",
    "Unlicense": "the unlicense",
    "CC0-1.0": "cc0(?: 1 0)?|creative commons (?:zero|cc0)",
    "WTFPL": "wtfpl",
    "Zlib": "zlib(?: libpng)? licen[sc]e",
    "CDDL-1.0": "(?:common development and distribution license(?: cddl)?|cddl) ?(?:version |v ?)?1 0",
    "CDDL-1.1": "(?:common development and distribution license(?: cddl)?|cddl) ?(?:version |v ?)?1 1",
    "EUPL-1.2": "(?:european union public licen[sc]e|eupl) ?(?:version |v ?)?1 2",
    "AGPL-3.0": _AFFERO + _3, "LGPL-3.0": _LESSER + _3, "LGPL-2.1": _LESSER + "(?:version |v ?)?2 1", "GPL-3.0": _FREE + _3, "GPL-2.0": _FREE + _2,
}
for _name in ("AGPL-3.0", "LGPL-3.0", "LGPL-2.1", "GPL-3.0", "GPL-2.0"):
    NAMES[f"{_name}-or-later"] = NAMES[_name] + _LATER
_CC = {"BY-NC-SA": "(?:by nc sa|attribution non ?commercial share ?alike)", "BY-NC-ND": "(?:by nc nd|attribution non ?commercial no ?deriv(?:s|atives))", "BY-NC": "(?:by nc|attribution non ?commercial)", "BY-SA": "(?:by sa|attribution share ?alike)", "BY-ND": "(?:by nd|attribution no ?deriv(?:s|atives))", "BY": "(?:by|attribution)"}
for _code, _words in _CC.items():
    for _v in ("4.0", "3.0", "2.5", "2.0"):
        NAMES[f"CC-{_code}-{_v}"] = f"(?:cc|creative commons) {_words} {_v.replace('.', ' ')}"
#: Ordered rules: the first that holds is the text's main licence.  Whole texts come first, then notices, then names.
RULES = [
    ("Apache-2.0", ["apache_title", "apache_date"]),
    ("AGPL-3.0", ["agpl_title", "agpl3_date"]),
    ("LGPL-3.0", ["lgpl_title", "gpl3_date"]),
    ("LGPL-2.1", ["lgpl_title", "lgpl2_date"]),
    ("GPL-3.0", ["gpl_title", "gpl3_date"]),
    ("GPL-2.0", ["gpl_title", "gpl2_date"]),
    ("Apache-2.0", ["apache_head", "apache_use", "apache_asis"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("ISC", ["isc_grant"]),
    ("MPL-2.0", ["mpl_form"]),
    ("Unlicense", ["unlicense"]),
    ("Zlib", ["zlib_grant", "zlib_origin"]),
    ("BSL-1.0", ["boost_grant"]),
    ("WTFPL", ["wtfpl_title", "wtfpl_terms"]),
    ("CC0-1.0", ["cc0_deed"]),
    ("CC0-1.0", ["cc0_waived"]),
    ("CC0-1.0", ["cc0_title"]),
    ("CDDL-1.1", ["cddl11_title"]),
    ("CDDL-1.0", ["cddl10_title"]),
    ("CDDL-1.0", ["cddl_form"]),
    ("EUPL-1.2", ["eupl_form"]),
]
for _k in ("agpl", "lgpl", "gpl"):
    for _v in reversed(_VERSIONS[_k]):
        _name = f"{_k.upper()}-{_v}" + ".0" * (len(_v) == 1)
        RULES += [(f"{_name}-or-later", [f"{_k}{_v}_whole"]), (f"{_name}-or-later", [f"{_k}_terms", f"v{_v}_later"])]
        RULES += [(f"{_name}-only", [f"{_k}{_v}_only"]), (f"{_name}-only", [f"{_k}_terms", f"v{_v}_this"])]
_ONLY = ["AGPL-3.0-only", "LGPL-3.0-only", "LGPL-2.1-only", "GPL-3.0-only", "GPL-2.0-only"]
RULES += [(name, [f"ref:{name}"]) for name in [*[n for n in NAMES if n.endswith("later")], *_ONLY, *[n for n in NAMES if not n.endswith("later")]]]
RULES += [("Public-Domain", ["public_domain"]), ("All-Rights-Reserved", ["reserved"])]
#: Every rule needs something that holds one of these, so a text without any has nothing to look up.
STEMS = ["licen", "permission", "redistribut", "copyright", "domain", "reserved", "mpl", "epl", "cc0", "gpl", "apache", "bsd", "commons", "cc by", "cc-by", "wtfpl", "under mit", "under the mit", "cddl", "eupl", "do what the fuck", "zlib", "waived"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What ends a sentence once white space is single blanks; a full stop inside 2.0 or a host name does not.
SENTENCE_END = r"[.!?;:]+( |$)"
#: A line without a letter or digit parts paragraphs, whatever marks of a comment it has.
PARAGRAPH = r"\n[^\p{L}\p{N}\n]*\n"
ADDRESS = r"(https?://[^ \t\n\x0B\f\r]+)"
BLANKS = r"[ \t\n\x0B\f\r]+"
#: A holder's name, whatever it is, before what is said of it.
HOLDER = r"^(?:neither the names? of .* (nor the names? of )|.* (licenses this file to you under )|.* (is distributed in the hope that it will )|to the extent possible under law .* (ha(?:s|ve) waived all copyright and related or neighboring rights).*$)"
#: What is left of a sentence that HOLDER fits.
HELD = r"$1$2$3$4"
#: A sentence that puts something under a licence.
REFERENCE = r"\b(?:licen[sc]ed|dual licen[sc]ed|released|distributed|redistributed|available|published|provided|offered|covered|shared) (?:[a-z0-9]+ ){0,4}?(?:under|with)\b"
#: What a sentence says that it is not put under.
DENIED = r"\b(?:not|never|no longer) (?:[a-z0-9]+ ){0,2}?(?:licen[sc]ed|released|distributed|redistributed|available|published|provided|offered|covered|shared) .*?(?: but |$)"
#: A sentence that gives something up.
PUBLIC = r"\b(?:is|are|been) (?:hereby )?(?:placed |released |dedicated |put )?(?:in|into|to) the public domain\b"
#: A tag with an expression of licence ids, and what parts the ids.
TAG = r"(?:spdx-license-identifier|licen[sc]e(?:-expression)?)[\"']?[ \t]*[:=][ \t]*[\"']?([a-z0-9.+() \t-]+)"
ID_ENDS = r"[() \t]+"
#: Exceptions that an expression may add to a licence.
EXCEPTIONS = ["Classpath-exception-2.0", "GCC-exception-2.0", "GCC-exception-3.1", "LLVM-exception", "Linux-syscall-note", "Autoconf-exception-3.0", "Bison-exception-2.2", "Font-exception-2.0", "OpenSSL-exception"]
OPERATORS = ["and", "or", "with"]


def _plain(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


@lru_cache(maxsize=1)
def known() -> dict[str, str]:
    """Normalised sentence to identifier: what the splitter makes of each known sentence."""
    cut = SENTENCE_END.replace("( |$)", "(?: |$)")
    return {_plain(re.split(cut, " ".join(s.split()).lower())[0]): i for i, own in SENTENCES.items() for s in own}


@lru_cache(maxsize=1)
def ids() -> dict[str, str]:
    """Licence ids of tags, in lower case, to identifiers."""
    out = {name.lower(): f"ref:{name}" for name in NAMES}
    for name in [n.removesuffix("-only") for n in _ONLY]:
        out |= {f"{name}-only".lower(): f"ref:{name}-only", f"{name}+".lower(): f"ref:{name}-or-later"}
    return out


@lru_cache(maxsize=1)
def marks() -> dict[str, str]:
    """What an expression of licence ids is made of, in lower case, and how it is written."""
    out = {k: v.removeprefix("ref:") for k, v in ids().items()} | {e.lower(): e for e in EXCEPTIONS} | {o: o.upper() for o in OPERATORS}
    return out | {"(": "(", ")": ")"}


def named() -> list[tuple[str, str | None, str]]:
    """(expression, expression to give way to, identifier) of each licence that a reference may name."""
    word = lambda p: rf"\b(?:{p})\b"
    return [(word(p), word(NAMES[f"{n}-or-later"]) if f"{n}-or-later" in NAMES else None, f"ref:{n}") for n, p in NAMES.items()]


def rule_pattern(ids: list[str]) -> str:
    """Of a rule over ",a,b,": its identifiers one after the other, with any between."""
    return "," + ",(.*,)?".join(i.replace(".", r"\.") for i in ids) + ","


def _table(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in d.items() for x in pair])


def _sequence(text: Column, ends: str) -> Column:
    """The identifiers of a text's known sentences, in order."""
    sentences = F.transform(F.split(text, ends, -1), lambda s: F.regexp_replace(F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")), HOLDER, HELD))
    whole = lambda s: F.element_at(_table(known()), s)
    none = F.array().cast("array<string>")
    # only a sentence with a reference is looked at for what it denies
    kept = lambda s: F.get(F.transform(F.array(F.regexp_replace(s, DENIED, " ")), lambda t: F.when(t.rlike(REFERENCE), _told(t)).otherwise(none)), F.lit(0))
    return F.flatten(F.transform(sentences, lambda s: F.when(whole(s).isNotNull(), F.array(whole(s))).when(s.rlike(REFERENCE), kept(s)).when(s.rlike(PUBLIC), F.array(F.lit("public_domain"))).otherwise(none)))


def _told(s: Column) -> Column:
    """The licences that normalised words name."""
    return F.array_compact(F.array(*[F.when(s.rlike(p) & (~s.rlike(but) if but else F.lit(True)), F.lit(i)) for p, but, i in named()]))


def _tagged(low: Column) -> Column:
    """The identifiers of the licence ids of all tags, in order; of a tag without an id those of the licences that it names."""

    def of(e: Column) -> Column:
        found = F.filter(F.transform(F.split(e, ID_ENDS, -1), lambda i: F.element_at(_table(ids()), F.rtrim(i, F.lit(".")))), lambda i: i.isNotNull())
        return F.get(F.transform(F.array(found), lambda x: F.when(F.size(x) > 0, x).otherwise(_told(F.trim(F.regexp_replace(e, "[^a-z0-9]+", " "))))), F.lit(0))

    return F.flatten(F.transform(F.regexp_extract_all(low, F.lit(TAG), F.lit(1)), of))


def _expression(low: Column) -> Column:
    """The first tag's expression, as it is written, if it is one of known ids with operators; else null."""
    given = F.trim(F.regexp_replace(F.regexp_replace(F.rtrim(F.regexp_extract(low, TAG, 1), F.lit(". \t")), r"([()])", " $1 "), r"[ \t]+", " "))
    parts = F.split(given, " ")
    written = F.transform(parts, lambda i: F.element_at(_table(marks()), i))
    joined = F.replace(F.replace(F.array_join(written, " "), F.lit("( "), F.lit("(")), F.lit(" )"), F.lit(")"))
    return F.when(F.exists(parts, lambda i: i.isin(OPERATORS)) & ~F.exists(written, lambda i: i.isNull()), joined)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, license, licenses, expression of each row of ``docs``.

    Sentences are told apart three times: by sentence ends with lines run together (as licence texts are wrapped),
    by lines as well (as a reference may stand in a line between others), and as the first with an end after each
    paragraph and address (as a header follows a copyright line); a rule may hold in any sequence, or in that of the
    tags' ids.  ``sentence_ids`` is the second sequence, or of the first, the third and the tags' the first that is
    longer than those before it.  ``license`` is the first rule's that holds, ``licenses`` are all, in the order of the
    rules; ``expression`` is that of the first tag, where it joins ids by AND, OR or WITH, and then the licence as well; a text without a licence, an empty or a null text has null and "".  Repeated rows and ids are scanned
    alike; very long texts are scanned whole; an empty table gives no rows; other columns are ignored.
    """
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(reduce(Column.__or__, [low.contains(s) for s in STEMS]), F.regexp_replace(low, "\r\n?", "\n")).otherwise("").alias("low"))
    parts = F.regexp_replace(F.regexp_replace("low", PARAGRAPH, " . "), ADDRESS, "$1. ")
    runs = rows.select(
        "doc_id",
        _sequence(F.regexp_replace("low", BLANKS, " "), SENTENCE_END).alias("wrapped"),
        _sequence(F.col("low"), rf"\n|{SENTENCE_END}").alias("lined"),
        _sequence(F.regexp_replace(parts, BLANKS, " "), SENTENCE_END).alias("parted"),
        _tagged(F.col("low")).alias("tagged"),
        _expression(F.col("low")).alias("expression"),
    )
    told = lambda c: F.concat(F.lit(","), F.array_join(c, ","), F.lit(","))
    kinds = ["lined", "wrapped", "parted", "tagged"]
    more = F.col("lined")
    for k, c in enumerate(kinds[1:], 1):
        more = F.when(F.size(c) > F.greatest(*[F.size(x) for x in kinds[:k]], F.lit(0)), F.col(c)).otherwise(more)
    runs = runs.select("doc_id", "expression", more.alias("ids"), *[told(c).alias(c) for c in kinds])
    holds = lambda p: F.col("wrapped").rlike(p) | F.col("lined").rlike(p) | F.col("parted").rlike(p) | F.col("tagged").rlike(p)
    shown = [F.when(holds(rule_pattern(own)), F.lit(name)) for name, own in RULES]
    found = F.when(F.size("ids") > 0, F.array_distinct(F.array_compact(F.array(*shown)))).otherwise(F.array().cast("array<string>"))
    runs = runs.select("doc_id", "expression", "ids", found.alias("found"))
    return runs.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.coalesce("expression", F.get("found", F.lit(0))).alias("license"),
        F.array_join("found", ",").alias("licenses"),
        "expression",
    )


def oracle_sql() -> str:
    """The same for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    lookup = lambda d: "MAP {" + ", ".join(f"{quote(s)}: {quote(i)}" for s, i in d.items()) + "}"
    blanks = "[ \\t\\n\\v\\f\\r]+"

    def names(s: str) -> str:
        each = ", ".join(f"CASE WHEN regexp_matches({s}, {quote(p)})" + (f" AND NOT regexp_matches({s}, {quote(but)})" if but else "") + f" THEN {quote(i)} END" for p, but, i in named())
        return f"list_filter([{each}], lambda i: i IS NOT NULL)"

    def seq(text: str, ends: str) -> str:
        plain = f"regexp_replace(trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')), {quote(HOLDER)}, '\\1\\2\\3\\4')"
        sentences = f"list_transform(regexp_split_to_array({text}, {quote(ends)}), lambda s: {plain})"
        whole = f"{lookup(known())}[s]"
        kept = f"list_transform([regexp_replace(s, {quote(DENIED)}, ' ', 'g')], lambda t: CASE WHEN regexp_matches(t, {quote(REFERENCE)}) THEN {names('t')} ELSE [] END)[1]"
        told = f"CASE WHEN {whole} IS NOT NULL THEN [{whole}] WHEN regexp_matches(s, {quote(REFERENCE)}) THEN {kept} WHEN regexp_matches(s, {quote(PUBLIC)}) THEN ['public_domain'] ELSE [] END"
        return f"flatten(list_transform({sentences}, lambda s: {told}))"

    address = "regexp_replace(regexp_replace(low, " + quote(PARAGRAPH) + ", ' . ', 'g'), " + quote(ADDRESS.replace("\\x0B", "\\v")) + ", '\\1. ', 'g')"
    one_line = lambda text: f"regexp_replace({text}, '{blanks}', ' ', 'g')"
    by_id = f"list_filter(list_transform(regexp_split_to_array(e, {quote(ID_ENDS)}), lambda i: {lookup(ids())}[rtrim(i, '.')]), lambda i: i IS NOT NULL)"
    spelt = "list_transform([trim(regexp_replace(e, '[^a-z0-9]+', ' ', 'g'))], lambda t: " + names("t") + ")[1]"
    tagged = f"flatten(list_transform(regexp_extract_all(low, {quote(TAG)}, 1), lambda e: CASE WHEN len({by_id}) > 0 THEN {by_id} ELSE {spelt} END))"
    given = f"string_split(trim(regexp_replace(regexp_replace(rtrim(regexp_extract(low, {quote(TAG)}, 1), '. ' || chr(9)), '([()])', ' \\1 ', 'g'), '[ \\t]+', ' ', 'g')), ' ')"
    written = f"list_transform({given}, lambda i: {lookup(marks())}[i])"
    joined = f"replace(replace(array_to_string({written}, ' '), '( ', '('), ' )', ')')"
    expression = f"CASE WHEN len(list_filter({given}, lambda i: i IN ({', '.join(map(quote, OPERATORS))}))) > 0 AND len(list_filter({written}, lambda i: i IS NULL)) = 0 THEN {joined} END"
    any_of = lambda p: " OR ".join(f"regexp_matches({c}, {quote(p)})" for c in "wlpt")
    ordered = ", ".join(f"CASE WHEN {any_of(rule_pattern(own))} THEN {k} END" for k, (_, own) in enumerate(RULES))
    listed = "[" + ", ".join(quote(name) for name, _ in RULES) + "]"
    return f"""
        WITH rows AS (
            SELECT doc_id, CASE WHEN {" OR ".join(f"contains(low, {quote(s)})" for s in STEMS)} THEN regexp_replace(low, '\\r\\n?', chr(10), 'g') ELSE '' END AS low
            FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents)
        ), runs AS (
            SELECT doc_id, {seq(one_line("low"), SENTENCE_END)} AS wrapped, {seq("low", chr(92) + "n|" + SENTENCE_END)} AS lined, {seq(one_line(address), SENTENCE_END)} AS parted, {tagged} AS tagged, {expression} AS expression FROM rows
        ), told AS (
            SELECT doc_id, expression, CASE WHEN len(tagged) > greatest(len(lined), len(wrapped), len(parted)) THEN tagged WHEN len(parted) > greatest(len(lined), len(wrapped)) THEN parted
                   WHEN len(wrapped) > len(lined) THEN wrapped ELSE lined END AS ids,
                   ',' || array_to_string(wrapped, ',') || ',' AS w, ',' || array_to_string(lined, ',') || ',' AS l, ',' || array_to_string(parted, ',') || ',' AS p, ',' || array_to_string(tagged, ',') || ',' AS t FROM runs
        ), held AS (
            SELECT doc_id, expression, ids, CASE WHEN len(ids) = 0 THEN [] ELSE list_transform(list_filter([{ordered}], lambda k: k IS NOT NULL), lambda k: {listed}[k + 1]) END AS found FROM told
        ), firsts AS (
            SELECT doc_id, expression, ids, list_filter(found, lambda x, i: list_position(found, x) = i) AS found FROM held
        )
        SELECT doc_id, len(ids) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
               coalesce(expression, found[1]) AS license, expression, coalesce(array_to_string(found, ','), '') AS licenses
        FROM firsts"""
