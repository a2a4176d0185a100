"""License scans: ordered signature rules as Spark column expressions.

A text is brought to its lower-case words, each with a space at either end. A rule is a regex over these words,
a priority and a keyword: what license texts say themselves, and what texts say of licenses by their names. Only texts with a license word at all are normalised, and only rules whose keyword
the text has are matched. Of the matches, an interval of words that lies within another one of equal or
higher priority is suppressed. What is left gives the labels. No Python runs on the executors.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The phrases that must be found, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: What separates words; A-Z counts as a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before lower-casing
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: label, keyword, name, identifier; names and identifiers are regexes over words with one space between.
LICENSES = [
    ("mit", "mit", "mit (?:open source )?license", "mit"),
    ("mit-0", "mit", "mit no attribution(?: license)?", "mit 0"),
    ("x11", "x11", "x11 license", "x11"),
    ("isc", "isc", "isc license", "isc"),
    ("apache", "apache", "apache (?:software )?license", "apache [12](?: [01])?"),
    ("gpl", "general", "(?:gnu )?general public license", "gpl [123](?: 0)?(?: only| or later)?"),
    ("gpl", "gpl", "(?:gnu )?gpl(?: ?v?[123])?(?: license)?", "gpl v?[123]"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public license", "lgpl [23](?: [01])?(?: only| or later)?"),
    ("lgpl", "library", "(?:gnu )?library general public license", "lgpl 2 0(?: only| or later)?"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl(?: ?v?[23])?(?: license)?", "lgpl v?[23]"),
    ("agpl", "affero", "(?:gnu )?affero general public license", "agpl 3 0(?: only| or later)?"),
    ("agpl", "agpl", "(?:gnu )?agpl(?: ?v?3)?(?: license)?", "agpl v?3"),
    ("gfdl", "documentation", "(?:gnu )?free documentation license", "gfdl 1 [123](?: only| or later)?"),
    ("bsd", "bsd", "(?:new |modified |simplified |original )?bsd(?: [0234] clause)? license", "bsd [0234] clause"),
    ("bsd-patent", "bsd", "bsd(?: 2 clause)? plus patent license", "bsd 2 clause patent"),
    ("0bsd", "0bsd", "0bsd license", "0bsd"),
    ("mpl", "mozilla", "mozilla public license", "mpl [12] [01]"),
    ("mpl", "mpl", "mpl v?[12](?: [01])? license", "mpl v?[12]"),
    ("epl", "eclipse", "eclipse public license", "epl [12] 0"),
    ("cddl", "distribution", "common development and distribution license", "cddl 1 [01]"),
    ("cpl", "common", "common public license", "cpl 1 0"),
    ("eupl", "union", "european union public licence", "eupl 1 [012]"),
    ("osl", "open", "open software license", "osl [123] [01]"),
    ("afl", "academic", "academic free license", "afl [123] [012]"),
    ("artistic", "artistic", "artistic license", "artistic [12] 0"),
    ("zlib", "zlib", "zlib(?: libpng)? license", "zlib"),
    ("boost", "boost", "boost software license", "bsl 1 0"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl(?: license)?", "wtfpl"),
    ("python", "python", "python software foundation license", "psf 2 0"),
    ("php", "php", "php license", "php 3 0?1?"),
    ("ruby", "ruby", "ruby license", "ruby"),
    ("postgresql", "postgresql", "postgresql license", "postgresql"),
    ("openssl", "openssl", "openssl license", "openssl"),
    ("ofl", "font", "(?:sil )?open font license", "ofl 1 [01]"),
    ("ecl", "community", "educational community license", "ecl [12] 0"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? license", "ncsa"),
    ("ms-pl", "microsoft", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license", "ms rl"),
    ("odbl", "database", "open (?:data commons open )?database license", "odbl 1 0"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("public-domain", "domain", "public domain(?: dedication)?", "public domain"),
    ("cc-by", "cc", "cc by(?: [1234] [05])?", "cc by [1234] [05]"),
    ("cc-by-sa", "cc", "cc by sa(?: [1234] [05])?", "cc by sa [1234] [05]"),
    ("cc-by-nd", "cc", "cc by nd(?: [1234] [05])?", "cc by nd [1234] [05]"),
    ("cc-by-nc", "cc", "cc by nc(?: [1234] [05])?", "cc by nc [1234] [05]"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1234] [05])?", "cc by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1234] [05])?", "cc by nc nd [1234] [05]"),
    ("cc", "commons", "creative commons(?: [a-z]+){0,4} licen[cs]e", "cc [a-z]+"),
    ("proprietary", "rights", "all rights reserved", "proprietary"),
]
#: What license texts themselves say, as label, keyword and regex over words.
SIGNATURES = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "deal", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit", "permission", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", "authors", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("x11", "advertising", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", "the software is provided as is and (?:the author|isc) disclaims all warranties with regard to this software"),
    ("isc", "liable", "in no event shall (?:the author|isc) be liable for any special direct indirect or consequential damages"),
    ("hpnd", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("postgresql", "agreement", "for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice(?: this list of conditions)?"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice(?: this list of conditions)?"),
    ("bsd", "endorse", "nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "contributors", "this software is provided by the (?:copyright holders and contributors|regents and contributors|author) as is and any express or implied warranties"),
    ("bsd-patent", "patent", "a perpetual worldwide non exclusive no charge royalty free irrevocable patent license to make have made use offer to sell sell import and otherwise transfer this software"),
    ("apache", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "compliance", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache", "contributor", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent)? ?license"),
    ("apache", "notices", "you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache", "derivative", "you must give any other recipients of the work or derivative works a copy of this license"),
    ("apache", "foundation", "this product includes software developed (?:at|by) the apache software foundation"),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "program", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", "received", "you should have received a copy of the gnu general public license along with"),
    ("gpl", "either", "either version [123] of the license or (?:at your option )?any later version"),
    ("gpl", "freedom", "the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change"),
    ("gpl", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl", "library", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "received", "you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("lgpl", "library", "the object code form of an application may incorporate material from a header file that is part of the library"),
    ("agpl", "received", "you should have received a copy of the gnu affero general public license along with"),
    ("agpl", "remotely", "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("agpl", "copyleft", "the gnu affero general public license is a free copyleft license for software"),
    ("gfdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl", "incompatible", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl", "mozilla", "the contents of this file are subject to the mozilla public license version"),
    ("epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", "eclipse", "the accompanying program is provided under the terms of this eclipse public license"),
    ("cpl", "common", "the accompanying program is provided under the terms of this common public license"),
    ("cpl", "recipient", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("cddl", "distribution", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", "cddl", "when distributing covered (?:code|software) include this cddl header notice in each file"),
    ("eupl", "eupl", "licensed under the eupl version 1 [012]"),
    ("eupl", "union", "this european union public licence the eupl applies to the work"),
    ("osl", "open", "licensed under the open software license version [123] [01]"),
    ("afl", "academic", "licensed under the academic free license version [123] [012]"),
    ("ecl", "educational", "licensed under the educational community license version [12] 0"),
    ("artistic", "package", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", "verbatim", "you may make and give away verbatim copies of the source form of the standard version of this package"),
    ("artistic", "package", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("perl", "perl", "you can redistribute it and or modify it under the same terms as perl itself"),
    ("zlib", "authors", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("boost", "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("boost", "boost", "distributed under the boost software license version 1 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "fuck", "do what the fuck you want to(?: public license)?"),
    ("cc0", "waived", "has waived all copyright and related or neighboring rights to"),
    ("cc0", "deed", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", "commons", "creative commons attribution(?: [1234] [05])?(?: international| unported| generic)? licen[cs]e"),
    ("cc-by-sa", "commons", "creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported| generic)? licen[cs]e"),
    ("cc-by-nd", "commons", "creative commons attribution no ?deriv(?:ative)?s(?: [1234] [05])?(?: international| unported| generic)? licen[cs]e"),
    ("cc-by-nc", "commons", "creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported| generic)? licen[cs]e"),
    ("cc-by-nc-sa", "commons", "creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported| generic)? licen[cs]e"),
    ("cc-by-nc-nd", "commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] [05])?(?: international| unported| generic)? licen[cs]e"),
    ("ofl", "font", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("ofl", "font", "this font software is licensed under the sil open font license"),
    ("ofl", "reserved", "with reserved font name"),
    ("python", "python", "this license agreement is between the python software foundation"),
    ("python", "psf", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("php", "php", "this product includes php software freely available from"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("openssl", "cryptographic", "this product includes cryptographic software written by eric young"),
    ("ncsa", "deal", "to deal with the software without restriction including without limitation the rights to use"),
    ("ms-pl", "accept", "if you use the software you accept this license if you do not accept the license do not use the software"),
    ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", "portions of this software are copyright(?: [a-z0-9]+){0,6} the freetype project"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("beerware", "stuff", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("sleepycat", "accompanied", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("openldap", "verbatim", "redistributions must contain a verbatim copy of this document"),
    ("lppl", "latex", "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("w3c", "w3c", "w3c software(?: and document)? (?:notice and )?license"),
    ("unicode", "files", "permission is hereby granted free of charge to any person obtaining a copy of (?:the unicode )?data files and any associated documentation"),
    ("blueoak", "oak", "blue oak model license"),
    ("upl", "universal", "universal permissive license"),
    ("cecill", "cecill", "governed by the cecill(?: [abc])? license"),
    ("sspl", "server", "server side public license"),
    ("busl", "business", "business source license"),
    ("elastic", "elastic", "elastic license(?: 2 0)?"),
    ("commons-clause", "commons", "commons clause license condition"),
    ("commons-clause", "sell", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("odbl", "database", "this (?:[a-z0-9]+ ){1,6}is made available under the open database license"),
    ("odbl", "contents", "any rights in individual contents of the database are licensed under the database contents license"),
    ("ogl", "sector", "contains public sector information licensed under the open government licence"),
    ("public-domain", "holder", "the copyright holder of this work (?:hereby )?releases? (?:it|this work) into the public domain"),
    ("public-domain", "dedicated", "(?:has been |is )?dedicated to the public domain"),
    ("public-domain", "released", "(?:has been |is )?released into the public domain"),
    ("public-domain", "government", "is a work of the united states government(?: [a-z]+){0,12} public domain"),
    ("proprietary", "unauthori", "unauthori[sz]ed copying of this file via any medium is strictly prohibited"),
    ("proprietary", "confidential", "this software is the confidential and proprietary information of"),
    ("proprietary", "part", "no part of this (?:publication|book|document|work|website) may be reproduced"),
    ("proprietary", "written", "may not be (?:copied|reproduced|distributed|used)(?: [a-z]+){0,8} without (?:the )?(?:prior |express )?(?:prior )?written permission"),
    ("proprietary", "end", "this end user license agreement(?: eula)? is a legal agreement"),
    ("proprietary", "reverse", "you may not reverse engineer decompile or disassemble the software"),
    ("non-commercial", "commercial", "licensed for non ?commercial use only"),
    ("non-commercial", "personal", "licensed for personal use only"),
    ("non-commercial", "only", "licensed for (?:academic |research )+(?:use|purposes) only"),
]
#: priority (0 is the highest) and phrase.
FORMS = [
    (0, "(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{name}"),
    (0, "(?:subject to|governed by|covered by|under) (?:the )?(?:terms of )?(?:the )?{name}"),
    (0, "spdx license identifier {id}"),
    (1, "{name} (?:version |v)?[0-9]+(?: [0-9]+)?(?: or (?:any )?later(?: version)?)?"),
    (2, "{name}"),
]
#: How sure a label of each priority is.
SURE = [1.0, 0.8, 0.5]
#: One of these is part of every match (cc by: see gate()).
GATE = ["licen", "gpl", "wtfpl", "cc0", "domain", "reserved", "copyright", "warrant", "redistribut", "liable", "granted", "permi", "eupl", "mpl", "cecill", "software", "fuck", "invariant", "files", "reproduced", "verbatim", "perl", "this notice", "copying", "copied", "cddl", "agreement", "header file", "remotely"]
#: Marks put around a match; no word has them.
OPEN, CLOSE = "\u0001", "\u0002"


@cache
def rules() -> list[tuple[int, int, str, str, str]]:
    """(priority, number, label, keyword, regex); the regex is over words with two spaces between."""
    bodies = [(0, label, keyword, text) for label, keyword, text in SIGNATURES]
    for priority, form in FORMS:
        for label, keyword, name, identifier in LICENSES:
            own = keyword if "{name}" in form else "spdx"
            bodies.append((priority, label, own, form.replace("{name}", f"(?:{name})").replace("{id}", identifier)))
    out = []
    for n, (priority, label, keyword, body) in enumerate(sorted(bodies, key=lambda b: b[0])):
        # A space inside an optional group stands at its end or start, so doubling it keeps words apart.
        body = body.replace(" ?", "(?:  )?").replace(" ", "  ").replace("(?:    )?", "(?:  )?")
        out.append((priority, n, label, keyword, f" ({body}) "))
    return out


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


@cache
def _rule_array() -> str:
    """Rules by keyword, as one SQL literal."""
    by: dict[str, list] = {}
    for r in rules():
        by.setdefault(r[3], []).append(r)
    groups = []
    for keyword, own in by.items():
        structs = ", ".join(f"named_struct('priority', {p}, 'number', {n}, 'label', {_quoted(label)}, 'regex', {_quoted(x)})" for p, n, label, _, x in own)
        # A match has a word that starts with the keyword: forms such as gplv3 join the version to it.
        groups.append(f"named_struct('keyword', {_quoted(f' {keyword}')}, 'rules', array({structs}))")
    return f"array({', '.join(groups)})"


def gate(text: Column) -> Column:
    """Whether any rule can match; false for most texts, at the price of a few substring searches."""
    low = F.lower(text)
    hit = F.contains(low, F.lit("cc")) & F.rlike(text, F.lit(r"(?i)(?<![0-9A-Za-z])cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by"))
    for word in GATE:
        hit = F.contains(low, F.lit(word)) | hit
    return hit


def normal(text: Column) -> Column:
    """Lower-case words with two spaces between, before the first and after the last."""
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(text, UPPER, LOWER), F.lit(" ")), SEPARATORS, "  ")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _numbers(parts: Column, holds) -> Column:
    """Numbers of the words for which ``holds``, in order."""
    return F.filter(F.transform(parts, lambda w, i: F.when(holds(w, i), i - 1)), lambda i: i.isNotNull())


def matches(norm: Column) -> Column:
    """All rules' matches, sorted: array of (start, till, priority, number, label).

    ``start`` is the first word's number, ``till`` minus the one after the last word's: of matches with one
    start the longest comes first, and of equal intervals the highest priority.
    """
    rows = F.flatten(F.transform(F.filter(F.expr(_rule_array()), lambda g: F.contains(norm, g["keyword"])), lambda g: g["rules"]))

    def of_rule(r: Column) -> Column:
        parts = F.split(F.regexp_replace(norm, r["regex"], F.lit(f" {OPEN}$1{CLOSE} ")), "  ")
        return _let(
            parts,
            lambda ws: F.zip_with(
                _numbers(ws, lambda w, i: F.startswith(w, F.lit(OPEN))),
                _numbers(ws, lambda w, i: F.endswith(w, F.lit(CLOSE))),
                lambda a, b: F.struct(a.alias("start"), (-(b + 1)).alias("till"), r["priority"].alias("priority"), r["number"].alias("number"), r["label"].alias("label")),
            ),
        )

    return F.array_sort(F.flatten(F.transform(rows, of_rule)))


def _base(norm: Column) -> Column:
    """(word number, label) of all places of PHRASES."""

    def at(ws: Column) -> Column:
        def label(w: Column, i: Column) -> Column:
            out = F.lit(None).cast("string")
            for phrase, name in PHRASES.items():
                first, *rest = phrase.split()
                holds = w == first
                for k, word in enumerate(rest, 1):
                    holds = holds & (F.get(ws, i + k) == word)
                out = F.when(holds, F.lit(name)).otherwise(out)
            return F.struct((i - 1).alias("word"), out.alias("label"))

        return F.filter(F.transform(ws, label), lambda x: x["label"].isNotNull())

    return _let(F.split(norm, "  "), at)


def _summary(found: Column) -> Column:
    """(labels, best priority, number of detections) after suppression, in one pass over sorted matches.

    What holds a match lies before it in the order; the farthest end so far of each priority and
    the higher ones tells whether anything does.
    """
    start = F.struct(
        *[F.lit(-1).alias(f"end{p}") for p in range(3)], F.array().cast("array<string>").alias("labels"), F.lit(3).alias("best"), F.lit(0).alias("n")
    )

    def step(acc: Column, x: Column) -> Column:
        end = -x["till"]
        far = F.when(x["priority"] == 0, acc["end0"]).when(x["priority"] == 1, acc["end1"]).otherwise(acc["end2"])
        alive = end > far
        return F.struct(
            *[F.when(x["priority"] <= p, F.greatest(acc[f"end{p}"], end)).otherwise(acc[f"end{p}"]).alias(f"end{p}") for p in range(3)],
            F.when(alive, F.array_union(acc["labels"], F.array(x["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(alive, F.least(acc["best"], x["priority"])).otherwise(acc["best"]).alias("best"),
            (acc["n"] + alive.cast("int")).alias("n"),
        )

    return F.aggregate(found, start, step)


def scan(documents: DataFrame) -> DataFrame:
    """One row for each row of ``documents``: ``doc_id, n_words, n_base, first_word, last_word`` (long),
    ``base_labels, labels`` (string), ``score`` (double) and ``n_detections`` (long).

    Null texts are empty: no words, no labels, score 0, no first or last word. The score is how sure the surest
    detection is. Rows keep their number and multiplicity, null ids included; other columns are ignored.
    Everything happens in the scan's stage, without a shuffle.
    """
    d = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    d = d.select("doc_id", F.regexp_count("_t", F.lit(WORDS)).cast("long").alias("n_words"), F.when(gate(F.col("_t")), normal(F.col("_t"))).alias("_n"))
    some = F.col("_n").isNotNull()
    d = d.select("doc_id", "n_words", F.when(some, _base(F.col("_n"))).alias("_b"), F.when(some, _summary(matches(F.col("_n")))).alias("_s"))
    word = F.transform("_b", lambda x: x["word"])
    base = F.array_sort(F.array_distinct(F.transform("_b", lambda x: x["label"])))
    none = F.array().cast("array<string>")
    base, own = F.coalesce(base, none), F.coalesce(F.col("_s.labels"), none)
    return d.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size(F.when(F.col("_b").isNotNull(), F.col("_b"))), F.lit(0)).cast("long").alias("_size"),
        F.array_min(word).cast("long").alias("first_word"),
        F.array_max(word).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.coalesce(F.get(F.array(*[F.lit(s) for s in SURE], F.lit(0.0)), F.col("_s.best")), F.lit(0.0)).alias("score"),
        F.coalesce(F.col("_s.n"), F.lit(0)).cast("long").alias("n_detections"),
    ).select("doc_id", "n_words", F.greatest("_size", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", "base_labels", "labels", "score", "n_detections")


def detections(documents: DataFrame) -> DataFrame:
    """``doc_id, first_word, n_words, label, rule, priority`` of every detection that isn't suppressed.

    Null and empty texts have none, repeated rows have theirs each, null ids stay null; other columns are ignored.
    """
    d = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_t")).where(gate(F.col("_t")))
    d = d.select("doc_id", F.monotonically_increasing_id().alias("_row"), normal(F.col("_t")).alias("_n"))
    d = d.select("doc_id", "_row", F.explode(matches(F.col("_n"))).alias("_m")).select("doc_id", "_row", "_m.*")
    before = Window.partitionBy("_row").orderBy("start", "till", "priority", "number").rowsBetween(Window.unboundedPreceding, -1)
    end = -F.col("till")
    far = [F.max(F.when(F.col("priority") <= p, end)).over(before) for p in range(3)]
    held = F.coalesce(F.when(F.col("priority") == 0, far[0]).when(F.col("priority") == 1, far[1]).otherwise(far[2]) >= end, F.lit(False))
    return d.select("*", held.alias("_held")).where("not _held").select(
        "doc_id", F.col("start").cast("long").alias("first_word"), (end - F.col("start")).cast("long").alias("n_words"), "label", F.col("number").alias("rule"), "priority"
    )


def sql() -> str:
    """:func:`scan` in DuckDB's SQL, from the same rules."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({p}, {n}, {q(label)}, {q(k)}, {q(x)})" for p, n, label, k, x in rules())
    tests = "\n    ".join(
        f"WHEN {' AND '.join(f'ws[i + {k}] = {q(w)}' for k, w in enumerate(phrase.split()))} THEN {q(label)}" for phrase, label in PHRASES.items()
    )
    return f"""
WITH r(priority, number, label, keyword, regex) AS (VALUES {values}),
n AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_replace(translate(concat(' ', text, ' '), '{UPPER}', '{LOWER}'), '{SEPARATORS}', '  ', 'g') AS norm
  FROM documents
),
w AS (SELECT rid, doc_id, norm, string_split(norm, '  ') AS ws FROM n),
b AS (
  SELECT rid, i - 2 AS word, CASE {tests} END AS label
  FROM (SELECT rid, ws, unnest(range(2, len(ws))) AS i FROM w WHERE contains(norm, ' license '))
),
bs AS (
  SELECT rid, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, list(DISTINCT label) AS labels
  FROM b WHERE label IS NOT NULL GROUP BY rid
),
m AS (
  SELECT rid, priority, number, label,
         string_split(regexp_replace(norm, regex, concat(' ', chr(1), '\\1', chr(2), ' '), 'g'), '  ') AS ws
  FROM w JOIN r ON contains(norm, concat(' ', keyword)) AND regexp_matches(norm, regex)
),
p AS (
  SELECT rid, priority, number, label,
         unnest(list_zip(list_filter(range(1, len(ws) + 1), lambda i: starts_with(ws[i], chr(1))),
                         list_filter(range(1, len(ws) + 1), lambda i: suffix(ws[i], chr(2))))) AS z
  FROM m
),
d AS (SELECT rid, priority, number, label, z[1] AS a, z[2] AS e FROM p),
k AS (
  SELECT * FROM d x WHERE NOT EXISTS (
    SELECT 1 FROM d y WHERE y.rid = x.rid AND y.number <> x.number AND y.priority <= x.priority AND y.a <= x.a AND y.e >= x.e
      AND (y.a < x.a OR y.e > x.e OR y.priority < x.priority OR y.number < x.number))
),
ks AS (SELECT rid, min(priority) AS best, count(*) AS n, list(DISTINCT label) AS labels FROM k GROUP BY rid)
SELECT w.doc_id, CAST(len(w.ws) - 2 AS BIGINT) AS n_words,
       CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       array_to_string(list_sort(coalesce(bs.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.labels, []), coalesce(ks.labels, [])))), ',') AS labels,
       CAST(CASE best WHEN 0 THEN {SURE[0]} WHEN 1 THEN {SURE[1]} WHEN 2 THEN {SURE[2]} ELSE 0 END AS DOUBLE) AS score,
       CAST(coalesce(ks.n, 0) AS BIGINT) AS n_detections
FROM w LEFT JOIN bs USING (rid) LEFT JOIN ks USING (rid)
"""
