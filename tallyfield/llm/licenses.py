"""License detection with ordered signature rules, in DataFrame functions alone (operator 5).

A text becomes its words with one space between and at either end.  Rules are
regexes on that.  Every place of a rule holds one of a few stems, so texts
without any are done; each rule has a keyword besides, and only rules whose
keyword the text holds are tried.  Places found are intervals.  An interval inside one of at least its
own priority is suppressed; of equal ones the first rule's stays.  That is one
pass over the intervals in order of their starts, with the farthest end seen so
far for each priority.
"""

from __future__ import annotations

import itertools
import string

from pyspark.sql import Column, DataFrame, functions as F

#: Phrases of the base labels, in words.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Substrings of which every place of a rule has one; most texts have none.
STEMS = ("licen", "copyright", "reserv", "réserv", "vorbehalten", "public domain", "cc by", "cc0", "gpl", "permi", "warrant", "proprietary", "unauthorized", "may not be", "creative", "redistribut", "provided as is", "may be reproduced", "riservati", "voorbehouden", "lizenz", "merchantability")

#: Label, keyword, what names the licence, its short names with the keyword of those.
_NAMED = [
    ("gpl", "general", "(?:gnu )?general public licen[cs]e", "gnu gpl|gpl ?v?[123](?: 0)?|gpl", "gpl"),
    ("lgpl", "general public", "(?:gnu )?(?:lesser|library) general public licen[cs]e", "gnu lgpl|lgpl ?v?[23](?: [01])?|lgpl", "lgpl"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", "gnu agpl|agpl ?v?[13](?: 0)?|agpl", "agpl"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation licen[cs]e", "gnu fdl|gfdl", "fdl"),
    ("apache", "apache", "apache (?:software )?licen[cs]e", "apache (?:1 [01]|2(?: 0)?)|asl 2(?: 0)?", "licen"),
    ("mit", "mit", "(?:the )?mit licen[cs]e", "mit style licen[cs]e|mit x11", "mit"),
    ("bsd", "bsd", "(?:the )?(?:[0234] clause |modified |simplified |revised |new )?bsd licen[cs]e", "bsd [0234] clause|(?:two|three) clause bsd", "bsd"),
    ("isc", "isc", "(?:the )?isc licen[cs]e", "isc style licen[cs]e", "isc"),
    ("mpl", "mozilla", "mozilla public licen[cs]e", "mpl [12](?: [01])?", "mpl"),
    ("epl", "eclipse", "eclipse public licen[cs]e", "epl [12](?: 0)?", "epl"),
    ("edl", "eclipse", "eclipse distribution licen[cs]e", "edl 1(?: 0)?", "edl"),
    ("cddl", "common development", "common development and distribution licen[cs]e", "cddl(?: 1 [01])?", "cddl"),
    ("cpl", "common public", "common public licen[cs]e", "cpl 1(?: 0)?", "cpl"),
    ("ipl", "ibm", "ibm public licen[cs]e", "ipl 1(?: 0)?", "ipl"),
    ("eupl", "european", "european union public licen[cs]e", "eupl(?: 1 [012])?", "eupl"),
    ("artistic", "artistic", "(?:the )?(?:clarified )?artistic licen[cs]e", "artistic [12](?: 0)?", "artistic"),
    ("boost", "boost", "boost software licen[cs]e", "bsl 1(?: 0)?", "bsl"),
    ("busl", "business source", "business source licen[cs]e", "busl(?: 1 1)?", "busl"),
    ("sspl", "server side", "server side public licen[cs]e", "sspl(?: 1)?", "sspl"),
    ("elastic", "elastic", "elastic licen[cs]e", "elastic 2(?: 0)?", "elastic"),
    ("zlib", "zlib", "(?:the )?zlib(?: libpng)? licen[cs]e", "zlib libpng", "zlib"),
    ("libpng", "libpng", "(?:the )?libpng licen[cs]e", "libpng 2(?: 0)?", "libpng"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense org", "unlicense"),
    ("wtfpl", "wtf", "wtfpl licen[cs]e", "wtf public licen[cs]e|wtfpl", "wtf"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", "creative commons zero", "zero"),
    ("openssl", "openssl", "(?:the )?openssl licen[cs]e", "ssleay licen[cs]e", "ssleay"),
    ("php", "php", "(?:the )?php licen[cs]e", "php 3(?: 0[01]?)?", "php"),
    ("python", "python", "python (?:software foundation )?licen[cs]e", "psf licen[cs]e", "psf"),
    ("ruby", "ruby", "(?:the )?ruby licen[cs]e", "ruby s licen[cs]e", "ruby"),
    ("perl", "perl", "perl licen[cs]e", "perl 5(?: 0)?", "perl"),
    ("postgresql", "postgresql", "(?:the )?postgresql licen[cs]e", "postgresql style licen[cs]e", "postgresql"),
    ("ofl", "open font", "(?:sil )?open font licen[cs]e", "ofl(?: 1 1)?", "ofl"),
    ("odbl", "open database", "open (?:data commons open )?database licen[cs]e", "odbl(?: 1 0)?", "odbl"),
    ("odc-by", "attribution", "open data commons attribution licen[cs]e", "odc by", "odc"),
    ("pddl", "public domain", "public domain dedication and licen[cs]e", "pddl", "pddl"),
    ("upl", "universal permissive", "universal permissive licen[cs]e", "upl 1(?: 0)?", "upl"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e", "ncsa style licen[cs]e", "ncsa"),
    ("w3c", "w3c", "w3c (?:software )?(?:notice and )?licen[cs]e", "w3c document licen[cs]e", "w3c"),
    ("afl", "academic free", "academic free licen[cs]e", "afl [123](?: [01])?", "afl"),
    ("osl", "open software", "open software licen[cs]e", "osl [123](?: [01])?", "osl"),
    ("ms-pl", "microsoft public", "microsoft public licen[cs]e", "ms pl", "ms"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[cs]e", "ms rl", "ms"),
    ("cecill", "cecill", "cecill(?: [abc12])?(?: free software)? licen[cs]e", "cecill [abc12](?: [01])?", "cecill"),
    ("mulan", "mulan", "mulan (?:permissive|public)(?: software)? licen[cs]e", "mulan psl", "mulan"),
    ("vim", "vim", "(?:the )?vim licen[cs]e", "vim style licen[cs]e", "vim"),
    ("beerware", "beer", "beer ?ware licen[cs]e", "beer ?ware", "beer"),
    ("json", "json", "(?:the )?json licen[cs]e", "json good not evil", "evil"),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict) licen[cs]e", "polyform (?:noncommercial|shield|strict)", "polyform"),
    ("llama", "llama", "llama(?: [234])? community licen[cs]e", "llama(?: [234])? licen[cs]e", "llama"),
    ("openrail", "rail", "(?:big ?science |creative ?ml )?open ?rail(?: m| s)? licen[cs]e", "open ?rail(?: m)?", "rail"),
]

#: Label, keyword, regex, priority of rules that stand alone.
_ALONE = [
    ("reserved", "reserved", "all rights reserved", 1),
    ("reserved", "reserved", "copyright (?:c )?(?:19|20)[0-9]{2}(?: [^ ]+){1,8} all rights reserved", 3),
    ("reserved", "reservados", "todos los derechos reservados", 2),
    ("reserved", "vorbehalten", "alle rechte vorbehalten", 2),
    ("reserved", "réservés", "tous droits réservés", 2),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", 1),
    ("copyright", "copyrighted", "copyrighted (?:material|work)s?", 1),
    ("proprietary", "proprietary", "proprietary (?:and|or) confidential", 2),
    ("proprietary", "proprietary", "proprietary licen[cs]e", 2),
    ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction|distribution|use)", 2),
    ("proprietary", "may not be", "may not be (?:copied|reproduced|distributed)", 1),
    ("proprietary", "written permission", "without (?:the )?(?:express |prior )*written permission", 1),
    ("proprietary", "licensed not sold", "licensed not sold", 2),
    ("proprietary", "end user", "end user licen[cs]e agreement", 2),
    ("public-domain", "public domain", "(?:dedicated to|released (?:in)?to|placed in|in) the public domain", 2),
    ("public-domain", "public domain", "public domain", 1),
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 3),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose", 3),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 3),
    ("apache", "apache", "www apache org licenses license 2 0", 2),
    ("gpl", "gnu", "www gnu org (?:licenses|copyleft) gpl", 2),
    ("lgpl", "gnu", "www gnu org (?:licenses|copyleft) lgpl", 2),
    ("mpl", "mozilla", "mozilla org (?:mpl 2 0 )?license", 2),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", 3),
    ("zlib", "as is", "this software is provided as is without any express or implied warranty", 2),
    ("boost", "boost", "www boost org license 1 0", 2),
    ("warranty", "warranty", "without warranty of any kind", 1),
    ("warranty", "warranties", "without warranties or conditions of any kind", 1),
    ("open-source", "open source", "open source licen[cs]e", 1),
    ("cc", "creative commons", "creative commons(?: licen[cs]e)?", 1),
    ("cc", "creativecommons", "creativecommons org licenses", 1),
]


#: Label, keyword, regex, priority of sentences that notices are made of, and of licences in other tongues.
_NOTICES = [
    ("gpl", "free software", "(?:this program|this library|it) is free software you can redistribute it and or modify", 3),
    ("gpl", "at your option", "either version [123] of the license or at your option any later version", 3),
    ("gpl", "received a copy", "you should have received a copy of the gnu general public license", 3),
    ("lgpl", "received a copy", "you should have received a copy of the gnu (?:lesser|library) general public license", 3),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public license", 3),
    ("gfdl", "free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 3),
    ("mit", "permission notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 3),
    ("mit", "sublicense", "use copy modify merge publish distribute sublicense and or sell copies of the software", 3),
    ("mit", "noninfringement", "warranties of merchantability fitness for a particular purpose and noninfringement", 2),
    ("isc", "permission notice", "provided that the above copyright notice and this permission notice appear in all copies", 3),
    ("isc", "disclaims all", "the software is provided as is and the author disclaims all warranties", 3),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice(?: this list of conditions and the following disclaimer)?", 3),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice", 3),
    ("bsd", "endorse or promote", "may be used to endorse or promote products derived from this software without specific prior written permission", 3),
    ("bsd", "copyright holders", "this software is provided by the copyright holders and contributors as is", 3),
    ("apache", "in compliance with", "you may not use this file except in compliance with the license", 3),
    ("apache", "agreed to in writing", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 3),
    ("apache", "irrevocable", "perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license", 3),
    ("mpl", "source code form", "this source code form is subject to the terms of the mozilla public license", 3),
    ("mpl", "secondary licenses", "incompatible with secondary licenses", 2),
    ("epl", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license", 3),
    ("cddl", "contents of this file", "the contents of this file are subject to the terms of the common development and distribution license", 3),
    ("boost", "boost software", "distributed under the boost software license(?: version)? 1 0", 3),
    ("zlib", "commercial applications", "permission is granted to anyone to use this software for any purpose including commercial applications", 3),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 3),
    ("wtfpl", "you want to public", "do what the [^ ]+ you want to public license", 3),
    ("cc0", "neighboring rights", "waived all copyright and related or neighboring rights", 3),
    ("cc", "creative commons", "this (?:work|article|image|file|text) is licensed under (?:a|the) creative commons", 2),
    ("ofl", "font software", "this font software is licensed under the sil open font license", 3),
    ("postgresql", "written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", 3),
    ("hpnd", "without fee", "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:is hereby granted )?without fee", 2),
    ("python", "python software", "python software foundation license version 2", 3),
    ("ogl", "open government", "open government licen[cs]e(?: v?[123](?: 0)?)?", 2),
    ("crown", "crown copyright", "crown copyright", 2),
    ("proprietary", "confidential and", "confidential and proprietary(?: information)?(?: and trade secrets)?", 2),
    ("proprietary", "may be reproduced", "no part of this (?:publication|book|document|work|material|site) may be reproduced", 3),
    ("proprietary", "evaluation", "evaluation licen[cs]e", 1),
    ("proprietary", "commercial licen", "commercial licen[cs]e", 1),
    ("proprietary", "transferable", "non ?exclusive non ?transferable licen[cs]e", 2),
    ("proprietary", "site licen", "site licen[cs]e", 1),
    ("proprietary", "single user", "single user licen[cs]e", 1),
    ("proprietary", "licensor", "the licensor (?:grants|reserves|retains)", 1),
    ("freeware", "freeware", "freeware licen[cs]e", 1),
    ("shareware", "shareware", "shareware licen[cs]e", 1),
    ("source-available", "source available", "source available licen[cs]e", 2),
    ("source-available", "commons clause", "commons clause licen[cs]e(?: condition)?", 2),
    ("reserved", "reserves all", "reserves all rights", 2),
    ("some-rights", "some rights", "some rights reserved", 2),
    ("reserved", "direitos", "todos os direitos reservados", 2),
    ("reserved", "diritti", "tutti i diritti riservati", 2),
    ("reserved", "rechten", "alle rechten voorbehouden", 2),
    ("reserved", "urheberrechte", "alle urheberrechte vorbehalten", 2),
    ("warranty", "merchantability", "(?:implied )?warrant(?:y|ies) of merchantability", 1),
    ("warranty", "provided as is", "provided as is", 1),
    ("warranty", "disclaim", "disclaims? (?:all|any) warranties", 1),
    ("copyright", "copyright", "(?:all )?copyrights? (?:is |are )?(?:owned|held|retained) by", 1),
    ("public-domain", "no known copyright", "no known copyright(?: restrictions)?", 2),
    ("public-domain", "all copyright", "waives? all copyrights?", 2),
    ("permission", "permission", "(?:used|reprinted|reproduced) (?:by|with) (?:kind )?permission(?: of)?", 1),
    ("permission", "granted to", "permission is (?:hereby )?granted to (?:copy|use|distribute|reproduce)", 2),
    ("open-source", "osi approved", "osi approved licen[cs]e", 2),
    ("open-source", "free software licen", "free software licen[cs]e", 1),
    ("open-source", "permissive", "permissive licen[cs]e", 1),
    ("open-source", "copyleft", "copyleft licen[cs]e", 1),
    ("open-source", "dual licen", "dual licen[cs]ed", 1),
    ("open-data", "open data", "open data licen[cs]e", 1),
    ("mit", "mit lizenz", "(?:unter der )?mit lizenz", 2),
    ("bsd", "bsd lizenz", "(?:unter der )?bsd lizenz", 2),
    ("apache", "apache lizenz", "(?:unter der )?apache lizenz", 2),
    ("gpl", "gnu gpl lizenz", "(?:unter der )?gnu gpl lizenz", 2),
    ("cc", "commons lizenz", "creative commons lizenz", 2),
    ("mit", "licencia mit", "(?:bajo )?(?:la )?licencia mit", 2),
    ("apache", "licencia apache", "(?:bajo )?(?:la )?licencia apache", 2),
    ("gpl", "blica general", "licencia p[uú]blica general(?: de)?(?: gnu)?", 2),
    ("cc", "licencia creative", "(?:bajo )?(?:una |la )?licencia creative commons", 2),
    ("mit", "licence mit", "(?:sous )?(?:la )?licence mit", 2),
    ("apache", "licence apache", "(?:sous )?(?:la )?licence apache", 2),
    ("gpl", "licence publique", "licence publique g[eé]n[eé]rale(?: gnu)?", 2),
    ("cc", "licence creative", "(?:sous )?(?:une |la )?licence creative commons", 2),
]


def rules() -> list[tuple[str, str, str, int]]:
    """Label, keyword, regex, priority (3 a full notice, 2 a licence by name, 1 a mention), in order of precedence."""
    out = []
    for label, key, name, short, short_key in _NAMED:
        version = "(?: (?:version |v)?[0-9](?: [0-9])?)?(?: or (?:any )?later(?: version)?)?"
        out += [
            (label, key, f"(?:licensed|released|distributed|available|published|provided|made available) under (?:the )?(?:terms of )?(?:the )?(?:{name}){version}", 3),
            (label, key, f"(?:terms|conditions) of (?:the )?(?:{name}){version}", 3),
            (label, key, f"(?:{name}){version}", 2),
            (label, "spdx", f"spdx licen[cs]e identifier (?:{short})(?: only| or later)?", 3),
            (label, short_key, f"licen[cs]ed?(?: under)?(?: the)? (?:{short})", 2),
        ]
    for by, nc, nd, sa in itertools.product(("by",), ("", "nc"), ("", "nd"), ("", "sa")):
        if nd and sa:
            continue
        tail = " ".join(x for x in (by, nc, nd, sa) if x)
        label = "cc-" + tail.replace(" ", "-")
        out += [
            (label, "cc", f"(?:licensed|released|available|published|distributed) under (?:a |the )?cc {tail}(?: [1-4] [05])?(?: [a-z]{{2}})?(?! (?:nc|nd|sa) )", 3),
            (label, "cc", f"cc {tail}(?: [1-4] [05])?(?! (?:nc|nd|sa) )", 2),
            (label, "creativecommons", f"creativecommons org licenses {tail}(?: [1-4] [05])?(?! (?:nc|nd|sa) )", 3),
        ]
    words = {"nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}
    for parts in ((), ("nc",), ("nd",), ("sa",), ("nc", "nd"), ("nc", "sa")):
        spelled = " ".join(["attribution", *(words[p] for p in parts)])
        out.append(("-".join(["cc-by", *parts]), "creative commons", f"creative commons {spelled}(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", 3))
    return sorted([*out, *_ALONE, *_NOTICES], key=lambda r: -r[3])


def words_of(text: Column) -> Column:
    """The words, one space between and at either end; a space alone if there are none. Case stays."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", " ")
    bare = F.trim(spaced)
    return F.when(bare == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), bare, F.lit(" ")))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _base(s: Column) -> dict[str, Column]:
    """Counts, first and last word of the phrases in the lower-case words ``s``."""
    doubled = F.replace(s, F.lit(" "), F.lit("  "))
    n, first, last, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in sorted(BASE.items(), key=lambda x: x[1]):
        wide = f" {phrase.replace(' ', '  ')} "
        n = n + ((F.length(doubled) - F.length(F.replace(doubled, F.lit(wide), F.lit("")))) / len(wide)).cast("long")
        at, back = F.instr(s, f" {phrase} "), F.instr(F.reverse(s), f" {phrase[::-1]} ")
        first.append(F.when(at > 0, _spaces(F.substring(s, F.lit(1), at)) - 1))
        last.append(F.when(back > 0, _spaces(F.substring(s, F.lit(1), F.length(s) - back - len(phrase))) - 1))
        labels.append(F.when(at > 0, F.lit(label)))
    return {"n_base": n, "first_word": F.least(*first).cast("long"), "last_word": F.greatest(*last).cast("long"), "base": F.array_compact(F.array(*labels))}


def _detected(s: str) -> Column:
    """Strength and labels of the rules left after suppression, in the lower-case words of column ``s``."""
    table = rules()
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    literal = "array(" + ",".join(f"named_struct('k',{quote(k)},'r',{quote(f'(?<= )(?:{r})(?= )')},'l',{quote(label)},'p',{p},'o',{o})" for o, (label, k, r, p) in enumerate(table)) + ")"
    tried = f"filter({literal}, r -> contains({s}, r.k))"
    # lengths of what lies between the places and of the places themselves, in turns
    places = f"""aggregate(
        zip_with(split({s}, r.r, -1), regexp_extract_all({s}, r.r, 0), (a, b) -> struct(length(a) AS a, length(b) AS b)),
        struct(0 AS at, cast(array() AS array<struct<a:int,e:int,p:int,o:int,l:string>>) AS out),
        (acc, x) -> struct(acc.at + x.a + coalesce(x.b, 0) AS at,
            CASE WHEN x.b IS NULL THEN acc.out ELSE array_append(acc.out, struct(acc.at + x.a AS a, -(acc.at + x.a + x.b) AS e, -r.p AS p, r.o AS o, r.l AS l)) END AS out),
        acc -> acc.out)"""
    ordered = f"array_sort(flatten(transform({tried}, r -> {places})))"
    inside = "-x.e <= greatest(acc.e3, CASE WHEN -x.p <= 2 THEN acc.e2 ELSE 0 END, CASE WHEN -x.p <= 1 THEN acc.e1 ELSE 0 END)"
    left = f"""aggregate({ordered},
        struct(0 AS e1, 0 AS e2, 0 AS e3, 0 AS strength, cast(array() AS array<string>) AS labels),
        (acc, x) -> struct(
            greatest(acc.e1, CASE WHEN x.p = -1 THEN -x.e ELSE 0 END) AS e1,
            greatest(acc.e2, CASE WHEN x.p = -2 THEN -x.e ELSE 0 END) AS e2,
            greatest(acc.e3, CASE WHEN x.p = -3 THEN -x.e ELSE 0 END) AS e3,
            acc.strength + CASE WHEN {inside} THEN 0 ELSE -x.p END AS strength,
            CASE WHEN {inside} THEN acc.labels ELSE array_union(acc.labels, array(x.l)) END AS labels),
        acc -> struct(acc.strength AS strength, acc.labels AS labels))"""
    return F.expr(left)


def detected(docs: DataFrame, text: str = "text", *, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with ``n_words, n_base, first_word, last_word, base_labels, labels, score``.

    A row for each row of ``docs``, without a shuffle and without Python.  Null
    and wordless texts have no words, no labels and score 0.  ``score`` is
    1 - 2 ** -(sum of the priorities of what was found / 2): 0.29 for a mention,
    0.65 for a notice, towards 1 for many.
    """
    if clash := {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"} & set(keep):
        raise ValueError(f"columns named as results: {sorted(clash)}")
    # one column for those that are kept, so that their names can't clash
    slim = docs.select(F.struct(*[docs[c] for c in keep]).alias("__row"), words_of(docs[text].cast("string")).alias("__w"))
    folded = slim.withColumn("__l", F.lower("__w"))
    gate = F.lit(False)
    for k in STEMS:
        gate = gate | F.contains("__l", F.lit(k))
    # only A-Z are folded where it counts
    exact = F.when(gate, F.translate("__w", string.ascii_uppercase, string.ascii_lowercase))
    gated = folded.select("__row", _spaces(F.col("__w")).alias("__n"), exact.alias("__s"))
    base = _base(F.col("__s"))
    found = gated.select("__row", "__n", F.when(F.col("__s").isNotNull(), F.struct(*[v.alias(k) for k, v in base.items()])).alias("__b"), F.when(F.col("__s").isNotNull(), _detected("__s")).alias("__d"))
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union(F.coalesce("__b.base", none), F.coalesce("__d.labels", none)))
    return found.select(
        "__row.*", (F.col("__n") - 1).cast("long").alias("n_words"), F.coalesce("__b.n_base", F.lit(0)).cast("long").alias("n_base"), F.col("__b.first_word").alias("first_word"), F.col("__b.last_word").alias("last_word"),
        F.array_join(F.coalesce("__b.base", none), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), (1 - F.pow(F.lit(0.5), F.least(F.coalesce("__d.strength", F.lit(0)), F.lit(100)) / 2)).alias("score"),
    )
