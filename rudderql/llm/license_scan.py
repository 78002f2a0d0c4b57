"""Licence scans by sentence rules.

Texts are normalised (ASCII lower case, runs of other characters than a-z and
0-9 become one mark) and searched for whole known licence sentences; the
sequence of identifiers is then matched against ordered rules. A known sentence
starts and ends at a sentence end, a line feed, a colon or a semicolon, and may
run on over line feeds, colons and semicolons, so notices are found wrapped or
not. Comment and list marks at the start of a line do not count. A rule names
identifiers that must follow each other in this order, other known sentences
between them allowed; the first rule that matches names the primary licence.
Everything happens within the row.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, text_of

_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files {}to deal in the software without restriction including without limitation {}the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_GNU = "* is free software you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation "
_VERSIONS = ("either version {} of the license or at your option any later version", "either version {} or at your option any later version", "version {} of the license", "version {}")
#: Name in the sentence -> first part of identifiers and versions.
_FAMILY = {"": ("gpl", ("2", "3")), "lesser ": ("lgpl", ("2 1", "3")), "library ": ("lgpl", ("2",)), "affero ": ("agpl", ("3",))}
#: In a text without line feeds nothing ends the sentence after the address.
_AS_IS = " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
_ENDORSE = "to endorse or promote products derived from this software without specific prior written permission"
_BSD = "must {} the above copyright notice this list of conditions and the following disclaimer"
_ISC = "permission to use copy modify and {}distribute this software for any purpose with or without fee is hereby granted"
#: Creative Commons elements -> their names in full.
_CC = {"by": "attribution", "by sa": "attribution sharealike", "by nd": "attribution noderivatives", "by nc": "attribution noncommercial", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}


def _gnu_id(family: str, version: str) -> str:
    """gpl-grant is that of version 3."""
    return family + ("" if (family, version) == ("gpl", "3") else version.replace(" ", "")) + "-grant"


#: Normalised sentence -> identifier. A * stands for a name of up to NAME words.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2-ref",
    "licensed under the apache license version 2 0 the license": "apache2-ref",
    "* licenses this file to you under the apache license version 2 0 the license": "apache2-ref",
    "you may not use this file except in compliance with the license": "apache2-comply",
    **{f"you may obtain a copy of the license at {x} www apache org licenses license 2 0{y}": "apache2-copy" for x in ("http", "https") for y in ("", _AS_IS)},
    "see the license for the specific language governing permissions and limitations under the license": "apache2-limits",
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    **{_MIT.format(x, y): "mit-grant" for x in ("the software ", "") for y in ("", "on ")},
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 3": "gpl3-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-grant",
    **{_GNU.format(name) + v.format(n): _gnu_id(family, n) for name, (family, versions) in _FAMILY.items() for n in versions for v in _VERSIONS},
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    **{f"you should have received a copy of the gnu {name}general public license along with *": f"{family}-copy" for name, (family, _) in _FAMILY.items()},
    **{f"licensed under cc {code} 4 0": f"cc-{code.replace(' ', '-')}-ref" for code in _CC},
    **{f"this work is licensed under {article}creative commons {name} 4 0 international license": f"cc-{code.replace(' ', '-')}-ref" for code, name in _CC.items() for article in ("a ", "the ", "")},
    "to the extent possible under law * has waived all copyright and related or neighboring rights to *": "cc0-waiver",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    f"redistributions of source code {_BSD.format('retain')}": "bsd-source",
    f"redistributions in binary form {_BSD.format('reproduce')} in the documentation and or other materials provided with the distribution": "bsd-binary",
    f"neither the name of * nor the names of * may be used {_ENDORSE}": "bsd-names",
    f"neither the names of * nor the names of * may be used {_ENDORSE}": "bsd-names",
    f"the name of * may not be used {_ENDORSE}": "bsd-names",
    f"the names of * may not be used {_ENDORSE}": "bsd-names",
    **{f"{_ISC.format(x)} provided that the above copyright notice and this permission notice appear in all copies": "isc-grant" for x in ("or ", "")},
    **{_ISC.format(x): "0bsd-grant" for x in ("or ", "")},
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-ref",  # a sentence ends at the stop in "v. 2.0"
    **{f"if a copy of the mpl was not distributed with this file you can obtain one at {x} mozilla org mpl 2 0": "mpl2-copy" for x in ("http", "https")},
    "this is free and unencumbered software released into the public domain": "unlicense-domain",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-free",
    "all rights reserved": "reserved",
}
#: (rule, licence, identifiers in order); the first match is the primary one.
RULES = (
    ("apache2-notice", "Apache-2.0", ("apache2-ref", "apache2-comply", "apache2-limits")),
    ("mit-text", "MIT", ("mit-grant", "mit-notice")),
    ("gpl-notice", "GPL-3.0", ("gpl-grant", "gpl-copy")),
    ("gpl2-notice", "GPL-2.0", ("gpl2-grant", "gpl-copy")),
    ("lgpl3-notice", "LGPL-3.0", ("lgpl3-grant", "lgpl-copy")),
    ("lgpl21-notice", "LGPL-2.1", ("lgpl21-grant", "lgpl-copy")),
    ("lgpl2-notice", "LGPL-2.0", ("lgpl2-grant", "lgpl-copy")),
    ("agpl3-notice", "AGPL-3.0", ("agpl3-grant", "agpl-copy")),
    ("mpl2-notice", "MPL-2.0", ("mpl2-ref", "mpl2-copy")),
    ("unlicense-text", "Unlicense", ("unlicense-domain", "unlicense-free")),
    ("bsd3-text", "BSD-3-Clause", ("bsd-grant", "bsd-names")),
    ("bsd2-text", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("isc-text", "ISC", ("isc-grant",)),
    ("0bsd-text", "0BSD", ("0bsd-grant",)),
    ("cc0-text", "CC0-1.0", ("cc0-waiver",)),
    ("gpl3-sentence", "GPL-3.0", ("gpl3-ref",)),
    *[(f"cc-{code.replace(' ', '-')}-sentence", f"CC-{code.replace(' ', '-').upper()}-4.0", (f"cc-{code.replace(' ', '-')}-ref",)) for code in ("by nc nd", "by nc sa", "by nc", "by nd", "by sa", "by")],
    ("apache2-sentence", "Apache-2.0", ("apache2-ref",)),
    ("mit-sentence", "MIT", ("mit-ref",)),
    ("bsd-sentence", "BSD", ("bsd-grant",)),
    ("reserved-sentence", "All-Rights-Reserved", ("reserved",)),
)
#: Words that a * in a sentence stands for at most.
NAME = 12
#: What may stand before the words of a line: comment marks, then a comment word or a list number.
LINE_START = r"\n[^a-z0-9\n]*(?:(?:rem|dnl|c)[\x20\x09]+|[0-9a-z]{1,2}\)[\x20\x09]+)?"
#: Sentences end at ., ! or ? and white space. Here and below a pattern begins only where a run does, else long runs take time by their square.
BREAKS = r"(?<![.!?])[.!?]++[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Words with one mark between two: H where a sentence ends, S at a line feed, colon or semicolon, else a blank."""
    out = F.regexp_replace(F.concat(F.lit("\n"), F.translate(text, UPPER, LOWER)), LINE_START, "\n")
    for pattern, mark in ((BREAKS, "H"), ("[\n;:]", "S"), ("[^a-z0-9HS]+", " "), ("(?<![ S])[ S]*+H[ HS]*+", "H"), ("(?<! ) *+S[ S]*+", "S")):
        out = F.regexp_replace(out, pattern, mark)
    return F.btrim(out)


def _pattern(sentence: str) -> str:
    """Finds a sentence in a normalised text. A name in the middle may hold a full stop; at the ends it stays in its line."""
    words, out = sentence.split(), ""
    for i, word in enumerate(words):
        last = i == len(words) - 1
        if word != "*":
            out += word + ("" if last else "[ S]")
        elif i == 0:
            out += f"(?:[a-z0-9]+ ){{0,{NAME}}}"
        else:
            out += f"[a-z0-9]+(?: [a-z0-9]+){{0,{NAME - 1}}}" if last else f"(?:[a-z0-9]+[ SH]){{1,{NAME}}}?"
    return out


def trigger(sentences: dict[str, str]) -> str:
    """A pattern of words of which every sentence has one; of seven letters or more if it has such."""
    left, found = [[w for w in s.split() if w != "*"] for s in sentences], []
    while left:
        usable = Counter(w for words in left for w in {x for x in words if len(x) >= min(7, max(map(len, words)))})
        found.append(max(usable, key=lambda w: (usable[w], len(w), w)))
        left = [words for words in left if not any(found[-1] in w for w in words)]
    return "|".join(found)


def license_scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids, rules, license for each row.

    sentence_ids: identifiers in text order, rules: matching rules in rule
    order, both comma-joined and empty where there is none; license: that of
    the first matching rule, or null. Null or empty text: none. Repeated rows
    each get their row; other columns are ignored; empty table: empty result.
    """
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    # At one place the longest sentence counts.
    any_of = "|".join(_pattern(s) for s in sorted(sentences, key=len, reverse=True))
    names = [(f"^(?:{_pattern(s)})$", i) for s, i in sentences.items() if "*" in s.split()]
    id_of = lambda x: F.coalesce(F.try_element_at(known, F.translate(x, "S", " ")), *[F.when(x.rlike(p), i) for p, i in names])
    ids = F.transform(F.regexp_extract_all(normalised(text_of()), F.lit(f"(?<![^HS])(?:{any_of})(?![^HS])"), F.lit(0)), id_of)
    found = F.when(text_of().rlike(f"(?i){trigger(sentences)}"), ids).otherwise(F.array().cast("array<string>"))
    cols = docs.select("doc_id", found.alias("ids"))
    hits = F.filter(F.array(*[F.when(_in_order(F.col("ids"), parts), F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("license"))) for rule, name, parts in rules]), lambda x: x.isNotNull())
    out = cols.withColumn("hits", F.when(F.size("ids") > 0, hits).otherwise(F.array().cast("array<struct<rule: string, license: string>>")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(F.transform("hits", lambda x: x["rule"]), ",").alias("rules"), F.get("hits", F.lit(0))["license"].alias("license"))


def _in_order(ids: Column, parts: tuple[str, ...]) -> Column:
    """Whether ``ids`` has these identifiers in this order, others between them allowed: one pass with a place in the rule."""
    if len(parts) == 1:
        return F.array_contains(ids, parts[0])
    rule = F.array(*[F.lit(p) for p in parts])
    return F.aggregate(ids, F.lit(0), lambda at, x: F.when(F.get(rule, at) == x, at + 1).otherwise(at)) == len(parts)
