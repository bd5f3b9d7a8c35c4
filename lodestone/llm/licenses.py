"""Licence scans by sentence rules, with DataFrame operations only.

The sentences of a text are normalised, and the known licence sentences in them mapped to identifiers; the identifiers, in
the order of the text, are matched against ordered licence rules by a fold over them. A rule that matches uses up its
identifiers, so the notice that two licences share counts for the longer one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-title": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "as-is": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"
    ],
    "apache-title": ["Apache License Version 2.0, January 2004", "Apache License"],
    "apache-compliance": ["you may not use this file except in compliance with the License"],
    "gpl-title": ["GNU GENERAL PUBLIC LICENSE"],
    "version-3": ["Version 3, 29 June 2007"],
    "version-2": ["Version 2, June 1991"],
    "free-software": ["This program is free software"],
    "gpl3-later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "version-2-later": ["either version 2 of the License, or (at your option) any later version"],
    "version-3-later": ["either version 3 of the License, or (at your option) any later version"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl2-form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc0-reference": ["dedicated to the public domain under CC0 1.0"],
    "lgpl3-later": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "lgpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "version-2.1-later": ["either version 2.1 of the License, or (at your option) any later version"],
    "agpl3-later": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "apache-terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "lgpl-title": ["GNU LESSER GENERAL PUBLIC LICENSE"],
    "agpl-title": ["GNU AFFERO GENERAL PUBLIC LICENSE"],
    "version-2.1": ["Version 2.1, February 1999"],
    "version-3-agpl": ["Version 3, 19 November 2007"],
    "epl2-title": ["Eclipse Public License - v 2.0"],
    "mpl2-title": ["Mozilla Public License Version 2.0"],
    "bsl-title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
    "unlicense-grant": ["This is free and unencumbered software released into the public domain"],
}

# Names of licences, as notices refer to them, by the identifier of such a notice.
NAMES = {
    "mit-reference": ["MIT License", "MIT", "Expat License"],
    "apache-reference": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0"],
    "gpl3-later-reference": ["GNU General Public License, version 3 or later", "GPL v3 or later", "GPLv3+", "GPL-3.0-or-later"],
    "gpl3-reference": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPL version 3", "GPL v3", "GPLv3"],
    "gpl2-later-reference": ["GNU General Public License, version 2 or later", "GPL v2 or later", "GPLv2+", "GPL-2.0-or-later"],
    "gpl2-reference": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPL version 2", "GPL v2", "GPLv2"],
    "lgpl3-reference": ["GNU Lesser General Public License, version 3", "LGPL version 3", "LGPL v3", "LGPLv3"],
    "lgpl2.1-reference": ["GNU Lesser General Public License, version 2.1", "LGPL version 2.1", "LGPL v2.1", "LGPLv2.1"],
    "agpl3-reference": ["GNU Affero General Public License, version 3", "GNU AGPL version 3", "AGPL v3", "AGPLv3"],
    "bsd3-reference": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "BSD-3-Clause"],
    "bsd2-reference": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"],
    "isc-reference": ["ISC License", "ISC"],
    "mpl2-reference": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "MPL 2.0"],
    "epl2-reference": ["Eclipse Public License 2.0", "Eclipse Public License v. 2.0", "EPL 2.0"],
    "zlib-reference": ["zlib License"],
    "bsl-reference": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "unlicense-reference": ["Unlicense"],
    "cc-by-nc-reference": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa-reference": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-reference": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "cc0-reference": ["CC0 1.0"],
}
# Sentences with a name in them, by identifier: what stands before it and after it.
SLOTTED = {"bsd-names": ("Neither the name of", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission")}
#: Words that such a name has at most.
SLOT_WORDS = 12
# Names that SPDX tags had before, by those that they have now.
FORMER_TAGS = {
    "GPL-2.0": "GPL-2.0-only", "GPL-2.0+": "GPL-2.0-or-later", "GPL-3.0": "GPL-3.0-only", "GPL-3.0+": "GPL-3.0-or-later", "LGPL-2.1": "LGPL-2.1-only", "LGPL-2.1+": "LGPL-2.1-or-later",
    "LGPL-3.0": "LGPL-3.0-only", "LGPL-3.0+": "LGPL-3.0-or-later", "AGPL-3.0": "AGPL-3.0-only", "AGPL-3.0+": "AGPL-3.0-or-later",
}
VERBS = ("released", "licensed", "distributed", "available", "provided", "published", "covered", "made available")
#: Identifiers of titles: they count where they are a whole line or sentence, as prose names licences too.
TITLES = ("mit-title", "apache-title", "gpl-title", "lgpl-title", "agpl-title", "epl2-title", "mpl2-title", "bsl-title", "apache-terms", "version-2", "version-3", "version-2.1", "version-3-agpl")

#: Ordered rules: a licence by the identifiers that a text has in this order, others between them allowed.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-reference",)),
    ("MIT", ("mit-title",)),
    ("Apache-2.0", ("apache-title", "apache-terms")),
    ("Apache-2.0", ("apache-reference", "apache-compliance")),
    ("Apache-2.0", ("apache-reference",)),
    ("Apache-2.0", ("apache-title", "apache-compliance")),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("GPL-3.0-or-later", ("gpl-terms", "version-3-later")),
    ("GPL-3.0-or-later", ("gpl3-later-reference",)),
    ("GPL-2.0-or-later", ("gpl-terms", "version-2-later")),
    ("GPL-2.0-or-later", ("gpl2-later-reference",)),
    ("LGPL-3.0-or-later", ("lgpl3-later",)),
    ("LGPL-2.1-or-later", ("lgpl-terms", "version-2.1-later")),
    ("LGPL-3.0-only", ("lgpl-title", "version-3")),
    ("LGPL-2.1-only", ("lgpl-title", "version-2.1")),
    ("LGPL-3.0-only", ("lgpl3-reference",)),
    ("LGPL-2.1-only", ("lgpl2.1-reference",)),
    ("AGPL-3.0-or-later", ("agpl3-later",)),
    ("AGPL-3.0-only", ("agpl-title", "version-3-agpl")),
    ("AGPL-3.0-only", ("agpl3-reference",)),
    ("GPL-3.0-only", ("gpl-title", "version-3")),
    ("GPL-2.0-only", ("gpl-title", "version-2")),
    ("GPL-3.0-only", ("gpl3-reference",)),
    ("GPL-2.0-only", ("gpl2-reference",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd3-reference",)),
    ("BSD-2-Clause", ("bsd2-reference",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-reference",)),
    ("MPL-2.0", ("mpl2-form",)),
    ("MPL-2.0", ("mpl2-reference",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("EPL-2.0", ("epl2-title",)),
    ("EPL-2.0", ("epl2-reference",)),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("Zlib", ("zlib-reference",)),
    ("BSL-1.0", ("bsl-title",)),
    ("BSL-1.0", ("bsl-reference",)),
    ("CC-BY-4.0", ("cc-by-reference",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-reference",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-reference",)),
    ("CC0-1.0", ("cc0-reference",)),
    ("Unlicense", ("unlicense-grant",)),
    ("Unlicense", ("unlicense-reference",)),
]
#: A tag names its licences itself: its identifier is "spdx:" and the name, a rule of its own.
SPDX = sorted({licence for licence, _ in RULES})
RULES += [(licence, (f"spdx:{licence}",)) for licence in SPDX]

#: A sentence ends at . ! ? ; or : before white space.
_STOP = r"[.!?;:](?=[ \t\f\x0B\r\n]|$)"
#: Words are ASCII letters and digits, dots between digits, and a plus after one.
_BETWEEN_WORDS = r"[^a-z0-9.+\n]+|\.(?![0-9])|(?<![0-9])[.+]"


def normalised(sentence: str) -> str:
    """Lower-case ASCII words and numbers, single spaces between; dots inside numbers stay."""
    return " ".join(re.sub(_BETWEEN_WORDS, " ", sentence.lower()).split())


KNOWN = {normalised(s): i for i, own in SENTENCES.items() for s in own}
NAMED = {normalised(s): i for i, own in NAMES.items() for s in own}


def _either(phrases) -> str:
    """The phrases, longer ones first, whatever breaks the lines between their words."""
    return "|".join(re.escape(p).replace("\\ ", "[ \n]") for p in sorted(phrases, key=lambda p: (-len(p), p)))


_UNDER = rf"(?:{_either(VERBS)})[ \n]under[ \n](?:the[ \n]|an?[ \n])?(?:terms[ \n]of[ \n])?(?:the[ \n])?(?:conditions[ \n]of[ \n]the[ \n])?"
#: A licence's name, and up to four of them in one notice.
_NAME = f"(?:{_either(NAMED)})"
_LIST = rf"{_NAME}(?:[ \n](?:and|or|and[ \n]or)[ \n](?:the[ \n])?{_NAME}){{0,3}}"
#: What denies a notice, as it reads without its apostrophe.
_DENIED = "".join(f"(?<!{word}[ \n])" for word in ("not", "never", "n t", "not be", "n t be", "not been", "n t been", "no longer"))
_SLOTS = "|".join(rf"{_either([normalised(a)])}[ \n](?:[^ \n]+[ \n]){{1,{SLOT_WORDS}}}?{_either([normalised(z)])}" for a, z in SLOTTED.values())
#: What the scan recognises in a normalised text: titles as whole lines, notices that aren't denied, a name after the line
#: "License", and sentences anywhere.
PHRASES = (
    rf"(?m)^(?:{_either(k for k, i in KNOWN.items() if i in TITLES)})$|^licen[cs]e[ \n](?:the[ \n])?{_LIST}$"
    rf"|(?<![a-z0-9.])(?:{_either(k for k, i in KNOWN.items() if i not in TITLES)}|{_SLOTS}|{_DENIED}(?:{_UNDER}|uses?[ \n]the[ \n]){_LIST})(?![a-z0-9+])"
)
#: Every known sentence, notice and tag has one of these words; other texts need no look-up.
MARKERS = ("licen", "permi", "copyright", "redistribut", "software", "version", "domain", " under", "\nunder", "spdx")
_TAG = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()\- ]+)"


#: Rules of several identifiers, and the licences of single ones; where an identifier is in both, its sequences come first.
SEQUENCES = [(licence, ids) for licence, ids in RULES if len(ids) > 1]
SINGLE = {ids[0]: licence for licence, ids in RULES if len(ids) == 1}
ORDERED = sorted({i for _, ids in SEQUENCES for i in ids})


def normalised_text(value: Column) -> Column:
    """The text's sentences and lines, each normalised, one a line."""
    cut = F.regexp_replace(F.lower(value), _STOP, "\n")
    words = F.regexp_replace(F.regexp_replace(cut, r"\r\n?", "\n"), _BETWEEN_WORDS, " ")
    return F.regexp_replace(F.trim(F.regexp_replace(words, " *\n[ \n]*", "\n"), F.lit(" \n")), " +", " ")


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def _identifiers(value: Column) -> Column:
    """The identifiers of a text's known sentences, in its order, then those of its tags."""
    known, named, tags = _map(KNOWN), _map(NAMED), _map({x.lower(): f"spdx:{x}" for x in SPDX} | {old.lower(): f"spdx:{x}" for old, x in FORMER_TAGS.items()})
    plain = lambda x: F.replace(x, F.lit("\n"), F.lit(" "))
    found = F.transform(F.regexp_extract_all(normalised_text(value), F.lit(PHRASES), F.lit(0)), plain)
    before = rf"^(?:{_UNDER}|uses?[ \n]the[ \n]|licen[cs]e[ \n](?:the[ \n])?)"

    def named_in(x: Column) -> Column:  # a notice names one licence or a list
        return F.transform(F.regexp_extract_all(F.regexp_replace(x, before, ""), F.lit(_NAME), F.lit(0)), lambda n: F.try_element_at(named, n))

    def of(x: Column) -> Column:
        slot = F.lit(None).cast("string")
        for i, (head, _) in SLOTTED.items():
            slot = F.when(F.startswith(x, F.lit(normalised(head))), i).otherwise(slot)
        one = F.coalesce(F.try_element_at(known, x), slot)
        return F.when(one.isNotNull(), F.array(one)).otherwise(named_in(x))

    ids = F.flatten(F.transform(found, of))
    names = F.flatten(F.transform(F.regexp_extract_all(value, F.lit(_TAG), F.lit(1)), lambda x: F.split(x, r"(?i)[()]+|\s+(?:or|and|with)\s+")))
    tagged = F.transform(names, lambda x: F.try_element_at(tags, F.lower(F.trim(x))))
    return F.filter(F.concat(ids, tagged), lambda i: i.isNotNull())


def _matched(ids: Column) -> Column:
    """The licences of a text's identifiers, distinct and sorted.

    A fold over the rules of several identifiers, and inside it one over the identifiers that such rules have: it takes a
    rule's identifiers one after the other as they come, and leaves those between them to the rules that follow. What no
    sequence took counts by itself. A sentence that directly repeats itself is one.
    """
    strings = "array<string>"
    none = F.array().cast(strings)
    listed = F.array(*map(F.lit, ORDERED))
    inside = F.filter(ids, lambda i: F.array_contains(listed, i))
    once = F.transform(F.array(inside), lambda a: F.filter(a, lambda i, at: (at == 0) | (i != F.get(a, at - 1))))
    rules = F.array(*(F.struct(F.lit(x).alias("licence"), F.array(*map(F.lit, own)).alias("own")) for x, own in SEQUENCES))

    def taken(rest: Column, own: Column) -> Column:
        """(left, hit): what a rule leaves of the identifiers, and whether it matched."""
        start = F.struct(F.lit(0).alias("k"), none.alias("since"), none.alias("between"), none.alias("left"), F.lit(False).alias("hit"))

        def step(s: Column, i: Column) -> Column:
            met = i == F.get(own, s["k"])
            whole = met & (s["k"] + 1 == F.size(own))
            begun = s["k"] > 0
            return F.struct(
                F.when(whole, 0).when(met, s["k"] + 1).otherwise(s["k"]).alias("k"),
                F.when(whole, none).when(met | begun, F.array_append(s["since"], i)).otherwise(s["since"]).alias("since"),
                F.when(whole, none).when(begun & ~met, F.array_append(s["between"], i)).otherwise(s["between"]).alias("between"),
                F.when(whole, F.concat(s["left"], s["between"])).when(~met & ~begun, F.array_append(s["left"], i)).otherwise(s["left"]).alias("left"),
                (s["hit"] | whole).alias("hit"),
            )

        return F.aggregate(rest, start, step, lambda s: F.struct(F.concat(s["left"], s["since"]).alias("left"), s["hit"].alias("hit")))

    def rule(s: Column, r: Column) -> Column:
        possible = F.size(F.array_except(r["own"], s["rest"])) == 0
        done = F.get(F.transform(F.array(taken(s["rest"], r["own"])), lambda t: F.struct(t["left"].alias("rest"), F.when(t["hit"], F.array_append(s["licenses"], r["licence"])).otherwise(s["licenses"]).alias("licenses"))), F.lit(0))
        return F.when(possible, done).otherwise(s)

    start = F.struct(F.get(once, F.lit(0)).alias("rest"), none.alias("licenses"))
    single = _map(SINGLE)
    alone = lambda a: F.filter(F.transform(F.array_distinct(a), lambda i: F.try_element_at(single, i)), lambda x: x.isNotNull())
    folded = F.aggregate(rules, start, rule, lambda s: F.concat(s["licenses"], alone(s["rest"])))
    return F.array_sort(F.array_distinct(F.concat(folded, alone(F.filter(ids, lambda i: ~F.array_contains(listed, i))))))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with sentence_ids and licenses, arrays of strings; columns of these names are replaced.

    A known sentence counts wherever its words stand in a row, whole or within another sentence and however its lines are
    wrapped; a title counts as a whole line or sentence only, a notice ("released under ...", of one licence or a list)
    unless it is denied ("isn't released under ..."). Identifiers come in the order of the text, repeats included, those of tags last; licenses are distinct and
    sorted. Null and empty texts have neither. Whole texts, no shuffle.
    """
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [c for c in docs.columns if c.lower() not in ("sentence_ids", "licenses")]
    marked = F.rlike(F.lower(value), F.lit("|".join(MARKERS)))
    none = F.array().cast("array<string>")
    found = docs.select(*(F.col(f"`{c}`") for c in kept), F.when(marked, _identifiers(value)).otherwise(none).alias("sentence_ids"))
    return found.withColumn("licenses", F.when(F.size("sentence_ids") == 0, none).otherwise(_matched(F.col("sentence_ids"))))


def query(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))
