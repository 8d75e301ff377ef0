"""Licence scans by sentence rules (native DataFrame operations only).

A text is normalised (letters and digits, lower case, single spaces, which drops
comment marks) with marks at line ends and at hard ends: blank lines, and ``.``,
``!`` or ``?`` before white space. A known licence sentence is found between two
marks, behind the label of a list item if there is one; it may be wrapped over lines,
but holds no hard end. Known are the sentences of licence texts and headers, some
with a name left open, and notices: an opening ("licensed under the"), and any of the
licences' names, by rule. Where several begin at one place the longest counts.

The identifier sequence of a text is matched against ordered licence rules. A rule
fires where its identifiers stand next to each other, in order, in the sequence of
known sentences; it takes them out, so that a shorter rule of another licence, which
follows it in the list, finds only what is left. ``generic`` counts the lines and
sentences in a line with a strong cue that no identifier covers.

Defined cases: null or empty text has no sentences and no licences; repeated rows
give repeated results; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

#: Sentences of licence texts and headers in normal form and their identifiers (fixed values).
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-disclaimer",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-disclaimer",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-disclaimer",
    "see the license for the specific language governing permissions and limitations under the license": "apache-permissions",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorsement",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-disclaimer",
    "this software is provided as is without any express or implied warranty": "zlib-disclaimer",
    "this software is provided as is without any express or implied warranties": "zlib-disclaimer",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "the origin of this software must not be misrepresented you must not claim that you wrote the original software": "zlib-origin",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib-altered",
    "this notice may not be removed or altered from any source distribution": "zlib-notice-stays",
    "this is free and unencumbered software released into the public domain": "unlicense-dedication",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0-header",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2.0-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2.0-copy",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-disclaimer",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "lgpl-disclaimer",
    "see the gnu general public license for more details": "gpl-details",
    "see the gnu lesser general public license for more details": "lgpl-details",
    "see the gnu affero general public license for more details": "agpl-details",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution": "epl-1.0-header",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl-2.0-header",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-1.0-grant",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gpl-verbatim",
    "you just do what the fuck you want to": "wtfpl-terms",
    "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work": "cc0-1.0-waiver",
    "this font software is licensed under the sil open font license version 1 1": "ofl-1.1-header",
    "all rights reserved": "reserved",
}
#: Sentences of the licence families of one publisher: what is granted, its name, and versions (fixed values).
for _what, _id in (("program", "gpl"), ("library", "lgpl"), ("program", "lgpl"), ("program", "agpl")):
    _name = {"gpl": "gnu general public license", "lgpl": "gnu lesser general public license", "agpl": "gnu affero general public license"}[_id]
    for _version, _mark in (("2", "2.0"), ("2 1", "2.1"), ("3", "3.0")):
        for _later in ("", " or at your option any later version"):
            SENTENCES[f"this {_what} is free software you can redistribute it and or modify it under the terms of the {_name} as published by the free software foundation {'either ' if _later else ''}version {_version} of the license{_later}"] = f"{_id}-{_mark}-grant"
#: Sentences with a name left open, as patterns of words, and their identifiers (fixed values).
OPEN = {
    "neither the name of [a-z0-9 ]{1,80} nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorsement",
    "neither the names? of [a-z0-9 ]{1,80} may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorsement",
    "in no event shall [a-z0-9 ]{1,80} be liable for any direct indirect incidental special exemplary or consequential damages [a-z0-9 ]{1,400} even if advised of the possibility of such damage": "bsd-liability",
    "to the extent possible under law [a-z0-9 ]{1,80} has waived all copyright and related or neighboring rights to [a-z0-9 ]{1,80}": "cc0-1.0-waiver",
}
#: Openings of a notice, and what may stand before the name (fixed values).
OPENINGS = [
    "licensed under", "released under", "distributed under", "published under", "available under", "provided under", "made available under", "covered by", "dual licensed under",
    *[f"{what} is {how} under" for what in ("this project", "this work", "this software", "this program", "this library", "this package", "this file", "this document", "this code", "the code", "the source code", "the software") for how in ("licensed", "released", "distributed", "available", "made available", "provided")],
]
BEFORE = ["", "the ", "a ", "an ", "the terms of the ", "the terms of ", "the conditions of the "]
#: Names of licences in normal form (fixed values).
NAMES = {
    "MIT": ["mit license", "mit licence", "mit", "mit expat license", "expat license"],
    "Apache-2.0": ["apache license version 2 0", "apache license version 2 0 the license", "apache license 2 0", "apache license v2 0", "apache 2 0 license", "apache 2 0", "asl 2 0", "apache software license 2 0"],
    "Apache-1.1": ["apache license version 1 1", "apache license 1 1", "apache software license version 1 1"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd 2 clause", "freebsd license", "two clause bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "revised bsd license", "bsd 3 clause", "three clause bsd license"],
    "BSD-4-Clause": ["bsd 4 clause license", "4 clause bsd license", "original bsd license"],
    "BSD": ["bsd license", "bsd licence", "bsd style license"],
    "ISC": ["isc license", "isc licence", "isc"],
    "Zlib": ["zlib license", "zlib libpng license", "zlib licence"],
    "Unlicense": ["unlicense", "unlicense license"],
    "WTFPL": ["wtfpl", "do what the fuck you want to public license"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "boost software license"],
    "MPL-1.1": ["mozilla public license version 1 1", "mozilla public license 1 1", "mpl 1 1"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "EPL-1.0": ["eclipse public license version 1 0", "eclipse public license 1 0", "eclipse public license v1 0", "epl 1 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0", "epl 2 0"],
    "CDDL-1.0": ["common development and distribution license version 1 0", "common development and distribution license 1 0", "cddl 1 0"],
    "Artistic-2.0": ["artistic license 2 0", "artistic license version 2 0"],
    "EUPL-1.2": ["european union public licence version 1 2", "european union public licence 1 2", "eupl 1 2", "eupl v1 2"],
    "OFL-1.1": ["sil open font license version 1 1", "sil open font license 1 1", "sil ofl 1 1", "open font license version 1 1"],
    "PSF-2.0": ["python software foundation license", "psf license", "python software foundation license version 2"],
    "PostgreSQL": ["postgresql license", "postgresql licence"],
    "MS-PL": ["microsoft public license", "ms pl"],
    "NCSA": ["university of illinois ncsa open source license", "ncsa license"],
    "OSL-3.0": ["open software license version 3 0", "open software license 3 0"],
    "CC0-1.0": ["cc0", "cc0 1 0", "cc0 1 0 universal", "creative commons zero", "creative commons cc0 1 0 universal license", "cc0 license"],
}
for _id, _names, _versions in (
    ("GPL", ["gnu general public license", "gnu gpl", "gpl"], ("2", "3")),
    ("LGPL", ["gnu lesser general public license", "gnu lgpl", "lgpl"], ("2 1", "3")),
    ("AGPL", ["gnu affero general public license", "gnu agpl", "agpl"], ("3",)),
):
    for _v in _versions:
        _more = [f" {x}{_v}{zero}{later}" for x in ("version ", "v", "v ", "") for zero in (("", " 0") if " " not in _v else ("",)) for later in ("", " or later", " only", " license")]
        NAMES[f"{_id}-{_v.replace(' ', '.') if ' ' in _v else _v + '.0'}"] = [n + m for n in _names for m in _more]
for _kind, _long in (
    ("by", "attribution"), ("by sa", "attribution sharealike"), ("by nc", "attribution noncommercial"), ("by nd", "attribution noderivatives"),
    ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives"),
):
    for _v in ("2 0", "2 5", "3 0", "4 0"):
        _forms = [f"cc {_kind} {_v}", f"cc {_kind} {_v} license"] + [f"creative commons {_long} {_v}{end}" for end in ("", " license", " international license", " unported license", " international", " generic license")]
        NAMES[f"CC-{_kind.upper().replace(' ', '-')}-{_v.replace(' ', '.')}"] = _forms
NAME_IDS = {name: f"{license_id.lower()}-notice" for license_id, names in NAMES.items() for name in names}
#: Ordered rules of several sentences, the longer before those they hold, and of single sentences of headers (fixed values).
TEXT_RULES = [
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorsement"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD", ["bsd-grant", "bsd-source"]),
    ("BSD", ["bsd-grant"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-disclaimer", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-disclaimer"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("ISC", ["isc-grant", "isc-disclaimer"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant", "isc-disclaimer"]),
    ("Apache-2.0", ["apache-2.0-notice", "apache-compliance", "apache-copy", "apache-disclaimer", "apache-permissions"]),
    ("Apache-2.0", ["apache-2.0-notice", "apache-compliance", "apache-copy", "apache-disclaimer"]),
    ("Apache-2.0", ["apache-compliance", "apache-copy", "apache-disclaimer"]),
    ("Zlib", ["zlib-disclaimer", "zlib-liability", "zlib-grant", "zlib-origin"]),
    ("Zlib", ["zlib-grant", "zlib-origin"]),
    ("Unlicense", ["unlicense-dedication", "unlicense-grant"]),
    ("Unlicense", ["unlicense-dedication"]),
    ("MPL-2.0", ["mpl-2.0-header", "mpl-2.0-copy"]),
    ("MPL-2.0", ["mpl-2.0-header"]),
    *[(f"{k.upper()}-{v}", [f"{k}-{v}-grant", f"{end}-disclaimer"]) for k in ("gpl", "lgpl", "agpl") for v in ("2.0", "2.1", "3.0") for end in ("gpl", "lgpl")],
    *[(f"{k.upper()}-{v}", [f"{k}-{v}-grant"]) for k in ("gpl", "lgpl", "agpl") for v in ("2.0", "2.1", "3.0")],
    ("EPL-1.0", ["epl-1.0-header"]),
    ("EPL-2.0", ["epl-2.0-header"]),
    ("BSL-1.0", ["bsl-1.0-grant"]),
    ("WTFPL", ["wtfpl-terms"]),
    ("CC0-1.0", ["cc0-1.0-waiver"]),
    ("OFL-1.1", ["ofl-1.1-header"]),
]
RULES = TEXT_RULES + [(license_id, [f"{license_id.lower()}-notice"]) for license_id in NAMES]
#: A text without any of these in it holds no licence sentence (fixed values).
CUES = [
    "licens", "licenc", "permission", "permitted", "copyright", "warrant", "redistribut", "complian", "reserved", "under", "covered", "endorse", "advertising", "liable", "misrepresented",
    "distribution", "unencumbered", "commercial", "mpl", "fuck",
]
STRONG = ["licens", "licenc"]
LABEL = "(?:[a-h]|i{1,3}|iv|vi{0,3}|[0-9]{1,2}) "


def of_words(text: str) -> str:
    """A pattern whose spaces may be line ends."""
    return text.replace("[a-z0-9 ]", "[a-z0-9 ~]").replace("} ", "}[ ~]").replace(" ", "[ ~]").replace("[a-z0-9[ ~]~]", "[a-z0-9 ~]")


def longest_first(texts) -> str:
    return "|".join(sorted(texts, key=lambda s: (-len(s), s)))


NOTICE = f"(?:{longest_first(OPENINGS)}) (?:{longest_first(BEFORE)})"
#: A known sentence between marks: ``~`` is a line end and ``|`` a hard end.
KNOWN = f"(?<=[|~])(?:{of_words(LABEL)})?(?:{of_words(longest_first(SENTENCES))}|{of_words(NOTICE)}(?:{of_words(longest_first(NAME_IDS))})|{of_words('|'.join(OPEN))})(?=[|~])"


def marked(low: Column) -> Column:
    """Lower-case text in normal form with marks at its line ends and hard ends."""
    out = low
    for pattern, to in (
        ("[|~]", " "), (r"([.!?])[\x20\x09-\x0D]+", "$1|"), (r"\n", "~"), ("[^a-z0-9|~]+", " "),
        (" ?([|~]) ?", "$1"), ("~{2,}", "|"), (r"[|~]*\|[|~]*", "|"),
    ):
        out = F.regexp_replace(out, pattern, to)
    return F.concat(F.lit("|"), F.btrim(out), F.lit("|"))


def has_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def identifier(sentence: Column) -> Column:
    """The identifier of a known sentence."""
    plain = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    flat = F.translate(sentence, "~", " ")
    bare = F.regexp_replace(flat, f"^{LABEL}", "")
    name = F.regexp_replace(bare, f"^{NOTICE}", "")
    out = F.coalesce(*[F.try_element_at(plain(SENTENCES), x) for x in (flat, bare)], *[F.try_element_at(plain(NAME_IDS), x) for x in (name,)])
    for pattern, own in OPEN.items():
        out = F.coalesce(out, F.when(bare.rlike(f"^(?:{pattern})$"), F.lit(own)))
    return out


def fired(ids: Column) -> Column:
    """Licences whose rules fire, in the order of the rules; a rule takes its identifiers out."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + ",".join(own) + ",").alias("own")) for name, own in RULES])
    start = F.struct(F.concat(F.lit(","), F.array_join(ids, ","), F.lit(",")).alias("left"), F.array().cast("array<string>").alias("names"))

    def step(now: Column, rule: Column) -> Column:
        hit = now.left.contains(rule.own)
        return F.when(hit, F.struct(F.replace(now.left, rule.own, F.lit(",|,")).alias("left"), F.array_append(now.names, rule["name"]).alias("names"))).otherwise(now)

    return F.when(F.size(ids) > 0, F.array_distinct(F.aggregate(rules, start, step).names)).otherwise(F.array().cast("array<string>"))


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licenses, n_generic) of every row; licenses in rule order, each once."""
    low = F.lower(F.col("text"))
    rows = common.texts(docs).select("doc_id", F.when(has_any(low, CUES), marked(low)).otherwise("").alias("s"))
    found = F.regexp_extract_all("s", F.lit(KNOWN), F.lit(0))
    rows = rows.select("doc_id", "s", F.transform(found, identifier).alias("ids"))
    generic = F.filter(F.split(F.regexp_replace("s", KNOWN, ""), "[|~]", -1), lambda x: has_any(x, STRONG))
    return rows.select("doc_id", F.array_join("ids", ",").alias("sentence_ids"), fired(F.col("ids")).alias("licenses"), F.size(generic).cast("long").alias("n_generic"))
