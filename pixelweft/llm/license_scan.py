"""Licence recognition by sentence rules, with DataFrame functions only.

A text is cut into sentences, each is normalised (lower case, runs of other characters than letters
and digits as one blank), and known ones become identifiers. The identifiers of a text, in order, are
matched against ordered rules: a rule holds where its identifiers follow each other with no other
known sentence between them. A rule whose identifiers all lie in a row in a longer one that also holds is left out: so the appendix of a
licence text, which shows how to apply it, doesn't count as a notice of its own.

Sentences end at ``.``, ``!``, ``?``, ``:`` or ``;`` before a blank. Each text is read twice: with every line end as the
end of a sentence, as in titles and one-line notices, and with lines joined, as in wrapped licence texts and headers; a rule may hold in
either reading. Joined lines part at lines without letters or digits (blank ones, bare comment marks) and around lines that are a web address;
comment marks before a line go with the other marks. The known sentences are a fixed list of public licence wording, looked up by
hash, so nothing is shuffled, collected or broadcast. Null and empty texts have no sentences. Repeated rows and
extra columns don't matter; names that begin with ``pw_`` are reserved. An empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licences and notices, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0 the license": "apache-intro",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "apache license version 2 0 january 2004": "apache-title",
    "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document": "apache-definition",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "mit-0-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "gnu general public license version 2 june 1991": "gpl2-title",
    "the licenses for most software are designed to take away your freedom to share and change it": "gpl-freedom",
    "this general public license applies to most of the free software foundation s software and to any other program whose authors commit to using it": "gpl2-applies",
    "gnu general public license version 3 29 june 2007": "gpl3-title",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "gpl3-copyleft",
    "gnu affero general public license version 3 19 november 2007": "agpl3-title",
    "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software": "agpl3-copyleft",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21-title",
    "this license the lesser general public license applies to some specially designated software packages typically libraries of the free software foundation and other authors who decide to use it": "lgpl21-applies",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3-title",
    "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below": "lgpl3-incorporates",
    "this program is free software": "gpl-free",
    "this library is free software": "gpl-free",
    "this file is free software": "gpl-free",
    "this software is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-terms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-only-terms",
    "you can redistribute it and or modify it under the terms of version 2 of the gnu general public license as published by the free software foundation": "gpl2-only-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "gpl3-only-terms",
    "either version 2 of the license or at your option any later version": "gnu-later-2",
    "either version 2 1 of the license or at your option any later version": "gnu-later-21",
    "either version 3 of the license or at your option any later version": "gnu-later-3",
    "version 2 of the license": "gnu-only-2",
    "version 3 of the license": "gnu-only-3",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "this library is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-implied",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-form",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-form",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl-copy",
    "mozilla public license version 2 0": "mpl-title",
    "contributor means each individual or legal entity that creates contributes to the creation of or owns covered software": "mpl-contributor",
    "this is free and unencumbered software released into the public domain": "unlicense-public",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-free",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-grant",
    "this font software is licensed under the sil open font license version 1 1": "ofl-notice",
    "cc0 1 0 universal": "cc0-title",
    "creative commons corporation is not a law firm and does not provide legal services": "cc-law-firm",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-dedication",
    "all rights reserved": "reserved",
}
# Ordered rules (licence, what it recognises, identifiers).
RULES = (
    ("Apache-2.0", "text", ("apache-title", "apache-definition", "apache-intro", "apache-compliance", "apache-copy", "apache-basis", "apache-see")),
    ("Apache-2.0", "text without appendix", ("apache-title", "apache-definition")),
    ("Apache-2.0", "header", ("apache-intro", "apache-compliance", "apache-copy", "apache-basis", "apache-see")),
    ("Apache-2.0", "start of header", ("apache-intro", "apache-compliance")),
    ("Apache-2.0", "copy", ("apache-compliance", "apache-copy")),
    ("Apache-2.0", "end of header", ("apache-basis", "apache-see")),
    ("MIT", "text", ("mit-grant", "mit-condition", "mit-warranty", "mit-liability")),
    ("MIT", "grant", ("mit-grant", "mit-condition")),
    ("MIT-0", "text", ("mit-0-grant", "mit-warranty")),
    ("GPL-2.0", "text", ("gpl2-title", "gpl-freedom", "gpl2-applies", "gpl-free", "gpl-terms", "gnu-later-2", "gpl-hope", "gpl-implied")),
    ("GPL-2.0", "text without appendix", ("gpl2-title", "gpl-freedom", "gpl2-applies")),
    ("GPL-3.0", "text", ("gpl3-title", "gpl3-copyleft", "gpl-free", "gpl3-terms", "gpl-hope", "gpl-implied")),
    ("GPL-3.0", "text without appendix", ("gpl3-title", "gpl3-copyleft")),
    ("AGPL-3.0", "text", ("agpl3-title", "agpl3-copyleft", "gpl-free", "agpl3-terms", "gpl-hope", "gpl-implied")),
    ("AGPL-3.0", "text without appendix", ("agpl3-title", "agpl3-copyleft")),
    ("LGPL-2.1", "text", ("lgpl21-title", "gpl-freedom", "lgpl21-applies", "gpl-free", "lgpl-terms", "gnu-later-21", "gpl-hope", "gpl-implied")),
    ("LGPL-2.1", "text without appendix", ("lgpl21-title", "gpl-freedom", "lgpl21-applies")),
    ("LGPL-3.0", "text", ("lgpl3-title", "lgpl3-incorporates")),
    ("GPL-3.0-or-later", "header", ("gpl-free", "gpl3-terms", "gpl-hope", "gpl-implied")),
    ("GPL-3.0-or-later", "terms", ("gpl-free", "gpl3-terms")),
    ("GPL-3.0-or-later", "parted terms", ("gpl-free", "gpl-terms", "gnu-later-3")),
    ("GPL-3.0-only", "terms", ("gpl-free", "gpl3-only-terms")),
    ("GPL-3.0-only", "parted terms", ("gpl-free", "gpl-terms", "gnu-only-3")),
    ("GPL-2.0-or-later", "header", ("gpl-free", "gpl2-terms", "gpl-hope", "gpl-implied")),
    ("GPL-2.0-or-later", "terms", ("gpl-free", "gpl2-terms")),
    ("GPL-2.0-or-later", "parted terms", ("gpl-free", "gpl-terms", "gnu-later-2")),
    ("GPL-2.0-only", "terms", ("gpl-free", "gpl2-only-terms")),
    ("GPL-2.0-only", "parted terms", ("gpl-free", "gpl-terms", "gnu-only-2")),
    ("AGPL-3.0-or-later", "terms", ("gpl-free", "agpl3-terms")),
    ("AGPL-3.0-or-later", "parted terms", ("gpl-free", "agpl-terms", "gnu-later-3")),
    ("LGPL-2.1-or-later", "terms", ("gpl-free", "lgpl21-terms")),
    ("LGPL-2.1-or-later", "parted terms", ("gpl-free", "lgpl-terms", "gnu-later-21")),
    ("LGPL-3.0-or-later", "terms", ("gpl-free", "lgpl3-terms")),
    ("LGPL-3.0-or-later", "parted terms", ("gpl-free", "lgpl-terms", "gnu-later-3")),
    ("BSD-4-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-name")),
    ("BSD-3-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", "text", ("isc-grant", "isc-warranty")),
    ("ISC", "grant", ("isc-grant",)),
    ("0BSD", "text", ("0bsd-grant", "isc-warranty")),
    ("MPL-2.0", "header", ("mpl-form", "mpl-copy")),
    ("MPL-2.0", "text", ("mpl-title", "mpl-contributor")),
    ("Unlicense", "text", ("unlicense-public", "unlicense-free")),
    ("Zlib", "text", ("zlib-warranty", "zlib-grant")),
    ("BSL-1.0", "grant", ("bsl-grant",)),
    ("OFL-1.1", "notice", ("ofl-notice",)),
    ("CC0-1.0", "text", ("cc0-title", "cc-law-firm")),
    ("CC0-1.0", "dedication", ("cc0-dedication",)),
    ("all-rights-reserved", "notice", ("reserved",)),
)
# Names that notices give licences, normalised.
NAMES = {
    "MIT": ("mit license",),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license"),
    "BSD-2-Clause": ("bsd 2 clause license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "new bsd license", "modified bsd license"),
    "ISC": ("isc license",),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0"),
    "GPL-2.0-only": ("gnu general public license version 2", "gpl version 2"),
    "GPL-3.0-only": ("gnu general public license version 3", "gpl version 3"),
    "LGPL-2.1-only": ("gnu lesser general public license version 2 1",),
    "LGPL-3.0-only": ("gnu lesser general public license version 3",),
    "AGPL-3.0-only": ("gnu affero general public license version 3",),
}
# How one-line notices begin.
OPENINGS = ("licensed under the", "released under the", "distributed under the", "this work is licensed under the", "this project is licensed under the", "this software is licensed under the", "this software is released under the", "this program is licensed under the", "this file is licensed under the")
# Creative Commons licences by code, and their versions.
CC_CODES = {"by": "attribution", "by sa": "attribution sharealike", "by nd": "attribution noderivatives", "by nc": "attribution noncommercial", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
CC_VERSIONS = {"4 0": "4 0 international", "3 0": "3 0 unported"}
SPDX = "spdx license identifier"


def _notices() -> dict[str, tuple[str, str]]:
    """Sentences that name a licence by themselves, built from names and openings: {sentence: (identifier, licence)}."""
    out = {}
    for licence, names in NAMES.items():
        out |= {f"{o} {n}": (f"{licence} notice", licence) for o in OPENINGS for n in names}
    for code, name in CC_CODES.items():
        for version, long in CC_VERSIONS.items():
            licence = f"CC-{code.upper().replace(' ', '-')}-{version.replace(' ', '.')}"
            said = [f"{o} cc {code} {version}" for o in ("licensed under", "released under", "this work is licensed under")]
            said += [f"this work is licensed under {a} creative commons {name} {long} license" for a in ("a", "the")]
            out |= {x: (f"{licence} notice", licence) for x in said}
    for licence in sorted({r[0] for r in RULES if r[0] != "all-rights-reserved"} | {r for _, r in out.values()}):
        out[f"{SPDX} {' '.join(licence.lower().replace('-', ' ').replace('.', ' ').split())}"] = (f"{licence} tag", licence)
    return out


KNOWN = SENTENCES | {s: i for s, (i, _) in _notices().items()}
ALL_RULES = RULES + tuple((licence, i.rsplit(" ", 1)[1], (i,)) for i, licence in dict.fromkeys(_notices().values()))
#: Every known sentence holds one of these inside a word, in lower case: texts without any are not cut up.
MARKS = ("licen", "permi", "warrant", "redistribut", "reserved", "software", "mpl", "gpl", "creative commons", "cc0", "cc by")
#: A sentence with a name of its own in it, whole or cut after a point in the name ("Example Inc."), and the known sentence it stands for.
BSD_NAME = next(s for s, i in SENTENCES.items() if i == "bsd-name")
ANY_BSD_NAME = "^(neither the name of .*)?" + BSD_NAME[BSD_NAME.index("nor the names of") :].replace("of its", "of (its|any|their)") + "$"

SENTENCE_END, OTHER = r"([.!?:;])[ \t\r\n]+", "[^a-z0-9]+"
#: Line ends, and what stands before a line's first letter or digit.
LINE_END, LEAD = r"\r\n|\r|\n", "^[^a-z0-9]+"
#: A line that is a web address, comment marks before it aside; what a sentence's colon may not part from a tag; and letters or digits.
ADDRESS, TAG, TEXT = r"^[^a-z0-9]*(https?://|www[.])[^ \t]*[ \t\r]*$", r"spdx-license-identifier:[ \t]*", "[a-z0-9]"


def _ids(lines: Column) -> Column:
    """Identifiers of the known sentences of lower-case text, in order."""
    bare = F.transform(F.split(F.regexp_replace(lines, SENTENCE_END, "$1\n"), "\n", -1), lambda s: F.regexp_replace(F.trim(F.regexp_replace(s, OTHER, " ")), ANY_BSD_NAME, BSD_NAME))
    known = F.from_json(F.lit(json.dumps(KNOWN)), "map<string,string>")
    return F.transform(F.filter(bare, lambda s: s.isin(*KNOWN)), lambda s: F.try_element_at(known, s))


def _unwrapped(lower: Column) -> Column:
    """Lines joined, but for empty ones and addresses."""
    part = lambda x: F.when(~x.rlike(TEXT), F.lit("\n")).when(x.rlike(ADDRESS), F.concat(F.lit("\n"), x, F.lit("\n"))).otherwise(F.concat(F.lit(" "), F.regexp_replace(x, LEAD, "")))
    return F.array_join(F.transform(F.split(lower, LINE_END, -1), part), "")


def _joined(ids: Column) -> Column:
    return F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))


def rule_name(k: int) -> str:
    return f"{ALL_RULES[k][0]}: {ALL_RULES[k][1]}"


def _longer(k: int) -> list[int]:
    """Rules that contain rule k's identifiers in a row, and more."""
    inner = "," + ",".join(ALL_RULES[k][2]) + ","
    return [j for j, (_, _, ids) in enumerate(ALL_RULES) if j != k and inner in "," + ",".join(ids) + ","]


def scan(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """All columns, and pw_by_line and pw_wrapped (identifiers in either reading, comma-joined with commas at both ends),
    pw_rules (names of rules that hold, in the list's order) and pw_licenses (distinct, sorted)."""
    text = F.lower(F.col(text_col).cast("string"))
    marked = F.coalesce(text.rlike("|".join(MARKS)), F.lit(False))
    lower = F.regexp_replace(text, TAG, f"{SPDX} ")
    none = F.array().cast("array<string>")
    docs = docs.withColumn("pw_by_line", _joined(F.when(marked, _ids(lower)).otherwise(none)))
    docs = docs.withColumn("pw_wrapped", _joined(F.when(marked, _ids(_unwrapped(lower))).otherwise(none)))
    # A list of the rules that hold is made only where there is an identifier: most texts have none.
    any_id = (F.col("pw_by_line") != ",,") | (F.col("pw_wrapped") != ",,")
    rules = [{"needle": "," + ",".join(ids) + ",", "name": rule_name(k), "licence": licence, "longer": _longer(k), "k": k} for k, (licence, _, ids) in enumerate(ALL_RULES)]
    every = F.from_json(F.lit(json.dumps(rules)), "array<struct<needle:string,name:string,licence:string,longer:array<int>,k:int>>")
    found = F.filter(every, lambda r: F.col("pw_by_line").contains(r.needle) | F.col("pw_wrapped").contains(r.needle))
    docs = docs.withColumn("pw_found", F.when(any_id, found).otherwise(F.filter(every, lambda r: F.lit(False))))
    docs = docs.withColumn("pw_held", F.transform("pw_found", lambda r: r.k))
    docs = docs.withColumn("pw_found", F.filter("pw_found", lambda r: ~F.arrays_overlap(r.longer, F.col("pw_held"))))
    docs = docs.withColumn("pw_rules", F.transform("pw_found", lambda r: r["name"])).withColumn("pw_licenses", F.array_sort(F.array_distinct(F.transform("pw_found", lambda r: r.licence))))
    return docs.drop("pw_found", "pw_held")


def oracle_sql() -> str:
    """DuckDB SQL for doc_id, by_line, wrapped, rules and licenses over ``documents``."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in KNOWN.items()) + "}"

    def ids(text: str) -> str:
        cut = rf"string_split(regexp_replace({text}, '([.!?:;])[ \t\r\n]+', '\1' || chr(10), 'g'), chr(10))"
        bare = f"list_transform({cut}, lambda s: regexp_replace(trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')), {q(ANY_BSD_NAME)}, {q(BSD_NAME)}))"
        return f"',' || coalesce(array_to_string(list_filter(list_transform({bare}, lambda s: k[s]), lambda s: s IS NOT NULL), ','), '') || ','"

    joined = rf"""array_to_string(list_transform(string_split_regex(x, '{LINE_END}'), lambda l: CASE WHEN NOT regexp_matches(l, '{TEXT}') THEN chr(10)
      WHEN regexp_matches(l, '{ADDRESS}') THEN chr(10) || l || chr(10) ELSE ' ' || regexp_replace(l, '{LEAD}', '') END), '')"""
    has = lambda k: "(contains(by_line, {0}) OR contains(wrapped, {0}))".format(q("," + ",".join(ALL_RULES[k][2]) + ","))
    cond = [" AND ".join([has(k), *(f"NOT {has(j)}" for j in _longer(k))]) for k in range(len(ALL_RULES))]
    names = ", ".join(f"CASE WHEN {c} THEN {q(rule_name(k))} END" for k, c in enumerate(cond))
    licences = ", ".join(f"CASE WHEN {c} THEN {q(ALL_RULES[k][0])} END" for k, c in enumerate(cond))
    return f"""WITH k AS (SELECT {known} AS k),
    t AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '{TAG}', '{SPDX} ', 'g') AS x FROM documents),
    s AS (SELECT doc_id, {ids('x')} AS by_line, {ids(joined)} AS wrapped FROM t, k)
    SELECT doc_id, by_line, wrapped,
      coalesce(array_to_string(list_filter([{names}], lambda r: r IS NOT NULL), ','), '') AS rules,
      coalesce(array_to_string(list_sort(list_distinct(list_filter([{licences}], lambda r: r IS NOT NULL))), ','), '') AS licenses
    FROM s"""
