"""License statements: normalised sentences to identifiers, identifier sequences to licenses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .common import let

#: Sentences of license texts (letters and digits in lower case) by identifier.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-grant": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "rights": "all rights reserved",
}
#: Names that short statements use, by license.
NAMES = {
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"),
    "MIT": ("mit license", "mit licence", "expat license"),
    "BSD-2-Clause": ("bsd 2 clause license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "new bsd license", "bsd license"),
    "ISC": ("isc license",),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gpl v2", "gplv2"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gpl v3", "gplv3"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "lgpl v3", "lgplv3"),
    "AGPL-3.0": ("gnu affero general public license version 3", "agpl v3", "agplv3"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license"),
}
#: The opening of a short statement; normalised to the one word "under".
OPENING = r"^(?:(?:this|the) (?:work|project|software|code|file|document|text|program|page|content) is )?(?:licensed|licenced|released|distributed|available|published) under (?:the terms of )?(?:the |a )?"
#: License of an identifier sequence; rules are tried in this order, and what one matches is taken from the next.
SEQUENCES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")), ("MIT", ("mit-grant", "mit-notice")), ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant", "isc-warranty")), ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")), ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")), ("BSD", ("bsd-grant",)),
    ("Apache-2.0", ("apache-grant", "apache-use", "apache-copy")), ("Apache-2.0", ("apache-grant", "apache-use")), ("Apache-2.0", ("apache-grant",)),
    ("GPL-3.0", ("gpl-free", "gpl-warranty", "gpl-copy")), ("GPL-3.0", ("gpl-free", "gpl-warranty")), ("GPL-3.0", ("gpl-free",)),
    ("GPL-2.0", ("gpl2-free", "gpl-warranty", "gpl-copy")), ("GPL-2.0", ("gpl2-free", "gpl-warranty")), ("GPL-2.0", ("gpl2-free",)),
    ("MPL-2.0", ("mpl-form", "mpl-copy")), ("MPL-2.0", ("mpl-form",)),
    ("Unlicense", ("unlicense-domain",)), ("Proprietary", ("rights",)),
) + tuple((name, (f"is-{name.lower()}",)) for name in NAMES)
#: A text with a known sentence holds one of these.
GATE = "(?i)" + "|".join(("licens", "licenc", "permission", "copyright", "redistribut", "warrant", r"public\s+domain", r"rights\s+reserved", r"(?:licensed|released|distributed|available|published)\s+under", r"gnu\s+general", "spdx", "mozilla"))
#: Sentences end at line ends, or only at blank lines; both at full stops that no number follows, and at semicolons.
ENDS = r"[.!?]+(?=\s+[^\s0-9]|\s*$)|;(?=\s)|[.!?:;]*\s*\n"
WRAPPED_ENDS = r"[.!?]+(?=\s+[^\s0-9]|\s*$)|;(?=\s)|[:;]?\s*\n\s*\n"
#: What a line of a comment begins with in usual languages.
COMMENT = r"(?m)^[ \t]*(?:#+|//+|/?\*+/?|--+|;+|%+|<!--+|dnl\b|rem\b|\|)(?=\s|$)[ \t]?"
#: Words that may go on after a short statement.
TAIL = "see|please|for|a copy|and|or|in|as|with|which|you|unless|c|copyright|the|refer|read|http|https|except|found|available|by|all|it"


def known() -> dict[str, str]:
    """Identifier of each known sentence in normal form: license texts, short statements by name, SPDX lines."""
    out = {re.sub(OPENING, "under ", text): key for key, text in SENTENCES.items()}
    for name, forms in NAMES.items():
        key = f"is-{name.lower()}"
        out["spdx license identifier " + re.sub("[-.]", " ", name.lower())] = key
        out.update({f"under {form}": key for form in forms})
    return out


FOUND = "array<struct<at:int,id:string>>"


def _found(text: Column, ends: str, table: dict[str, str]) -> Column:
    """The known sentences as ``at`` (how many words come before) and ``id``, in order."""
    by_key: dict[str, list[str]] = {}
    for sentence, key in table.items():
        by_key.setdefault(key, []).append(sentence)

    def key_of(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for key, forms in by_key.items():
            out = F.when(s.isin(*forms), key).otherwise(out)
        return out

    short = "|".join(sorted((s[6:] for s in table if s.startswith("under ")), key=len, reverse=True))
    known_form = rf"^(under (?:{short}))(?: (?:{TAIL})\b.*)?$"

    def form(plain: Column) -> Column:
        opened = F.regexp_replace(plain, OPENING, "under ")
        cut = F.regexp_extract(opened, known_form, 1)
        return F.when(opened.startswith("under ") & (cut != ""), cut).otherwise(opened)

    def step(a: Column, s: Column) -> Column:
        after = a["at"] + F.when(s == "", 0).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "))) + 1)
        return let(form(s), lambda f: F.struct(after.alias("at"), F.when(f.isin(*table), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), key_of(f).alias("id"))))).otherwise(a["out"]).alias("out")))

    plain = F.transform(F.split(text, ends), lambda s: F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    return F.aggregate(plain, F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out")), step)["out"]


def scan(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every row of ``docs`` with ``licenses`` (array, by rule order) and ``sentence_ids`` (array, in text order).

    Comment marks at line starts are left out.  Texts are cut into sentences at line ends
    and at full stops and semicolons before white space; a second cut joins lines that are
    only wrapped.  What either knows is put in the order of the text by the words before
    it, which both count alike; what both know is there once.  A short statement may go on
    after the name.  The identifiers' sequence is matched by the ordered rules: longer
    sequences come before their parts, and what a rule matched is not matched again.
    Null, empty or unmarked texts have neither; each row is judged by itself.
    """
    table = known()
    text = F.coalesce("text", F.lit(""))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f" {'  '.join(keys)} ").alias("keys")) for name, keys in SEQUENCES])
    none = F.array().cast("array<string>")

    def matched(ids: Column) -> Column:
        start = F.struct(F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" ")).alias("left"), none.alias("found"))
        done = F.aggregate(rules, start, lambda a, r: F.when(F.contains(a["left"], r["keys"]), F.struct(F.replace(a["left"], r["keys"], F.lit(" | ")).alias("left"), F.concat(a["found"], F.array(r["name"])).alias("found"))).otherwise(a))
        return F.struct(F.array_distinct(done["found"]).alias("licenses"), ids.alias("sentence_ids"))

    bare = F.regexp_replace(text, COMMENT, "")
    both = let(bare, lambda x: F.array_sort(F.array_union(_found(x, ENDS, table), _found(x, WRAPPED_ENDS, table))))
    ids = F.transform(both, lambda x: x["id"])
    found = F.when(text.rlike(GATE), let(ids, lambda i: F.when(F.size(i) > 0, matched(i)))).otherwise(F.lit(None))
    out = docs.select(*columns, found.alias("_f"))
    return out.select(*columns, F.coalesce("_f.licenses", none).alias("licenses"), F.coalesce("_f.sentence_ids", none).alias("sentence_ids"))
