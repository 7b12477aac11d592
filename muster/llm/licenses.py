"""Licence scans by sentence rules.

Texts are normalised (lower case, runs of anything but letters, digits, dots and plus signs
become one space) with marks where a sentence must end (a blank line, or '.', '!' or '?' that
white space follows, but not after 'v.') and where it may end (a line end, or ';' or ':'
that white space follows).  Known sentences are looked for from mark to mark, the longest
first; they run across places where a sentence may end, so wrapped texts are whole, and
never across places where it must.  What is found carries the identifier of a licence
sentence.  The sequence of identifiers of a document is then
matched against ordered rules: each rule that finds its identifiers in a row takes them
out and names a licence, so the more specific rules come first.  Everything is done within
the row: no shuffle, no join.

Defined results: NULL and empty texts, and texts without known sentences, have no
licences; identifiers no rule takes are reported as ``rest``; a sentence is a whole
sentence, so mere mention of a name is not a licence; equal rows each give a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.common import let, named

# Licence sentences as the licences and their customary notices have them,
# normalised, each with its identifier.
SENTENCES = (
    ("ApacheRef", "licensed under the apache license version 2.0"),
    ("ApacheRef", "licensed under the apache license version 2.0 the license"),
    ("ApacheRef", "this file is licensed under the apache license version 2.0"),
    ("ApacheUse", "you may not use this file except in compliance with the license"),
    ("ApacheCopy", "you may obtain a copy of the license at"),
    ("ApacheCopy", "you may obtain a copy of the license at http www.apache.org licenses license 2.0"),
    ("AsIsSoftware", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
    ("MITRef", "released under the mit license"),
    ("MITRef", "licensed under the mit license"),
    ("MITRef", "this project is licensed under the mit license"),
    ("MITGrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MITNotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MITWarranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("ISCGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSDGrant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSDSource", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSDBinary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BSDEndorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDAdvertise", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("BSDRef", "licensed under the bsd license"),
    ("GPL3Ref", "this work is licensed under the gnu general public license version 3"),
    ("GPL3Ref", "licensed under the gnu general public license version 3"),
    ("GPL3Ref", "licensed under the gnu general public license v3.0"),
    ("GPL2Ref", "this work is licensed under the gnu general public license version 2"),
    ("GPL2Ref", "licensed under the gnu general public license version 2"),
    ("GPLFree3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GPLFree2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GPLHope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GPLSee", "see the gnu general public license for more details"),
    ("GPLCopy", "you should have received a copy of the gnu general public license along with this program"),
    ("LGPLFree21", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"),
    ("LGPL3Ref", "licensed under the gnu lesser general public license version 3"),
    ("AGPL3Ref", "licensed under the gnu affero general public license version 3"),
    ("MPL2Ref", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("MPL2Ref", "this source code form is subject to the terms of the mozilla public license v. 2.0"),
    ("MPL2Copy", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0"),
    ("EPL2Ref", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0"),
    ("CCBYRef", "licensed under cc by 4.0"),
    ("CCBYRef", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("CCBYSARef", "licensed under cc by sa 4.0"),
    ("CCBYSARef", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("CCBYNCRef", "licensed under cc by nc 4.0"),
    ("CCBYNCRef", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("CCBYNDRef", "licensed under cc by nd 4.0"),
    ("CC0Ref", "licensed under cc0 1.0"),
    ("CC0Ref", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("PublicDomain", "this work is in the public domain"),
    ("Boost1", "distributed under the boost software license version 1.0"),
    ("AllRights", "all rights reserved"),
)

# Rules in order; the first that matches takes its identifiers.
RULES = (
    ("Apache-2.0", ("ApacheRef", "ApacheUse", "ApacheCopy", "AsIsSoftware", "ApacheSee")),
    ("Apache-2.0", ("ApacheRef", "ApacheUse", "ApacheCopy")),
    ("Apache-2.0", ("ApacheRef",)),
    ("MIT", ("MITGrant", "MITNotice", "MITWarranty")),
    ("MIT", ("MITGrant", "MITNotice")),
    ("MIT", ("MITRef",)),
    ("ISC", ("ISCGrant",)),
    ("BSD-4-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDAdvertise", "BSDEndorse")),
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary")),
    ("BSD", ("BSDRef",)),
    ("GPL-3.0-or-later", ("GPLFree3", "GPLHope", "GPLSee", "GPLCopy")),
    ("GPL-3.0-or-later", ("GPLFree3",)),
    ("GPL-2.0-or-later", ("GPLFree2", "GPLHope", "GPLSee", "GPLCopy")),
    ("GPL-2.0-or-later", ("GPLFree2",)),
    ("LGPL-2.1-or-later", ("LGPLFree21",)),
    ("AGPL-3.0-only", ("AGPL3Ref",)),
    ("LGPL-3.0-only", ("LGPL3Ref",)),
    ("GPL-3.0-only", ("GPL3Ref",)),
    ("GPL-2.0-only", ("GPL2Ref",)),
    ("MPL-2.0", ("MPL2Ref", "MPL2Copy")),
    ("MPL-2.0", ("MPL2Ref",)),
    ("EPL-2.0", ("EPL2Ref",)),
    ("CC-BY-NC-4.0", ("CCBYNCRef",)),
    ("CC-BY-SA-4.0", ("CCBYSARef",)),
    ("CC-BY-ND-4.0", ("CCBYNDRef",)),
    ("CC-BY-4.0", ("CCBYRef",)),
    ("CC0-1.0", ("CC0Ref",)),
    ("Unlicense", ("Unlicense",)),
    ("LicenseRef-public-domain", ("PublicDomain",)),
    ("BSL-1.0", ("Boost1",)),
    ("LicenseRef-all-rights-reserved", ("AllRights",)),
)

# The split of the SQL: at every line feed, and at a mark that white space follows.  It finds
# the sentences that lie between two such places; ``sentence_ids`` finds those and the ones
# that run across line ends, ';' and ':'.
SENTENCE_END = r"\n|[.;:!?][\x20\x09-\x0D]+"
NOISE = r"[^a-z0-9.+]+"
# Where a sentence of a lower-cased text must end (a line of signs only is blank), and where
# it may.  Upper-case letters are free to mark them: M and C.
MUST_END = r"(?<!\bv)[.!?][\x20\x09-\x0D]++|\n(?:[^a-z0-9\n]*+\n)++"
CAN_END = r"\n|[;:][\x20\x09-\x0D]++"
# Words that every known sentence has one of; texts without any have no licence.
HINT = r"(?i)licen[sc]e|copyright|permi|redistribut|rights|software|program|public|documentation|advertising|neither|mpl|gnu"
# Any known sentence between two marks, its words on any lines.
KNOWN = (
    "(?<=[MC])(?:"
    + "|".join(
        s.replace(".", "[.]").replace("+", "[+]").replace(" ", "[ C]")
        for s in sorted({s for _, s in SENTENCES}, key=lambda s: (-len(s), s))
    )
    + ")(?=[MC])"
)


def marked(text: Column) -> Column:
    """Lower case, noise to single spaces, M and C where a sentence must and can end."""
    line = F.regexp_replace(F.regexp_replace(F.lower(text), MUST_END, "M"), CAN_END, "C")
    line = F.regexp_replace(F.concat(F.lit("M"), line, F.lit("M")), r"[^a-z0-9.+MC]+", " ")
    # No dots or spaces beside a mark, and one mark of several.
    line = F.regexp_replace(line, r"(?<![ .MC])[ .C]*+M[ .MC]*+", "M")
    return F.regexp_replace(line, r"(?<![ .C])[ .]*+C[ .C]*+", "C")


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for name, sentence in SENTENCES for x in (sentence, name)])
    found = F.when(
        text.rlike(HINT), F.regexp_extract_all(marked(text), F.lit(KNOWN), F.lit(0))
    ).otherwise(F.array().cast("array<string>"))
    return F.transform(found, lambda s: F.try_element_at(known, F.replace(s, F.lit("C"), F.lit(" "))))


def match_rules(ids: Column) -> Column:
    """Struct (licenses, rest): licences in the order of the rules, and what none took."""
    line = F.concat(F.lit("|"), F.array_join(F.transform(ids, lambda i: F.concat(i, F.lit("|"))), "|"))
    # Every identifier stands between bars of its own: |A||B||C|.
    state = F.struct(line.alias("line"), F.array().cast("array<string>").alias("found"))
    rules = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit("".join(f"|{i}|" for i in needs)).alias("needs"),
            )
            for name, needs in RULES
        ]
    )

    def step(a: Column, r: Column) -> Column:
        hit = F.contains(a["line"], r["needs"])
        return F.struct(
            F.when(hit, F.replace(a["line"], r["needs"], F.lit("||"))).otherwise(a["line"]).alias("line"),
            F.when(hit, F.array_append(a["found"], r["name"])).otherwise(a["found"]).alias("found"),
        )

    def end(a: Column) -> Column:
        left = F.array_remove(F.split(a["line"], r"\|+"), "")
        return F.struct(F.array_distinct(a["found"]).alias("licenses"), left.alias("rest"))

    return F.when(F.size(ids) > 0, F.aggregate(rules, state, step, end))


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: doc_id, sentences (identifiers in order), licenses, rest, n_licenses."""
    text = F.coalesce(named(text_col), F.lit(""))
    none = F.array().cast("array<string>")
    return (
        docs.select(named(id_col).alias("doc_id"), sentence_ids(text).alias("sentences"))
        .select("doc_id", "sentences", let(F.col("sentences"), match_rules).alias("found"))
        .select(
            "doc_id",
            "sentences",
            F.coalesce("found.licenses", none).alias("licenses"),
            F.coalesce("found.rest", none).alias("rest"),
            F.size(F.coalesce("found.licenses", none)).cast("long").alias("n_licenses"),
        )
    )
