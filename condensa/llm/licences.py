"""Licence recognition by sentence rules (native DataFrame operators only).

Method: a text is cut into sentences (at sentence punctuation before white space, and at line
ends), which are normalised: lower case, letters, digits and inner full stops only. Known licence
sentences map to identifiers; blank pieces are dropped. A known sentence may be wrapped
at any of its words, the longest match at a place counts. The identifiers in text order are then matched against
the licence rules in their order: a rule is a sequence of identifiers that follow each other
among the recognised sentences; what it matches is taken out before the next rule is tried, so
long, specific rules come first. Identifiers that no rule takes make the text "unknown".

Every known sentence holds one of KEYWORDS (checked when the module is loaded), so a text without any
has no known sentence and is not cut up. All work is done in the document's own row: no shuffle, no
group, no skew.

A null text is an empty one: no licence. Repeated rows and ids are rows of their own; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS

MAX_LINES = 12  # of the SQL twin only; the operator has no such bound
CUT = rf"([.!?;:])[{SPACE_CLASS}]"
KEYWORDS = ("licen", "rights", "permission", "warrant", "redistribut", "copyright", "public domain", "free software", "either version")

# Known licence sentences, by identifier.
SENTENCES = {
    "mit-name": ["Released under the MIT License", "This project is licensed under the MIT License", "Licensed under the MIT License",
                 "This software is released under the MIT License", "The MIT License", "MIT License", "The MIT License (MIT)"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
                  "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
                  "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
                  "subject to the following conditions"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
                  "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "mit-liable": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
                   "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
                  "the above copyright notice and this permission notice appear in all copies"],
    "apache2-name": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "Apache License, Version 2.0",
                     "Released under the Apache License, Version 2.0"],
    "apache2-comply": ["you may not use this file except in compliance with the License"],
    "apache2-copy": ["You may obtain a copy of the License at"],
    "apache2-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                      "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache2-see": ["See the License for the specific language governing permissions and limitations under the License"],
    "gpl2-name": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2"],
    "gpl3-name": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3"],
    "lgpl3-name": ["Licensed under the GNU Lesser General Public License, version 3", "This work is licensed under the GNU Lesser General Public License, version 3"],
    "agpl3-name": ["Licensed under the GNU Affero General Public License, version 3", "This work is licensed under the GNU Affero General Public License, version 3"],
    "gpl-free": ["This program is free software"],
    "gpl2-later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "gpl2-option": ["either version 2 of the License, or (at your option) any later version", "either version 2, or (at your option) any later version"],
    "gpl3-later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
                   "either version 3 of the License, or (at your option) any later version"],
    "gpl-no-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "gpl-details": ["See the GNU General Public License for more details"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
                   "documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
                    "software without specific prior written permission"],
    "mpl2-name": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"],
    "cc-by-4": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-4": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd-4": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc0": ["Released under CC0 1.0 public domain dedication", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "reserved": ["All rights reserved"],
}

# Licence rules, in the order in which they are tried.
RULES = (
    ("MIT", ("mit-name", "mit-grant", "mit-notice", "mit-as-is", "mit-liable")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liable")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant", "mit-as-is")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache2-name", "apache2-comply", "apache2-copy", "apache2-as-is", "apache2-see")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-later", "gpl-no-warranty", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-later", "gpl2-option", "gpl-no-warranty", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-later")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-later", "gpl2-option")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-name",)),
    ("Apache-2.0", ("apache2-name",)),
    ("GPL-2.0-only", ("gpl2-name",)),
    ("GPL-3.0-only", ("gpl3-name",)),
    ("LGPL-3.0-only", ("lgpl3-name",)),
    ("AGPL-3.0-only", ("agpl3-name",)),
    ("MPL-2.0", ("mpl2-name",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("All-rights-reserved", ("reserved",)),
)


def normalised(sentence: str) -> str:
    """As ``_normalise`` does with a column."""
    return re.sub("^[ .]+|[ .]+$", "", re.sub("[^a-z0-9.]+", " ", sentence.lower()))


def as_found(sentence: str) -> str:
    """A known sentence as the pieces of a text give it: cut, normalised, joined."""
    pieces = map(normalised, re.sub(CUT, r"\1\n", sentence).split("\n"))
    return " ".join(p for p in pieces if p)


KNOWN = {normalised(s): i for i, some in SENTENCES.items() for s in some}
# what texts are compared with: a full stop inside ("v. 2.0") is a cut if white space follows, else it stays
KEYS = KNOWN | {as_found(s): i for i, some in SENTENCES.items() for s in some}
if not all(any(k in s for k in KEYWORDS) for s in KEYS):
    raise ValueError("a known sentence has no keyword")


def _normalise(sentence: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(sentence), "[^a-z0-9.]+", " "), "^[ .]+|[ .]+$", "")


def sentence_ids(text: Column) -> Column:
    """array<string>: identifiers of the known sentences of a text, in its order."""
    pieces = F.transform(F.split(F.regexp_replace(text, CUT, "$1\n"), "\n"), _normalise)
    lines = F.array_join(F.filter(pieces, lambda s: s != ""), "\n")
    # at every line's begin the longest known sentence that ends at a line's end, wherever it is wrapped
    longest_first = "|".join(re.escape(s).replace("\\ ", "[ \n]") for s in sorted(KEYS, key=lambda s: (-len(s), s)))
    found = F.regexp_extract_all(lines, F.lit(f"(?m)^(?=({longest_first})$)"), F.lit(1))
    known = F.create_map(*[F.lit(x) for pair in KEYS.items() for x in pair])
    ids = F.transform(found, lambda s: F.element_at(known, F.translate(s, "\n", " ")))
    likely = F.lower(text).rlike("|".join(k.replace(" ", "[^a-z0-9]+") for k in KEYWORDS))  # a keyword of two words may be wrapped, too
    return F.when(likely, ids).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id, sentences (array of identifiers), licences (array of names in the order of the
    rules, each once), n_unknown (recognised sentences that no rule takes)."""
    found = docs.select(F.col(row_id).alias("row_id"), sentence_ids(F.coalesce(F.col(text), F.lit(""))).alias("sentences"))
    left = F.concat(F.lit("|"), F.array_join("sentences", "||"), F.lit("|"))
    steps = found.withColumn("left_0", F.when(F.size("sentences") > 0, left).otherwise(F.lit("")))
    names = []
    for n, (name, ids) in enumerate(RULES):
        pattern = "".join(f"|{i}|" for i in ids)
        rest = F.replace(F.col(f"left_{n}"), F.lit(pattern), F.lit(""))
        steps = steps.withColumn(f"left_{n + 1}", rest)
        names.append(F.when(F.col(f"left_{n + 1}") != F.col(f"left_{n}"), F.lit(name)))
    licences = F.array_distinct(F.filter(F.array(*names), lambda x: x.isNotNull()))
    last = F.col(f"left_{len(RULES)}")
    unknown = F.floor((F.length(last) - F.length(F.replace(last, F.lit("|"), F.lit("")))) / 2).cast("long")
    return steps.select(F.col("row_id").alias(row_id), "sentences", licences.alias("licences"), unknown.alias("n_unknown"))
