"""Licence recognition by sentences and ordered rules, with DataFrame functions only.

A text's sentences are normalised and mapped to identifiers of known licence
sentences; rules are sequences of identifiers.  Rules are tried in their order,
and one that matches takes its sentences away from later ones.  Sentences and
rules are tables that a caller may replace (``Book``).
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences in their licences' wording, by identifier.
SENTENCES = {
    "ApacheLic": "Licensed under the Apache License, Version 2.0",
    "ApacheLicLong": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "ApacheCopy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "ApacheAsIs": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "ApacheSee": "See the License for the specific language governing permissions and limitations under the License.",
    "MITName": "The MIT License (MIT)",
    "MITReleased": "Released under the MIT License",
    "MITLicensed": "Licensed under the MIT License",
    "MITGrant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MITNotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MITAsIs": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "GPLWork3": "This work is licensed under the GNU General Public License, version 3",
    "GPLFree": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPLFree2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPLHope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPLSee": "See the GNU General Public License for more details.",
    "GPLReceived": "You should have received a copy of the GNU General Public License along with this program.",
    "BSDRedist": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSDSource": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSDBinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSDNames": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSDAsIs": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "MPLSubject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ISCGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CCByNc4": "Licensed under CC BY-NC 4.0",
    "CCBy4": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CCBySa4": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPLWork2": "This work is licensed under the GNU General Public License, version 2",
    "AGPLFree": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPLFree2": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPLFree3": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPLMade2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "EPLMade1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "ZlibAsIs": "This software is provided 'as-is', without any express or implied warranty.",
    "ZlibGrant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "UnlicenseFree": "This is free and unencumbered software released into the public domain.",
    "CC0Dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "BoostDistributed": "Distributed under the Boost Software License, Version 1.0.",
    "ISCOnly": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CCBySa3": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License",
    "CCBy3": "This work is licensed under a Creative Commons Attribution 3.0 Unported License",
    "CCByNcSa4": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CCByNd4": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "BSDLicensed": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "SpdxMIT": "SPDX-License-Identifier: MIT",
    "SpdxApache": "SPDX-License-Identifier: Apache-2.0",
    "AllRights": "All rights reserved",
}
#: Further SPDX identifiers, as tags name them.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only "
    "GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT-0 MPL-2.0 MS-PL MulanPSL-2.0 NCSA OFL-1.1 OSL-3.0 PostgreSQL Unlicense UPL-1.0 WTFPL Zlib"
).split()
SENTENCES |= {f"Spdx{x}": f"SPDX-License-Identifier: {x}" for x in SPDX}
#: Rules by priority; the identifiers have to follow each other among the known sentences.
RULES = (
    ("Apache-2.0", "ApacheLicLong ApacheCopy ApacheAsIs ApacheSee"),
    ("Apache-2.0", "ApacheLicLong"),
    ("Apache-2.0", "ApacheLic"),
    ("Apache-2.0", "SpdxApache"),
    ("MIT", "MITGrant MITNotice MITAsIs"),
    ("MIT", "MITName"),
    ("MIT", "MITReleased"),
    ("MIT", "MITLicensed"),
    ("MIT", "SpdxMIT"),
    ("GPL-3.0-or-later", "GPLFree GPLHope GPLSee GPLReceived"),
    ("GPL-3.0-or-later", "GPLFree"),
    ("GPL-2.0-or-later", "GPLFree2"),
    ("GPL-3.0-only", "GPLWork3"),
    ("BSD-3-Clause", "BSDRedist BSDSource BSDBinary BSDNames BSDAsIs"),
    ("BSD-2-Clause", "BSDRedist BSDSource BSDBinary BSDAsIs"),
    ("MPL-2.0", "MPLSubject"),
    ("ISC", "ISCGrant"),
    ("CC-BY-NC-4.0", "CCByNc4"),
    ("CC-BY-4.0", "CCBy4"),
    ("CC-BY-SA-4.0", "CCBySa4"),
    ("GPL-2.0-only", "GPLWork2"),
    ("AGPL-3.0-or-later", "AGPLFree"),
    ("LGPL-2.1-or-later", "LGPLFree2"),
    ("LGPL-3.0-or-later", "LGPLFree3"),
    ("EPL-2.0", "EPLMade2"),
    ("EPL-1.0", "EPLMade1"),
    ("Zlib", "ZlibAsIs ZlibGrant"),
    ("Unlicense", "UnlicenseFree"),
    ("CC0-1.0", "CC0Dedicated"),
    ("BSL-1.0", "BoostDistributed"),
    ("ISC", "ISCOnly"),
    ("CC-BY-SA-3.0", "CCBySa3"),
    ("CC-BY-3.0", "CCBy3"),
    ("CC-BY-NC-SA-4.0", "CCByNcSa4"),
    ("CC-BY-ND-4.0", "CCByNd4"),
    ("LicenseRef-BSD-style", "BSDLicensed"),
    *((x, f"Spdx{x}") for x in SPDX),
    ("LicenseRef-AllRightsReserved", "AllRights"),
)
#: Each known sentence has one of these, so texts without any need no further look.
HINT = "(?i)(licen|permission|warrant|redistribut|general public|rights reserved|used to endorse|free software|unencumbered|neighboring)"


def normal(text: str) -> str:
    """A sentence as Python sees it: lower-case words of ASCII letters and digits, parted by one blank."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())


class Book(NamedTuple):
    """Known sentences by identifier, rules by priority, and a pattern that each text with a known sentence has."""

    sentences: dict[str, str] = SENTENCES
    rules: tuple[tuple[str, str], ...] = RULES
    hint: str = HINT

    def known(self) -> dict[str, str]:
        """Identifiers by normalised sentence."""
        out = {normal(s): k for k, s in self.sentences.items()}
        if len(out) != len(self.sentences):
            raise ValueError("two known sentences are the same when normalised")
        return out

    def openings(self) -> str:
        """Each known sentence's first words, four or as many as no other known sentence has inside it."""
        out, known = set(), list(self.known())
        for s in known:
            words = s.split()
            n = min(4, len(words))
            while n < len(words) and any(" " + " ".join(words[:n]) + " " in f" {other} "[1:] for other in known):
                n += 1
            out.add("[^a-z0-9]+".join(words[:n]))
        return "|".join(sorted(out))

    def wrapped_end(self) -> str:
        """Sentences that go over line ends end at a stop, at the colon before conditions, at an empty line, and where a line opens with a known one."""
        return rf"(?i)(?<=[.!?]){INSIDE}\s+|(?<=conditions:)\s+|(?<=restrictions:)\s+|(?<=are met:)\s+|(?<! at)(?<! at\r)\n[ \t\r*#/;%-]*\n|\n[^a-z0-9\n]*(?=(?:{self.openings()})(?:[^a-z0-9]|$))"


KNOWN = Book().known()
#: Stops inside known sentences: ``v. 2.0``, ``License-Identifier: MIT``, ``"License"); you``, ``software: you``, ``Foundation; either``.
INSIDE = r"(?!(?<=[^a-z0-9]v[.])\s+[0-9])(?<!identifier:)(?!(?<=[:;])\s+(?:you (?:may not use|can redistribute)|either version))"
#: Sentences end at a line's end, or at a stop, colon or semicolon before white space.
SENTENCE_END = rf"(?i)(?<=[.!?:;]){INSIDE}\s+|\n"
WRAPPED_END = Book().wrapped_end()


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def identifiers(text: Column, ends: str, book: Book = Book()) -> Column:
    """Identifiers of a text's known sentences, in order."""
    known = F.from_json(F.lit(json.dumps(book.known())), "map<string,string>")
    return F.filter(F.transform(F.split(text, ends, -1), lambda s: F.try_element_at(known, _normal(s))), lambda k: k.isNotNull())


def _matched(ids: Column, book: Book) -> Column:
    """Names of the rules that match a sequence of identifiers."""
    rules = F.from_json(F.lit(json.dumps([{"name": n, "ids": f" {i} "} for n, i in book.rules])), "array<struct<name string, ids string>>")
    start = F.struct(F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" ")).alias("left"), F.array().cast("array<string>").alias("names"))

    def step(state: Column, rule: Column) -> Column:
        spread = F.replace(F.trim(rule.ids), F.lit(" "), F.lit("  "))
        sought = F.concat(F.lit(" "), spread, F.lit(" "))
        has = F.contains(state.left, sought)
        return F.struct(
            F.when(has, F.replace(state.left, sought, F.lit(" - "))).otherwise(state.left).alias("left"),
            F.when(has, F.array_append(state.names, rule["name"])).otherwise(state.names).alias("names"),
        )

    return F.aggregate(rules, start, step, lambda s: s.names)


def recognise(docs: DataFrame, *, book: Book = Book(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ``sentences`` (identifiers in order), ``licenses`` (names, sorted, each once).

    Sentences are looked for line by line, and again over line ends, as licence
    texts are often wrapped; a licence found in either way counts.  A text that is null
    or has no known sentence has empty arrays.  Rows are independent.
    """
    text = F.col("_text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(F.col(text_col).rlike(book.hint), F.col(text_col)).alias("_text"))
    none = F.array().cast("array<string>")
    both = rows.select("doc_id", F.coalesce(identifiers(text, SENTENCE_END, book), none).alias("by_line"), F.coalesce(identifiers(text, book.wrapped_end(), book), none).alias("wrapped"))
    names = F.array_sort(F.array_distinct(F.concat(_matched(F.col("by_line"), book), _matched(F.col("wrapped"), book))))
    return both.select("doc_id", F.when(F.size("by_line") >= F.size("wrapped"), F.col("by_line")).otherwise(F.col("wrapped")).alias("sentences"), names.alias("licenses"))
