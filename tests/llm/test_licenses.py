import random
import re
import textwrap

from palimpsest.llm import licenses
from palimpsest.llm.licenses import HINT, KNOWN, RULES, SENTENCES, normal, recognise

from .helpers import SCHEMA, awkward


def brute(text):
    found = []
    for ends in (licenses.SENTENCE_END, licenses.WRAPPED_END):
        ids = [KNOWN[normal(s)] for s in re.split(ends, text or "") if normal(s) in KNOWN]
        found.append(ids)
    names = set()
    for ids in found:
        left = list(ids)
        for name, rule in RULES:
            rule = rule.split()
            i = 0
            while i + len(rule) <= len(left):
                if left[i : i + len(rule)] == rule:
                    names.add(name)
                    left[i : i + len(rule)] = ["-"]
                i += 1
    return (found[0] if len(found[0]) >= len(found[1]) else found[1]), sorted(names)


def test_each_known_sentence_passes_the_hint_and_has_a_rule():
    assert all(re.search(HINT, s) for s in SENTENCES.values())
    used = {i for _, r in RULES for i in r.split()}
    assert used == set(SENTENCES)


def test_texts_match_brute_force(spark):
    rng = random.Random(2)
    rows = awkward(rng)
    names = list(SENTENCES)
    apache = "\n".join(SENTENCES[k] for k in ("ApacheLicLong", "ApacheCopy", "ApacheAsIs", "ApacheSee"))
    mit = " ".join(SENTENCES[k] for k in ("MITGrant", "MITNotice", "MITAsIs"))
    wrapped = re.sub(r"(.{50}\S*) ", r"\1\n", mit)
    texts = [apache, mit, wrapped, "foo bar\nLicensed under CC BY-NC 4.0.\nAll rights reserved.", "RELEASED under the  MIT license!", "license", SENTENCES["BSDRedist"] + "\n* " + SENTENCES["BSDSource"]]
    for _ in range(60):
        parts = [rng.choice([SENTENCES[rng.choice(names)], "some words here."]) for _ in range(rng.randrange(6))]
        texts.append(rng.choice(["\n", " ", "\n\n"]).join(parts))
    rows += [(2000 + i, t, None, None, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as licenses", "2 as sentences", "3 as _text")
    want = sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    assert sorted(((r.doc_id, r.sentences, r.licenses) for r in recognise(docs).collect()), key=str) == want
    assert recognise(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_rule_fires_on_its_own_text(spark):
    """Plain, line by line, wrapped at 70 columns, as a comment, and after a line without a stop."""
    rows, want = [], {}
    for name, rule in RULES:
        sentences = [SENTENCES[k] for k in rule.split()]
        lines = "\n".join(sentences)
        wrapped = "\n\n".join(textwrap.fill(s, 70) for s in sentences)
        tight = "\n".join(textwrap.fill(s, 70) for s in sentences)
        head = "Copyright (c) 2020 Foo Bar\n"
        comment = "\n".join(f" * {x}" for x in wrapped.split("\n"))
        for text in (lines, wrapped, tight, comment, head + lines, head + wrapped, head + tight, head + "\n" + tight, " * " + head + comment, tight + "\n\nint main() { }", lines + "\nint main() { }"):
            want[len(rows)] = name, text
            rows.append((len(rows), text, None, None, None))
        if all(s.endswith((".", ":")) for s in sentences):
            want[len(rows)] = name, " ".join(sentences)
            rows.append((len(rows), " ".join(sentences), None, None, None))
    found = {r.doc_id: r.licenses for r in recognise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(n, t) for i, (n, t) in want.items() if found[i] != [n]] == []


def test_usual_headers_are_found(spark):
    apache = """Copyright 2020 Foo

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
    mpl = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
    parts = ("BSDRedist", "BSDSource", "BSDBinary", "BSDNames", "BSDAsIs")
    red, *conditions, as_is = (textwrap.fill(SENTENCES[k], 70) for k in parts)
    bsd = "Copyright (c) 2020, Foo\nAll rights reserved.\n\n" + red + "\n\n" + "\n".join(f"{i}. {c}" for i, c in enumerate(conditions, 1)) + "\n\n" + as_is
    rows = [(i, t, None, None, None) for i, t in enumerate([apache, mpl, bsd])]
    found = {r.doc_id: (r.sentences, r.licenses) for r in recognise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[0] == (["ApacheLicLong", "ApacheCopy", "ApacheAsIs", "ApacheSee"], ["Apache-2.0"])
    assert found[1] == (["MPLSubject"], ["MPL-2.0"])
    assert found[2] == (["AllRights", *parts], ["BSD-3-Clause", "LicenseRef-AllRightsReserved"])
