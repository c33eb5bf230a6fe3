import re

from tickloom.llm import licences as op

#: The licence lines of the test tables.
LINES = {
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "Released under the MIT License.": "mit",
}


def test_finds_exactly_the_planted_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {r.doc_id: r for r in op.scan_licences(docs, op.train(docs)).collect()}
    wrong = 0
    for d in docs.collect():
        lines = d.text.split("\n")
        wanted = [(k, LINES[t]) for k, t in enumerate(lines) if t in LINES]
        found = [(int(x.split(":")[0]), x.split(":")[1]) for x in got[d.doc_id].found.split(";") if x]
        wrong += wanted != found
        assert got[d.doc_id].n_paragraphs == sum(bool(re.search(r"[^\x20\x09-\x0D]", t)) for t in lines)
    assert wrong <= 3


#: Wordings that no template holds, with their families, and prose.
WORDINGS = [
    ("This project is licensed under the MIT license - see LICENSE.md", "mit"),
    ("SPDX-License-Identifier: MIT", "mit"),
    ("MIT License", "mit"),
    ("The MIT License (MIT)", "mit"),
    ("Licensed under MIT", "mit"),
    ("code is made available under the terms of the Apache License 2.0", "apache-2.0"),
    ("Apache License\n Version 2.0, January 2004", "apache-2.0"),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
    ("you can use it under Apache 2.0", "apache-2.0"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("GPLv3 or later, see COPYING", "gpl"),
    ("Distributed under GNU GPL v3.", "gpl"),
    ("License: GPL version 2", "gpl"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("Released under the ISC license by its authors", "isc"),
    ("This Source Code Form is subject to the terms of the\nMozilla Public License, v. 2.0. If a copy of the MPL was not\ndistributed with this file, You can obtain one", "mpl-2.0"),
    ("Our code uses the Mozilla Public License 2.0", "mpl-2.0"),
    ("Images are shared under a Creative Commons Attribution 4.0 licence", "cc-by"),
    ("Text available as CC BY 4.0", "cc-by"),
    ("figures: CC BY-NC 4.0, by the museum", "cc-by-nc"),
    ("under a Creative Commons Attribution-NonCommercial 4.0 license", "cc-by-nc"),
    ("Use of this source code is governed by a BSD-style license", "bsd"),
    ("Released under the 3-clause BSD license", "bsd"),
    ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer", "bsd"),
    ("SPDX-License-Identifier: BSD-2-Clause", "bsd")]
PROSE = [
    "the driving license is valid in version 2.0 of the app", "He studied at MIT and worked under contract", "a license to kill", "general public transport version 3 timetable", "permission is hereby requested from the parents", "The public got a copy of the file at once", "creative people in commons rooms gave attribution", "the Apache tribe lived here", "you may not use this door except in an emergency", "software is provided to schools without charge", "this list of conditions is long", "terms of the public debate", "copyright notice: all rights reserved by the author", "the above notice appears in all rooms", "free of charge, to any person over 60", "any later version of the story", "Mozilla published a report", "licensed under state law", "BSD is a unix family", "4.0 international students"]


def plain_classifier():
    return op.Classifier().fit([([], k, max(k // 3, 0)) for k in range(3, 60)] * 10)


def test_unseen_wordings_and_what_the_classifier_adds():
    """Precision and recall with the classifier, and with template comparison alone."""
    c = plain_classifier()
    families = lambda t: {op.FAMILIES[f] for _, f, _, _ in c.scan(t)[1]}
    hits = sum(families(t) == {f} for t, f in WORDINGS)
    false = sum(bool(families(t)) for t in PROSE)
    assert hits >= 20 and false <= 3
    alone = 0
    for t in PROSE:
        x = c.features([t])
        alone += c.best_likeness(x.of(0), int(x.two[0])) >= op.ALIKE
    assert alone > 2 * false


def test_variants_unknown_and_confirmation():
    c = plain_classifier()
    n, found = c.scan("Intro text\n\nlicensed under the APACHE license version 2.0 (see below)\nsome general public tram of nothing\nThe software department is provided with tea")
    assert n == 4 and [(k, op.FAMILIES[f]) for k, f, _, _ in found] == [(2, "apache-2.0")]
    full = " ".join(op.TEMPLATES["mit"])
    assert [op.FAMILIES[f] for _, f, _, _ in c.scan("x " * 100_000 + "\n" + full)[1]] == ["mit"]
    assert c.scan("") == (0, [])


def test_wrapped_notices_are_one_paragraph():
    c = plain_classifier()
    text = "Something else.\n\nRedistribution and use in\nsource and binary\nforms with or without\nmodification are permitted\n\nThe end."
    n, found = c.scan(text)
    assert n == 6 and [(k, op.FAMILIES[f]) for k, f, _, _ in found] == [(2, "bsd")] or {op.FAMILIES[f] for _, f, _, _ in found} == {"bsd"}


def test_batches_give_what_single_texts_give():
    c = plain_classifier()
    texts = [t for t, _ in WORDINGS] + PROSE + ["", "\n\n", "\nMIT License\n", "a\nb\n\nc"]
    got = c.scan_batch([t.encode() for t in texts])
    assert [(n, [x[:2] for x in f]) for n, f in got] == [(n, [x[:2] for x in f]) for n, f in map(c.scan, texts)]


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 3), (None, "Released under the MIT License.", 3)], "doc_id long, text string, found int")
    got = {r.doc_id: r for r in op.scan_licences(df, op.train(df)).collect()}
    assert got[1].n_paragraphs == 0 and got[None].families == "mit"
    assert op.scan_licences(df.limit(0), op.train(df.limit(0))).count() == 0
