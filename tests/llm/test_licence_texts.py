"""Licence scans on the licences' own wording, on one line and wrapped."""

import re
import textwrap

from test_operators_llm import docs_of

from parley.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = BSD2 + "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
GPL = """This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{1} either version {2} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0'
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
TEXTS = {
    "MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "GPL-3.0-or-later": GPL.format(":", ",", 3), "GPL-2.0-or-later": GPL.format(";", ";", 2),
    "Apache-2.0": APACHE, "ISC": ISC, "MPL-2.0": MPL, "Unlicense": "This is free and unencumbered software released into the public domain.",
    "LicenseRef-all-rights-reserved": "All-rights  reserved.",
}


def test_own_texts_of_licences(spark):
    texts, want = [], []
    for name, text in TEXTS.items():
        wrapped = ["\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n")) for width in (60, 72, 80)]
        for t in (text, *wrapped, re.sub("(?m)^", " * ", wrapped[1]), "Some words\n" + wrapped[2]):
            texts.append(t)
            want.append(name)
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_every_sentence_is_found_wrapped(spark):
    known = licenses.SENTENCES | licenses.CANONICAL
    texts = ["Words.\n" + textwrap.fill(s, 50) + "\nwords" for s in known]
    got = {r.doc_id: r.sentence_ids for r in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == list(known.values())
    assert all(s == re.sub("[^a-z0-9]+", " ", s).strip() and re.search(licenses.HINT, s) and re.search(licenses.HINT, s.replace(" ", "||")) for s in known)


def test_hint_loses_nothing(spark, monkeypatch):
    known = list(licenses.SENTENCES | licenses.CANONICAL)
    texts = ["All  rights reserved.", "all-rights reserved", "ALL\nRIGHTS: reserved!", "x. " + "; ".join(known), *TEXTS.values(), *(f"\u212a {k.title().replace(' ', '_ ')}\u0130" for k in known)]
    texts += [k.replace(" ", "\n", 3).replace(" ", " \t-", 5).upper() for k in known]
    run = lambda: [tuple(r) for r in licenses.scan_licenses(docs_of(spark, texts)).orderBy("doc_id").collect()]
    with_hint = run()
    assert all(re.search(licenses.WORDS, k) for k in known)
    monkeypatch.setattr(licenses, "HINT", "")
    monkeypatch.setattr(licenses, "WORDS", "")
    assert run() == with_hint
    assert [r[2] for r in with_hint[:3]] == ["reserved.notice"] * 3


def test_sql_finds_the_same(spark):
    import duckdb

    from parley.llm.oracles import licenses_sql

    texts = [w for t in TEXTS.values() for w in (t, textwrap.fill(t, 60), textwrap.indent(textwrap.fill(t, 72), "# "))] + [None, "", "all-rights  reserved"]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = [tuple(r) for r in licenses.scan_licenses(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert db.execute(licenses_sql() + " ORDER BY doc_id").fetchall() == got
