import os

import pytest

from tagtide.llm.licenses import TEXTS, scan


def test_equivalent_texts_match(make_docs):
    mit = dict(TEXTS)["MIT"]
    british = "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENCE").replace('"', "“") + "\n© 2021 Other. All rights reserved."
    rows = [(1, mit), (2, british), (3, mit + " more"), (4, None), (5, ""), (6, "Copyright 2020 A"), (7, "x\n  Released under the MIT licence \nLicensed under CC BY-NC 4.0."), (8, mit), (8, mit), (None, mit), (9, "y" * 1_000_000)]
    got = {}
    for r in scan(make_docs(rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], r["notices"]))
    assert got[1] == got[2] == [("MIT", "")] and got[3] == [(None, "")]
    assert got[4] == got[5] == got[6] == got[9] == [(None, "")]
    assert got[7] == [(None, "CC-BY-NC-4.0,MIT")]
    assert got[8] == [("MIT", "")] * 2 and got[None] == [("MIT", "")]


def test_null_and_empty_digests(spark, make_docs):
    rows = {r["doc_id"]: r["digest"] for r in scan(make_docs([(1, None), (2, ""), (3, "Copyright 2020 A")])).collect()}
    assert rows[1] is None and rows[2] == rows[3]
    assert scan(make_docs([])).collect() == []


def test_texts_are_told_apart(spark):
    names = [n for n, _ in TEXTS]
    docs = spark.createDataFrame(list(enumerate(t for _, t in TEXTS)), "doc_id long, text string")
    assert {r["doc_id"]: r["license"] for r in scan(docs).collect()} == dict(enumerate(names))


UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>
"""
COMMON = "/usr/share/common-licenses"
FILES = {"Apache-2.0": "Apache-2.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3"}


def test_whole_texts_by_digest(make_docs):
    rows = [(1, UNLICENSE), (2, UNLICENSE.upper().replace(" ", "  ")), (3, UNLICENSE + "and more")]
    assert {r["doc_id"]: r["license"] for r in scan(make_docs(rows)).collect()} == {1: "Unlicense", 2: "Unlicense", 3: None}


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no licence texts on this machine")
def test_long_licences_by_digest(spark):
    rows, want = [], {}
    for i, (file, name) in enumerate(FILES.items()):
        text = open(f"{COMMON}/{file}", encoding="utf-8").read()
        for j, t in enumerate([text, text.split("END OF TERMS AND CONDITIONS")[0] if "GPL" in file or "Apache" in file else text, text + " and more"]):
            rows.append((10 * i + j, t))
            want[10 * i + j] = name if j < 2 else None
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["license"] for r in scan(docs).collect()} == want


def test_callers_notices(make_docs):
    rows = [(1, "text\nSome rights reserved by X.\nmore"), (2, "some   RIGHTS reserved; by x"), (3, "Some rights"), (4, ""), (5, "\n"), (6, "Licenced &\nlicenced & free"), (7, None)]
    got = {r["doc_id"]: r["notices"] for r in scan(make_docs(rows), notices=[("X", "Some rights reserved by X"), ("Y", "License and"), ("Z", " - "), ("F", "Licensed and free")]).collect()}
    assert got == {1: "X", 2: "X", 3: "", 4: "", 5: "", 6: "F", 7: ""}
    assert {r["notices"] for r in scan(make_docs(rows), notices=[]).collect()} == {""}
