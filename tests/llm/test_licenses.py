import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import licenses as L

from .fixtures import awkward, empty


@pytest.fixture(scope="module")
def index():
    v = L.vocabulary()
    return L.build(v, np.zeros(len(v)), 1000)


def found(index, *texts):
    return [(r, L.TEMPLATES[t].license) for r, t, *_ in sorted(L.scan(pa.array(texts), index), key=lambda x: (x[0], x[2]))]


def test_every_template_is_found(index):
    noise = "Some words of the code and then the text of it.\n"
    for t in L.TEMPLATES:
        assert (0, t.license) in found(index, noise + t.text.upper().replace(" ", "\n * ") + "\n" + noise), t.text


def test_key_phrases_are_mandatory(index):
    assert found(index, "Licensed under the Apache License, Version 3.0.") == []
    assert found(index, "license version under the apache 2 0 licensed") == []
    assert found(index, "It is licensed and released under the", "GNU", None, "") == []
    gpl = next(t for t in L.TEMPLATES if t.license == "GPL-3.0" and "free software" in t.text)
    assert found(index, gpl.text) == [(0, "GPL-3.0")]
    assert found(index, gpl.text.replace("version 3", "version 2")) == [(0, "GPL-2.0")]


def test_two_in_one_text(index):
    t = "Released under the MIT License.\n" + "code " * 500 + "Licensed under CC BY-NC 4.0. Released under the MIT License"
    assert found(index, t) == [(0, "MIT"), (0, "CC-BY-NC-4.0"), (0, "MIT")]


def test_documents(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    want: Counter = Counter()
    for r in docs.collect():
        low = re.sub("[^a-z0-9]+", " ", r.text.lower())
        for name, p in (("Apache-2.0", "licensed under the apache license version 2 0"), ("MIT", "released under the mit license"), ("GPL-3.0", "licensed under the gnu general public license version 3"), ("CC-BY-NC-4.0", "licensed under cc by nc 4 0")):
            want[r.doc_id, name] += low.count(p)
    got = Counter((r.doc_id, r.license) for r in L.find(docs).collect())
    assert got == +want


def test_frequencies(spark):
    d = spark.createDataFrame([(1, "MIT mit license"), (2, None), (3, "License"), (3, "License")], "doc_id long, text string").repartition(2)
    v = np.sort(np.concatenate([L._words("mit"), L._words("license")]))
    df, n = L.frequencies(d, v)
    assert n == 4 and dict(zip(v.tolist(), df.tolist())) == {int(L._words("mit")[0]): 1, int(L._words("license")[0]): 3}


def test_awkward(spark):
    assert L.find(awkward(spark)).count() == 0 and L.find(empty(spark)).count() == 0


def test_identifiers_and_short_forms(index):
    assert found(index, "# SPDX-License-Identifier: MIT\nint main() {}", "/* SPDX-License-Identifier: BSD-3-Clause */", "SPDX-License-Identifier: CC-BY-NC-SA-4.0", "spdx-license-identifier: other", "Released under the ISC License.", "Licensed under the Unlicense") == [(0, "MIT"), (1, "BSD-3-Clause"), (2, "CC-BY-NC-SA-4.0"), (4, "ISC"), (5, "Unlicense")]


@pytest.mark.parametrize("edit", ["line", "word", "case"])
def test_files_with_edited_notices(index, edit):
    """Every notice within a file of code, with line prefixes, a word more, or in capitals."""
    for t in L.TEMPLATES:
        text = {"line": "\n" + re.sub(r"(\S+ \S+ \S+) ", r"\1\n// ", t.text), "word": " " + t.text + " indeed", "case": " " + t.text.upper()}[edit]
        code = "def f(x):\n    return x + 1\n" * 40
        assert [x for x in found(index, code + text + "\n" + code) if x[1] == t.license], t.text
