"""License scan with a positional rare-token index.

The document frequency of every word that occurs in a license template is counted over all documents. Each template is
indexed by its words of highest inverse document frequency, with their positions. A document looks up its
words in the index; a posting at template position p met at document position q votes for the template
beginning at q - p. Votes for nearly the same beginning are joined, and where enough of a template's weight
has voted, the template's mandatory key phrases must follow each other word for word in that stretch.

A license is known by its notice, by short forms of it, and by its SPDX identifier behind ``SPDX-License-Identifier:``.

Defined results: words are runs of letters and digits, case ignored; null and empty texts match nothing; texts of any length
are scanned whole; of matches that overlap the one that covers most words stays; a license found twice in a text is
reported twice; repeated rows are reported again; other columns are ignored; no documents give no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ALNUM, ID, TEXT, chunks, flat, narrow, tokens

ANCHORS = 12
SLACK = 3
SHARE = 0.6

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


@dataclass(frozen=True)
class Template:
    license: str
    text: str
    phrases: tuple[str, ...]


def _templates() -> list[Template]:
    t = [
        Template("MIT", _MIT, ("permission is hereby granted free of charge", "to deal in the software without restriction")),
        Template("MIT", "Released under the MIT License", ("mit license",)),
        Template("MIT", "Licensed under the MIT License", ("mit license",)),
        Template("MIT", "This project is licensed under the terms of the MIT license", ("mit license",)),
        Template("Apache-2.0", _APACHE, ("apache license version 2 0", "except in compliance with the license")),
        Template("Apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
        Template("Apache-2.0", "Released under the Apache License 2.0", ("apache license 2 0",)),
        Template("BSD-2-Clause", _BSD, ("redistribution and use in source and binary forms", "must retain the above copyright notice")),
        Template("BSD-3-Clause", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("redistribution and use in source and binary forms", "may be used to endorse or promote products")),
        Template("BSD-3-Clause", "Licensed under the BSD 3-Clause License", ("bsd 3 clause",)),
        Template("BSD-2-Clause", "Licensed under the BSD 2-Clause License", ("bsd 2 clause",)),
        Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("for any purpose with or without fee",)),
        Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("mozilla public license v 2 0",)),
        Template("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0", ("mozilla public license version 2 0",)),
        Template("Unlicense", "This is free and unencumbered software released into the public domain.", ("free and unencumbered software",)),
        Template("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ("has waived all copyright and related or neighboring rights",)),
        Template("CC0-1.0", "Licensed under CC0 1.0", ("cc0 1 0",)),
        Template("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", ("provided as is", "in no event will the authors be held liable")),
    ]
    for v in ("2", "3"):
        for name, long in (("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"), ("AGPL", "GNU Affero General Public License")):
            if (name, v) == ("AGPL", "2"):
                continue
            ident, key = f"{name}-{v}.0", long.lower()
            t.append(Template(ident, _GPL.replace("GNU General Public License", long).format(v), (key, f"version {v} of the license")))
            for lead in ("This work is licensed under the", "Licensed under the", "Released under the"):
                t.append(Template(ident, f"{lead} {long}, version {v}", (f"{key} version {v}",)))
    for code, long in _CC.items():
        words = code.lower().replace("-", " ")
        t.append(Template(f"CC-{code}-4.0", f"Licensed under CC {code} 4.0", (f"cc {words} 4 0",)))
        full = "creative commons " + long.lower().replace("-", " ").replace("sharealike", "sharealike") + " 4 0 international"
        t.append(Template(f"CC-{code}-4.0", f"This work is licensed under a Creative Commons {long} 4.0 International License", (full,)))
    for ident, name in (("ISC", "ISC License"), ("Zlib", "zlib License"), ("Unlicense", "Unlicense")):
        key = name.lower()
        for lead in ("Licensed under the", "Released under the", "This project is licensed under the terms of the"):
            t.append(Template(ident, f"{lead} {name}", (f"the {key}",)))
    # a file may say no more than the identifier
    for ident in dict.fromkeys(x.license for x in t):
        tag = " ".join(re.findall("[a-z0-9]+", ident.lower()))
        t.append(Template(ident, f"SPDX-License-Identifier: {ident}", (f"spdx license identifier {tag}",)))
    return t


TEMPLATES = _templates()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _tokens(values: np.ndarray, offsets: np.ndarray):
    return tokens(_FOLD[values], offsets, ALNUM)


def _words(s: str) -> np.ndarray:
    return _tokens(*flat(pa.array([s])))[0]


def vocabulary(templates: list[Template] = TEMPLATES) -> np.ndarray:
    """Hashes of all template words, sorted."""
    return np.unique(np.concatenate([_words(t.text) for t in templates]))


def frequencies(docs: DataFrame, vocab: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each word occurs, and how many documents there are."""

    def run(batches):
        df, n = np.zeros(len(vocab), np.int64), 0
        for b in batches:
            n += b.num_rows
            for i, j in chunks(b.column(0)):
                h, first, _, _ = _tokens(*flat(b.column(0).slice(i, j - i)))
                at = np.searchsorted(vocab, h).clip(max=len(vocab) - 1)
                hit = np.flatnonzero(vocab[at] == h)
                doc = np.searchsorted(first, hit, "right") - 1
                df += np.bincount(np.unique(doc * len(vocab) + at[hit]) % len(vocab), minlength=len(vocab))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(vocab)), -1)), pa.array(np.append(df, n))], names=["w", "n"])

    rows = narrow(docs, id_col, text_col).select(TEXT).mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    got = {r["w"]: r["n"] for r in rows}
    return np.array([got.get(i, 0) for i in range(len(vocab))], float), got.get(-1, 0)


@dataclass
class Index:
    """Postings (word, template, position, weight) sorted by word."""

    word: np.ndarray
    template: np.ndarray
    position: np.ndarray
    weight: np.ndarray
    total: np.ndarray
    length: np.ndarray
    phrases: list[list[np.ndarray]]


def build(vocab: np.ndarray, df: np.ndarray, n: int, templates: list[Template] = TEMPLATES, anchors: int = ANCHORS) -> Index:
    """Index each template by its ``anchors`` words of highest inverse document frequency."""
    idf = np.log((n + 1) / (df + 1)) + 1e-3
    rows, total, length = [], [], []
    for t, x in enumerate(templates):
        h = _words(x.text)
        w = np.unique(h)
        weight = idf[np.searchsorted(vocab, w)]
        best = np.lexsort((w, -weight))[:anchors]
        total.append(weight[best].sum())
        length.append(len(h))
        for k in best:
            rows += [(w[k], t, p, weight[k]) for p in np.flatnonzero(h == w[k])]
    rows.sort(key=lambda r: (int(r[0]), r[1], r[2]))
    word, temp, pos, wt = zip(*rows)
    return Index(np.array(word, np.uint64), np.array(temp), np.array(pos), np.array(wt), np.array(total), np.array(length), [[_words(p) for p in x.phrases] for x in templates])


def _within(h: np.ndarray, phrase: np.ndarray) -> bool:
    m = len(h) - len(phrase) + 1
    if m < 1:
        return False
    ok = h[:m] == phrase[0]
    for j in range(1, len(phrase)):
        ok &= h[j : j + m] == phrase[j]
    return bool(ok.any())


def scan(texts: pa.Array, ix: Index, share: float = SHARE) -> list[tuple[int, int, int, int, float]]:
    """(row, template, start word, end word, share of the weight that voted) of all matches in the texts."""
    out = []
    for i0, j0 in chunks(texts):
        h, first, _, _ = _tokens(*flat(texts.slice(i0, j0 - i0)))
        lo, hi = np.searchsorted(ix.word, h, "left"), np.searchsorted(ix.word, h, "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            continue
        many = hi[hit] - lo[hit]
        at = np.repeat(hit, many)
        post = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[hit], many)
        doc = np.searchsorted(first, at, "right") - 1
        begin = at - ix.position[post]  # where the template would begin, counted over the whole slice
        order = np.lexsort((begin, ix.template[post], doc))
        doc, begin, post = doc[order], begin[order], post[order]
        temp = ix.template[post]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (temp[1:] != temp[:-1]) | (begin[1:] - begin[:-1] > SLACK)
        group = np.cumsum(new) - 1
        # each word of a template votes once in a group
        key = np.lexsort((ix.word[post], group))
        g, w = group[key], ix.word[post][key]
        once = np.ones(len(g), bool)
        once[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
        votes = np.bincount(g[once], ix.weight[post][key][once], minlength=group[-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(doc)) - 1
        good = np.flatnonzero(votes >= share * ix.total[temp[head]])
        found: dict[int, list] = {}
        for k in good:
            d, t = int(doc[head[k]]), int(temp[head[k]])
            s = max(int(begin[head[k]]), int(first[d]))
            e = min(int(begin[tail[k]]) + int(ix.length[t]), int(first[d + 1]))
            a, z = max(s - SLACK, int(first[d])), min(e + SLACK, int(first[d + 1]))
            if all(_within(h[a:z], p) for p in ix.phrases[t]):
                share_ = float(votes[k] / ix.total[t])
                found.setdefault(d, []).append((-share_ * ix.length[t], s - int(first[d]), e - int(first[d]), t, share_))
        for d, ms in found.items():
            kept: list = []
            for v, s, e, t, sh in sorted(ms):
                if all(e <= x[1] or s >= x[2] for x in kept):
                    kept.append((v, s, e, t, sh))
            out += [(i0 + d, t, s, e, sh) for _, s, e, t, sh in kept]
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, templates: list[Template] | None = None) -> DataFrame:
    """One row per license found: (doc_id, license, start_word, end_word, votes)."""
    templates = TEMPLATES if templates is None else templates
    vocab = vocabulary(templates)
    ix = build(vocab, *frequencies(docs, vocab, id_col, text_col), templates)

    def run(batches):
        for b in batches:
            rows = sorted(scan(b.column(1), ix, share), key=lambda r: (r[0], r[2]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([templates[r[1]].license for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32()), pa.array([round(r[4], 4) for r in rows], pa.float64())],
                names=["doc_id", "license", "start_word", "end_word", "votes"],
            )

    return narrow(docs, id_col, text_col).select(ID, TEXT).mapInArrow(run, "doc_id long, license string, start_word int, end_word int, votes double")
