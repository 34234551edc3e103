"""Licence scan: a trained paragraph classifier with an unknown class, confirmed by comparison with templates.

A paragraph is a line, or a run of lines without a blank one between them, as wrapped notices are. It becomes a sparse
vector of word 1- and 2-grams that occur in the templates. A multinomial logistic regression tells families apart, and
from an unknown class that is trained on a bounded sample of corpus paragraphs (a documented parameter) and on sentences
that talk about licences. A temperature, fitted on templates that a first model doesn't see, calibrates the probabilities;
below CERTAIN the class is unknown. A prediction counts only if a template of that family confirms it: at least SIMILAR of
the template's five-word shingles (of the whole sequence, for a shorter one, in order) are in the paragraph, or of the
paragraph's in the template.

Versions are left out of both, as one number in many words must not decide a family. They are read from the confirmed
paragraph exactly: a version that the family has gives its name (GPL-2.0), one that it doesn't have gives no licence, and a
family whose texts need a version but don't state one is named without (GPL). The parts of a Creative Commons licence are
read in the same way. A line with `SPDX-License-Identifier:` is no matter for a classifier: the identifier is looked up.

Every line is classified. Then the words of each block of lines are looked through for template shingles, across line
ends, so a notice is found at any wrap width: from the line of the first shingle of a group, line by line to that of the
last, the most similar run counts, and its first line is the place. A run ends at four times the longest template, as a
notice of which more is foreign is none.

Null and empty texts have no paragraphs and no rows; texts of any length are read whole. Repeated rows each give theirs;
a line that states a licence gives one row, with the likeliest family. Other columns are not read. An empty table gives
an empty result; with no corpus sample the unknown class is trained on the sentences and on empty paragraphs alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Corpus paragraphs in the training sample, at most; share of shingles and probability that a licence needs.
SAMPLE, SIMILAR, CERTAIN, SHINGLE, SEED = 2000, 0.8, 0.5, 5, 3
#: Variants of each template, steps of the fit, and words without a template shingle that end a run.
COPIES, STEPS, GAP = 10, 250, 40

# Short statements and paragraphs of public licences.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License.", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Zlib": ["Licensed under the zlib License.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "CC0 1.0 Universal public domain dedication."],
    "Proprietary": ["All rights reserved. No part of this publication may be reproduced without prior written permission.", "Copyright. All rights reserved."],
}

# Further licences by their identifiers and names; the versions that families have; identifiers by family.
NAMES = {"EUPL-1.2": "European Union Public Licence, version 1.2", "EPL-2.0": "Eclipse Public License, version 2.0", "BSL-1.0": "Boost Software License, version 1.0", "Artistic-2.0": "Artistic License, version 2.0", "OFL-1.1": "SIL Open Font License, version 1.1", "CDDL-1.1": "Common Development and Distribution License, version 1.1"}
VERSIONS = {
    "GPL-3.0": ("GPL", "1.0 2.0 3.0"), "AGPL-3.0": ("AGPL", "1.0 3.0"), "LGPL": ("LGPL", "2.0 2.1 3.0"), "MPL-2.0": ("MPL", "1.0 1.1 2.0"), "Apache-2.0": ("Apache", "1.0 1.1 2.0"), "CC-BY": ("CC-BY", "1.0 2.0 2.5 3.0 4.0"),
    "EUPL-1.2": ("EUPL", "1.0 1.1 1.2"), "EPL-2.0": ("EPL", "1.0 2.0"), "BSL-1.0": ("BSL", "1.0"), "Artistic-2.0": ("Artistic", "1.0 2.0"), "OFL-1.1": ("OFL", "1.0 1.1"), "CDDL-1.1": ("CDDL", "1.0 1.1"), "CC0": ("CC0", "1.0"),
}
IDENTIFIERS = "MIT ISC Zlib Unlicense BSD-2-Clause BSD-3-Clause CC0-1.0".split()
#: Families that may stand without a version: their texts belong to one version, or to all.
_VERSION_FREE = {"Apache-2.0", "CC0", "MPL-2.0"}
#: What a licence text without a version is called, and version names that are the families' own.
_PLAIN = {"LGPL-2.1": "LGPL", "CC0-1.0": "CC0", "BSD-2-Clause": "BSD", "BSD-3-Clause": "BSD"}
TEMPLATES |= {k: [f"Licensed under the {name}.", f"This work is distributed under the terms of the {name}."] for k, name in NAMES.items()}
#: Sentences that name licences and grant nothing, for the unknown class: own ones, each subject with each saying.
_SUBJECTS = ["the MIT License", "the Apache License", "the GNU General Public License", "the GNU Lesser General Public License", "the Mozilla Public License", "Creative Commons", "the BSD license", "a driving licence", "the copyright notice", "public domain software"]
_SAYINGS = ["The committee discussed {} for three hours and went home.", "Many lawyers wonder how {} would fare in court.", "Her talk compared {} with older rules of the trade.", "In 1989 nobody had heard of {} yet.", "Ask your local office about {} before you travel.", "He wrote a short history of {} and its critics."]

_TABLE = bytes(32 if chr(i) in "!\"#$%&'()*,/:;<=>?@[\\]^_`{|}~" else i for i in range(256))


def words(paragraph: str) -> list[bytes]:
    """Lower-cased words; dots and hyphens count inside a word only, and a version is # whatever its number."""
    raw = paragraph.lower().encode("utf-8", "surrogatepass").translate(_TABLE)
    return [_VERSION.sub(b"#", w) if w[-1:].isdigit() or b"-clause" in w else w for w in (x.strip(b".-") for x in raw.split()) if w]


_VERSION = re.compile(rb"^v?[0-9]+([.][0-9]+)*$|(?<=license-)[0-9.]+$|^[0-9](?=-clause$)")
_STATED = re.compile(r"(?:version|\bv[.]?|\bby(?:-[a-z]+)*|[al]?gpl[ -]?|(?:mpl|apache|eupl|epl|cc0|cddl|ofl|bsl|artistic)[ -]?|license-|licenses?/[a-z-]+/|attribution(?:-[a-z]+)*|universal|licen[sc]e,?)[ \n]*v?([0-9]+(?:[.][0-9]+)?)(?![0-9]*-clause)", re.I)
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)")


def _spdx(name: str) -> str | None:
    """The licence of an identifier, by the table's exact spelling; null for others."""
    bare = re.sub(r"(-only|-or-later|[+])$", "", name)
    if bare in IDENTIFIERS or bare in TEMPLATES:
        return _PLAIN.get(bare, bare)
    for base, known in VERSIONS.values():
        if bare in {f"{base}-{v}" for v in known.split()}:
            return _PLAIN.get(bare, bare)
    parts = re.fullmatch(r"CC-BY((?:-NC|-ND|-SA)*)-([0-9.]+)", bare)
    return _commons(parts[1].strip("-").split("-"), parts[2]) if parts else None


def _commons(parts: list[str], version: str | None) -> str | None:
    """The name of a Creative Commons licence; version 4.0 goes without saying."""
    kept = [p for p in ("NC", "ND", "SA") if p in parts]
    if version is not None and version not in VERSIONS["CC-BY"][1].split() or {"ND", "SA"} <= set(kept):
        return None
    return "-".join(["CC-BY", *kept, *([version] if version not in (None, "4.0") else [])])


def settled(family: str, paragraph: str) -> str | None:
    """The licence of a paragraph that the family's templates confirm, by the tokens in it; null if they rule it out."""
    stated = [v if "." in v else f"{v}.0" for v in _STATED.findall(paragraph)]
    if family.startswith("CC-BY"):
        low = paragraph.lower()
        marks = {"NC": r"non-?commercial|\bby-nc|-nc\b", "ND": r"no-?deriv|-nd\b", "SA": r"share-?alike|-sa\b"}
        return _commons([k for k, mark in marks.items() if re.search(mark, low)], stated[0] if stated else None)
    if family not in VERSIONS:
        return family
    base, known = VERSIONS[family]
    if not stated:
        return family if family in _VERSION_FREE else base
    name = f"{base}-{stated[0]}"
    return _PLAIN.get(name, name) if stated[0] in known.split() else None


def _named(family: str, raw: list[str], low: int, high: int) -> str | None:
    """The licence of the lines low to high; if their sentence goes on without a version, the next line's first words count."""
    paragraph = "\n".join(raw[low : high + 1])
    if high + 1 < len(raw) and not paragraph.rstrip().endswith((".", ":", ";", "!", "?")) and not _STATED.search(paragraph):
        paragraph += "\n" + " ".join(raw[high + 1].split()[:4])
    return settled(family, paragraph)


def _grams(own: list[bytes]) -> list:
    return [*own, *zip(own, own[1:])]


def _shingles(own: list[bytes], n: int) -> set[tuple]:
    return {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}


def similarity(template: list[bytes], own: list[bytes]) -> float:
    """The larger share of shingles of the one that are in the other; for the paragraph's only from half the template's length."""
    n = min(SHINGLE, len(template), max(1, len(own)))
    if n < min(SHINGLE, len(template)):
        return 0.0
    a, b = _shingles(template, n), _shingles(own, n)
    both = len(a & b)
    return max(both / max(1, len(a)), both / max(1, len(b)) if len(own) * 2 >= len(template) else 0.0)


class Classifier:
    """Weights over template n-grams, a temperature, and the templates' words."""

    def __init__(self, unknown: list[str], templates: dict[str, list[str]] = TEMPLATES):
        made = np.random.default_rng(SEED)
        self.families = ["unknown", *templates]
        self.templates = {f: [words(t) for t in ts] for f, ts in templates.items()}
        every = [t for ts in self.templates.values() for t in ts]
        grams = sorted({g for t in every for g in _grams(t)}, key=repr)
        self.index = {g: i for i, g in enumerate(grams)}
        self.shingles = set().union(*(_shingles(t, SHINGLE) for t in every))
        self.begins = {x[0] for x in self.shingles}
        self.most = 4 * max(map(len, every))
        rows: list[tuple[int, int, list[bytes]]] = []  # class, template, words
        unknown = [*unknown, *(saying.format(subject) for subject in _SUBJECTS for saying in _SAYINGS)]
        filler = [w for t in unknown[:200] for w in words(t)] or [b"x"]
        n = 0
        for k, ts in enumerate(self.templates.values(), 1):
            for t in ts:
                for copy in range(COPIES):  # words left out and put in
                    own = [w for w in t if copy == 0 or made.random() > 0.06]
                    for _ in range(int(made.integers(0, 12)) if copy else 0):
                        own.insert(int(made.choice([0, len(own)])), filler[int(made.integers(len(filler)))])
                    rows.append((k, n, own))
                n += 1
        rows += [(0, -1 - i, own) for i, t in enumerate([*unknown, *[""] * 20]) if not (own := words(t)) or any(g in self.index for g in _grams(own))]
        for t in every:  # single words of templates alone are no licence
            rows += [(0, -1 - i, [w]) for i, w in enumerate(t)]
            rows += [(0, -1, [t[i] for i in made.permutation(len(t))[: max(1, len(t) // 3)]])]
        x, y = self._matrix([r for *_, r in rows]), np.array([k for k, *_ in rows])
        whole = np.array([n for _, n, _ in rows])
        held = whole % 5 == 4
        self.heat = 1.0
        z = x[held] @ self._fit(x[~held], y[~held])
        at = np.arange(held.sum())
        loss = {t: -np.log(self._softmax(z / t)[at, y[held]] + 1e-12).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0)}
        self.heat = min(loss, key=loss.get)
        self.weights = self._fit(x, y)

    def _fit(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        weights = np.zeros((x.shape[1], len(self.families)))
        one = np.eye(len(self.families))[y]
        share = 1 / np.maximum(np.bincount(y, minlength=len(self.families)), 1)[y]
        share[y == 0] *= 3
        share /= share.sum()
        step = np.zeros_like(weights)
        for _ in range(STEPS):
            g = x.T @ ((self._softmax(x @ weights) - one) * share[:, None]) + 1e-5 * weights
            step = 0.9 * step - 4.0 * g
            weights += step
        return weights

    def _matrix(self, texts: list[list[bytes]]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.index) + 1))
        x[:, -1] = 1
        for i, own in enumerate(texts):
            at = {self.index[g] for g in _grams(own) if g in self.index}
            if at:
                x[i, list(at)] = 1 / np.sqrt(len(at))
        return x

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def _classes(self, at: list[list[int]]) -> np.ndarray:
        """Probabilities of the classes for lists of n-gram numbers."""
        z = np.stack([self.weights[k].sum(0) / np.sqrt(max(1, len(k))) + self.weights[-1] for k in at])
        return self._softmax(z / self.heat)

    def _confirmed(self, p: np.ndarray, own: list[bytes]) -> tuple[str, float, float] | None:
        """(family, probability, similarity) if a template of the likeliest family confirms it."""
        k = int(p.argmax())
        if not k or p[k] < CERTAIN:
            return None
        near = max(similarity(t, own) for t in self.templates[self.families[k]])
        return (self.families[k], float(p[k]), near) if near >= SIMILAR else None

    def _numbers(self, own: list[bytes]) -> list[int]:
        get = self.index.get
        return list({k for g in _grams(own) if (k := get(g)) is not None})

    def scan(self, text: str | None) -> list[tuple[int, str, float, float]]:
        """(place of the first line, licence, probability, similarity) of the paragraphs that are a licence."""
        raw = (text or "").split("\n")
        lines = [words(x) for x in raw]
        at = {i: n for i, own in enumerate(lines) if (n := self._numbers(own))}
        found, where = {}, list(at)
        for b in range(0, len(where), 512):
            part = where[b : b + 512]
            p = self._classes([at[i] for i in part])
            for j in (p[:, 0] < 1 - CERTAIN).nonzero()[0].tolist():
                i = part[j]
                if told := self._confirmed(p[j], lines[i]):
                    found[i] = (_named(told[0], raw, i, i), *told[1:])
        for i, line in enumerate(raw):
            if named := _SPDX.search(line):  # an identifier is exact
                found[i] = (_spdx(named[1]), 1.0, 1.0)
        for low, high in self._runs(lines, found):
            found |= self._wrapped(raw, lines, low, high)
        return [(i, *found[i]) for i in sorted(found) if found[i][0]]

    def _runs(self, lines: list[list[bytes]], found: dict) -> Iterator[tuple[int, int]]:
        """(first line, last line) of the runs of more than a line between which template shingles stand."""
        block: list[tuple[bytes, int]] = []
        for i in range(len(lines) + 1):
            if i < len(lines) and lines[i] and i not in found:
                block += [(w, i) for w in lines[i]]
                continue
            own = [w for w, _ in block]
            hits = [k for k in range(len(own) - SHINGLE + 1) if own[k] in self.begins and tuple(own[k : k + SHINGLE]) in self.shingles]
            first = None
            for k, after in zip(hits, [*hits[1:], None]):
                first = k if first is None else first
                if after is None or after - k > GAP:
                    low, high = block[first][1], block[k + SHINGLE - 1][1]
                    if high > low:
                        yield low, high
                    first = None
            block = []

    def _wrapped(self, raw: list[str], lines: list[list[bytes]], low: int, high: int) -> dict[int, tuple]:
        """Licences of the lines low to high by their first lines: from each line the most similar run, then on after it."""
        found = {}
        while low < high:
            own, best = list(lines[low]), None
            for j in range(low + 1, high + 1):
                if len(own) > self.most:
                    break
                before = max(0, len(own) - SHINGLE + 1)
                own += lines[j]
                if not any(tuple(own[k : k + SHINGLE]) in self.shingles for k in range(before, len(own) - SHINGLE + 1)):
                    continue  # the line ends no shingle, so the run is no more similar than before
                told = self._confirmed(self._classes([self._numbers(own)])[0], own)
                if told and (best is None or told[2] >= best[1][2]):
                    best = (j, told)
            if best:
                found[low] = (_named(best[1][0], raw, low, best[0]), *best[1][1:])
            low = best[0] + 1 if best else low + 1
        return found


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, templates: dict[str, list[str]] = TEMPLATES) -> Classifier:
    """A classifier whose unknown class comes from at most `sample` paragraphs: one whole line of each of the texts with
    the least hashes, without those that hold the word licence, in either spelling, or copyright. Texts are first chosen
    by a range of hashes that about four times as many fall into, so that no more are sent to the driver."""
    texts = docs.select(F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h")).filter("t is not null")
    part = min(1.0, 4 * sample / max(1, docs.count()))
    some = texts.filter(F.pmod("h", F.lit(2**40)) <= int(part * 2**40)).withColumn("p", F.split("t", "\n"))
    some = some.select(F.element_at("p", (F.pmod(F.xxhash64("h"), F.size("p")) + 1).cast("int")).alias("p"), "h")
    rows = some.orderBy("h", "p").limit(sample).collect()
    return Classifier([r.p for r in rows if not re.search("licen[sc]|copyright|rights reserved", r.p, re.I)], templates)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(id, paragraph, family, probability, similarity), a row for each paragraph that states a licence.

    A narrow map over the scan; the classifier has a fixed size."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, text_col, sample, templates))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for r in model.value.scan(text):
                    where.append(i)
                    rows.append(r)
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.float64())))], [id_col, "paragraph", "family", "probability", "similarity"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, paragraph long, family string, probability double, similarity double")
