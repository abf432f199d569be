"""Operator 5: licence scans with a trained paragraph classifier.

A paragraph is a run of lines with no blank line, and no line of mere comment or
punctuation marks, between them; it is read as one run of words, each stripped of
the marks around it and folded to lower case, so a grant may be wrapped over lines,
stand behind comment marks or lie inside a line of any length.

*Units.* In every paragraph the places are sought where enough of a template's own
word pairs (by weight, see below) stand close together for the template comparison
to be able to confirm a grant; each place with ``CONTEXT`` words on either side is a
unit. Other words can't be confirmed, so they need not be classified.

*Classifier.* Sparse word n-grams (one to three words, hashed) feed a multinomial
logistic regression whose classes are the licence families and *unknown*. It is
trained here on the templates, with words dropped, swapped or added at random and
with words of the corpus around them, and, as unknown, on plain paragraphs of the
corpus, on grants of other licences and on sentences that only mention one. A
temperature fitted on held-out examples calibrates the probabilities.

*Denials.* A unit whose words deny a grant or set it aside (``DENIED``: "is not licensed under", "unlike projects
released under", "we considered the ... license") names no family, whatever the classifier says.

*Comparison.* A unit counts only if its most likely class is a family whose
probability reaches ``CUT`` and the family's templates confirm it: ``CONFIRM`` of a
template's word pairs must occur in the unit, each pair weighing one over the number
of families that have it, so words that all grants share prove nothing.

The training sample is bounded: at most ``SAMPLE`` stretches of at most ``STRETCH``
words, those with the smallest hashes among all stretches of the documents drawn by
hash, so a table always gives the same model. Scanning reads whole texts.

Defined cases: null or empty texts have no paragraphs and no family; a paragraph of
any length is one paragraph; a family is named once per paragraph, by its surest
unit, and at the line where the first of its units begins; repeated rows are scanned each for itself; other columns are not read; an
empty table gives no rows (the model is then trained on the templates and the fixed
sentences alone).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import _FOLDED, _R, _R_INV, _SEP, _slices, lean, mix, text_chunks

DIM, CUT, CONFIRM = 1 << 15, 0.5, 0.6
#: Stretches of the corpus that serve as unknown in training, at most, and their words; examples made per family.
SAMPLE, STRETCH, EXAMPLES = 2000, 40, 160
#: Words on either side that are judged with a place; a stretch this much like a template is no example of unknown.
CONTEXT, ALIKE = 5, 0.4
#: Words before a unit that may deny it.
LEAD = 8

#: How grants name a licence.
GRANTS = (
    "licensed under the {}",
    "released under the {}",
    "distributed under the {}",
    "this project is licensed under the terms of the {}",
    "this work is licensed under {}",
    "available under the {}",
    "subject to the terms of the {}",
)
#: Names by which licences are granted, per family; the first word of an entry of IDS is its short identifier.
NAMES: dict[str, tuple[str, ...]] = {
    "Apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"),
    "MIT": ("MIT License", "MIT/X11 License", "MIT"),
    "GPL": ("GNU General Public License, version 3", "GNU General Public License v2.0", "GNU GPL", "GPL version 2", "GPLv3"),
    "LGPL": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL version 3"),
    "AGPL": ("GNU Affero General Public License, version 3", "GNU Affero General Public License", "GNU AGPL", "AGPL version 3"),
    "BSD": ("BSD 3-Clause License", "BSD 2-Clause License", "BSD License", "New BSD License", "BSD-style license"),
    "MPL": ("Mozilla Public License, Version 2.0", "Mozilla Public License 1.1", "MPL 2.0"),
    "EPL": ("Eclipse Public License, Version 2.0", "Eclipse Public License 1.0", "EPL 2.0"),
    "ISC": ("ISC License", "ISC"),
    "Zlib": ("Zlib License", "zlib/libpng License"),
    "BSL": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost License"),
    "Unlicense": ("Unlicense",),
    "CC0": ("CC0 1.0 Universal Public Domain Dedication", "CC0 1.0", "CC0"),
    "CC": (
        "CC BY 4.0", "CC BY-SA 4.0", "CC BY-NC 4.0", "CC BY-ND 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC BY-SA 3.0", "CC BY 3.0",
        "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 International License",
        "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution 3.0 Unported License",
    ),
}
#: Identifiers in SPDX lines.
IDS: dict[str, tuple[str, ...]] = {
    "Apache": ("Apache-2.0",), "MIT": ("MIT",), "GPL": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0", "GPL-3.0"),
    "LGPL": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-2.1"), "AGPL": ("AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL-3.0"),
    "BSD": ("BSD-2-Clause", "BSD-3-Clause"), "MPL": ("MPL-2.0", "MPL-1.1"), "EPL": ("EPL-2.0", "EPL-1.0"), "ISC": ("ISC",), "Zlib": ("Zlib",),
    "BSL": ("BSL-1.0",), "Unlicense": ("Unlicense",), "CC0": ("CC0-1.0",), "CC": ("CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"),
}
#: Paragraphs of licences and of the notices that they ask for.
TEXTS: dict[str, tuple[str, ...]] = {
    "Apache": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation",
    ),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "BSD": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ),
    "BSL": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    ),
    "CC": (
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
}
FAMILIES = tuple(NAMES)
#: Licences of no family here, whose grants are unknown.
OTHER_NAMES = (
    "Artistic License 2.0", "Academic Free License 3.0", "Common Development and Distribution License", "Microsoft Public License", "SIL Open Font License 1.1",
    "PostgreSQL License", "Python Software Foundation License", "PHP License 3.01", "Ruby License", "Beerware License", "Sleepycat License", "W3C Software License",
    "Common Public License", "Sun Public License", "Netscape Public License", "Open Database License", "Do What The Fuck You Want To Public License", "GNU Free Documentation License",
    "Amended Community License", "Standard Commercial License", "Enterprise License Agreement", "Developer License", "Evaluation License 2.0", "Site License", "End User License Agreement",
    "Server Side Public License", "Elastic License 2.0", "Business Source License 1.1", "Apple Public Source License", "Proprietary License, Version 2.0", "Reciprocal Public License",
)
#: Plain sentences that are no grant although they share words with one.
PLAIN = (
    "The driver lost the license after the third offence.",
    "A free version of the work was released to the public in the spring.",
    "General terms and conditions of use are published on this page.",
    "Permission to enter the building was granted to any person with a copy of the letter.",
    "The source of the river is found under the northern hills.",
    "Version two of the program will be released next year.",
    "This file is a copy of the public record.",
    "The foundation published the results of its work.",
    "The park is available to the general public under the terms of the license that the town granted.",
    "The company compared the MIT License with the Apache License and chose neither.",
    "Many authors prefer the GNU General Public License to the Mozilla Public License, others do not.",
    "Students of MIT and of Berkeley met under the bridge.",
    "An article on the history of the BSD license and of the Eclipse foundation appeared in the paper.",
)

#: Sentences that mention a licence and grant nothing.
MENTIONS = (
    "the {} is popular with", "a history of the {} appeared", "they compared the {} with the", "unlike the {} it has", "what does the {} say about",
    "an article about the {} and its", "she read the {} twice", "the text of the {} is long", "who wrote the {} and why", "critics of the {} argue that",
)

#: Bare words that deny a grant, compare with one or set one aside. ("not distributed with this file" is part of a grant.)
_GRANTED = rb"(?:licen[sc]ed|released|distributed|available|covered|governed|provided|published|offered)"
DENIED = re.compile(
    rb"\b(?:not|never|no longer|neither|nor|isn't|aren't|wasn't|cannot be)(?: \S+){0,2} " + _GRANTED + rb"(?: \S+)? under\b"
    rb"|\b(?:unlike|contrary to|in contrast to|as opposed to)(?: \S+){0,5} " + _GRANTED + rb" under\b"
    rb"|\b(?:considered|evaluated|discussed|rejected|declined|avoided|dropped|abandoned)(?: \S+){1,5} licen[sc]e\b"
    rb"|\bnot(?: \S+){0,2} (?:use|adopt|choose|chose|accept)(?: \S+){1,5} licen[sc]e\b",
    re.IGNORECASE,
)


# --------------------------------------------------------------------- words
_BARE = np.zeros(256, bool)  # what words are stripped of
_BARE[list(b"!\"#$%&'()*,./:;<=>?@[\\]^_`{|}~-")] = True
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


class Bare:
    """The words of a chunk without the marks around them, folded: hash, byte bounds, document, line and paragraph."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        self.buf = buf = np.frombuffer(joined, np.uint8)
        edge = np.flatnonzero(np.diff(_SEP[buf], prepend=True))
        first, last = edge[0::2], edge[1::2]
        inner = ~_BARE[buf] & ~_SEP[buf]
        places = np.flatnonzero(inner)
        upto = np.concatenate(([0], np.cumsum(inner)))
        low, high = upto[first], upto[last]
        keep = high > low
        self.starts, self.ends = places[low[keep]], places[high[keep] - 1] + 1
        self.hash = mix(_slices(_FOLDED[buf], _R, _R_INV, self.starts, self.ends) + (self.ends - self.starts).astype(np.uint64))
        doc_at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
        bounds = np.searchsorted(self.starts, doc_at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        breaks = np.cumsum(buf == 10)
        self.line = breaks[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        self.first_line = np.concatenate(([0], breaks))[doc_at[:-1]]
        fresh = np.ones(len(self.doc), bool)
        fresh[1:] = (np.diff(self.line) > 1) | (np.diff(self.doc) > 0)
        self.block = np.cumsum(fresh) - 1
        self.block_at = np.append(np.flatnonzero(fresh), len(self.doc))
        self.blocks = np.bincount(self.doc[fresh], minlength=len(texts)) if len(self.doc) else np.zeros(len(texts), np.int64)
        self.before = np.concatenate(([0], np.cumsum(self.blocks)))  # paragraphs of the documents before

    def pairs(self) -> np.ndarray:
        return mix(self.hash[:-1] * _PAIR + self.hash[1:])

    def text(self, first: int, after: int) -> bytes:
        """The words, bare, with one blank between them."""
        return b" ".join(self.buf[a:b].tobytes() for a, b in zip(self.starts[first:after].tolist(), self.ends[first:after].tolist(), strict=True))


def _pair_set(words: Bare, first: int = 0, after: int | None = None) -> np.ndarray:
    own = words.hash[first:after]
    return np.unique(mix(own[:-1] * _PAIR + own[1:])) if len(own) > 1 else np.unique(own)


def templates() -> list[tuple[str, bytes]]:
    """(family, text) of every template: names in grants, identifiers, paragraphs."""
    out = []
    for f in FAMILIES:
        out += [(f, g.format(n).encode()) for n in NAMES[f] for g in GRANTS]
        out += [(f, f"SPDX-License-Identifier: {i}".encode()) for i in IDS[f]]
        out += [(f, t.encode()) for t in TEXTS[f]]
    return out


class Templates:
    """Word pairs of all templates with their weights, and per pair the templates that have it (as offsets into a list)."""

    def __init__(self):
        self.all = templates()
        self.family = np.array([FAMILIES.index(f) for f, _ in self.all])
        self.words = [Bare([t]) for _, t in self.all]
        sets = [_pair_set(w) for w in self.words]
        self.keys = np.unique(np.concatenate(sets))
        member = np.zeros((len(self.all), len(self.keys)), bool)
        for i, s in enumerate(sets):
            member[i, np.searchsorted(self.keys, s)] = True
        families = np.stack([member[self.family == f].any(axis=0) for f in range(len(FAMILIES))]).sum(axis=0)
        self.weight = 1.0 / families
        self.total = member @ self.weight
        self.member = member
        own = families <= 3  # the pairs by which places are found; of the others, all are taken to be there
        self.need = CONFIRM * self.total - (member & ~own) @ self.weight
        self.reach = np.array([2 * len(w.hash) + 8 for w in self.words])
        self.own_keys = self.keys[own]
        rows = [np.flatnonzero(member[:, k]) for k in np.flatnonzero(own)]
        self.list_at = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        self.lists = np.concatenate(rows)
        self.own_weight = self.weight[own]
        self.mask = np.zeros(1 << 16, bool)
        self.mask[self.own_keys & np.uint64(0xFFFF)] = True

    def share(self, pairs: np.ndarray) -> np.ndarray:
        """Per family the greatest share of a template's pairs that is among ``pairs``."""
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        here = at[self.keys[at] == pairs]
        got = self.member[:, here] @ self.weight[here] / self.total
        out = np.zeros(len(FAMILIES))
        np.maximum.at(out, self.family, got)
        return out


_TEMPLATES: list[Templates] = []


def known() -> Templates:
    if not _TEMPLATES:
        _TEMPLATES.append(Templates())
    return _TEMPLATES[0]


def places(words: Bare) -> list[tuple[int, int]]:
    """(first word, word after the last) of every place that the comparison might confirm, with its context, inside its paragraph."""
    known_, n = known(), len(words.hash)
    if n < 2:
        return []
    pairs = words.pairs()
    hit = np.flatnonzero(known_.mask[(pairs & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(known_.own_keys, pairs[hit]), len(known_.own_keys) - 1)
    sure = (known_.own_keys[at] == pairs[hit]) & (words.block[hit] == words.block[hit + 1])
    hit, at = hit[sure], at[sure]
    if not len(hit):
        return []
    count = known_.list_at[at + 1] - known_.list_at[at]
    owner = np.repeat(np.arange(len(hit)), count)
    template = known_.lists[np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + known_.list_at[at][owner]]
    pos, weight = hit[owner], known_.own_weight[at][owner]
    order = np.lexsort((pos, template))
    template, pos, weight = template[order], pos[order], weight[order]
    # the most that a template's pairs weigh between a hit and its reach, inside the paragraph (pairs that repeat count again)
    big = np.int64(n + 1)
    key = template * big + pos
    limit = np.minimum(pos + known_.reach[template], words.block_at[words.block[pos] + 1])
    end = np.searchsorted(key, template * big + limit)
    total = np.concatenate(([0.0], np.cumsum(weight)))
    good = np.flatnonzero(total[end] - total[:-1] >= known_.need[template] - 1e-9)
    spans = set()
    for a, b in zip(pos[good].tolist(), pos[end[good] - 1].tolist(), strict=True):
        block = int(words.block[a])
        spans.add((max(int(words.block_at[block]), a - CONTEXT), min(int(words.block_at[block + 1]), b + 2 + CONTEXT)))
    return sorted(spans)


# ----------------------------------------------------------------- classifier
def _rows(units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, slot, weight) of the hashed n-grams; each unit's weights have unit length."""
    words = Bare([u.replace(b"\n", b" ") for u in units])
    owner, slot = [], []
    gram = words.hash
    for k in (1, 2, 3):
        if k > 1:
            gram = mix(gram[:-1] * _PAIR + words.hash[k - 1 :]) if len(gram) else gram
        inside = words.doc[k - 1 :] == words.doc[: len(gram)] if len(gram) else np.zeros(0, bool)
        owner.append(words.doc[: len(gram)][inside])
        slot.append((mix(gram[inside] + np.uint64(k)) % np.uint64(DIM)).astype(np.int64))
    owner, slot = np.concatenate(owner), np.concatenate(slot)
    order = np.argsort(owner, kind="stable")
    owner, slot = owner[order], slot[order]
    count = np.bincount(owner, minlength=len(units))
    return owner, slot, 1 / np.sqrt(np.maximum(count, 1))[owner]


def _sums(rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each owner (owners come sorted)."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(owner):
        at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        out[owner[at]] = np.add.reduceat(rows, at, axis=0)
    return out


def probabilities(units: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Per unit the probability of each family and, last, of unknown."""
    owner, slot, w = _rows(units)
    return _softmax(_sums(weights[slot] * w[:, None], owner, len(units)) + weights[-1])


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def examples(plain: list[bytes], seed: int = 7) -> tuple[list[bytes], np.ndarray]:
    """Training units and classes; the last class is unknown."""
    rnd = np.random.default_rng(seed)
    filler = sorted({w for p in [*plain, *[x.encode() for x in PLAIN]] for w in p.split()})
    some = lambda n: [filler[i] for i in rnd.integers(0, len(filler), n)]

    def varied(text: bytes, plainly: bool) -> bytes:
        words = text.split()
        if not plainly:
            words = [w for w in words if rnd.random() > 0.06] or words
            for _ in range(int(rnd.integers(0, 3))):
                words[int(rnd.integers(0, len(words)))] = some(1)[0] if rnd.random() < 0.3 else words[int(rnd.integers(0, len(words)))]
        return b" ".join(some(int(rnd.integers(0, CONTEXT + 1))) + words + some(int(rnd.integers(0, CONTEXT + 1))))

    texts, classes = [], []
    own: dict[str, list[bytes]] = {}
    for f, t in templates():
        own.setdefault(f, []).append(t)
    for c, family in enumerate(FAMILIES):
        for i in range(max(EXAMPLES, 2 * len(own[family]))):
            t = own[family][i % len(own[family])]
            texts.append(t if i < len(own[family]) else varied(t, i % 3 == 0))
            classes.append(c)
    others = [g.format(n).encode() for n in OTHER_NAMES for g in GRANTS]
    others += [g.format(b" ".join(some(int(k))).decode("utf-8", "replace") + " License").encode() for g in GRANTS for k in rnd.integers(1, 4, 20)]
    others += [m.format(n).encode() for f in FAMILIES for n in NAMES[f] for m in MENTIONS]
    unknown = [*plain, *[varied(x.encode(), True) for x in PLAIN for _ in range(12)], *others, *[varied(x, True) for x in others]]
    return texts + unknown, np.array(classes + [len(FAMILIES)] * len(unknown))


_HEATS = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)


def train(plain: list[bytes], rounds: int = 70, seed: int = 7) -> np.ndarray:
    """Weights [DIM + 1][classes], the last row the bias, scaled by the calibration temperature."""
    texts, classes = examples(plain, seed)
    k = len(FAMILIES) + 1
    held = np.random.default_rng(seed).random(len(texts)) < 0.2
    owner, slot, w = _rows(texts)
    common = np.bincount(slot, minlength=DIM)[slot] >= 3  # what is rarer keeps weight 0
    owner, slot, w = owner[common], slot[common], w[common]
    w = w.astype(np.float32)
    used, inverse = np.unique(slot, return_inverse=True)
    by_slot = np.argsort(inverse, kind="stable")
    target = np.eye(k, dtype=np.float32)[classes]
    weights, bias, speed = np.zeros((len(used), k), np.float32), np.zeros(k, np.float32), np.zeros((len(used), k), np.float32)
    per_class = np.maximum(np.bincount(classes[~held], minlength=k), 1)
    importance = np.where(held, 0.0, (1 / per_class)[classes])
    importance = (importance / importance.sum()).astype(np.float32)
    forward = lambda m, b: _sums(m[inverse] * w[:, None], owner, len(texts)) + b
    for _ in range(rounds):
        gap = (_softmax(forward(weights, bias)) - target) * importance[:, None]
        grad = _sums((gap[owner] * w[:, None])[by_slot], inverse[by_slot], len(used)) + 1e-5 * weights
        speed = 0.9 * speed - 20.0 * grad
        weights += speed
        bias -= 3.0 * gap.sum(axis=0)
    z = forward(weights, bias)[held].astype(np.float64)
    loss = [float(-np.log(_softmax(z * t)[np.arange(len(z)), classes[held]] + 1e-12).mean()) for t in _HEATS] if len(z) else [0.0]
    scale = _HEATS[int(np.argmin(loss))]
    out = np.zeros((DIM + 1, k))
    out[used], out[-1] = weights * scale, bias * scale
    return out


# ----------------------------------------------------------------------- scan
def _grants(words: Bare, weights: np.ndarray) -> dict[int, list[tuple]]:
    """Per document (paragraph, line, family, probability, share, text) of its confirmed families, by paragraph and line."""
    spans = places(words)
    if not spans:
        return {}
    units: dict[bytes, list[tuple[int, int]]] = {}
    for a, b in spans:
        units.setdefault(words.text(a, b), []).append((a, b))
    best: dict[tuple[int, int], tuple] = {}
    texts = list(units)
    for at in range(0, len(texts), 4096):
        part = texts[at : at + 4096]
        for text, p in zip(part, probabilities(part, weights), strict=True):
            c = int(p.argmax())
            if c == len(FAMILIES) or p[c] < CUT:
                continue
            a, b = units[text][0]
            share = float(known().share(_pair_set(words, a, b))[c])
            if share < CONFIRM:
                continue
            for a, b in units[text]:
                block = int(words.block[a])
                if DENIED.search(words.text(max(int(words.block_at[block]), a - LEAD), b)):
                    continue
                rank, held = (-float(p[c]), a), best.get((block, c))
                first = a if held is None else min(a, held[1])
                best[block, c] = (rank, first, float(p[c]), share, text) if held is None or rank < held[0] else (held[0], first, *held[2:])
    out: dict[int, list[tuple]] = {}
    for (block, c), (_, a, p, share, text) in best.items():
        doc = int(words.doc[a])
        out.setdefault(doc, []).append((block - int(words.before[doc]), int(words.line[a] - words.first_line[doc]), FAMILIES[c], p, share, text.decode("utf-8", "replace")))
    return {d: sorted(rows) for d, rows in out.items()}


_OUT = "doc_id long, n_paragraphs long, paragraph long, line long, family string, probability double, template_share double, text string"


def _scan(weights: np.ndarray) -> Callable[[Iterable], Iterator]:
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in _OUT.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.string())
        for batch, texts in text_chunks(batches):
            words = Bare(texts)
            found = _grants(words, weights)
            cols: list[list] = [[] for _ in names]
            for d, doc in enumerate(batch.column("doc_id").to_pylist()):
                for row in found.get(d) or [(None,) * 6]:
                    for c, v in zip(cols, (doc, int(words.blocks[d]), *row), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def _stretches(batches: Iterable) -> Iterator:
    """Every stretch of ``STRETCH`` words of the drawn documents that is not like a grant."""
    import pyarrow as pa

    for _, texts in text_chunks(batches):
        words, out = Bare(texts), set()
        for a, b in zip(words.block_at[:-1].tolist(), words.block_at[1:].tolist(), strict=True):
            for at in range(a, b, STRETCH):
                end = min(b, at + STRETCH)
                if known().share(_pair_set(words, at, end)).max() < ALIKE:
                    out.add(words.text(at, end).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.string())], ["p"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Train on the templates and on at most ``sample`` stretches of about ``sample`` documents drawn by hash."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    limit = int(min(1.0, sample / max(rows.count(), 1)) * (1 << 30))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < limit).select("text")
    ordered = drawn.mapInArrow(lean(_stretches), "p string").distinct().orderBy(F.xxhash64(F.lit(5), "p"), "p").limit(sample)
    return train(sorted(r["p"].encode() for r in ordered.collect()))


def scan(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """One row per paragraph and family (or one with nulls for a document without): doc_id, n_paragraphs, paragraph,
    line (both count from 0; where the family's first unit begins), family, probability, template_share, text (the unit's bare words)."""
    ship(docs.sparkSession)
    weights = fit(docs) if weights is None else weights
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(_scan(weights)), _OUT)
