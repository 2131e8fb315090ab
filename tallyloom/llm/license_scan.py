"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Templates are grouped by length. For a group whose templates have up to ``c`` shingles, a text is read in windows of
``2 c`` shingles that start every ``c`` shingles, so that an occurrence lies wholly inside some window. That bounds the
Jaccard similarity of window and template from below, and the number of bands (of one row) follows from this bound and
the miss probability allowed.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from tallyloom.llm.common import flat, pieces, starts_of
from tallyloom.llm.decontaminate import words_of

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-6

# fixed values: public license notices, each as far as it differs from those of its family; MIT, Apache-2.0, GPL-3.0 and
# CC-BY-NC-4.0 are sentences of the given documents
TEMPLATES = {
    "AGPL-3.0-or-later-header": "under the terms of the GNU Affero General Public License as published by the Free Software "
    "Foundation",
    "AGPL-3.0-spdx": "SPDX-License-Identifier: AGPL-3.0",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-spdx": "SPDX-License-Identifier: Apache-2.0",
    "BSD-2-Clause-spdx": "SPDX-License-Identifier: BSD-2-Clause",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission.",
    "BSD-3-Clause-spdx": "SPDX-License-Identifier: BSD-3-Clause",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-notice": "licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-notice": "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0-notice": "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0-notice": "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0-notice": "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-notice": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": "have dedicated all copyright and related and neighboring rights to this software to the public domain "
    "worldwide.",
    "CC0-1.0-spdx": "SPDX-License-Identifier: CC0-1.0",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
    "2.0",
    "GPL-2.0-or-later-header": "GNU General Public License as published by the Free Software Foundation; either version 2 of the "
    "License",
    "GPL-2.0-spdx": "SPDX-License-Identifier: GPL-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version.",
    "GPL-3.0-spdx": "SPDX-License-Identifier: GPL-3.0",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-or-later-header": "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 "
    "of the License",
    "LGPL-3.0-or-later-header": "terms of the GNU Lesser General Public License as published by the Free Software Foundation, either "
    "version 3 of the License, or",
    "LGPL-2.1-spdx": "SPDX-License-Identifier: LGPL-2.1",
    "LGPL-3.0-spdx": "SPDX-License-Identifier: LGPL-3.0",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT-licensed": "licensed under the MIT License",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-spdx": "SPDX-License-Identifier: MPL-2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib-warranty": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
    "held liable for any damages arising from the use of this software.",
}


def shingles(words: list[bytes]) -> list[bytes]:
    return [b" ".join(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)]


def bands_for(least: int, c: int, containment: float, miss: float) -> int:
    """Bands of one row so that a window holding ``containment`` of ``least`` shingles or more collides."""
    jaccard = containment * least / (2 * c + (1 - containment) * least)
    return math.ceil(math.log(miss) / math.log1p(-jaccard))


@dataclass
class Group:
    """Templates of c/2 to c distinct shingles."""

    c: int
    names: list[str] = field(default_factory=list)
    sets: list[frozenset[bytes]] = field(default_factory=list)
    bands: int = 0
    #: smallest hash of each template in each band, and its low 16 bits as a table
    least: np.ndarray | None = None
    table: np.ndarray | None = None


def multipliers(n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"band", k) | 1 for k in range(n)], np.uint64)


def hashes_of(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, items), np.uint64, len(items))


class Scanner:
    def __init__(self, templates: Mapping[str, str], containment: float = CONTAINMENT, miss: float = MISS):
        groups: dict[int, Group] = {}
        for name, text in sorted(templates.items()):
            own = frozenset(shingles(words_of(text.encode())))
            if not own:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            c = 1 << (len(own) - 1).bit_length()
            group = groups.setdefault(c, Group(c))
            group.names.append(name)
            group.sets.append(own)
        self.groups, self.containment = [groups[c] for c in sorted(groups)], containment
        for g in self.groups:
            g.bands = bands_for(min(map(len, g.sets)), g.c, containment, miss)
        self.factors = multipliers(max((g.bands for g in self.groups), default=0))
        for g in self.groups:
            g.least = np.array([[self.band(hashes_of(list(s)), k).min() for s in g.sets] for k in range(g.bands)], np.uint32)
            g.table = np.zeros((g.bands, 1 << 16), bool)
            for k in range(g.bands):
                g.table[k, g.least[k] & 0xFFFF] = True

    def band(self, hashes: np.ndarray, k: int) -> np.ndarray:
        return ((hashes * self.factors[k]) >> np.uint64(32)).astype(np.uint32)

    def candidates(self, hashes: np.ndarray, n: np.ndarray) -> dict[int, set[tuple[int, int, int]]]:
        """Group -> (document, window, template) that share a band; ``n`` is the number of shingles of each document."""
        layout = []
        for g in self.groups:
            blocks = -(-n // g.c)
            heads = np.repeat(starts_of(n), blocks) + g.c * (np.arange(blocks.sum()) - np.repeat(starts_of(blocks), blocks))
            last = np.zeros(len(heads), bool)
            last[np.cumsum(blocks)[blocks > 0] - 1] = True
            owner = np.repeat(np.arange(len(n)), blocks)
            layout.append((heads, last, owner, np.arange(len(heads)) - starts_of(blocks)[owner]))
        found: dict[int, set[tuple[int, int, int]]] = {k: set() for k in range(len(self.groups))}
        for k in range(len(self.factors) if len(hashes) else 0):
            values = self.band(hashes, k)
            for which, (g, (heads, last, owner, window)) in enumerate(zip(self.groups, layout)):
                if k >= g.bands:
                    continue
                block = np.minimum.reduceat(values, heads)
                after = np.append(block[1:], np.uint32(0xFFFFFFFF))
                smallest = np.where(last, block, np.minimum(block, after))
                at = np.flatnonzero(g.table[k][smallest & 0xFFFF])
                for t, value in enumerate(g.least[k]):
                    hit = at[smallest[at] == value]
                    found[which].update(zip(owner[hit].tolist(), window[hit].tolist(), [t] * len(hit)))
        return found

    def scan(self, texts: list[bytes]) -> list[list[dict]]:
        """The licenses of each text: for every template that some window contains, the best window (the first of equals)."""
        words = [words_of(t) for t in texts]
        items, n = flat([shingles(w) for w in words])
        starts, best = starts_of(n), [{} for _ in texts]
        for which, pairs in self.candidates(hashes_of(items), n).items():
            g = self.groups[which]
            for d, w, t in sorted(pairs):
                a, b = w * g.c, min((w + 2) * g.c, int(n[d]))
                common = g.sets[t].intersection(items[starts[d] + a : starts[d] + b])
                share = len(common) / len(g.sets[t])
                if share >= self.containment and share > best[d].get(g.names[t], {"containment": 0})["containment"]:
                    best[d][g.names[t]] = {"name": g.names[t], "from": a, "to": b + SHINGLE - 1, "containment": share}
        return [[found[name] for name in sorted(found)] for found in best]


MATCH = StructType(
    [
        StructField("name", StringType()),
        StructField("from", IntegerType()),
        StructField("to", IntegerType()),
        StructField("containment", DoubleType()),
    ]
)


def finder(scanner: Scanner):
    """text -> array of the licenses found: name, window of words and containment. NULL and short texts have none."""

    @F.arrow_udf(ArrayType(MATCH))
    def find(texts: pa.Array) -> pa.Array:
        kind = pa.list_(
            pa.struct([("name", pa.string()), ("from", pa.int32()), ("to", pa.int32()), ("containment", pa.float64())])
        )
        return pa.array([found for piece in pieces(texts) for found in scanner.scan(piece)], kind)

    return find


def licenses(
    documents: DataFrame, templates: Mapping[str, str] = TEMPLATES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, licenses) of every document row; templates are a parameter of a few texts, other columns are not read."""
    return documents.select(F.col(key).alias("doc_id"), finder(Scanner(templates))(F.col(text)).alias("licenses"))


def names(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda m: m["name"]), ",")
