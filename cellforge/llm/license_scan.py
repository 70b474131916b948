"""License scans: conditional compression against templates, confirmed by exact wording."""

from __future__ import annotations

import bisect
import functools
import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.llm import common

# Short notices of public licenses.
TEMPLATES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-line": "Licensed under the BSD License.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0-line": "Released under CC0 1.0 Universal.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "AGPL-3.0-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3 of the License. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "GPL-2.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2 of the License. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 3 of the License. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
# SPDX lines; of a longer expression, each license that is named here.
TEMPLATES |= {f"{k}-spdx": f"SPDX-License-Identifier: {k}" for k in ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")}
TRIGGERS = ("licen", "permission", "redistribution", "public domain", "released under", "spdx", "copyright")

#: A notice's size must fall by this share at least, and this share of the template's words stand in it in order.
REDUCTION, WORDING = 0.25, 0.9
#: Characters on each side of a trigger: four times the longest template, which the size reduction lets no notice exceed.
REACH = 4 * max(map(len, TEMPLATES.values()))
_MARKS = r"[\W_]{1,200}"
_SPDX = ["spdx", "license", "identifier"]
_EXPRESSION = re.compile(r"SPDX-License-Identifier:[ \t]*(?:\(*[\w.+-]+\)*[ \t]+(?:OR|AND|WITH)[ \t]+)*\(*[\w.-]+", re.I)
_VERSIONS = re.compile(r"(?:-only|-or-later|\+)?(?![\w+-]|\.\w)", re.I)
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Adds a range to sorted ones, if it meets none of them."""
    at = bisect.bisect(taken, (start, end))
    if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end):
        return False
    taken.insert(at, (start, end))
    return True


class Scanner:
    """Finds templates' wording in a block, ranked by how much smaller the notice gets with each as a raw dictionary."""

    def __init__(self, templates: dict[str, str], level: int = 9):
        self.words = {k: words_of(v) for k, v in templates.items()}
        self.counts = {k: Counter(v) for k, v in self.words.items()}
        self.tails = {k: v[max((m.end() for m in _WORD.finditer(v)), default=0) :] for k, v in templates.items()}
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        self.with_template = {}
        for k, v in self.words.items():
            data = zstandard.ZstdCompressionDict(" ".join(v).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.with_template[k] = zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)

    def reduction(self, have: list[str], name: str) -> float:
        """The share by which a notice's words, apart from the text around them, get smaller with a template."""
        data = " ".join(have).encode("utf-8", "surrogatepass")
        return 1 - len(self.with_template[name].compress(data)) / len(self.plain.compress(data))

    def places(self, have: np.ndarray, want: list[int], missing: int, weight: int):
        """(first word, end, missing words) of the template's words in order, at most `missing` of them missing.

        A missing word costs `weight`, another word between them 1; for each end, the cheapest beginning. Cost and beginning
        are one number, so that a running minimum carries both.
        """
        n, m = len(want), len(have)
        step = np.arange(m + 1, dtype=np.int64) << 32
        best = np.int64(m) - np.arange(m + 1)
        for w in want:
            now = best + (weight << 32)
            np.minimum(now[1:], np.where(have == w, best[:-1], now[1:]), out=now[1:])
            best = np.minimum.accumulate(now - step) + step
        cost, first = best >> 32, m - (best & 0xFFFFFFFF)
        size = np.arange(m + 1) - first
        lost = (cost - size + n) // (weight + 1)
        # an end is a matched word's: one more word would cost more
        own = np.flatnonzero((lost <= missing) & (cost < np.append(np.iinfo(np.int64).max, cost[:-1] + 1)) & (size > 0))
        taken: list[tuple[int, int]] = []
        for i in own[np.argsort(cost[own], kind="stable")].tolist():
            x = int(first[i])
            if _free(taken, x, i):
                yield x, i, int(lost[i])

    def other_number(self, have: list[str], name: str) -> bool:
        """Whether another number, as of a version, stands for one of the template's."""
        want = self.words[name]
        for kind, a, b, x, y in SequenceMatcher(None, want, have, autojunk=False).get_opcodes():
            if kind == "replace" and any(w[0].isdecimal() for w in want[a:b]) and any(w[0].isdecimal() for w in have[x:y]):
                return True
        return False

    def scan(self, block: str, reduction: float = REDUCTION, wording: float = WORDING) -> list[tuple[int, int, str, float, int]]:
        """(start, end, template, size reduction, missing words) of the notices in a block that the wording confirms.

        The reduction is that of the notice alone, from its first word to its last, whatever stands around it. White space,
        marks and case don't count. Of templates that share words of the text, the one with more words in common wins, less
        missing and other words, then the larger reduction; those that share none are all given.
        """
        spans = [(m.start(), m.end()) for m in _WORD.finditer(block)]
        have = [block[x:y].lower() for x, y in spans]
        count, ids = Counter(have), {}
        codes = np.array([ids.setdefault(w, len(ids)) for w in have], np.int64)
        found = []
        for name, want in self.words.items():
            n, most = len(want), int((1 - wording) * len(want) + 1e-9)
            if not n or n - sum(min(c, count[w]) for w, c in self.counts[name].items()) > most:
                continue
            seen = set()
            for weight in (8, 64):
                for x, y, missing in self.places(codes, [ids.get(w, -1) for w in want], most, weight):
                    if (x, y) in seen:
                        continue
                    seen.add((x, y))
                    if want[:3] == _SPDX and not (_EXPRESSION.fullmatch(block, spans[x][0], spans[y - 1][1]) and _VERSIONS.match(block, spans[y - 1][1])):
                        continue
                    share = self.reduction(have[x:y], name)
                    if share >= reduction and not (missing and self.other_number(have[x : y + 1], name)):
                        found.append((2 * (n - missing) - (y - x) - missing, share, name, x, y, missing))
        found.sort(key=lambda f: (-f[0], -f[1], f[2]))
        out, used = [], []
        for _, share, name, x, y, missing in found:
            # the licenses of an SPDX expression share its head
            if _free(used, y - len(self.words[name]) + 3 if self.words[name][:3] == _SPDX else x, y):
                end = spans[y - 1][1]
                out.append((spans[x][0], end + len(self.tails[name]) * block.startswith(self.tails[name], end), name, share, missing))
        return sorted(out)


@functools.lru_cache(maxsize=4)
def _scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(templates))


def blocks(text: str, triggers: tuple[str, ...] = TRIGGERS, reach: int = REACH):
    """(start, end) of the text around triggers, line feeds or not: `reach` characters on each side.

    White space and comment marks may stand between the words of a trigger as in a notice.
    """
    low = text.lower()
    if len(low) != len(text):  # a few letters change length in lower case; offsets must hold
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    start = end = 0
    for at in sorted({m.start() for t in triggers if t.split()[0] in low for m in re.finditer(_MARKS.join(map(re.escape, t.split())), low)}):
        if at - reach > end:
            if end:
                yield start, end
            start = at - reach
        end = min(at + reach, len(text))
    if end:
        yield start, end


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", reduction: float = REDUCTION, wording: float = WORDING) -> DataFrame:
    """(doc_id, start, end, license, reduction, missing_words) of the notices whose wording a template confirms.

    start and end are code points, the end exclusive. Null and empty texts have no notice; repeated rows are scanned each. A
    tie of reductions falls to the name in order.
    """
    own = tuple(sorted((TEMPLATES if templates is None else templates).items()))

    def run(batches):
        scanner = _scanner(own)
        for b in batches:
            out = [[] for _ in range(6)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for s, e in blocks(text or ""):
                    for x, y, *got in scanner.scan(text[s:e], reduction, wording):
                        for o, v in zip(out, (doc, s + x, s + y, *got), strict=True):
                            o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["doc_id", "start", "end", "license", "reduction", "missing_words"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_arrow(rows, run, "doc_id long, start long, end long, license string, reduction double, missing_words long")


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
