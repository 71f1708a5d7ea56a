"""License texts in documents, by patience alignment.

Words that occur exactly once in both a text and a template are anchors; the longest run of anchors in
the same order on both sides is kept, and the gaps between them are aligned in the same way until no
anchors are left. Coverage is the share of the template's words that are aligned.

A text may hold a license more than once, or use its words elsewhere; then few words are unique in the
whole of it. So where the whole text isn't aligned as far as its words allow, stretches of it are aligned
too: of about the template's length from every place where a covering alignment can begin, then of growing
lengths up to the whole text. The best alignment counts.

A text may hold a license more than once, or use its words elsewhere; then few words are unique in the
whole of it. So where the whole text isn't aligned as far as its words allow, stretches of it are too: from
every place where an alignment that covers enough can begin, of about the template's length and then of
growing lengths up to the whole text. The best alignment counts.

A template can't be covered better than by the words it has in common with the text, so only templates
for which this bound reaches the threshold are aligned; nothing that could reach it is left out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.llm.common import fresh, query, run_hashes, runs, slices, table, text_bytes
from sparktab.session import spread

#: Share of a template's words that must be aligned.
COVERAGE = 0.8

# Widely used license texts, notices and statements.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT-line": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LETTER = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (letters, digits, bytes beyond ASCII), and the texts' bounds."""
    starts, stops, owner = runs(~_LETTER[data], offsets)
    return run_hashes(LOWER[data], starts, stops), np.searchsorted(owner, np.arange(len(offsets)))


def longest_rise(values: list[int]) -> list[int]:
    """Places of a longest rising subsequence, by piles of cards."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
        back[i] = at[pile - 1] if pile else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of aligned positions of two sequences, rising on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_b = Counter(b[b0:b1])
        # Only words of the template matter on the longer side.
        in_a = Counter(w for w in a[a0:a1] if w in in_b)
        place = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        anchors = [(i, place[a[i]]) for i in range(a0, a1) if in_a.get(a[i]) == 1 and a[i] in place]
        kept = [anchors[k] for k in longest_rise([j for _, j in anchors])]
        if not kept:
            continue
        out += kept
        edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        for (i, j), (k, m) in zip(edges, edges[1:], strict=False):
            if k - i > 1 and m - j > 1:
                todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def stretch_bounds(ids: np.ndarray, caps: np.ndarray, length: int) -> np.ndarray:
    """Words of a template (``caps`` of each) that the ``length`` words from each place of a text on have at most.

    ``ids`` are the text's words as places in ``caps``, -1 for others.
    """
    at = np.flatnonzero((ids >= 0) & (caps[ids] > 0))
    at = at[np.argsort(ids[at], kind="stable")]
    word = ids[at]
    # A word counts in the stretches that begin behind its occurrence ``caps`` times before.
    back = np.arange(len(at)) - caps[word]
    low = np.where((back >= 0) & (word[back] == word), at[back] + 1, 0)
    low = np.maximum(low, at - length + 1)
    change = np.bincount(low, minlength=len(ids) + 1) - np.bincount(at + 1, minlength=len(ids) + 1)
    return np.cumsum(change[: len(ids)])


def best_alignment(text: list[int], ids: np.ndarray, template: list[int], caps: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The longest alignment of the whole text or of a stretch of it, if one has ``least`` pairs.

    Of equally long ones, that of the whole text, then of the shortest and the first stretches.
    """
    best = patience(text, template)
    most = int(stretch_bounds(ids, caps, len(text)).max(initial=0))
    length = len(template) + len(template) // 4 + 1
    step = 1
    while len(best) < most:
        bounds = stretch_bounds(ids, caps, length)
        starts = np.arange(0, len(text), step)
        starts = starts[bounds[starts] >= max(least, len(best) + 1)]
        for s in starts[np.argsort(-bounds[starts], kind="stable")].tolist():
            need = max(least, len(best) + 1)
            if bounds[s] < need:
                break
            # An alignment that begins here, but further inside the template, has too few words left.
            if step > 1 or text[s] in template[: len(template) - need + 1]:
                pairs = patience(text[s : s + length], template)
                if len(pairs) > len(best):
                    best = [(s + i, j) for i, j in pairs]
        if length >= len(text):
            break
        # Longer stretches overlap by seven eighths, so that all of one length take time in line with the text.
        length += length // 2
        step = max(1, length // 8)
    return best


def scan_licenses(
    df: DataFrame, text: str, templates: dict[str, str] | None = None, coverage: float = COVERAGE, keep: list[str] | None = None
) -> DataFrame:
    """Every row of ``df`` (columns ``keep``; all, if None) with the license its text covers best.

    Added: license (of the covered templates the one of greatest coverage, then of most words, then by
    name; null if none reaches ``coverage``), coverage, n_matched (aligned words), first_word and
    last_word (places of the first and last aligned word in the text), n_covered (templates that reach
    it). A null or empty text covers nothing; a template without words is never covered. Texts are
    aligned whole and, where that leaves words of a template over that they hold, in stretches. Columns of these names in ``df``, in any spelling, are replaced.
    """
    added = ["license", "coverage", "n_matched", "first_word", "last_word", "n_covered"]
    types = ["string", "double", "int", "int", "int", "int"]
    chosen = TEMPLATES if templates is None else templates
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in added]
    copy = fresh(df, "text_to_scan")
    plain = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(copy))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema[:-1]), *map(" ".join, zip(added, types, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted(chosen)
        raw = [chosen[n].encode() for n in names]
        flat, bounds = word_keys(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
        words = np.unique(flat)
        owned = [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        # How often each template holds each word.
        holds = np.stack([np.bincount(np.searchsorted(words, o), minlength=len(words)) for o in owned]) if len(words) else np.zeros((len(names), 0))
        sizes = np.array([len(o) for o in owned])
        # The fewest words that make the share; rounding of the product must not ask for one more.
        least = np.ceil(coverage * sizes - 1e-9)
        lists = [o.tolist() for o in owned]
        for batch in batches:
            for part in slices(batch, copy):
                keys, at = word_keys(*text_bytes(part.column(copy)))
                rows = []
                place = np.minimum(np.searchsorted(words, keys), max(len(words) - 1, 0))
                common = words[place] == keys if len(words) else np.zeros(len(keys), bool)
                owner = np.repeat(np.arange(part.num_rows), np.diff(at))[common]
                counts = np.zeros((part.num_rows, len(words)), np.int32)
                np.add.at(counts, (owner, place[common]), 1)
                ids = np.where(common, place, -1)
                for d in range(part.num_rows):
                    bound = np.minimum(holds, counts[d]).sum(1)
                    best, n = None, 0
                    for t in np.flatnonzero((bound >= least) & (sizes > 0)):
                        pairs = best_alignment(keys[at[d] : at[d + 1]].tolist(), ids[at[d] : at[d + 1]], lists[t], holds[t], int(least[t]))
                        share = len(pairs) / int(sizes[t])
                        if pairs and share >= coverage:
                            n += 1
                            one = (share, int(sizes[t]), [-ord(c) for c in names[t]], names[t], len(pairs), pairs[0][0], pairs[-1][0])
                            best = max(best, one) if best else one
                    rows.append((best[3], best[0], *best[4:], n) if best else (None, 0.0, 0, None, None, 0))
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                kinds = [pa.string(), pa.float64(), *[pa.int32()] * 4]
                out = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *out], names=[*kept, *added])

    return plain.mapInArrow(run, schema)


@query("op4_licenses")
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text", keep=["doc_id"])
