"""License notices in texts, by conditional compression.

A stretch of text that repeats a template costs almost nothing to compress once the compressor
knows the template. Around every cue word the words of the text are aligned with those of each
template, as far to both sides as the template can reach. A stretch that holds enough of the template's
words and few others in between is compressed with zstandard alone and with the template as raw
dictionary, and is a notice if that saves enough of its size.

Only words are aligned, so a notice may stand anywhere in a line, go on over several lines, and have
comment marks in front of them. Of overlapping notices the one that holds most words, less those
missing and added, is reported; all that do not overlap are.

Defined cases: a missing or empty text has no blocks. Rows are scanned one by one and whole, so
repeated rows repeat their results. Ties go to the first template by name.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .tokens import with_fields

# Wording of common public notices. A caller may pass templates of its own.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0 terms": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
    'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met:",
    "BSD notice": "Licensed under the BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT terms": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
}
# Words of a cue may stand on two lines, with comment marks between them.
CUE = re.compile(
    r"licen[sc]|copyright|all\W{1,80}rights\W{1,80}reserved|public\W{1,80}domain|redistribut|permission\W{1,80}(?:is|to)"
    r"|warrant|\bCC\W{0,80}(?:BY|0)\b", re.I
)
CUES = ("licen", "copyright", "reserved", "domain", "redistribut", "permission", "warrant", "cc")
WORD = re.compile(r"\w+(?:[.-]\w+)*")
LEVEL = 3
# A winner saves this share of the size, holds this share of the template's words, and may have
# this share of other words between them.
LEAST_SAVED, LEAST_WORDS, MOST_EXTRA = 0.3, 0.8, 0.25
# Comment marks at the beginning of a line; a sentence's end, which belongs to its notice.
MARKS = re.compile(r"\n[\s#*/;%!<>|-]*")
STOP = re.compile(r"[.!?]?")


class Matcher:
    """Finds the notices of one text."""

    def __init__(self, templates: Mapping[str, str] = TEMPLATES):
        self.names = sorted(templates)
        self.words = {n: WORD.findall(templates[n].lower()) for n in self.names}
        self.alone = zstandard.ZstdCompressor(LEVEL)
        self.given = {
            n: zstandard.ZstdCompressor(
                LEVEL, dict_data=zstandard.ZstdCompressionDict(_shape(templates[n]), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            )
            for n in self.names
        }

    def saved(self, stretch: str, name: str) -> float:
        """The share of a stretch's size that a template saves."""
        data = _shape(MARKS.sub(" ", stretch))
        return 1 - len(self.given[name].compress(data)) / len(self.alone.compress(data))

    def aligned(self, name: str, own: list[str], cue: int) -> tuple[int, int, int] | None:
        """(first word, last word + 1, words held) of the template's best stretch around word `cue`."""
        words = self.words[name]
        reach = int(len(words) * (1 + MOST_EXTRA))
        low, high = max(0, cue - reach), cue + 1 + reach
        while True:
            part = own[low:high]
            known = set(part)
            if sum(w in known for w in words) < LEAST_WORDS * len(words):
                return None
            same = [m for m in difflib.SequenceMatcher(None, words, part, autojunk=False).get_matching_blocks() if m.size]
            found = []
            for i in range(len(same)):
                held = 0
                for m in same[i:]:
                    held += m.size
                    start, end = low + same[i].b, low + m.b + m.size
                    if start <= cue < end and held >= LEAST_WORDS * len(words) and end - start - held <= MOST_EXTRA * len(words):
                        found.append((len(words) + end - start - 3 * held, start, end, held))
            if found:
                return min(found)[1:]
            # the words of another notice: look at what is left on the side of the cue
            longest = max(same, key=lambda m: m.size)
            if low + longest.b + longest.size <= cue:
                low += longest.b + longest.size
            elif low + longest.b > cue:
                high = low + longest.b
            else:
                return None

    def notices(self, text: str | None) -> list[tuple]:
        """(start, end, template, share saved, words, words missing, words added) in order of start."""
        low = (text or "").lower()
        if not any(cue in low for cue in CUES):
            return []
        cues = [cue.start() for cue in CUE.finditer(text)]
        if not cues:
            return []
        places = [m.span() for m in WORD.finditer(text)]
        own = [text[s:e].lower() for s, e in places]
        heads = [s for s, _ in places]
        found = set()
        for cue in sorted({bisect_right(heads, at) - 1 for at in cues}):
            for name in self.names:
                stretch = self.words[name] and self.aligned(name, own, cue)
                if stretch:
                    found.add((name, *stretch))
        ranked = []
        for name, first, last, held in found:
            start, end = places[first][0], STOP.match(text, places[last - 1][1]).end()
            saved = self.saved(text[start:end], name)
            if saved >= LEAST_SAVED:
                size = len(self.words[name])
                missing, added = size - held, last - first - held
                ranked.append((missing + added - held, missing + added, -saved, name, start, end, size, missing, added))
        out: list[tuple] = []
        for _, _, saved, name, start, end, size, missing, added in sorted(ranked):
            if all(end <= s or e <= start for s, e, *_ in out):
                out.append((start, end, name, -saved, size, missing, added))
        return sorted(out)


def _shape(text: str) -> bytes:
    return " ".join(text.lower().split()).encode()


def find_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, text: str = "text") -> DataFrame:
    """One row per notice: doc_id, start, end (code points), license, saved, n_words, n_missing, n_added, exact."""
    templates = dict(templates)
    fields = "start bigint, `end` bigint, license string, saved double, n_words bigint, n_missing bigint, n_added bigint, exact boolean"
    names = ["doc_id", *(f.split()[0].strip("`") for f in fields.split(", "))]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates)
        for batch in batches:
            at, rows = [], []
            for i, value in enumerate(batch.column(text)):
                for notice in matcher.notices(value.as_py()):
                    at.append(i)
                    rows.append((*notice, notice[5] == notice[6] == 0))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=names,
            )

    source = docs.select("doc_id", f"`{text}`")
    return source.mapInArrow(find, with_fields(source.select("doc_id"), fields))
