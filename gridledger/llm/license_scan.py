"""License notices found by conditional compression.

Blocks of text around cues may hold notices. A block is compressed alone and with each template as a raw zstandard
dictionary; templates that take off a large part of their own size are candidates, those that take off most bytes first.
A candidate is laid on the block word by word, and the wording differences decide: enough words in order, and no word
among the differences that names another license or another version. No license is reported rather than a wrong one.
Between the notices found, the rest of the block is compressed again, until no candidate is confirmed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Notices as their licenses or common practice word them.
GNU = ("This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the"
       " Free Software Foundation, either version {2} of the License, or (at your option) any later version.")
REDISTRIBUTION = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided"
                  " that the following conditions are met")
SOURCE_BINARY = (": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the"
                 " following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this"
                 " list of conditions and the following disclaimer in the documentation and/or other materials provided with"
                 " the distribution.")
ENDORSE = (" 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
           " products derived from this software without specific prior written permission.")
CREATIVE = "This work is licensed under a Creative Commons {} 4.0 International License."
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
                   " compliance with the License. You may obtain a copy of the License at"
                   " http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD", REDISTRIBUTION),
    ("BSD-2-Clause", REDISTRIBUTION + SOURCE_BINARY),
    ("BSD-3-Clause", REDISTRIBUTION + SOURCE_BINARY + ENDORSE),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", CREATIVE.format("Attribution")),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", CREATIVE.format("Attribution-NonCommercial")),
    ("CC-BY-NC-ND", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND", CREATIVE.format("Attribution-NonCommercial-NoDerivatives")),
    ("CC-BY-NC-SA", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA", CREATIVE.format("Attribution-NonCommercial-ShareAlike")),
    ("CC-BY-ND", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND", CREATIVE.format("Attribution-NoDerivatives")),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", CREATIVE.format("Attribution-ShareAlike")),
    ("AGPL", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL", GNU.format("program", "Affero General Public License", "3")),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", GNU.format("program", "General Public License", "3")),
    ("LGPL", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL", GNU.format("library", "Lesser General Public License", "2.1")),
    ("LGPL", GNU.format("program", "Lesser General Public License", "3")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
            " documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    *((name, f"SPDX-License-Identifier: {tag}") for name, tag in [
        ("AGPL", "AGPL-3.0-only"), ("Apache-2.0", "Apache-2.0"), ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"),
        ("GPL", "GPL-3.0-only"), ("LGPL", "LGPL-2.1-only"), ("MIT", "MIT"), ("MPL-2.0", "MPL-2.0")]),
]
# Words by which licenses are told apart. A notice that has one more, or one less, is not the template's.
NAMING = frozenset("""
    affero agpl apache artistic attribution boost bsd by cc cc0 commons creative eclipse epl gnu gpl isc lesser lgpl library
    mit mozilla mpl nc nd noncommercial noderivatives noderivs public sa sharealike unlicense zlib
""".split())
CUE = rb"licen[cs]e|copyright|\bpermission is\b|redistribut|creative commons"
WORD = r"[^\W_]+"
BREAK = re.compile(r"\s*\n[\s#*/;%!>|\-]*")   # a line's end and the comment marks after it
BEFORE, AFTER = 300, 900   # how far a block reaches from a cue, in bytes
LEAST_TAKEN = 0.4          # of a template's own size that it must take off a piece of the block
PIECE_WORDS = 400          # pieces of long blocks, overlapping by half
LEAST_SHARE = 0.75         # of the template's words that must be in the block, in order

FOUND = "array<struct<first_byte: long, end_byte: long, license: string, gain: double, missing: int, added: int>>"


def blocks(raw: bytes, cue: re.Pattern) -> list[tuple[int, int]]:
    """Stretches around the cues, over line ends; overlapping ones join."""
    out: list[tuple[int, int]] = []
    for match in cue.finditer(raw):
        lo, hi = max(0, match.start() - BEFORE), min(len(raw), match.end() + AFTER)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


class Templates:
    """Compressors with a template as dictionary each, and the templates' words."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [name for name, _ in templates]
        self.words = [re.findall(WORD, text.lower()) for _, text in templates]
        self.fixed = [{w for w in words if w in NAMING or w.isdigit() and w in re.findall(r"\d+", name)}
                      for name, words in zip(self.names, self.words)]
        self.numbers = {word: i for i, word in enumerate(sorted({w for words in self.words for w in words}))}
        self.has = [np.isin(np.arange(-1, len(self.numbers)), [self.numbers[w] for w in words]) for words in self.words]
        self.alone = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.given = [
            zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(
                text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, text in templates]
        self.own = [self.taken(i, text.lower())[0] for i, (_, text) in enumerate(templates)]

    def taken(self, i: int, text: str, size: int | None = None) -> tuple[int, int]:
        """Bytes that a template takes off a text in lower case, and the text's size without it.

        Line ends with the comment marks after them count as spaces.
        """
        raw = BREAK.sub(" ", text).encode("utf-8", "surrogateescape")
        size = len(self.alone.compress(raw)) if size is None else size
        return size - len(self.given[i].compress(raw)), size

    def candidates(self, pieces: list[str]) -> list[int]:
        """Templates that take off enough of their own size from some piece, by most bytes first."""
        best = [0] * len(self.names)
        for piece in pieces:
            size = None
            for i in range(len(self.names)):
                less, size = self.taken(i, piece, size)
                best[i] = max(best[i], less)
        return sorted((i for i in range(len(best)) if best[i] >= LEAST_TAKEN * self.own[i]), key=lambda i: (-best[i], i))

    def refuted(self, i: int, missing: list[str], added: list[str]) -> bool:
        """Whether words that differ name another license or another version."""
        return not self.fixed[i].isdisjoint(missing) or not NAMING.isdisjoint(added)

    def stretches(self, i: int, words: list[str], known: np.ndarray) -> set[tuple[int, int, int, int]]:
        """First and end word, template words that lack and words that were added, of stretches that a template's words
        confirm: enough of them in order, and no difference that refutes it."""
        mine = self.words[i]
        wide, least = len(mine) + max(2, len(mine) // 3), LEAST_SHARE * len(mine)
        count = np.concatenate([[0], np.cumsum(self.has[i][known + 1])])
        starts = np.flatnonzero(self.has[i][known + 1])
        starts = starts[count[np.minimum(starts + wide, len(words))] - count[starts] >= least]
        out = set()
        for at in starts.tolist():
            here = words[at:at + wide]
            if sum((Counter(here) & Counter(mine)).values()) < least:
                continue
            same = [m for m in SequenceMatcher(None, mine, here, autojunk=False).get_matching_blocks() if m.size]
            if sum(m.size for m in same) < least:
                continue
            lo, hi = same[0].b, same[-1].b + same[-1].size
            seen, held = set(), set()
            for m in same:
                seen.update(range(m.a, m.a + m.size))
                held.update(range(m.b, m.b + m.size))
            missing = [w for k, w in enumerate(mine) if k not in seen]
            added = [here[k] for k in range(lo, hi) if k not in held]
            if not self.refuted(i, missing, added):
                out.add((at + lo, at + hi, len(missing), len(added)))
        return out

    def match(self, block: bytes) -> list[tuple[int, int, str, float, int, int]]:
        """First and end byte, license, gain, template words the stretch lacks, and words in it that the template lacks.

        Of confirmed stretches that overlap, the one of which its template takes off most bytes stays; what lies between
        those that stay is compressed and searched again, until no template is confirmed.
        """
        text = block.decode("utf-8", "surrogateescape")
        spans = [m.span() for m in re.finditer(WORD, text)]
        words = [text[lo:hi].lower() for lo, hi in spans]
        known = np.array([self.numbers.get(w, -1) for w in words], np.int64)

        def part(first: int, end: int) -> str:
            return text[spans[first][0]:spans[end - 1][1]].lower()

        out, todo = [], [(0, len(words))] if words else []
        while todo:
            lo, hi = todo.pop()
            pieces = [part(at, min(at + PIECE_WORDS, hi)) for at in range(lo, max(hi - PIECE_WORDS // 2, lo + 1), PIECE_WORDS // 2)]
            seen = []
            for i in self.candidates(pieces):
                for first, end, missing, added in self.stretches(i, words[lo:hi], known[lo:hi]):
                    first, end = lo + first, lo + end
                    less, size = self.taken(i, part(first, end))
                    seen.append((-less, missing + added, i, first, end, less / size, missing, added))
            free, found = np.ones(hi - lo, bool), []
            for _, _, i, first, end, gain, missing, added in sorted(seen):
                if free[first - lo:end - lo].all():
                    free[first - lo:end - lo] = False
                    found.append((first, end, self.names[i], gain, missing, added))
            out += found
            if found:
                edge = [lo, *(x for t in sorted(found) for x in t[:2]), hi]
                todo += [(x, y) for x, y in zip(edge[::2], edge[1::2]) if x < y]
        at = [0] if text.isascii() else np.concatenate(
            [[0], np.cumsum([len(c.encode("utf-8", "surrogateescape")) for c in text])]).tolist()
        place = (lambda k: k) if len(at) == 1 else at.__getitem__
        return [(place(spans[first][0]), place(spans[end - 1][1]), *said) for first, end, *said in sorted(out)]


def scan_texts(templates: list[tuple[str, str]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, cue = Templates(templates), re.compile(CUE, re.I)
    kind = pa.list_(pa.struct([("first_byte", pa.int64()), ("end_byte", pa.int64()), ("license", pa.string()),
                               ("gain", pa.float64()), ("missing", pa.int32()), ("added", pa.int32())]))
    for batch in batches:
        found, tried = [], []
        for text in batch.column("text").cast(pa.large_binary()):
            raw = text.as_py() or b""
            here = blocks(raw, cue)
            tried.append(len(here))
            hits = [(lo + m[0], lo + m[1], *m[2:]) for lo, hi in here for m in known.match(raw[lo:hi])]
            found.append([dict(zip(("first_byte", "end_byte", "license", "gain", "missing", "added"), m)) for m in hits])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(tried, pa.int32()), pa.array(found, kind)], ["doc", "n_blocks", "notices"])


def scan_licenses(docs: DataFrame, columns: list[str], templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """``doc`` (the named columns), ``n_blocks`` tried, and the ``notices`` confirmed, per row. No shuffle.

    Whole texts are searched; a null or empty text has no blocks. Repeated notices are listed each, repeated rows too. Of
    templates that tie on a stretch the one with fewer differences stays, then the first. An empty table gives none. The
    named columns travel in ``doc``, so they may clash with no other.
    """
    rows = docs.select(F.struct(*columns).alias("doc"), "text")
    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, n_blocks int, notices {FOUND}"
    return rows.mapInArrow(lambda batches: scan_texts(templates or TEMPLATES, batches), schema)


def license_digest(docs: DataFrame) -> DataFrame:
    """Per document: blocks tried, notices confirmed, distinct licenses in order, words that differ from the templates."""
    found = scan_licenses(docs, ["doc_id"])
    return found.select(
        F.col("doc.doc_id").alias("doc_id"), "n_blocks", F.size("notices").alias("n_notices"),
        F.concat_ws(",", F.array_sort(F.array_distinct("notices.license"))).alias("licenses"),
        F.round(F.array_max("notices.gain"), 6).alias("best_gain"),
        F.aggregate("notices", F.lit(0), lambda n, x: n + x["missing"] + x["added"]).alias("n_differences"))
