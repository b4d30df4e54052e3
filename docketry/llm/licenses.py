"""License scans by conditional compression.

A text is searched whole, over its line ends. Wherever the rarest of a statement's telling words stands and the others
are near, a window of the statement's length and a few words more is compressed twice with the same parameters: alone,
and with the licence's templates as a raw zstandard dictionary. The window is a candidate if the dictionary saves enough
bytes. What is enough is calibrated for each statement on edited forms of it that the wording may still accept, at half
of what the worst of them saves less NOISE bytes; every statement is tried, and no number of winners is kept. Candidates are
confirmed by their exact wording: a statement counts if every word that tells it from other licences is there and at
least `similarity` of its words match in order. Of one licence's statements that overlap, the one whose passage saves
most stays. The words that differ are reported, and by what share the dictionary makes the passage smaller.

Words are compressed as they are compared: lower-cased, without punctuation around them, LONGEST characters at most.

Null or empty text: no rows. A line of any length is searched whole, and a statement may be wrapped over lines. Rows that repeat
are reported each for itself; a null id is kept.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The usual notices of public licences, and the words that tell each from the others.
TEMPLATES: dict[str, list[tuple[str, str]]] = {
    "Apache-2.0": [
        ("Licensed under the Apache License, Version 2.0.", "apache 2.0"),
        ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', "apache 2.0"),
    ],
    "MIT": [
        ("Released under the MIT License.", "mit license"),
        ("Licensed under the MIT License.", "mit license"),
        ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction', "granted deal software"),
    ],
    "GPL-3.0": [
        ("This work is licensed under the GNU General Public License, version 3.", "gnu general 3"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu general 3"),
    ],
    "GPL-2.0": [
        ("This work is licensed under the GNU General Public License, version 2.", "gnu general 2"),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gnu general 2"),
    ],
    "LGPL-3.0": [("This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser 3")],
    "AGPL-3.0": [("This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero 3")],
    "BSD": [
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution binary conditions"),
        ("Licensed under the BSD License.", "bsd license"),
    ],
    "MPL-2.0": [("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2.0")],
    "ISC": [("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "distribute fee granted")],
    "Unlicense": [("This is free and unencumbered software released into the public domain.", "unencumbered public domain")],
    "CC-BY-4.0": [("Licensed under CC BY 4.0.", "cc by 4.0"), ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative attribution 4.0")],
    "CC-BY-SA-4.0": [("Licensed under CC BY-SA 4.0.", "cc by-sa 4.0")],
    "CC-BY-NC-4.0": [("Licensed under CC BY-NC 4.0.", "cc by-nc 4.0")],
    "CC0-1.0": [("To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0", "waived cc0")],
    "All-rights-reserved": [("All rights reserved.", "all rights reserved")],
}

#: Words that a window takes on either side of a statement's place, the characters of a word that are compressed, and the
#: bytes by which the coding of long foreign words may blur a saving.
MARGIN, LONGEST, NOISE = 3, 48, 8


def wording(text: str) -> list[str]:
    return [w.strip(".,;:()\"'*#/!?").lower() for w in text.split()]


class Scanner:
    """Compressors and statements, made once for each worker."""

    def __init__(self, templates: dict[str, list[tuple[str, str]]], similarity: float):
        import zstandard as z

        self.similarity = similarity
        # the same parameters with and without a dictionary: otherwise they follow its size; short matches count, and the parsing is the cheapest
        shape = {"strategy": z.STRATEGY_BTULTRA2, "window_log": 12, "chain_log": 10, "hash_log": 10, "search_log": 6, "min_match": 3, "target_length": 256}
        params = z.ZstdCompressionParameters(**shape, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.plain = z.ZstdCompressor(compression_params=params)
        self.statements = {name: [(wording(text), set(telling.split())) for text, telling in own] for name, own in templates.items()}
        self.anchors = anchors(templates)
        raw = {name: b" ".join(written(words) for words, _ in own) for name, own in self.statements.items()}
        self.given = {name: z.ZstdCompressor(compression_params=params, dict_data=z.ZstdCompressionDict(text, dict_type=z.DICT_TYPE_RAWCONTENT)) for name, text in raw.items()}

        self.least = {name: [self.floor(name, words) for words, _ in own] for name, own in self.statements.items()}

    def saving(self, name: str, words: list[str]) -> tuple[int, float]:
        """Bytes that the licence's dictionary saves, and their share."""
        raw = written(words)
        alone = len(self.plain.compress(raw))
        saved = alone - len(self.given[name].compress(raw))
        return saved, saved / alone

    def floor(self, name: str, statement: list[str], forms: int = 48) -> float:
        """Half of the least saving on forms that the wording may accept: words replaced, the longest first, and others put in, as many as a window holds."""
        rng, n = random.Random(7), len(statement)
        spare, least = n - math.ceil(self.similarity * n - 1e-9), math.inf
        longest = sorted(range(n), key=lambda i: -len(statement[i]))
        for k in range(forms):
            letters = "etaoinshrdlu" if k % 2 else "abcdefghijklmnopqrstuvwxyz"
            other = lambda: "".join(rng.choices(letters, k=rng.randint(1, 12)))  # noqa: B023, E731
            gone = set((longest if k % 4 < 2 else rng.sample(range(n), n))[: rng.randint(0, spare) if k % 3 else spare])
            form = [other() if i in gone else w for i, w in enumerate(statement)]
            for _ in range(rng.randint(0, 2 * MARGIN) if k % 3 else 2 * MARGIN):
                form.insert(rng.randint(0, len(form)), other())
            least = min(least, self.saving(name, form)[0])
        return least / 2 - NOISE

    def confirmed(self, lines: list[str]) -> list[tuple[int, int, str, float, float, str]]:
        """(first line, last line, licence, reduction, similarity, differences) of every statement that holds; of those that overlap, one licence's best."""
        words, line_of = [], []
        for i, line in enumerate(lines):
            own = [w for w in wording(line) if w]  # comment marks are no words
            words += own
            line_of += [i] * len(own)
        places: dict[str, list[int]] = {w: [] for own in self.anchors.values() for w in own}
        for i, w in enumerate(words):
            if w in places:
                places[w].append(i)
        out = []
        for name, own in self.statements.items():
            found = []
            for (statement, telling), anchor, least in zip(own, self.anchors[name], self.least[name]):
                first = statement.index(anchor)
                for at in places[anchor]:
                    low = max(0, at - first - MARGIN)
                    near = words[low : max(0, at - first + len(statement) + MARGIN)]
                    if not telling <= set(near) or self.saving(name, near)[0] < least:
                        continue
                    match = SequenceMatcher(None, statement, near, autojunk=False)
                    parts = [m for m in match.get_matching_blocks() if m.size]
                    alike = sum(m.size for m in parts) / len(statement)
                    if alike >= self.similarity:
                        a, b = low + parts[0].b, low + parts[-1].b + parts[-1].size
                        saved, share = self.saving(name, words[a:b])
                        found.append((-saved, -alike, a, b, share, statement))
            taken: list[tuple[int, int]] = []
            for _, alike, a, b, share, statement in sorted(found):
                if any(a < y and x < b for x, y in taken):
                    continue
                taken.append((a, b))
                steps = SequenceMatcher(None, statement, words[a:b], autojunk=False).get_opcodes()
                differences = "; ".join(f"{' '.join(statement[i:j])} -> {' '.join(words[a + c : a + d])}" for kind, i, j, c, d in steps if kind != "equal")
                out.append((line_of[a], line_of[b - 1], name, round(share, 6), round(-alike, 6), differences))
        return sorted(out)


def written(words: list[str]) -> bytes:
    return f" {' '.join(w[:LONGEST] for w in words)} ".encode("utf-8", "surrogatepass")


def anchors(templates: dict[str, list[tuple[str, str]]]) -> dict[str, list[str]]:
    """Of each statement's telling words, all of which must be there, the one that is rarest among the statements."""
    seen = Counter(w for own in templates.values() for text, _ in own for w in set(wording(text)))
    return {name: [min(telling.split(), key=lambda w: (seen[w], -len(w), w)) for _, telling in own] for name, own in templates.items()}


def scan(docs: DataFrame, *, id_col="doc_id", text_col="text", templates=None, similarity=0.8) -> DataFrame:
    """(id, first_line, last_line, license, reduction, similarity, differences): one row for each statement confirmed; lines from 0."""
    id_type, templates = docs.schema[id_col].dataType.simpleString(), templates or TEMPLATES
    # each statement's rarest telling word: a text with none of them holds no statement
    cue = "(?iu)" + "|".join(sorted({re.escape(w) for own in anchors(templates).values() for w in own}))
    names = ["id", "first_line", "last_line", "license", "reduction", "similarity", "differences"]

    def run(batches):
        scanner = Scanner(templates, similarity)
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                out += [(key, *found) for found in scanner.confirmed(text.as_py().split("\n"))]
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(cue))
    return chosen.mapInArrow(run, f"id {id_type}, first_line long, last_line long, license string, reduction double, similarity double, differences string")
