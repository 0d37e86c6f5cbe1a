"""Operator 7: license scan by a positional index of rare words.

Templates are indexed by word and position. A word's rarity is its inverse
document frequency over all scanned documents. Of each template whose phrases'
words are all in the file, its own rarest words and its phrases' words are
looked up; each occurrence votes for a shift between positions, and shifts on
which words agree become candidates. A candidate counts if the mandatory key
phrases stand in the file where the shift puts them. The words of a phrase
agree wherever it stands, so no notice is lost to others in the same file. A
file that lacks a word of every template's phrases can have no license, so only
the others are looked up.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.chunks import ChunkPool, segments, slices, text_array
from quern.session import materialize, ship_code

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*").findall
#: A template's rarest words that are looked up, beside its phrases' words.
RARE = 24
#: How far key phrases may stand from where the shift puts them, in words. A
#: notice of several phrases with more words put in between than this isn't one;
#: a notice of one phrase is found wherever the phrase stands.
SLACK = 6
_SLICE = 4_000_000


@dataclass(frozen=True)
class Template:
    name: str
    text: str
    phrases: tuple[str, ...]  # each must be in the text


TEMPLATES = (
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2.0",)),
    Template("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', ("apache license version 2.0", "except in compliance with the license")),
    Template("MIT", "Released under the MIT License", ("under the mit license",)),
    Template("MIT", "Licensed under the MIT License", ("under the mit license",)),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "software and associated documentation files")),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("GPL-2.0", "This program is licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template("GPL-3.0-or-later", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license as published by the free software foundation", "either version 3 of the license")),
    Template("GPL-2.0-or-later", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license as published by the free software foundation", "either version 2 of the license")),
    Template("LGPL-3.0", "under the terms of the GNU Lesser General Public License, version 3", ("gnu lesser general public license version 3",)),
    Template("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3", ("gnu affero general public license version 3",)),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4.0",)),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4.0",)),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0", ("cc by 4.0",)),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4.0 international license",)),
    Template("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal", ("cc0 1.0",)),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2.0",)),
    Template("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "provided that the following conditions are met")),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    Template("BSL-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license version 1.0",)),
    Template("Unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
)


def words(text: str) -> list[str]:
    """Lower-cased words of a text; digits keep their inner points."""
    return [w for c in text.split(" ") for w in _WORD(c.lower())]


class Index:
    """Positional index of the templates' words."""

    def __init__(self, templates: Sequence[Template]):
        self.templates = list(templates)
        self.words = [words(t.text) for t in templates]
        self.vocabulary = sorted({w for ws in self.words for w in ws})
        self.code = {w: i for i, w in enumerate(self.vocabulary)}
        #: positions of each word, by template
        self.postings: list[dict[int, list[int]]] = [{} for _ in templates]
        for t, ws in enumerate(self.words):
            for at, w in enumerate(ws):
                self.postings[t].setdefault(self.code[w], []).append(at)
        self.phrases = []
        for t, template in enumerate(templates):
            own = []
            for p in template.phrases:
                ws = words(p)
                at = next((i for i in range(len(self.words[t]) - len(ws) + 1) if self.words[t][i : i + len(ws)] == ws), None)
                if at is None:
                    raise ValueError(f"{template.name}: its text lacks the phrase {p!r}")
                own.append((at, [self.code[w] for w in ws]))
            self.phrases.append(own)
        #: words that a file must have for the template to count
        self.needed = [np.unique([c for _, ws in own for c in ws]).astype(np.int64) for own in self.phrases]

    def eligible(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words each file has, and which files have all the words that
        some template needs."""
        size, n = len(self.vocabulary), len(offsets) - 1
        hit = codes >= 0
        present = np.zeros(n * size, bool)
        present[segments(offsets)[hit] * size + codes[hit]] = True
        present = present.reshape(n, size)
        some = np.zeros(n, bool)
        for needed in self.needed:
            some |= present[:, needed].all(1)
        return present, some

    def pool(self) -> ChunkPool:
        get = self.code.get
        return ChunkPool(lambda cs: [[get(w, -1) for w in _WORD(c.lower())] for c in cs], np.int32, limit=400_000)

    def scan(self, codes: np.ndarray, idf: Sequence[float], rare: int = RARE, slack: int = SLACK) -> list[tuple[str, int, int, float]]:
        """Licenses of one file: (name, first word, looked-up words that agree,
        share of the template's words in place). ``codes`` has a vocabulary
        code, or -1, for every word of the file."""
        at = np.flatnonzero(codes >= 0)
        own = codes[at]
        order = np.argsort(own, kind="stable")
        present, first = np.unique(own[order], return_index=True)
        places = dict(zip(present.tolist(), np.split(at[order], first[1:])))
        found: dict[tuple[str, int], tuple[float, int, int]] = {}
        for t, needed in enumerate(self.needed):
            if not all(c in places for c in needed.tolist()):
                continue
            starts = [self._starts(codes, places, ws, idf) for _, ws in self.phrases[t]]
            if not all(map(len, starts)):
                continue
            inner, ws = self.postings[t], self.words[t]
            looked = {*sorted((c for c in inner if c in places), key=lambda c: (-idf[c], c))[:rare], *needed.tolist()}
            votes = [np.unique(np.subtract.outer(places[c], inner[c])) for c in looked]
            shifts, agreed = np.unique(np.concatenate(votes), return_counts=True)
            good = agreed >= min(2, len(looked))
            for (p, _), own_starts in zip(self.phrases[t], starts):
                good &= np.searchsorted(own_starts, shifts + p - slack) < np.searchsorted(own_starts, shifts + p + slack, "right")
            for shift, n in zip(shifts[good].tolist(), agreed[good].tolist()):
                share = sum(0 <= shift + i < len(codes) and codes[shift + i] == self.code[w] for i, w in enumerate(ws)) / len(ws)
                key = (self.templates[t].name, max(shift, 0))
                if key not in found or (share, n) > found[key][:2]:
                    found[key] = (share, n, len(ws))
        return self._apart(found)

    @staticmethod
    def _starts(codes: np.ndarray, places: Mapping[int, np.ndarray], phrase: list[int], idf: Sequence[float]) -> np.ndarray:
        """Where a phrase stands, in order, from the places of its rarest word."""
        rarest = max(range(len(phrase)), key=lambda i: idf[phrase[i]])
        starts = places[phrase[rarest]] - rarest
        starts = starts[(starts >= 0) & (starts <= len(codes) - len(phrase))]
        for i, c in enumerate(phrase):
            starts = starts[codes[starts + i] == c]
        return starts

    @staticmethod
    def _apart(found: Mapping[tuple[str, int], tuple[float, int, int]]) -> list[tuple[str, int, int, float]]:
        """Of overlapping matches of one license the one in which most words
        are in place; at equal numbers the better share, then the first."""
        ranked = sorted(found.items(), key=lambda x: (-round(x[1][0] * x[1][2]), -x[1][0], x[0][1], x[0][0]))
        out: list[tuple[str, int, int, float]] = []
        spans: list[tuple[str, int, int]] = []
        for (name, start), (share, agreed, size) in ranked:
            if any(n == name and start < e and s < start + size for n, s, e in spans):
                continue
            spans.append((name, start, start + size))
            out.append((name, start, agreed, round(share, 4)))
        return sorted(out, key=lambda x: (x[1], x[0]))


def _coded(index: Index, batches: Iterator[pa.RecordBatch]):
    pool = index.pool()
    for batch in batches:
        whole = text_array(batch, "text")
        for a, b in slices(whole, _SLICE):
            codes, offsets = pool.documents(whole.slice(a, b - a))
            yield batch.slice(a, b - a), codes, offsets


def _encode(df: DataFrame, index: Index, id_col: str, text_col: str) -> DataFrame:
    """One pass over whole texts: files that may have a license as (id, codes),
    and each task's document frequencies as (code, n), code -1 for all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(index.vocabulary)
        total, seen, kind = 0, np.zeros(size, np.int64), None
        for rows, codes, offsets in _coded(index, batches):
            kind = rows.column("id").type
            present, some = index.eligible(codes, offsets)
            total += len(present)
            seen += present.sum(0)
            at = np.flatnonzero(some)
            raw = [codes[offsets[i] : offsets[i + 1]].astype(np.int32).tobytes() for i in at]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.int64()), rows.column("id").take(pa.array(at)), pa.array(raw, pa.binary())], ["code", "n", "id", "codes"])
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(size)], pa.int32()), pa.array([total, *seen.tolist()], pa.int64()), pa.nulls(size + 1, kind), pa.nulls(size + 1, pa.binary())], ["code", "n", "id", "codes"])

    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"code int, n bigint, id {slim.schema['id'].dataType.simpleString()}, codes binary")


def scan_licenses(df: DataFrame, templates: Sequence[Template] = TEMPLATES, rare: int = RARE, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses found in each row: (id, license, first_word, rare_words, in_place).

    One row per found notice, so a file with several gives several and one
    with none gives none; repeated rows are repeated. ``first_word`` counts
    words from 0, ``rare_words`` are the looked-up words that agree on the
    place (the template's ``rare`` rarest and those of its phrases), ``in_place`` is the share of the template's words that stand where
    they should. Null and empty texts have no license. Equal rarity is ordered
    by word. Further columns are left out. One pass over whole texts counts
    document frequencies and writes the words of files that may have a license
    to the shared folder; no shuffle but of those counts.
    """
    ship_code(df.sparkSession)
    index = Index(templates)
    encoded = materialize(_encode(df, index, id_col, text_col), "license-words")
    sums = {r["code"]: r["n"] for r in encoded.where("code IS NOT NULL").groupBy("code").agg(F.sum("n").alias("n")).collect()}
    idf = [math.log((1 + sums.get(-1, 0)) / (1 + sums.get(i, 0))) for i in range(len(index.vocabulary))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, raw in enumerate(batch.column("codes").to_pylist()):
                for match in index.scan(np.frombuffer(raw, np.int32), idf, rare, slack):
                    at.append(i)
                    out.append(match)
            cols = list(zip(*out)) or [()] * 4
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", "license", "first_word", "rare_words", "in_place"])

    files = encoded.where("codes IS NOT NULL").select("id", "codes")
    kind = files.schema["id"].dataType.simpleString()
    return files.mapInArrow(run, f"id {kind}, license string, first_word bigint, rare_words int, in_place double").withColumnRenamed("id", id_col)
