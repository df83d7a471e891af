"""License scans over a positional index of rare template words."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

# Phrases with their labels, each a template that is its own mandatory key phrase.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Openings of well-known public licence notices, with the phrase that each must contain.
NOTICES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "permission is hereby granted free of charge",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    "apache-2.0": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "apache license version 2 0",
    ),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "redistribute it and or modify it under the terms of the gnu",
    ),
    "lgpl": ("this library is free software you can redistribute it under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    "cc-by-sa": ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    "cc-by-nc": ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    "unlicense": ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "free and unencumbered software released into the public domain"),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "in no event will the authors be held liable for any damages arising from the use of this software",
    ),
    "epl-2.0": ("this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", "eclipse public license"),
    "agpl": ("it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    "bsl-1.0": ("distributed under the boost software license version 1 0 see accompanying file", "boost software license version 1 0"),
    "ofl-1.1": ("this font software is licensed under the sil open font license version 1 1 this license is copied below", "sil open font license"),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
}

_CUT = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words(text: str) -> list[bytes]:
    """A-Z lower-cased; runs of digits, letters and anything beyond ASCII."""
    return text.encode("utf-8").translate(_CUT).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    key: tuple[bytes, ...]
    base: bool

    @property
    def key_at(self) -> int:
        n = len(self.key)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key)


def templates(phrases: dict[str, str] | None = None, notices: dict[str, tuple[str, str]] | None = None) -> list[Template]:
    cut = lambda s: tuple(words(s))
    return [Template(v, cut(k), cut(k), True) for k, v in (PHRASES if phrases is None else phrases).items()] + [
        Template(k, cut(t), cut(key), False) for k, (t, key) in (NOTICES if notices is None else notices).items()
    ]


class Index:
    """Postings (template, position) of the rarest words of each template.

    A phrase's places all contain its rarest word, so posting that one word finds every place. A
    notice posts its ``rare`` rarest words, two of which must agree on where the notice would begin.
    """

    def __init__(self, known: list[Template], df: dict[bytes, int], n_docs: int, rare: int = 6):
        self.known, self.idf = known, {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) for t in known for w in t.words}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for k, t in enumerate(known):
            order = sorted(set(t.words), key=lambda w: (-self.idf[w], w))
            for w in order[: 1 if t.base else rare]:
                self.postings.setdefault(w, []).extend((k, i) for i, x in enumerate(t.words) if x == w)
        self.rare = frozenset(self.postings)

    def scan(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], dict[str, float]]:
        """Places (start, template) of phrases, and the score of each other label found."""
        if self.rare.isdisjoint(doc):
            return [], {}
        found: Counter = Counter()
        for at, w in enumerate(doc):
            for k, i in self.postings.get(w, ()):
                found[k, at - i] += 1
        places, scores = [], {}
        for (k, start), hits in found.items():
            t = self.known[k]
            if t.base:
                if start >= 0 and tuple(doc[start : start + len(t.key)]) == t.key:
                    places.append((start, k))
            elif hits >= 2:
                key_from = start + t.key_at
                if key_from >= 0 and tuple(doc[key_from : key_from + len(t.key)]) == t.key:
                    window = range(max(0, -start), min(len(t.words), len(doc) - start))
                    scores[t.label] = max(scores.get(t.label, 0.0), sum(doc[start + i] == t.words[i] for i in window) / len(t.words))
        return places, scores


def document_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """How many documents hold each template word, over all documents; the counts are as many as the vocabulary."""

    def run(batches):
        df: Counter = Counter()
        n = 0
        for b in slices(batches):
            for t in b.column(1).to_pylist():
                df.update(vocabulary.intersection(words(t)))
                n += 1
        got = [(w.decode("utf-8"), c) for w, c in df.items()] + [("", n)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in got]), pa.array([c for _, c in got], pa.int64())], ["word", "n"])

    counts = {r["word"]: r["n"] for r in docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w.encode("utf-8"): c for w, c in counts.items() if w}, counts.get("", 0)


def scan_licenses(docs: DataFrame, known: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence phrases and notices of every whole text.

    A first pass counts the document frequency of the template words over all documents; a second
    looks up the words with the highest IDF, intersects postings by relative position and verifies each
    template's mandatory key phrase word by word. n_base counts all places of phrases; first_word and last_word are their
    smallest and largest start, null without any; labels adds the notices found; score is 1 for a
    phrase, else the share of the best notice's words in place, 0 without labels. Null and empty texts have no words.
    Repeated rows are scanned one by one; an empty table gives no rows. Two narrow passes, no shuffle of text.
    """
    known = templates() if known is None else known
    rows = texts(docs, id_col, text_col)
    index = Index(known, *document_frequencies(rows, {w for t in known for w in t.words}))

    def run(batches):
        for b in slices(batches):
            out = []
            for t in b.column(1).to_pylist():
                doc = words(t)
                places, scores = index.scan(doc)
                base = {index.known[k].label for _, k in places}
                starts = [s for s, _ in places]
                score = 1.0 if places else max(scores.values(), default=0.0)
                out.append((len(doc), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | scores.keys())), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], SCHEMA_NAMES)

    return rows.mapInArrow(run, SCHEMA)


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
