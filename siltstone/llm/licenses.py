"""License scans as an exact set-similarity join of text blocks with templates.

A template is a list of words.  A text's blocks for it are runs of twice as many
words that start at multiples of its length, so each run of the template's
length lies whole in a block.  A block matches if it contains at least the
threshold's share of the template's distinct words.  All words are ordered by
their document frequency over all texts, rarest first.  By that order a
matching block must hold one of the template's first few words (prefix filter),
must have enough distinct words (length filter), and enough words must be left
in both behind the first shared one (positional filter); what passes is
verified by the sets themselves.  Phrases are templates with threshold one whose
words must then stand consecutively.

Templates are few and small, so they travel with the job; texts never move.
Null and empty texts have no words; texts of any length are read whole, block by
block.  Rows may repeat and are scanned each where it lies, so a row that a third
of the table repeats is no hot key.  Other columns are ignored, and an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ASCII digits and letters and whatever is not ASCII, in lower-cased UTF-8.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())  # bytes.lower changes A-Z only


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    threshold: float = 0.8
    phrase: bool = False


def template(label: str, text: str, threshold: float = 0.8, phrase: bool = False) -> Template:
    return Template(label, tuple(words_of(text)), 1.0 if phrase else threshold, phrase)


# The phrases to find, and public notices by which works name their license.
BASE = (
    template("mit", "mit license", phrase=True),
    template("apache", "apache license", phrase=True),
    template("gpl", "general public license", phrase=True),
)
NOTICES = (
    template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    template("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    template("gpl", "This work is licensed under the GNU General Public License, version 3"),
    template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    template("cc-by-nc", "Licensed under CC BY-NC 4.0", 1.0),
    template("cc-by-sa", "Licensed under CC BY-SA 4.0", 1.0),
    template("cc-by", "Licensed under CC BY 4.0", 1.0),
)


def frequencies(docs: DataFrame, templates: tuple[Template, ...], text_col: str = "text") -> dict[bytes, int]:
    """Document frequency over all texts of the templates' words (as many rows as these have)."""
    asked = frozenset(w for t in templates for w in t.words)

    def run(batches):
        for batch in batches:
            n: Counter = Counter()
            for x in batch.column(0):
                n.update(asked.intersection(words_of(x.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word binary, n long")
    found = {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: found.get(w, 0) for w in asked}


class Join:
    """The templates' side: prefixes as an inverted index, in the order of the frequencies."""

    def __init__(self, templates: tuple[Template, ...], df: dict[bytes, int]):
        self.templates = templates
        self.rank = {w: i for i, w in enumerate(sorted(df, key=lambda w: (df[w], w)))}
        self.need, self.sets, self.index = [], [], {}
        for k, t in enumerate(templates):
            ordered = sorted(set(t.words), key=self.rank.__getitem__)
            need = max(1, math.ceil(t.threshold * len(ordered) - 1e-9))
            self.need.append(need)
            self.sets.append(frozenset(ordered))
            for i, w in enumerate(ordered[: len(ordered) - need + 1]):
                self.index.setdefault(w, []).append((k, len(ordered) - i))

    def blocks(self, words: list[bytes]):
        """(template number, first word of the block, containment) for every block that matches, in order."""
        index, rank = self.index, self.rank
        hits = [(i, w) for i, w in enumerate(words) if w in index]
        tried = {}
        for i, w in hits:
            for k, left in index[w]:
                n = len(self.templates[k].words)
                for b in {i // n, max(0, i // n - 1)}:
                    tried.setdefault((k, b), []).append((w, left))
        for (k, b), shared in sorted(tried.items()):
            n, need = len(self.templates[k].words), self.need[k]
            block = set(words[b * n : b * n + 2 * n])
            if len(block) < need:
                continue
            first, left = min(shared, key=lambda x: rank[x[0]])
            behind = sum(1 for w in block if rank.get(w, -1) >= rank[first])  # words without a rank are in no template
            if min(left, behind) < need:
                continue
            same = len(block & self.sets[k])
            if same >= need:
                yield k, b * n, same / len(self.sets[k])

    def places(self, words: list[bytes], k: int, at: int) -> list[int]:
        """Where in a block a phrase's words stand consecutively."""
        phrase = list(self.templates[k].words)
        n = len(phrase)
        return [i for i in range(at, min(at + 2 * n, len(words) - n + 1)) if words[i : i + n] == phrase]


SCHEMA = "doc_id long, n_words long, phrases array<struct<label:string,at:long>>, notices array<struct<label:string,at:long,containment:double>>"


def scan(docs: DataFrame, phrases: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA: each place of a phrase, by place; each block that meets a notice's
    threshold, with its first word and containment."""
    templates = phrases + notices
    joined = Join(templates, frequencies(docs, templates, text_col))

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), 2000):
                part, counts, found, blocks = batch.slice(start, 2000), [], [], []
                for x in part.column(1):
                    words = words_of(x.as_py())
                    places, notes = set(), []
                    for k, at, share in joined.blocks(words):
                        if templates[k].phrase:
                            places.update((i, templates[k].label) for i in joined.places(words, k, at))
                        else:
                            notes.append({"label": templates[k].label, "at": at, "containment": share})
                    counts.append(len(words))
                    found.append([{"label": label, "at": i} for i, label in sorted(places)])
                    blocks.append(notes)
                place = pa.struct([("label", pa.string()), ("at", pa.int64())])
                note = pa.struct([("label", pa.string()), ("at", pa.int64()), ("containment", pa.float64())])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(place)), pa.array(blocks, pa.list_(note))], names=["doc_id", "n_words", "phrases", "notices"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
