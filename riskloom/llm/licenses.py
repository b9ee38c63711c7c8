"""Licence scan by a positional index of rare words.

Templates are short licence notices.  Their key phrases are mandatory: a file
carries a template's licence where the key phrase stands at one place, word
for word.  Over the whole corpus the document frequency of every licence word
is counted; a template is indexed under the words of its key phrase with the
highest IDF.  A file is looked up by those of its words: each occurrence minus
the word's place in the template is the one place the template could start,
the postings of the rare words are intersected on that relative position, the
key phrase is verified there, and the share of the template's words that agree
is the match's score.

Defined cases: null and empty texts have no words; the same place counts once
for a label; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import column, slices
from .tokens import ALNUM, Members, row_of, split_words, word_hashes


@dataclass(frozen=True)
class Template:
    """A notice; ``key`` is the mandatory phrase within it."""

    label: str
    text: str
    key: str
    base: bool = False

    def words(self) -> list[str]:
        return split_words(pa.array([self.text]), ALNUM)[0].to_pylist()

    def key_at(self) -> tuple[int, int]:
        w, k = self.words(), split_words(pa.array([self.key]), ALNUM)[0].to_pylist()
        return next(i for i in range(len(w)) if w[i:i + len(k)] == k), len(k)


#: fixed values: the phrases and labels that every scan reports
BASE = (Template("cc-by", "cc by", "cc by", True),
        Template("gpl", "general public license", "general public license", True),
        Template("reserved", "all rights reserved", "all rights reserved", True))

#: fixed values: common notices and the phrase that identifies each
NOTICES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", "Apache License"),
    Template("mit", "Released under the MIT License", "MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy "
             "of this software and associated documentation files",
             "Permission is hereby granted, free of charge"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without "
             "modification, are permitted provided that the following conditions are met",
             "Redistribution and use in source and binary forms"),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3",
             "GNU General Public License, version 3"),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2",
             "GNU General Public License, version 2"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License",
             "Lesser General Public License"),
    Template("agpl", "under the terms of the GNU Affero General Public License",
             "Affero General Public License"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public "
             "License, v. 2.0", "Mozilla Public License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", "CC BY-NC"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", "CC BY-SA"),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", "CC BY-ND"),
    Template("cc0", "dedicated to the public domain under CC0 1.0", "CC0 1.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain",
             "free and unencumbered software"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any "
             "purpose with or without fee is hereby granted",
             "Permission to use, copy, modify, and/or distribute this software"),
)


class Index:
    """Postings of each template's rarest key words."""

    def __init__(self, templates, df: dict[str, int], n_docs: int, rare: int):
        self.templates, self.hashes, self.rare, self.keys = templates, [], [], []
        looked = []
        for t in templates:
            words, (at, n) = t.words(), t.key_at()
            h = word_hashes(pa.array(words))
            # log((n + 1) / (df + 1)) falls as the frequency rises: order by frequency
            by_idf = sorted({words[i] for i in range(at, at + n)},
                            key=lambda w: (df.get(w, 0), w))[:rare]
            self.hashes.append(h)
            self.keys.append((at, n))
            self.rare.append([(int(word_hashes(pa.array([w]))[0]),
                               [i for i, x in enumerate(words) if x == w]) for w in by_idf])
            looked += [r[0] for r in self.rare[-1]]
        self.members = Members(np.array(looked, dtype=np.uint64))
        self.n_docs = n_docs

    def places(self, h: np.ndarray, rows: np.ndarray):
        """(template, start, share of agreeing words) of every verified place;
        ``start`` may lie before the text if only the template's end is there."""
        at, j = self.members.find(h)
        if not len(at):
            return
        where = {int(v): at[j == i] for i, v in enumerate(self.members.values)
                 if (j == i).any()}
        for t, (key_at, n) in enumerate(self.keys):
            starts = None
            for word, spots in self.rare[t]:
                own = where.get(word, at[:0])
                mine = np.unique(np.concatenate([own - s for s in spots]))
                starts = mine if starts is None else np.intersect1d(starts, mine)
                if not len(starts):
                    break
            else:
                first = starts + key_at
                starts = starts[(first >= 0) & (first + n <= len(h))]
                first = starts + key_at
                starts = starts[rows[first] == rows[first + n - 1]]
                words = self.hashes[t]
                same = h[(starts + key_at)[:, None] + np.arange(n)] == words[key_at:key_at + n]
                starts = starts[same.all(axis=1)]
                if len(starts):
                    full = starts[:, None] + np.arange(len(words))
                    inside = (full >= 0) & (full < len(h))
                    full = np.clip(full, 0, len(h) - 1)
                    agree = (inside & (h[full] == words)
                             & (rows[full] == rows[starts + key_at][:, None]))
                    yield t, starts, agree.sum(axis=1) / len(words)


_MATCHES = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()),
    T.StructField("word", T.LongType()), T.StructField("score", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64()),
                             ("score", pa.float64())]))


def _scan(sent):
    def run(batches):
        index = sent.value
        for batch in batches:
            for part in slices(batch, 1):
                words, offsets = split_words(column(part, 1), ALNUM)
                h, rows = word_hashes(words), row_of(offsets)
                found: list[list] = [[] for _ in range(part.num_rows)]
                for t, starts, score in index.places(h, rows):
                    tpl, key_at = index.templates[t], index.keys[t][0]
                    for s, x in zip(starts.tolist(), score.tolist()):
                        d = int(rows[s + key_at])
                        found[d].append({"label": tpl.label, "base": tpl.base, "score": x,
                                         "word": s + key_at - int(offsets[d])})
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(offsets)), pa.array(found, _ARROW)],
                    ["id", "n_words", "matches"])
    return run


def _frequency(words: list[str]):
    """Arrow kernel: how many texts hold each licence word."""
    def run(batches):
        members = Members(word_hashes(pa.array(words)))
        name = {int(v): w for w, v in zip(words, word_hashes(pa.array(words)).tolist())}
        df, n = np.zeros(len(members.values), np.int64), 0
        for batch in batches:
            for part in slices(batch, 0):
                flat, offsets = split_words(column(part, 0), ALNUM)
                at, j = members.find(word_hashes(flat))
                pairs = np.unique(row_of(offsets)[at] * len(members.values) + j)
                df += np.bincount(pairs % len(members.values), minlength=len(df))
                n += part.num_rows
        got = [("", n), *((name[int(v)], c) for v, c in zip(members.values.tolist(), df.tolist()))]
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got]),
                                          pa.array([g[1] for g in got])], ["word", "n"])
    return run


def license_matches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    templates=BASE + NOTICES, rare: int = 3) -> DataFrame:
    """(id, n_words, matches): every verified place with its label, the word
    where the key phrase starts and the template's share that agrees."""
    spark = docs.sparkSession
    vocabulary = sorted({w for t in templates for w in t.words()})
    counts = {r["word"]: r["n"] for r in docs.select(text_col).mapInArrow(
        _frequency(vocabulary), "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")).collect()}  # a row per licence word
    index = Index(templates, counts, counts.get("", 0), rare)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_words", T.LongType()),
                           T.StructField("matches", _MATCHES)])
    return docs.select(id_col, text_col).mapInArrow(_scan(spark.sparkContext.broadcast(index)),
                                                    schema)
