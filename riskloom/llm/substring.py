"""Exact removal of repeated word windows by difference-cover anchors.

A difference cover of period v is a set D of residues such that for any two
places i, j some d < v puts both i + d and j + d on D.  Hashes are therefore
taken only where a word's place modulo v is in D, each over window - v + 1
words: two equal windows, wherever they start, share at least one such anchor
at the same distance from their starts.

1. Of documents with equal texts all but the first are covered whole (every
   window of theirs starts earlier in the first); they take no further part.
2. Anchors of all other documents are dealt by hash and those that occur twice
   are kept (a task settles what repeats within itself and sends one
   representative of it, so no anchor, however common, gathers in one task).
   Hashes are cut to 32 bits within their bucket: a chance meeting only adds a
   candidate.
3. A match extends from its anchor: every window around a repeated anchor is
   hashed (96 bits and its bucket) and dealt by that hash; the least
   (document, start) of each window stays, every other occurrence is covered.
   Again a task sends one representative per window.  No pairs are made.
4. Covered words are removed from the text.

The texts are shuffled once, by row key; steps 2 to 4 read the same exchange.
Between the steps a row goes by its number within its bucket, which rows share
only if key, order and text are equal, so no two documents are mistaken for
each other, however many there are.

Defined cases: a null or empty text has no words; documents shorter than the
window keep all; rows that repeat an id and text are both kept (neither is
earlier) unless an earlier document covers them; rows without an id come last,
in the order of a hash of their text; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import slices
from .packed import bucket_count, groups, packed_rows, text_bytes, unpacked
from .tokens import row_of, split_words, window_hashes, word_hashes

#: perfect difference sets: every residue is a difference of two members
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18)}
#: row keys are a 63-bit hash of id and text; row numbers have to fit into 48 bits
KEY_BITS, NUMBER_BITS = 63, 48
#: documents without an id are ordered behind this
NO_ID = 1 << 62


def cover_for(window: int) -> tuple[int, np.ndarray, int]:
    """(period, is a residue in the cover, anchor length) for a window."""
    period = max([p for p in COVERS if window - p + 1 >= max(2, window // 3)], default=1)
    inside = np.zeros(period, dtype=bool)
    inside[list(COVERS.get(period, (0,)))] = True
    return period, inside, window - period + 1


def _anchors(h, offsets, window):
    """(hash, row, place) of the anchors of every text."""
    period, inside, length = cover_for(window)
    rows = row_of(offsets)
    place = np.arange(len(rows)) - offsets[rows]
    at = np.flatnonzero(inside[place % period] & (place + length <= np.diff(offsets)[rows]))
    return window_hashes(h, length)[at], rows[at], place[at].astype(np.int32)


def _narrow_key(key: np.ndarray) -> dict:
    return {"klo": (key & 0xFFFFFFFF).astype(np.uint32), "khi": (key >> 32).astype(np.uint16)}


def _wide_key(table, prefix: str = "") -> np.ndarray:
    lo = unpacked(table, prefix + "klo", np.uint32).astype(np.int64)
    return lo | (unpacked(table, prefix + "khi", np.uint16).astype(np.int64) << 32)


def _rows(schema: str, batches) -> pa.Table:
    """Packed rows of several kinds as one table; a kind's absent columns are
    null."""
    names = [c.split()[0] for c in schema.split(", ")]
    out = []
    for b in batches:
        have = dict(zip(b.schema.names, b.columns))
        out.append(pa.RecordBatch.from_arrays(
            [have.get(c, pa.nulls(b.num_rows, pa.binary())) for c in names], names))
    return pa.Table.from_batches(out, pa.schema(
        [pa.field(c, pa.int64() if c == "bucket" else pa.binary()) for c in names]))


# --------------------------------------------------------------- documents

def _numbers(docs: pa.Table, n_docs: int) -> np.ndarray:
    """The number of every row of a document bucket, the same in every step:
    the place of its (key, order, text) among the bucket's, times ``n_docs``,
    plus the bucket."""
    key, doc = (docs[c].to_numpy() for c in ("key", "ord"))
    order, first, run_of = groups(key, doc)
    new = np.zeros(len(order), dtype=bool)
    new[first] = True
    if len(first) < len(order):
        text = docs["text"].combine_chunks()
        kind = pc.dictionary_encode(text, null_encoding="encode").indices.to_numpy()[order]
        apart = np.flatnonzero(~new[1:] & (kind[1:] != kind[:-1])) + 1
        for run in np.unique(run_of[apart]):  # one key and order, different texts
            at = np.flatnonzero(run_of == run)
            texts = [text[i].as_py() for i in order[at].tolist()]
            by = sorted(range(len(at)), key=lambda i: (texts[i] is not None, texts[i] or ""))
            order[at] = order[at][by]
            new[at[1:]] = [texts[a] != texts[b] for a, b in zip(by[:-1], by[1:])]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = (np.cumsum(new) - 1) * n_docs + key[order] % n_docs
    if len(out) and out.max() >> NUMBER_BITS:
        raise OverflowError(f"row numbers over {NUMBER_BITS} bits: more, smaller buckets are needed")
    return out


def _found(docs: pa.Table, numbers: np.ndarray, table: pa.Table):
    """{row number: places} of a document bucket; whole documents have -1."""
    number, pos = _wide_key(table), unpacked(table, "pos", np.int32)
    order, first, _ = groups(number)
    ends = np.append(first, len(order))
    out = {int(number[order[a]]): pos[order[a:b]] for a, b in zip(ends[:-1], ends[1:])}
    whole = set(zip(unpacked(table, "wkey", np.int64).tolist(),
                    unpacked(table, "word", np.int64).tolist()))
    if whole:
        rows = zip(docs["key"].to_numpy().tolist(), docs["ord"].to_numpy().tolist())
        out.update((n, np.array([-1], dtype=np.int32)) for n, row in zip(numbers.tolist(), rows)
                   if row in whole)
    return out


def _doc_parts(docs: pa.Table, numbers: np.ndarray):
    """Slices of a document bucket: (id, order, number, words, offsets)."""
    at = 0
    for batch in docs.combine_chunks().to_batches():
        for part in slices(batch, 4):
            words, offsets = split_words(part.column(4))
            yield (part.column(1), part.column(2).to_numpy(zero_copy_only=False),
                   numbers[at:at + part.num_rows], words, offsets)
            at += part.num_rows


def _marks(found: dict, key, offsets, n: int):
    """(marked words, is the document covered whole)."""
    out, whole = np.zeros(n, dtype=bool), np.zeros(len(key), dtype=bool)
    for d, k in enumerate(key.tolist()):
        if k in found:
            pos = found[k]
            whole[d] = pos.min() < 0
            out[offsets[d] + pos[(pos >= 0) & (pos < offsets[d + 1] - offsets[d])]] = True
    return out, whole


_PLACE_ROW = "bucket long, klo binary, khi binary, pos binary, wkey binary, word binary"


def _places(number, pos, n_docs: int) -> pa.Table:
    return _rows(_PLACE_ROW, [packed_rows(number % n_docs, {
        **_narrow_key(number), "pos": pos.astype(np.int32)})])


def _whole(n_docs: int):
    """Arrow kernel: (key, order) of documents covered whole, dealt by
    document; their numbers are only known there."""
    def run(batches):
        for batch in batches:
            key, doc = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)
                        for i in (0, 1))
            yield from _rows(_PLACE_ROW, [packed_rows(
                key % n_docs, {"wkey": key, "word": doc})]).to_batches()
    return run


# ------------------------------------------------------------------ anchors

_ANCHOR_ROW = ("bucket long, h binary, klo binary, khi binary, pos binary, rep binary, "
               "kklo binary, kkhi binary, kpos binary")


def _emit_anchors(window: int, n_buckets: int, n_docs: int):
    """Anchors of a document bucket, settled within it: single anchors, one
    representative of each repeated one, and (dealt by document) the places
    already known to repeat."""
    def run(docs: pa.Table, covered: pa.Table) -> pa.Table:
        numbers, held = _numbers(docs, n_docs), []
        found = _found(docs, numbers, covered)
        for _, _, key, words, offsets in _doc_parts(docs, numbers):
            h, rows, pos = _anchors(word_hashes(words), offsets, window)
            live = ~_marks(found, key, offsets, len(words))[1][rows]
            held.append((h[live], key[rows[live]], pos[live]))
        if not held:
            return _rows(_ANCHOR_ROW, [])
        h, key, pos = map(np.concatenate, zip(*held))
        order, first, run_of = groups(h)
        size = np.diff(np.append(first, len(order)))
        single, rep = order[first[size == 1]], order[first[size > 1]]
        known = order[(size > 1)[run_of]]
        pick = np.concatenate([single, rep])
        kind = np.repeat(np.array([0, 1], dtype=np.uint8), [len(single), len(rep)])
        n = np.uint64(n_buckets)
        deal = key[known] % n_buckets
        return _rows(_ANCHOR_ROW, [
            packed_rows(h[pick] % n, {"h": (h[pick] // n).astype(np.uint32),
                                      **_narrow_key(key[pick]), "pos": pos[pick], "rep": kind}),
            packed_rows(deal, {"k" + c: v for c, v in
                               {**_narrow_key(key[known]), "pos": pos[known]}.items()})])
    return run


def _repeated_anchors(n_docs: int):
    """The places of a hash bucket's repeated anchors, dealt by document."""
    def run(table: pa.Table) -> pa.Table:
        h, key = unpacked(table, "h", np.uint32), _wide_key(table)
        pos, rep = unpacked(table, "pos", np.int32), unpacked(table, "rep", np.uint8)
        order, first, run_of = groups(h)
        again = np.diff(np.append(first, len(order))) > 1
        again[run_of[rep[order] == 1]] = True
        hit = np.zeros(len(h), dtype=bool)
        hit[order] = again[run_of]
        hit &= rep == 0
        key = np.concatenate([key[hit], _wide_key(table, "k")])
        pos = np.concatenate([pos[hit], unpacked(table, "kpos", np.int32)])
        return _places(key, pos, n_docs)
    return run


# ------------------------------------------------------------------ windows

_WINDOW_ROW = ("bucket long, h1 binary, h2 binary, doc binary, klo binary, khi binary, "
               "pos binary, kklo binary, kkhi binary, kpos binary")


def _windows(window: int, n_windows: int, n_docs: int):
    """Windows around repeated anchors, one representative of each, and the
    starts this bucket already knows to be covered."""
    period, _, _ = cover_for(window)

    def run(docs: pa.Table, places: pa.Table) -> pa.Table:
        numbers, held = _numbers(docs, n_docs), []
        found = _found(docs, numbers, places)
        for _, doc, key, words, offsets in _doc_parts(docs, numbers):
            n, rows = len(words), row_of(offsets)
            mark, whole = _marks(found, key, offsets, n)
            if n < window or not mark.any():
                continue
            near = np.concatenate([[0], np.cumsum(mark)])
            m = n - window + 1
            at = np.flatnonzero((near[period:period + m] > near[:m])
                                & (rows[:m] == rows[window - 1:]) & ~whole[rows[:m]])
            h = word_hashes(words)
            held.append((window_hashes(h, window, 1)[at],
                         window_hashes(h, window, 2)[at].astype(np.uint32), doc[rows[at]],
                         key[rows[at]], (at - offsets[rows[at]]).astype(np.int32)))
        if not held:
            return _rows(_WINDOW_ROW, [])
        h1, h2, doc, key, pos = map(np.concatenate, zip(*held))
        order = np.lexsort((pos, doc, h2, h1))
        lead, later = _lead(h1, h2, doc, pos, order)
        pick, known = order[~later], order[later]
        n = np.uint64(n_windows)
        return _rows(_WINDOW_ROW, [
            packed_rows(h1[pick] % n, {"h1": h1[pick], "h2": h2[pick], "doc": doc[pick],
                                       **_narrow_key(key[pick]), "pos": pos[pick]}),
            packed_rows(key[known] % n_windows, {"k" + c: v for c, v in {
                **_narrow_key(key[known]), "pos": pos[known]}.items()})])
    return run


def _lead(h1, h2, doc, pos, order):
    """(first occurrence of each row's window, is the row later than that)
    along ``order``; rows that tie with the first are not later."""
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in (h1, h2):
        new[1:] |= k[order][1:] != k[order][:-1]
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    return lead, (doc[order] != doc[lead]) | (pos[order] != pos[lead])


def _covered(n_docs: int):
    """Starts of a window bucket that are not the window's first occurrence."""
    def run(table: pa.Table) -> pa.Table:
        h1, h2 = unpacked(table, "h1", np.uint64), unpacked(table, "h2", np.uint32)
        doc, key = unpacked(table, "doc", np.int64), _wide_key(table)
        pos = unpacked(table, "pos", np.int32)
        order = np.lexsort((pos, doc, h2, h1))
        hit = order[_lead(h1, h2, doc, pos, order)[1]]
        return _places(np.concatenate([key[hit], _wide_key(table, "k")]),
                       np.concatenate([pos[hit], unpacked(table, "kpos", np.int32)]), n_docs)
    return run


def _strip(window: int, id_col: str, with_text: bool, n_docs: int):
    def run(docs: pa.Table, places: pa.Table) -> pa.Table:
        numbers, out = _numbers(docs, n_docs), []
        found = _found(docs, numbers, places)
        for ids, _, key, words, offsets in _doc_parts(docs, numbers):
            n, rows = len(words), row_of(offsets)
            start, whole = _marks(found, key, offsets, n)
            ends = np.concatenate([[0], np.cumsum(start)])
            lo = np.maximum(np.arange(n) - window + 1, offsets[rows])
            gone = ends[1:] > ends[lo]
            gone |= (whole & (np.diff(offsets) >= window))[rows]
            kept = words.filter(pa.array(~gone)) if gone.any() else words
            left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
            texts = kept.to_pylist()
            text = [" ".join(texts[a:b]) for a, b in zip(left[:-1], left[1:])]
            size = np.diff(offsets)
            out.append(pa.RecordBatch.from_arrays(
                [ids, pa.array(size), pa.array(size - np.diff(left)),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in text]),
                 *([pa.array(text)] if with_text else [])],
                [id_col, "n_words", "n_removed", "kept_sha256", "kept_text"][:4 + with_text]))
        return pa.Table.from_batches(out)
    return run


def later_copies(docs: DataFrame) -> DataFrame:
    """(key, ord) of the rows whose text an earlier document has: only digests are
    grouped and joined."""
    narrow = docs.select("ord", "key", F.xxhash64("text").alias("t1"),
                         F.xxhash64(F.lit(1), F.col("text")).alias("t2"))
    first = (narrow.groupBy("t1", "t2").agg(F.min("ord").alias("first"),
                                            F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("t1", "t2", "first"))
    return narrow.join(first, ["t1", "t2"]).where("ord > first").select("key", "ord")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    window: int = 20, with_text: bool = True,
                    bucket_bytes: int = 8 << 20) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept_text]) of every document:
    the words left when every occurrence of a ``window``-word sequence but its
    first is removed.  ``kept_text`` joins them by one space."""
    spark = docs.sparkSession
    field = docs.schema[id_col]
    hashed = F.xxhash64(id_col, text_col)
    order = F.coalesce(F.col(id_col).cast("long"),
                       F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(text_col), 3))
    base = docs.select(F.col(id_col).alias("id"), order.alias("ord"),
                       hashed.bitwiseAND(F.lit((1 << KEY_BITS) - 1)).alias("key"),
                       F.col(text_col).alias("text"))
    total = text_bytes(base, "text")
    n_docs = bucket_count(spark, total, bucket_bytes)
    n_hash = bucket_count(spark, total, bucket_bytes * 2)
    whole = later_copies(base).mapInArrow(_whole(n_docs), _PLACE_ROW)
    dealt = base.select((F.col("key") % F.lit(n_docs)).alias("bucket"), "id", "ord", "key",
                        "text").groupBy("bucket")
    anchors = dealt.cogroup(whole.groupBy("bucket")).applyInArrow(
        _emit_anchors(window, n_hash, n_docs), _ANCHOR_ROW)
    places = anchors.groupBy("bucket").applyInArrow(_repeated_anchors(n_docs), _PLACE_ROW)
    windows = dealt.cogroup(places.unionByName(whole).groupBy("bucket")).applyInArrow(
        _windows(window, n_hash, n_docs), _WINDOW_ROW)
    covered = windows.groupBy("bucket").applyInArrow(_covered(n_docs), _PLACE_ROW)
    schema = (f"`{id_col}` {field.dataType.simpleString()}, n_words long, n_removed long, "
              "kept_sha256 string" + (", kept_text string" if with_text else ""))
    return dealt.cogroup(covered.unionByName(whole).groupBy("bucket")).applyInArrow(
        _strip(window, id_col, with_text, n_docs), schema)
