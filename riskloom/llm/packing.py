"""Best-fit packing of token pieces with certified bin counts.

Tokenising: a document is its ids followed by id 0; one of more than
``capacity`` tokens is cut into pieces of ``capacity`` of which the first may
be shorter.  The byte-level tokenizer never joins a token across the start of
a white-space run, so a text is cut at single spaces, every distinct segment
of a batch goes through the tokenizer once and the ids are put together from
those (texts where a space follows other white space are encoded whole).

Packing: pieces are dealt over partitions of about ``part_pieces`` rows, each
packed by best-fit decreasing.  Dual feasible functions give a lower bound on
the bins any packing needs; a partition whose count equals its bound is
certified (``gap`` 0), and the whole packing is if its total equals the bound
over all lengths.  Otherwise a certified partition gives the pieces of its
bins that are not full to an exchange, a partition with a gap all its pieces;
the exchange deals them anew and packs them again.  A round stays if it saves
bins; rounds end at the bound or when a round saves none.

Defined cases: a null text is empty (one piece: the id 0); repeated rows and
null ids are documents of their own; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import column, fresh_name, slices, staged
from .tokens import word_hashes

# ---------------------------------------------------------------- tokenising

#: a space that follows other white space (Unicode): the text is encoded whole
_RUN = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] "
#: cut between a letter and these marks: byte-level pre-tokens end there
_MARKS = ".,!*%$&#"
#: segments whose ids a Python worker remembers
_CACHE_MAX = 2_000_000
#: bytes of text tokenised at a time, and words in one call of the tokenizer
SLICE = 5 << 20
CALL = 50_000
_STATE: dict[str, "_State"] = {}


class _State:
    """A tokenizer with what is known of it, once per Python worker: may texts
    be cut at spaces, which ids open with a space, and the ids of the segments
    met so far (flat, found by a sorted 64-bit hash)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.plain = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                      and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                      and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"]
                                  or t["single_word"] for t in spec.get("added_tokens", [])))
        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.opens[[i for t, i in vocab.items() if t[:1] == "\u0120"]] = True
        self.kind = np.uint16 if len(self.opens) < 1 << 16 else np.uint32
        self.forget()

    def forget(self):
        self.keys = np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, self.kind)

    def words(self, segments: pa.Array):
        """(start, size) in ``flat`` of the ids of " " + each distinct segment
        (none empty)."""
        if len(self.keys) > _CACHE_MAX:
            self.forget()
        h = word_hashes(segments)
        j = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[j] != h) if len(self.keys) else np.arange(len(h))
        if len(new):
            words = segments.take(pa.array(new)).to_pylist()
            parts = [self._encode_words(words[i:i + CALL]) for i in range(0, len(words), CALL)]
            ids = np.concatenate([p[0].astype(self.kind) for p in parts])
            base = np.cumsum([0, *(len(p[0]) for p in parts)])
            ends = np.concatenate([p[1][:-1] + at for p, at in zip(parts, base)] + [base[-1:]])
            keys = np.concatenate([self.keys, h[new]])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.start = np.concatenate([self.start, len(self.flat) + ends[:-1]])[order]
            self.size = np.concatenate([self.size, np.diff(ends).astype(np.int32)])[order]
            self.flat = np.concatenate([self.flat, ids.astype(self.kind)])
            j = np.searchsorted(self.keys, h)
        return self.start[j], self.size[j]

    def _encode_words(self, words: list[str]):
        """(ids, offsets) of words that each start with their only space: one
        call over the words in a row; a token that opens with a space starts
        the next word."""
        ids = np.asarray(self.tok.encode(" " + " ".join(words), add_special_tokens=False).ids,
                         dtype=np.uint32)
        at = np.flatnonzero(self.opens[ids])
        if len(at) != len(words):  # not as expected of this tokenizer: word by word
            return self.encode([" " + w for w in words])
        return ids, np.append(at, len(ids))

    def encode(self, texts: list[str]):
        """(ids, offsets) of texts encoded one by one."""
        got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)
        return np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(ends[-1])), ends


def _tokenizer(path: str) -> _State:
    if path not in _STATE:
        _STATE[path] = _State(path)
    return _STATE[path]


def encode_texts(texts: pa.Array, path: str):
    """(ids of all texts, one after another, each followed by id 0; offsets)."""
    state = _tokenizer(path)
    texts = texts.fill_null("")
    n = len(texts)
    whole = (pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False)
             if state.plain else np.ones(n, dtype=bool))
    lists = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
    flat = lists.flatten().dictionary_encode()
    codes = flat.indices.to_numpy()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
    first = np.zeros(len(codes), dtype=bool)
    first[ends[:-1]] = True

    # distinct segments after a space: words, marks cut off the end of words
    seen = np.unique(codes[~first])
    segments = flat.dictionary.take(pa.array(seen))
    base = pc.utf8_rtrim(segments, _MARKS)
    cut = (pc.match_substring_regex(base, r"\p{L}$").to_numpy(zero_copy_only=False)
           & pc.not_equal(pc.binary_length(base), pc.binary_length(segments)).to_numpy(
               zero_copy_only=False))
    base = pc.if_else(pa.array(cut), base, segments).dictionary_encode()
    full = pc.greater(pc.binary_length(base.dictionary), 0).to_numpy(zero_copy_only=False)
    b_start = np.zeros(len(full), np.int64)
    b_size = np.zeros(len(full), np.int64)
    b_start[full], b_size[full] = state.words(base.dictionary.filter(pa.array(full)))

    # the rest is few: marks, the space of an empty segment, first segments, whole texts, id 0
    at = np.flatnonzero(cut)
    wide = segments.take(pa.array(at)).to_pylist()
    bases = base.dictionary.take(base.indices.take(pa.array(at))).to_pylist()
    tails = [w[len(b):] for w, b in zip(wide, bases)]
    own = {t: i for i, t in enumerate(dict.fromkeys([" ", *tails]))}
    t_ids, t_ends = state.encode(list(own))
    heads = flat.dictionary.take(pa.array(codes[first]))
    h_ids, h_ends = state.encode(pc.if_else(pa.array(whole), texts, heads).to_pylist())
    pool = np.concatenate([state.flat.astype(np.uint32), t_ids, h_ids, np.zeros(1, np.uint32)])
    t_at, h_at = len(state.flat), len(state.flat) + len(t_ids)
    b_start[~full], b_size[~full] = t_at, t_ends[1]

    # every segment is two runs of the pool, base and marks; a text ends with id 0
    of = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
    of[seen] = np.arange(len(seen))
    tail_of = np.full(len(seen), -1)
    tail_of[at] = [own[t] for t in tails]
    seg = of[codes]
    start = np.zeros((len(codes), 2), np.int32)
    size = np.zeros((len(codes), 2), np.int32)
    if len(seen):
        b = base.indices.to_numpy()[seg]
        start[:, 0], size[:, 0] = b_start[b], b_size[b]
        t = tail_of[seg]
        start[:, 1], size[:, 1] = t_at + t_ends[t], np.where(t >= 0, np.diff(t_ends)[t], 0)
    start[first, 0], size[first, 0] = h_at + h_ends[:-1], np.diff(h_ends)
    size[first, 1] = 0
    start = np.insert(start.reshape(-1), 2 * ends[1:], len(pool) - 1)
    size = np.insert(size.reshape(-1), 2 * ends[1:], 1)
    to = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    at = np.repeat((start - to[:-1]).astype(np.int32), size)
    at += np.arange(int(to[-1]), dtype=np.int32)
    ids = pool[at]
    return ids, to[2 * ends + np.arange(n + 1)]


def _pieces(path: str, capacity: int, keep_ids: bool):
    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                key, rows = column(part, 0), []
                ids, at = encode_texts(column(part, 1), path)
                ids = memoryview(ids.astype("<u4").tobytes())
                for d, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    n, start, piece = hi - lo, 0, 0
                    size = n if n <= capacity else n % capacity or capacity
                    while start < n:
                        cut = ids[4 * (lo + start):4 * (lo + start + size)]
                        rows.append((d, piece, start, size, zlib.crc32(cut),
                                     bytes(cut) if keep_ids else None))
                        start, piece, size = start + size, piece + 1, capacity
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [key.take(pa.array(cols[0])), pa.array(cols[1], pa.int32()),
                     *(pa.array(c, pa.int64()) for c in cols[2:5]),
                     *([pa.array(cols[5], pa.binary())] if keep_ids else [])],
                    ["id", "piece", "start", "length", "ids_crc32", "ids"][:5 + keep_ids])
    return run


def token_pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id",
                 text_col: str = "text", capacity: int = 2048,
                 keep_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document; ``ids``
    are little-endian unsigned 32-bit."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{'`' + id_col + '`'} {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select(id_col, text_col).mapInArrow(
        _pieces(tokenizer, capacity, keep_ids), schema + (", ids binary" if keep_ids else ""))


# ------------------------------------------------------------------- packing

def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing of ``counts[x]`` pieces of length x needs: the
    largest bound over the threshold functions (drop pieces under e, count
    those over capacity - e as whole bins) and the step functions
    floor((k+1)x)/k."""
    x = np.arange(capacity + 1, dtype=object)
    n = counts.astype(object)
    best = -(-int((n * x).sum()) // capacity)
    ahead_n = np.concatenate([[0], np.cumsum(n)])
    ahead_x = np.concatenate([[0], np.cumsum(n * x)])
    for e in range(1, capacity // 2 + 1):
        big = ahead_n[capacity + 1] - ahead_n[capacity - e + 1]
        mid = ahead_x[capacity - e + 1] - ahead_x[e]
        best = max(best, -(-int(big * capacity + mid) // capacity))
    xs = np.arange(capacity + 1, dtype=np.int64)
    for k in range(1, 33):
        steps = (k + 1) * xs
        value = np.where(steps % capacity == 0, k * xs, steps // capacity * capacity)
        best = max(best, -(-int((n * value.astype(object)).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(length: np.ndarray, capacity: int):
    """(bin, offset) of each piece and the fill of each bin.  Bins are kept by
    the room they have left; the lowest set bit at or above a piece's length
    in a bit set of those rooms is the best fit."""
    order = np.argsort(-length, kind="stable")
    bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    room_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fill = 0, []
    for i, size in zip(order.tolist(), length[order].tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = room_bins[room].pop()
            if not room_bins[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offset[i] = b, fill[b]
        fill[b] += size
        room -= size
        if room:
            if not room_bins[room]:
                rooms |= 1 << room
            room_bins[room].append(b)
    return bins, offset, np.asarray(fill, dtype=np.int64)


def _pack(capacity: int, round_no: int):
    """One partition: assign pieces, certify the count, mark what goes to the
    exchange."""
    def run(key, table):
        length = table["length"].to_numpy()
        bins, offset, fill = best_fit_decreasing(length, capacity)
        gap = len(fill) - lower_bound(np.bincount(length, minlength=capacity + 1), capacity)
        loose = fill < capacity
        seq = (round_no << 52) + (key[0].as_py() << 24) + bins
        add = {"sequence_id": seq, "offset": offset, "loose": loose[bins] | (gap > 0),
               "gap": np.full(len(bins), gap, np.int64)}
        for name, v in add.items():
            table = table.append_column(name, pa.array(v))
        return table.drop_columns(["part"])
    return run


def _pack_round(pieces: DataFrame, n: int, part_pieces: int, capacity: int, round_no: int):
    parts = max(1, -(-n // part_pieces))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    key = F.pmod(F.xxhash64(*[F.col(c) for c in pieces.columns], F.lit(round_no)), F.lit(parts))
    return staged(
        pieces.withColumn("part", key).groupBy("part").applyInArrow(
            _pack(capacity, round_no),
            fields + ", sequence_id long, offset long, loose boolean, gap long"), "packed")


def pack(pieces: DataFrame, *, capacity: int = 2048, part_pieces: int = 50_000) -> DataFrame:
    """``pieces`` (any columns with a ``length`` of 1 to ``capacity``) plus
    ``sequence_id`` and ``offset``: no sequence holds more than ``capacity``
    tokens and its pieces stand gapless from 0.  Every piece has a stored row
    number; only numbers and lengths are packed, and the other columns (the
    ids) join the layout once it is fixed."""
    cols = pieces.columns
    row = fresh_name([*cols, "part", "sequence_id", "offset", "loose", "gap"], "row")
    whole = staged(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces", "zstd")
    pieces = whole.select(row, "length")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    bound, round_no = lower_bound(counts, capacity), 0
    packed = _pack_round(pieces, int(counts.sum()), part_pieces, capacity, 0)
    total, done = packed.where("offset = 0").count(), []
    while total > bound:
        loose = packed.where("loose")
        pool = loose.agg(F.count(F.lit(1)).alias("n"),
                         F.count_if(F.col("offset") == 0).alias("bins")).first()
        if pool["bins"] < 2:
            break
        round_no += 1
        again = _pack_round(loose.select(row, "length"), pool["n"], part_pieces, capacity, round_no)
        saved = pool["bins"] - again.where("offset = 0").count()
        if saved <= 0:
            break
        done.append(packed.where("not loose"))
        packed, total = again, total - saved
    for d in done:
        packed = packed.unionByName(d)
    layout = packed.select(row, "sequence_id", "offset").hint("shuffle_hash")
    return whole.join(layout, row).select(*cols, "sequence_id", "offset")


def packed_sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence (``packed`` from pieces with ids): one
    row of at most ``capacity`` tokens per sequence."""
    return (packed.groupBy("sequence_id")
            .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", F.expr(
                "aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids")))
