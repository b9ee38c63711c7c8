"""Exact Jaccard join of shingle sets by PartEnum signatures.

Sets of equal size bands that are similar enough differ in at most k elements
(k follows from the band's largest size), so the feature domain is partitioned
by hash: with n1 first-level partitions at least one holds at most one of the
differing elements, and of its three second-level partitions at least two hold
none.  A set's signatures are its projections on every two of the three, for
every first-level partition; similar sets share one.  A set signs for its own
band and the next, so neighbouring bands meet too.

Empty projections say nothing and would make large useless groups.  n1 has
some slack, which guarantees T matching partitions; a set with fewer than T
partitions that could give an empty projection leaves empty signatures out,
any other set keeps them.  A similar pair loses at most that many matches, so
it still shares a signature; no link is lost.

Equal sets are one class (128-bit digest) before anything is compared.  A task
settles what meets within itself and sends one lead of each signature on; the
classes that signatures connect are a family, so linked sets are in one family.
All members are compared with the family's root and with the member closest
to it, then components are built.  What is still in different components is
decided exactly: small families pair up, in larger ones members meet in cells
(:func:`cross_links`), where every pair is in one component, cannot be linked
(by its sketches, or measured on the whole lists of its changes against the
root), or is linked.

Defined cases: a text with fewer words than a shingle is one shingle; without
words (or null) its set is empty, it is linked with nothing and is its own
component; rows that repeat an id and text are one document; a null id is
larger than any other; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import NARROW, arrow_rows, column, in_tasks, slices, staged, text_batched
from .packed import bucket_count, groups, packed_rows, text_bytes, unpacked
from .tokens import LOWER, mix, split_words, window_hashes, word_hashes

U = np.uint64
LAST = np.iinfo(np.int64).max
FLUSH = 500_000
#: bytes of text a kernel holds as arrays at a time
SLICE = 1 << 20
#: cells of a sketch, as a power of two
SKETCH_BITS = 12
#: rows with whole sets that go to Python at a time
SET_ROWS = 32


# ------------------------------------------------------------ sets of shingles

def shingle_sets(texts: pa.Array, k: int, table: bytes | None = LOWER):
    """(sorted distinct shingle hashes of all texts, offsets per text)."""
    words, offsets = split_words(texts, table)
    h, n = word_hashes(words), np.diff(offsets)
    wide = window_hashes(h, k)
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(at[-1]), dtype=U)
    for i, (a, s, w) in enumerate(zip(at.tolist(), size.tolist(), n.tolist())):
        if w >= k:
            out[a:a + s] = wide[offsets[i]:offsets[i] + s]
            out[a:a + s].sort()
        elif w:
            out[a] = window_hashes(h[offsets[i]:offsets[i + 1]], w, 77)[0]
    row = np.repeat(np.arange(len(size)), size)
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[new], np.concatenate([[0], np.cumsum(new)])[at]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's values (0 for an empty row), wrapping."""
    acc = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
    return acc[offsets[1:]] - acc[offsets[:-1]]


def digests(h: np.ndarray, offsets: np.ndarray):
    """128-bit digest of every set, as two non-negative longs."""
    n = np.diff(offsets).astype(U)
    with np.errstate(over="ignore"):
        a = mix(_sums(mix(h + U(0xA24BAED4963EE407)), offsets) + n)
        b = mix(_sums(mix(h + U(0x9FB21C651E98DF25)), offsets) ^ n)
    return (a >> U(1)).astype(np.int64), (b >> U(1)).astype(np.int64)


# ----------------------------------------------------------------- signatures

@dataclass(frozen=True)
class Similarity:
    """Linked if num / den <= Jaccard similarity."""

    num: int
    den: int

    def bands(self, largest: int) -> np.ndarray:
        """First size of every band, up to past ``largest``."""
        out = [1]
        while out[-1] <= largest:
            out.append(out[-1] * self.den // self.num + 1)
        out.append(out[-1] * self.den // self.num + 1)
        return np.asarray(out, dtype=np.int64)

    def differing(self, size):
        """Most elements in which linked sets of at most ``size`` differ."""
        return 2 * size * (self.den - self.num) // (self.den + self.num)

    def linked(self, common: int, n1: int, n2: int) -> bool:
        return common > 0 and self.den * common >= self.num * (n1 + n2 - common)


def signatures(h: np.ndarray, offsets: np.ndarray, sim: Similarity):
    """(signature, row) of all sets."""
    n = np.diff(offsets)
    if not len(h):
        return np.zeros(0, U), np.zeros(0, np.int64)
    starts = sim.bands(int(n.max()))
    band = np.searchsorted(starts, n, side="right") - 1
    sigs, rows = [], []
    for step in (0, 1):
        b = np.maximum(band, 0) + step
        k = sim.differing(starts[b + 1] - 1)
        use = (n > 0) & (k > 0)
        if step:  # a partner in the next band exists only for the band's larger sets
            use &= n * sim.den // sim.num >= starts[b]
        mine = np.flatnonzero(use)
        if not len(mine):
            continue
        base = k[mine] // 2 + 1
        sure = 1 + np.where(base >= 8, 1 + base // 32, 0)  # matching partitions for certain
        n1 = base - 1 + sure
        first = np.concatenate([[0], np.cumsum(n1)])
        which = np.repeat(np.arange(len(mine)), n[mine])
        at = np.repeat(offsets[mine] - np.concatenate([[0], np.cumsum(n[mine])[:-1]]),
                       n[mine]) + np.arange(len(which))
        x = h[at]
        with np.errstate(over="ignore"):
            part = ((x >> U(32)) * (3 * n1[which]).astype(U)) >> U(32)
            cell = 3 * first[which] + part.astype(np.int64)
            acc = np.zeros(3 * int(first[-1]), dtype=U)
            np.add.at(acc, cell, mix(x + U(0xD6E8FEB86659FD93)))
            count = np.bincount(cell, minlength=len(acc)).reshape(-1, 3)
            acc = acc.reshape(-1, 3)
            row = np.repeat(np.arange(len(mine)), n1)
            p = np.arange(len(row)) - first[row]
            tag = b[mine][row] * 1_000_003 + p
            proj = acc.sum(axis=1, dtype=U)[:, None] - acc
            sig = mix(proj + mix(tag.astype(U)[:, None] * U(3) + np.arange(3, dtype=U)))
        empty = (count.sum(axis=1)[:, None] - count) == 0
        odd = np.bincount(row, weights=empty.any(axis=1), minlength=len(mine)) >= sure
        keep = ~empty | odd[row][:, None]
        sigs.append(sig[keep])
        rows.append(np.repeat(mine[row], 3).reshape(-1, 3)[keep])
    if not sigs:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(rows)


# ------------------------------------------------------- candidates, by bucket

_SENT = ("bucket long, sig binary, cls binary, fcls binary, flead binary, "
         "key binary, doc binary, n binary, s1 binary, s2 binary")
_COLS = [c.split()[0] for c in _SENT.split(", ")][1:]


def _pairs(a: np.ndarray, b: np.ndarray):
    """The distinct pairs of two columns."""
    order, first, _ = groups(a, b)
    return a[order[first]], b[order[first]]


def _settle(sig, cls, n_buckets):
    """A task's signatures: one lead per signature, and the distinct (class,
    lead) pairs of the classes that share one with a lead here."""
    sig, cls = _pairs(sig, cls)
    new = np.ones(len(sig), dtype=bool)
    new[1:] = sig[1:] != sig[:-1]
    lead = np.flatnonzero(new)
    yield packed_rows(sig[lead] % U(n_buckets), {
        "sig": (sig[lead] // U(n_buckets)).astype(np.uint32), "cls": cls[lead]})
    follow = np.flatnonzero(~new)
    if len(follow):
        c, l = _pairs(cls[follow], cls[lead[np.cumsum(new) - 1][follow]])
        yield packed_rows(c.view(U) % U(n_buckets), {"fcls": c, "flead": l})


def _complete(batch: pa.RecordBatch) -> pa.RecordBatch:
    have = dict(zip(batch.schema.names, batch.columns))
    none = pa.nulls(batch.num_rows, pa.binary())
    return pa.RecordBatch.from_arrays([have["bucket"], *(have.get(c, none) for c in _COLS)],
                                      ["bucket", *_COLS])


def _sign(k: int, sim: Similarity, n_buckets: int):
    """Arrow kernel over (key, id, text): signatures and set digests."""
    def run(batches):
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                key = column(part, 0).to_numpy(zero_copy_only=False).astype(np.int64)
                doc = column(part, 1).fill_null(LAST).to_numpy(
                    zero_copy_only=False).astype(np.int64)
                h, offsets = shingle_sets(column(part, 2), k)
                s1, s2 = digests(h, offsets)
                yield _complete(packed_rows(key.view(U) % U(n_buckets), {
                    "key": key, "doc": doc, "n": np.diff(offsets), "s1": s1, "s2": s2}))
                _, once = np.unique(s1, return_index=True)  # equal sets sign once
                once = once[np.diff(offsets)[once] > 0]
                size = np.diff(offsets)[once]
                ends = np.concatenate([[0], np.cumsum(size)])
                at = np.repeat(offsets[:-1][once] - ends[:-1], size) + np.arange(int(ends[-1]))
                sig, row = signatures(h[at], ends, sim)
                held.append((sig, s1[once][row]))
                n += len(sig)
                if n >= FLUSH:
                    yield from map(_complete, _settle(*map(np.concatenate, zip(*held)), n_buckets))
                    held, n = [], 0
        if n:
            yield from map(_complete, _settle(*map(np.concatenate, zip(*held)), n_buckets))
    return run


_FOUND = "kind int, a long, b long, c long, d long, e long"


def _meet(table: pa.Table) -> pa.Table:
    """Kind 0: the distinct (class, lead) pairs of classes that share a
    signature with its lead; kind 1: (key, id, n, digest) of the documents,
    passed on."""
    sig, cls = unpacked(table, "sig", np.uint32), unpacked(table, "cls", np.int64)
    order = np.lexsort((cls, sig))
    sig, cls = sig[order], cls[order]
    new = np.ones(len(sig), dtype=bool)
    new[1:] = sig[1:] != sig[:-1]
    lead = cls[np.flatnonzero(new)][np.cumsum(new) - 1] if len(sig) else cls
    other = cls != lead
    a, b = _pairs(np.concatenate([cls[other], unpacked(table, "fcls", np.int64)]),
                  np.concatenate([lead[other], unpacked(table, "flead", np.int64)]))
    docs = [unpacked(table, x, np.int64) for x in ("key", "doc", "n", "s1", "s2")]
    m, d = len(a), len(docs[0])
    zero = np.zeros(m, np.int64)
    cols = [np.concatenate(x) for x in zip((a, b, zero, zero, zero), docs)]
    return pa.table([pa.array(np.repeat(np.array([0, 1], np.int32), [m, d])),
                     *(pa.array(x) for x in cols)], ["kind", "a", "b", "c", "d", "e"])


def _sets(k: int):
    """Arrow kernel over (cid, s1, s2, text, root): the packed set of each class."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, 3, SLICE):
                h, offsets = shingle_sets(column(part, 3), k)
                s1, s2 = digests(h, offsets)
                same = ((s1 == column(part, 1).to_numpy()) & (s2 == column(part, 2).to_numpy()))
                rows = np.flatnonzero(same)
                sets = [h[offsets[i]:offsets[i + 1]] for i in rows.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [column(part, 0).take(pa.array(rows)), column(part, 4).take(pa.array(rows)),
                     pa.array(np.diff(offsets)[rows]),
                     pa.array([sketch(x) for x in sets], pa.binary()),
                     pa.array([x.tobytes() for x in sets], pa.binary())],
                    ["cid", "root", "n", "sketch", "shingles"])
    return run


def sketch(x: np.ndarray) -> bytes:
    """Parity of the elements in each of 2 ** SKETCH_BITS cells: two sets differ in
    at least as many elements as their sketches do in bits."""
    odd = np.bincount((x >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _apart(sim: Similarity, only_near: bool):
    """Arrow kernel over (u, v, sizes, sketches): in how many places the
    sketches differ; with ``only_near`` without the pairs that differ in more
    than linked sets can."""
    def run(batches):
        for batch in batches:
            n_u, n_v = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            bits = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(
                len(n_u), -1) for i in (4, 5)]
            apart = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1).astype(np.int64)
            most = (n_u + n_v) * (sim.den - sim.num) // (sim.den + sim.num)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(apart)],
                                             ["u", "v", "apart"])
            yield out.filter(pa.array(apart <= most)) if only_near else out
    return run


def _verify(sim: Similarity):
    """Arrow kernel over (u, v, set of u, set of v): linked pairs only."""
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x = np.frombuffer(a.as_buffer(), dtype=U)
                y = np.frombuffer(b.as_buffer(), dtype=U)
                if len(x) > len(y):
                    x, y = y, x
                j = np.searchsorted(y, x)
                j[j == len(y)] = 0
                keep.append(sim.linked(int((y[j] == x).sum()), len(x), len(y)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


class _Links:
    """Verified links and the components they make so far."""

    def __init__(self, sets: DataFrame, sim: Similarity):
        self.sets, self.sim, self.tested, self.links = sets, sim, None, None
        self.comp, self.added = None, False
        some = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.count, self.bytes = some[0], 8 * some[1]

    def whole_bytes(self, rows: int) -> int:
        """About the bytes of all sets and of ``rows`` of them."""
        return self.bytes + rows * (self.bytes // max(1, self.count))

    def sketch_bytes(self, rows: int) -> int:
        """The bytes of all sketches and of ``rows`` pairs of them."""
        return (self.count + 2 * rows) * (NARROW + (1 << SKETCH_BITS - 3))

    def sketched(self, pairs: DataFrame, rows: int) -> DataFrame:
        """The pairs (u, v), ``rows`` of them, with sizes and sketches, a few
        hundred bytes each."""
        for c in ("u", "v"):
            pairs = in_tasks(pairs.join(self.sets.select(
                F.col("cid").alias(c), F.col("n").alias(f"n_{c}"),
                F.col("sketch").alias(f"sketch_{c}")), c), self.sketch_bytes(rows))
        return pairs.select("u", "v", "n_u", "n_v", "sketch_u", "sketch_v")

    def test(self, pairs: DataFrame, rows: int) -> DataFrame:
        """Verify the pairs (u, v), at most about ``rows``, not compared yet; add
        and return those that are linked.  Sizes and sketches rule out most that
        are not before whole sets are joined."""
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["u", "v"], "left_anti")
        pairs = staged(in_tasks(pairs, rows * NARROW), "pairs")
        n = pairs.count()
        if not n:
            return pairs
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        sizes = (F.least("n_u", "n_v") * self.sim.den >= F.greatest("n_u", "n_v") * self.sim.num)
        near = staged(self.sketched(pairs, n).where(sizes).mapInArrow(
            _apart(self.sim, True), "u long, v long, apart long"), "near")
        n = near.count()
        if not n:
            return near.select("u", "v")
        size = self.whole_bytes(2 * n)
        some = likely(self.sets, "cid", near.select(F.explode(F.array("u", "v")).alias("cid")))
        whole = [in_tasks(some.join(near.select(F.col(c).alias("cid")), "cid", "left_semi"), size)
                 .select(F.col("cid").alias(c), F.col("shingles").alias(f"set_{c}"))
                 for c in ("u", "v")]
        with arrow_rows(pairs.sparkSession, SET_ROWS):
            got = staged(in_tasks(in_tasks(near.join(whole[0], "u"), size).join(whole[1], "v"), size)
                         .select("u", "v", "set_u", "set_v")
                         .mapInArrow(_verify(self.sim), "u long, v long"), "linked")
        self.add(got)
        return got

    def add(self, got: DataFrame) -> None:
        """Verified links."""
        if got.head(1):
            self.links = got if self.links is None else self.links.unionByName(got)
            self.added = True

    def open_families(self, family: DataFrame, n: int) -> DataFrame:
        """(cid, root, comp, m) of the families, ``n`` rows, that still hold more
        than one component, m being the family's size."""
        rows = family.select(F.col("node").alias("cid"), F.col("comp").alias("root"))
        if self.comp is None:
            rows = rows.withColumn("comp", F.col("cid"))
        else:
            rows = in_tasks(rows.join(self.comp, F.col("cid") == F.col("node"), "left"),
                            2 * n * NARROW).select(
                "cid", "root", F.coalesce("comp", "cid").alias("comp"))
        rows = staged(rows, "family")
        size = rows.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"),
                                        F.max("comp").alias("hi")).where("lo < hi")
        return staged(in_tasks(rows.join(size.select("root", "m"), "root"), 2 * n * NARROW), "open")

    def settle(self) -> bool:
        """The components of the links so far; whether there are new links."""
        new, self.added = self.added, False
        if new:
            self.comp = components(self.links, self.links.count())
        return new


#: families up to that size are compared in full
SMALL_FAMILY = 8
#: members of a larger family that tell which changes are common in it
SAMPLE = 128


def _changes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The elements in which a set differs from its root's, sorted."""
    return np.setxor1d(x, y, assume_unique=True)


def _set(cell) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), dtype=U) if cell.is_valid else np.zeros(0, U)


_CHANGED = "root long, cid long, n long, changes binary"


def _changed(batches):
    """Arrow kernel over (root, cid, set, set of the root): a member's size
    and its changes."""
    for batch in batches:
        n, changes = [], []
        for i in range(batch.num_rows):
            x, y = (_set(batch.column(j)[i]) for j in (2, 3))
            n.append(len(x))
            changes.append(_changes(x, y).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()),
             pa.array(changes, pa.binary())], ["root", "cid", "n", "changes"])


def _each_change(batches):
    """Arrow kernel over (root, changes): a row per change."""
    for batch in batches:
        for r, d in zip(*(batch.column(i) for i in (0, 1))):
            e = np.frombuffer(d.as_buffer(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), r.as_py())), pa.array(e)],
                                             ["root", "e"])


def _prefix_share(sim: Similarity) -> float:
    """What :func:`_first_changes` takes of a set's elements, at most."""
    return (1 + sim.den / sim.num) * (sim.den - sim.num) / (sim.den + sim.num)


def _first_changes(sim: Similarity, n_buckets: int):
    """Arrow kernel over (cid, root, set, set of the root, common elements): the
    changes that come first, as many as linked sets can differ in and one more:
    what is new against the root, then what is gone from it, each by hash, then
    the common elements in their given order.  They leave packed, with their
    member, by bucket of a hash of root and element."""
    def run(batches):
        held, n = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                x, y, c = (_set(batch.column(j)[i]) for j in (2, 3, 4))
                d = _changes(x, y)
                late = np.isin(d, y, assume_unique=True).astype(np.int64)
                most = (len(x) + len(x) * sim.den // sim.num) * (sim.den - sim.num) \
                    // (sim.den + sim.num)
                if len(c):
                    by = np.argsort(c)
                    j = np.minimum(np.searchsorted(c, d, sorter=by), len(c) - 1)
                    known = c[by[j]] == d
                    late[known] = 2 + by[j[known]]
                root = np.array([batch.column(1)[i].as_py()], np.int64).view(U)
                with np.errstate(over="ignore"):
                    e = mix(d[np.argsort(late, kind="stable")][:most + 1] + mix(root))
                held.append((e, np.full(len(e), batch.column(0)[i].as_py(), np.int64)))
                n += len(e)
            if n >= FLUSH:
                yield _dealt_out(held, n_buckets)
                held, n = [], 0
        if n:
            yield _dealt_out(held, n_buckets)
    return run


def _dealt_out(held, n_buckets: int) -> pa.RecordBatch:
    e, cid = map(np.concatenate, zip(*held))
    return packed_rows(e % U(n_buckets), {"e": (e // U(n_buckets)).astype(np.uint32), "cid": cid})


_SHARED = "e long, g long, s1 long, s2 long, part int, cids array<long>"
#: members in a row of a cell
LIST = 4096


def _shared(n_buckets: int):
    """Arrow kernel over a bucket: the elements with two members or more, one
    of those with the same members (128-bit digest), and the members, in rows
    of at most LIST.  Two elements with one short hash are one cell."""
    def run(table: pa.Table) -> pa.Table:
        e, cid = _pairs(unpacked(table, "e", np.uint32), unpacked(table, "cid", np.int64))
        new = np.ones(len(e), dtype=bool)
        new[1:] = e[1:] != e[:-1]
        g = np.diff(np.append(np.flatnonzero(new), len(e)))
        many = np.repeat(g > 1, g)
        e, cid, g = e[many], cid[many], g[g > 1]
        starts = np.cumsum(g) - g
        s1, s2 = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(g):
            with np.errstate(over="ignore"):
                s1, s2 = (np.add.reduceat(mix(cid.view(U) + U(k)), starts).view(np.int64)
                          for k in (0xA24BAED4963EE407, 0x9FB21C651E98DF25))
        order, first, _ = groups(g, s1, s2)
        once = np.zeros(len(g), dtype=bool)
        once[order[first]] = True
        cell, place = np.repeat(np.arange(len(g)), g), np.arange(len(e)) - np.repeat(starts, g)
        keep = once[cell]
        e, cid, cell, place = e[keep], cid[keep], cell[keep], place[keep]
        at = np.flatnonzero(place % LIST == 0)
        bucket = table["bucket"][0].as_py()
        return pa.table([
            pa.array(e[at].astype(np.int64) * n_buckets + bucket), pa.array(g[cell[at]]),
            pa.array(s1[cell[at]]), pa.array(s2[cell[at]]),
            pa.array((place[at] // LIST).astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(np.append(at, len(e)), pa.int32()), pa.array(cid))],
            ["e", "g", "s1", "s2", "part", "cids"])
    return run


def family_pairs(rows: DataFrame) -> DataFrame:
    """(u, v) of families of at most SMALL_FAMILY members: those in different
    components."""
    small = rows.where(F.col("m") <= SMALL_FAMILY)
    return (small.select("root", F.col("cid").alias("u"), F.col("comp").alias("cu"))
            .join(small.select("root", F.col("cid").alias("v"), F.col("comp").alias("cv")), "root")
            .where("u < v and cu != cv").select("u", "v"))


#: members of a cell that are compared in one task; a larger cell is cut into
#: slices, and every two slices meet
CELL = 1024


def _cells(table: pa.Table):
    """The rows of each cell that holds more than one component."""
    key = [table[c].to_numpy() for c in ("y", "x", "e", "root")]
    comp = table["comp"].to_numpy()
    order = np.lexsort(key)
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in key], axis=0)
    starts = np.append(np.flatnonzero(new), len(order))
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
        at = order[lo:hi]
        if len(at) > 1 and (comp[at] != comp[at[0]]).any():
            yield at


def _to_decide(comp: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which pairs of a cell's members are open; of a cell in two slices, those
    of one member of each."""
    out = comp[:, None] != comp
    if side.min() != side.max():
        out &= side[:, None] != side
    return out


def _forest(linked: np.ndarray):
    """Pairs that connect what the links connect."""
    seen = np.zeros(len(linked), dtype=bool)
    for s in np.flatnonzero(linked.any(axis=1)).tolist():
        if seen[s]:
            continue
        seen[s], todo = True, [s]
        while todo:
            u = todo.pop()
            for v in np.flatnonzero(linked[u] & ~seen).tolist():
                seen[v] = True
                todo.append(v)
                yield u, v


def _by_sketch(sim: Similarity):
    """Arrow kernel over a bucket of cells with sizes and sketches (see
    :func:`cross_links`): the members with an open pair that may be linked as
    far as those tell.  ``near`` is such a partner, or the member itself; these
    pairs connect, cell by cell, what all would."""
    def run(table: pa.Table) -> pa.Table:
        cid, comp, side, n = (table[c].to_numpy() for c in ("cid", "comp", "side", "n"))
        sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(
            table.num_rows, -1)
        keep, partners = [], []
        for at in _cells(table):
            odd = np.unpackbits(sketches[at], axis=1).astype(np.float32)
            ones, size = odd.sum(axis=1), n[at]
            apart = (ones[:, None] + ones - 2 * (odd @ odd.T)).astype(np.int64)
            most = (size[:, None] + size) * (sim.den - sim.num) // (sim.den + sim.num)
            near = (apart <= most) & _to_decide(comp[at], side[at])
            near &= np.minimum(size[:, None], size) * sim.den >= np.maximum(size[:, None], size) * sim.num
            partner = cid[at].copy()
            for a, b in _forest(near):
                partner[b] = cid[at[a]]
            some = near.any(axis=1)
            keep.append(at[some])
            partners.append(partner[some])
        none = np.zeros(0, np.int64)
        rows = table.select(_CELL_COLUMNS).take(pa.array(np.concatenate([none, *keep])))
        return rows.append_column("near", pa.array(np.concatenate([none, *partners])))
    return run


_CELL_ROW = "root long, e long, x int, y int, cid long, comp long, side int"
_CELL_COLUMNS = [c.split()[0] for c in _CELL_ROW.split(", ")]
_NEAR_ROW = _CELL_ROW + ", near long"


def _near_in_cells(sim: Similarity):
    """Arrow kernel over a bucket of cells with whole lists of changes: links
    that connect all members of a cell that links connect."""
    def linked_in(comp, side, n, lists):
        g = len(lists)
        size = np.array([len(x) for x in lists])
        flat, who = np.concatenate(lists), np.repeat(np.arange(g), size)
        order = np.argsort(flat, kind="stable")
        flat, who = flat[order], who[order]
        new = np.ones(len(flat), dtype=bool)
        new[1:] = flat[1:] != flat[:-1]
        code = np.cumsum(new) - 1
        twice = np.bincount(code)[code] > 1  # elements of one member meet nothing
        code, who = np.unique(code[twice], return_inverse=True)[1], who[twice]
        shared = np.zeros((g, g))
        for lo in range(0, int(code.max(initial=-1)) + 1, 4096):
            at = (code >= lo) & (code < lo + 4096)
            m = np.zeros((g, min(4096, int(code.max()) + 1 - lo)), dtype=np.float32)
            m[who[at], code[at] - lo] = 1
            shared += m @ m.T
        # |u xor v| from both sets' changes against one root: exact
        apart = size[:, None] + size - 2 * shared.astype(np.int64)
        both = n[:, None] + n
        common = (both - apart) // 2
        return (common > 0) & (sim.den * common >= sim.num * (both - common)) \
            & _to_decide(comp, side)

    def run(table: pa.Table) -> pa.Table:
        cid, comp, side, n = (table[c].to_numpy() for c in ("cid", "comp", "side", "n"))
        changes = table["changes"].combine_chunks()
        u, v = [], []
        for at in _cells(table):
            lists = [_set(changes[i]) for i in at.tolist()]
            for a, b in _forest(linked_in(comp[at], side[at], n[at], lists)):
                u.append(cid[at[a]])
                v.append(cid[at[b]])
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
    return run


def cross_links(rows: DataFrame, links: _Links, bucket_bytes: int) -> DataFrame:
    """(u, v): links between different components of a large family, enough of
    them to connect all that links connect; they are added to ``links``.

    All members have been compared with the root, so of two that are linked
    but in different components at least one differs from the root in more
    elements than linked sets do; their changes against the root then share an
    element among the first of each (the prefix filter on sets a bounded
    Hamming distance apart, in any order common to the family).  What a member
    has new comes first in that order and changes that a sample of the family
    shares last, the most frequent at the end, so copies of one text with
    different changes do not meet.

    The members with one such element are a cell; cells within one component
    are done.  The others go, with sizes and sketches, to tasks of bounded
    size: of the pairs that sketches leave open as many are verified as would
    connect them all, and the components are built anew.  What is then still
    apart in a cell and near by its sketch goes on with its whole list of
    changes, where two lists give the two sets' exact distance.  Members that
    such pairs connect over all cells are one block, whose lists go to one task
    once; only of a block of more than CELL members the cells go on instead.
    No pair leaves its task but those that connect something.  A cell of more
    than CELL members is cut into slices, and each two slices meet in a task.

    Whole sets are read where they lie: the few roots are joined to them, and
    of the sample's and the last members' only those are dealt out."""
    spark, sets, sim = rows.sparkSession, links.sets, links.sim
    large = staged(rows.where((F.col("m") > SMALL_FAMILY) & (F.col("cid") != F.col("root"))), "large")
    n_large = large.count()
    if not n_large:
        return spark.createDataFrame([], "u long, v long")
    size = links.whole_bytes(2 * n_large)
    heads = staged(in_tasks(large.groupBy("root").agg(F.max("m").alias("m")), n_large * NARROW), "heads")
    roots = staged(in_tasks(sets.where("cid = root").join(heads, "root"), size)
                   .select("root", "m", F.col("shingles").alias("root_set")), "roots")

    def whole(some):
        return some.where("cid != root").select("cid", "root", "shingles").join(roots, "root")

    def changed(some):
        with arrow_rows(spark, SET_ROWS):
            return staged(in_tasks(some, size).select("root", "cid", "shingles", "root_set")
                          .mapInArrow(_changed, _CHANGED), "changed")
    drawn = (F.xxhash64(F.lit(5), F.col("cid")) / float(1 << 63) + 1) / 2 * F.col("m") < SAMPLE
    sample = changed(whole(sets).where(drawn)).select("root", "changes") \
        .mapInArrow(_each_change, "root long, e long")
    # at most SAMPLE members' changes per family
    common = staged(
        in_tasks(in_tasks(sample.groupBy("root", "e").agg(F.count(F.lit(1)).alias("n")), size)
                 .where("n > 1").groupBy("root").agg(
            F.array_sort(F.collect_list(F.struct("n", "e"))).alias("e")), size)
        .select("root", _packed(F.transform("e", lambda x: x["e"])).alias("common")), "common")
    # an element and its member take 12 bytes
    prefixes = int(links.bytes * 1.5 * _prefix_share(sim)) + 12 * links.count
    n_buckets = bucket_count(spark, prefixes, bucket_bytes)
    with arrow_rows(spark, SET_ROWS):
        shared = whole(sets).join(common, "root", "left").select(
            "cid", "root", "shingles", "root_set", "common").mapInArrow(
            _first_changes(sim, n_buckets), "bucket long, e binary, cid binary") \
            .groupBy("bucket").applyInArrow(_shared(n_buckets), _SHARED)
        # of cells with the same members one is enough
        shared = in_tasks(shared.groupBy("g", "s1", "s2", "part").agg(
            F.min(F.struct("e", "cids")).alias("cell")), prefixes).select(
            F.col("cell.e").alias("e"), F.explode("cell.cids").alias("cid"))
        members = staged(in_tasks(shared.join(large.select("root", "cid", "comp"), "cid"), prefixes),
                         "members")
    narrow = members.count() * NARROW
    cells = in_tasks(members.groupBy("root", "e").agg(
        F.count(F.lit(1)).alias("g"), F.min("comp").alias("lo"), F.max("comp").alias("hi")), narrow) \
        .where("lo < hi").select("root", "e", F.ceil(F.col("g") / CELL).cast("int").alias("parts"))
    side = F.pmod(F.xxhash64(F.lit(9), F.col("cid")), F.col("parts")).cast("int")
    met = staged(in_tasks(members.join(cells, ["root", "e"]), 2 * narrow).select(
        "root", "e", "cid", "comp", side.alias("side"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with")).select(
        "root", "e", F.least("side", "with").alias("x"), F.greatest("side", "with").alias("y"),
        "cid", "comp", "side"), "cells")
    key = ["root", "e", "x", "y"]

    def dealt(some, size):
        n = bucket_count(spark, int(size), bucket_bytes)
        return some.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(n))).groupBy("bucket")

    def near(some, n, tag):
        by = in_tasks(some.join(sets.select("cid", "n", "sketch"), "cid"), links.sketch_bytes(n))
        return staged(in_tasks(dealt(by, n * (NARROW + (1 << SKETCH_BITS - 3))).applyInArrow(
            _by_sketch(sim), _NEAR_ROW), links.sketch_bytes(n)), tag)
    met = near(met, met.count(), "nearby")
    n_met = met.count()
    found = links.test(met.where("near != cid").select(F.col("near").alias("u"),
                                                       F.col("cid").alias("v")), n_met)
    met = met.drop("near")
    if links.settle():
        met = staged(in_tasks(met.drop("comp").join(
            links.comp, F.col("cid") == F.col("node"), "left"), n_met * NARROW).select(
            *key, "cid", F.coalesce("comp", "cid").alias("comp"), "side"), "settled")
    apart = met.groupBy(*key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")) \
        .where("lo < hi").select(*key)
    left = staged(in_tasks(met.join(apart, key, "left_semi"), n_met * NARROW)
                  .select(*_CELL_COLUMNS), "apart")
    n_left = left.count()
    if not n_left:
        return found
    left = near(left, n_left, "left")
    n_left = left.count()
    if not n_left:
        return found
    few = lambda df: in_tasks(df, n_left * NARROW)
    block = components(left.select(F.col("near").alias("u"), F.col("cid").alias("v")), n_left).select(
        F.col("node").alias("cid"), F.col("comp").alias("block"))
    fits = block.groupBy("block").agg((F.count(F.lit(1)) <= CELL).alias("fits"))
    left = staged(few(few(left.join(block, "cid")).join(fits, "block")), "blocks")
    no = F.lit(-1)
    blocks = left.where("fits").select("root", F.col("block").alias("e"), no.alias("x"), no.alias("y"),
                                       "cid", "comp", F.lit(0).alias("side")).distinct()
    rest = left.where("not fits").select(*_CELL_COLUMNS)
    each = lambda i: F.bit_xor(F.xxhash64(F.lit(i), F.col("cid"), F.col("side")))
    once = few(rest.groupBy(*key).agg(
        F.count(F.lit(1)).alias("g"), each(1).alias("s1"), each(2).alias("s2")))
    once = few(once.groupBy("root", "g", "s1", "s2").agg(
        F.min(F.struct("e", "x", "y")).alias("cell"))).select("root", "cell.*")
    left = staged(few(few(blocks).unionByName(few(rest.join(once, key, "left_semi"))
                                              .select(*_CELL_COLUMNS))), "once")
    some = staged(few(left.select("cid").distinct()), "some")
    lists = changed(whole(in_tasks(likely(sets, "cid", some).join(some, "cid", "left_semi"), size))
                    ).drop("root")
    size = left.join(lists.select("cid", F.length("changes").alias("b")), "cid").agg(
        F.sum(F.col("b") + 64)).first()[0]
    last = staged(dealt(left.join(lists, "cid"), size).applyInArrow(
        _near_in_cells(sim), "u long, v long"), "met")
    links.add(last)
    return found.unionByName(last)


def _packed(longs):
    """An array of longs as little-endian bytes."""
    def word(x):
        return F.reverse(F.lpad(F.hex(x), 16, "0"))
    # hex digits reversed give the bytes reversed with swapped halves: swap them back
    swap = F.regexp_replace(F.array_join(F.transform(longs, word), ""), "(.)(.)", "$2$1")
    return F.unhex(swap)


#: bits of the map that tells texts without a partner from the rest: 8 MB
MAP_BITS = 1 << 26


def likely(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted``: a bit
    per hash value, in at most MAP_BITS / 32768 rows of 4 KB whatever the size
    of ``wanted``, so texts that no join needs are not shuffled.  A shared bit
    lets a row pass; the join that follows decides."""
    at = lambda c: F.pmod(F.col(c), F.lit(MAP_BITS)) + 1
    bits = staged(in_tasks(
        wanted.groupBy(F.bitmap_bucket_number(at(key)).alias("_block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at(key))).alias("_bits")),
        MAP_BITS // 8), "map")
    place = F.bitmap_bit_position(at(key)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10)
    found = rows.withColumn("_block", F.bitmap_bucket_number(at(key))).join(
        F.broadcast(bits), "_block")
    set_ = F.floor(byte.cast("int") / F.pow(F.lit(2), place % 8)).cast("int") % 2 == 1
    return found.where(set_).drop("_block", "_bits")


def components_of_similar(docs: DataFrame, *, num: int, den: int, shingle: int,
                          id_col: str = "doc_id", text_col: str = "text",
                          bucket_bytes: int = 4 << 20) -> DataFrame:
    """(key, id, n_shingles, component_id) of every row, where ``key`` is
    ``row_key`` of the row and ``component_id`` the smallest id reachable over
    links of similarity num / den or more."""
    return _components_and_first(docs, num=num, den=den, shingle=shingle, id_col=id_col,
                                 text_col=text_col, bucket_bytes=bucket_bytes).drop("first")


def _components_and_first(docs: DataFrame, *, num: int, den: int, shingle: int, id_col: str,
                          text_col: str, bucket_bytes: int = 4 << 20) -> DataFrame:
    """``components_of_similar`` and ``first``, the key of the component's
    first row by (id, nulls last, key); a row without words is its own."""
    sim = Similarity(num, den)
    spark = docs.sparkSession
    rows = docs.select(row_key(id_col, text_col).alias("key"),
                       F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = text_bytes(docs, text_col)
    n_buckets = bucket_count(spark, size, bucket_bytes)
    with text_batched(spark):
        found = staged(rows.mapInArrow(_sign(shingle, sim, n_buckets), _SENT)
                       .groupBy("bucket").applyInArrow(_meet, _FOUND), "candidates")
    met = found.where("kind = 0")
    n_met = met.count()
    n_docs = found.where("kind = 1").count()
    met = met.select(F.col("a").alias("s1"), F.col("b").alias("lead")).distinct()
    few = lambda df: in_tasks(df, (n_docs + n_met) * NARROW)
    each = found.where("kind = 1").select(
        F.col("a").alias("key"), F.col("b").alias("id"), F.col("c").alias("n_shingles"),
        F.col("d").alias("s1"), F.col("e").alias("s2"))
    # a class is the documents with one set; the least (id, key) stands for it
    first = F.min(F.struct("id", "key"))
    classes = each.where("n_shingles > 0").groupBy("s1", "s2").agg(
        first["id"].alias("low"), first["key"].alias("cid"))
    links = None
    if n_met:
        met = staged(few(met), "met")
        some = met.select("s1").union(met.select(F.col("lead").alias("s1"))).distinct()
        near = staged(few(few(classes).join(some, "s1", "left_semi")), "classes")
        # classes that signatures connect are a family; all are compared with
        # its root, then with the member closest to the root, which for copies
        # of one text is that text or a copy with few changes
        met = few(met.join(near.select("s1", F.col("cid").alias("v")), "s1"))
        family = components(few(met.join(
            near.select(F.col("s1").alias("lead"), F.col("cid").alias("u")), "lead")), n_met)
        key = few(near.join(family, F.col("cid") == F.col("node"), "left")).select(
            F.col("cid").alias("key"), "s1", "s2", F.coalesce("comp", "cid").alias("root"))
        text = in_tasks(likely(rows, "key", near.select(F.col("cid").alias("key"))).join(
            key, "key"), size)
        with text_batched(spark):
            sets = staged(text.select("key", "s1", "s2", "text", "root").mapInArrow(
                _sets(shingle), "cid long, root long, n long, sketch binary, shingles binary"), "sets")
        links = _Links(sets, sim)
        n = family.count()
        star = family.where("node != comp").select(F.col("comp").alias("u"), F.col("node").alias("v"))
        far = links.sketched(star, n).mapInArrow(_apart(sim, False), "u long, v long, apart long")
        centre = staged(in_tasks(far.groupBy("u").agg(
            F.min(F.struct("apart", "v")).alias("x"), F.count(F.lit(1)).alias("m")), n * NARROW)
            .where("m > 1").select("u", F.col("x.v").alias("centre")), "centres")
        links.test(star.unionByName(
            in_tasks(star.join(centre, "u"), n * NARROW).where("v != centre")
            .select(F.col("centre").alias("u"), "v")), 2 * n)
        links.settle()
        open_ = links.open_families(family, n)
        # members of a small family meet SMALL_FAMILY - 1 others
        links.test(family_pairs(open_), open_.count() * SMALL_FAMILY // 2)
        cross_links(open_, links, bucket_bytes)
        links.settle()
    if links is None or links.comp is None:
        joined = classes.select("s1", "s2", F.col("low").alias("component"),
                                F.col("cid").alias("first"))
    else:
        comp = few(classes.join(links.comp, F.col("cid") == F.col("node")))
        least = comp.groupBy("comp").agg(F.min(F.struct("low", "cid")).alias("least"))
        own = few(comp.join(least, "comp")).select("s1", "s2", "least")
        joined = classes.join(own, ["s1", "s2"], "left").select(
            "s1", "s2", F.coalesce("least.low", "low").alias("component"),
            F.coalesce("least.cid", "cid").alias("first"))
    out = each.join(joined, ["s1", "s2"], "left")
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return out.select("key", known("id").alias("id"), "n_shingles", F.when(
        F.col("n_shingles") > 0, known("component")).otherwise(known("id")).alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(F.col("key")).alias("first"))


def row_key(id_col: str, text_col: str):
    """What tells rows apart: a 63-bit hash of id and text."""
    return F.xxhash64(id_col, text_col).bitwiseAND(F.lit(LAST))


def one_of_each(docs: DataFrame, *, num: int = 4, den: int = 5, shingle: int = 5,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of every component, columns as they were: the first by
    (id, nulls last, row key).  Of rows that repeat its id and text one stays,
    the first by a hash of all columns; so it is for rows without words, which
    are linked to nothing else."""
    got = _components_and_first(docs, num=num, den=den, shingle=shingle, id_col=id_col,
                                text_col=text_col)
    # rows that go, and the rows to choose from where a first row is repeated
    rest = staged(got.groupBy("key").agg(F.max(F.col("key") != F.col("first")).alias("gone"),
                                         F.count(F.lit(1)).alias("n"))
                  .where("gone or n > 1").select(F.col("key").alias("__key"), "gone"), "rest")
    key = row_key(id_col, text_col)
    single = docs.join(rest.select("__key"), key == F.col("__key"), "left_anti")
    if not rest.where("not gone").head(1):
        return single
    cols = [F.col(f"`{c}`") for c in docs.columns]
    again = (docs.join(rest.where("not gone"), key == F.col("__key"))
             .groupBy("__key").agg(F.min_by(F.struct(*cols), F.xxhash64(*cols)).alias("__row")))
    return single.unionByName(again.select("__row.*"))
