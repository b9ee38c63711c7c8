"""URL verdicts by a Bloom filter cascade: exact membership without joins.

The key universe of a corpus is every key any of its URLs could be listed
under: each host suffix with each path prefix of a rule's length, and each
word of a host.  The first filter encodes the listed keys, the second those
keys of the universe that pass the first although they are not listed, the
third the listed keys that pass the second, and so on until none passes in
error.  A key of the universe is then listed exactly if the first filter it
fails has an even number (or it passes all and their number is odd).

Filters are built and probed in Spark SQL.  The first is sized so that about
as many unlisted keys pass as there are listed ones; the cascade is thus a few
bits for each listed key whatever the corpus, and it is checked against
``max_bytes`` before it is sent to the executors as literals.

Rules: a rule (host and path) fits its host and all subdomains if the URL's
path starts with the rule's; the longest fitting rule decides.  Where none
fits, the method blocks a URL with a listed word in its host and allows
others.

Defined cases: a null URL or one without ``://`` has empty host and path, no
rule and the verdict allow; repeated rows get a row each; other columns are
ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: words that mark a host as spam; a parameter of the judge
SPAM_WORDS = ("pills", "casino", "viagra", "cialis", "poker", "betting", "jackpot", "payday",
              "replica", "escort", "warez", "torrent", "malware", "phishing")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


@dataclass(frozen=True)
class Filter:
    """One Bloom filter: ``hashes`` bit places per key in ``bits`` bits."""

    bits: int
    hashes: int
    seed: int
    data: bytes

    def holds(self, key: Column) -> Column:
        out = F.lit(True)
        for i in range(self.hashes):
            p = place(key, self.bits, self.seed + i)
            byte = F.conv(F.hex(F.substring(F.lit(self.data), (p / 8).cast("int") + 1, 1)), 16, 10)
            out = out & (F.getbit(byte.cast("int"), (p % 8).cast("int")) == 1)
        return out


def place(key: Column, bits: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits))


@dataclass(frozen=True)
class Cascade:
    filters: tuple[Filter, ...]

    def lists(self, key: Column) -> Column:
        """Is the key (of the universe) listed?"""
        out = F.lit(len(self.filters) % 2 == 1)
        for i in reversed(range(len(self.filters))):
            out = F.when(~self.filters[i].holds(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def _filter(keys: DataFrame, n: int, hashes: int, seed: int, max_bytes: int) -> Filter:
    """A filter that holds ``keys``; only its own bytes come to the driver."""
    bits = max(64, -(-int(n * (1.45 * hashes if hashes > 1 else 2)) // 8) * 8)
    if bits > 8 * max_bytes:
        raise ValueError(f"a filter of {bits // 8} bytes exceeds max_bytes={max_bytes}; "
                         "split the listed keys over several cascades")
    places = F.array(*[place(F.col("key"), bits, seed + i) for i in range(hashes)])
    rows = (keys.select(F.explode(places).alias("p"))
            .groupBy((F.col("p") / 8).cast("int").alias("byte"))
            .agg(F.bit_or(F.expr("shiftleft(1, int(p % 8))")).alias("v"))
            .collect())
    data = bytearray(bits // 8)
    for r in rows:
        data[r["byte"]] = r["v"]
    return Filter(bits, hashes, seed, bytes(data))


def build_cascade(listed: DataFrame, universe: DataFrame, *, max_bytes: int = 64 << 20) -> Cascade:
    """The cascade of ``listed`` (key) over ``universe`` (key, distinct).
    Listed keys outside the universe need no place in it."""
    n_all = universe.count()
    inside, other = staged(listed.distinct(), "listed"), universe
    n = inside.count()
    other = other.join(inside, "key", "left_anti")
    hashes = max(1, round(math.log2(max(2, n_all / max(1, n)))))
    filters, seed = [], 1
    while n:
        f = _filter(inside, n, hashes, seed, max_bytes)
        filters.append(f)
        passing = staged(other.where(f.holds(F.col("key"))), "passing")
        inside, other, n = passing, inside, passing.count()
        hashes, seed = 1, seed + 64
    return Cascade(tuple(filters))


def _rule_keys(host: Column, path: Column, rules) -> Column:
    """Every key under which a rule could fit, longest first."""
    labels = F.split(host, r"\.")
    sizes = sorted({h.count(".") + 1 for h, _ in rules})
    lengths = sorted({len(p) for _, p in rules})
    tails = F.filter(F.array(*[F.when(F.size(labels) >= n, F.array_join(
        F.slice(labels, -n, n), ".")) for n in sizes]), lambda x: x.isNotNull())
    heads = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n))
                               for n in lengths]), lambda x: x.isNotNull())
    keys = F.flatten(F.transform(tails, lambda t: F.transform(heads, lambda p: F.concat(t, p))))
    return F.array_distinct(keys)


def _words(host: Column) -> Column:
    return F.array_distinct(F.filter(F.split(host, r"[^a-z0-9]+"), lambda w: w != ""))


def judge(pages: DataFrame, allow, block, *, id_col: str = "page_id", url_col: str = "url",
          words=SPAM_WORDS, max_bytes: int = 64 << 20) -> DataFrame:
    """(id, host, path, rule, verdict) of every row; ``allow`` and ``block``
    are (host, path) rules."""
    spark = pages.sparkSession
    rules = [*allow, *block]
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule_keys, words_of = _rule_keys(F.col("host"), F.col("path"), rules), _words(F.col("host"))
    universe = staged(
        rows.select(F.explode(F.concat(F.transform(rule_keys, lambda k: F.concat(F.lit("r:"), k)),
                                       F.transform(words_of, lambda w: F.concat(F.lit("w:"), w))))
                    .alias("key")).distinct(), "universe")

    def cascade(keys):
        return build_cascade(spark.createDataFrame([(k,) for k in keys] or [], "key string"),
                             universe, max_bytes=max_bytes)

    blocked = cascade([*("r:" + h + p for h, p in block), *("w:" + w for w in words)])
    allowed = cascade(["r:" + h + p for h, p in allow])
    typed = lambda kind, k: F.concat(F.lit(kind), k)
    hit = F.transform(F.filter(F.col("keys"), lambda k: blocked.lists(typed("r:", k))
                               | allowed.lists(typed("r:", k))),
                      lambda k: F.struct(F.length(k).alias("n"), k.alias("k")))
    spam = F.exists(F.col("words"), lambda w: blocked.lists(typed("w:", w)))
    got = (rows.withColumns({"keys": rule_keys, "words": words_of})
           .withColumn("rule", F.array_max(hit)["k"]))
    by_rule = blocked.lists(typed("r:", F.col("rule")))
    blocks = F.when(F.col("rule").isNull(), spam).otherwise(by_rule)
    return got.select(F.col(id_col), "host", "path", "rule",
                      F.when(blocks, "block").otherwise("allow").alias("verdict"))
