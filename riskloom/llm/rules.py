"""Quality rules whose thresholds carry a risk guarantee.

A rule rejects a document when a share (symbols per character, repeated words
per word, ..) exceeds a cutoff.  Cutoffs are not chosen by eye: for every rule
and stratum a fixed list of candidates, from lenient to strict, is tested on
labelled documents that no choice was made on.  A candidate that rejects ``x``
of ``n`` good documents passes when the exact binomial probability of at most
``x`` rejections at a rejection rate of ``alpha / rules`` is at most
``delta / (rules x strata)`` (the Clopper-Pearson upper bound of the rate is
then at most ``alpha / rules``); the strictest candidate before the first one
that fails is taken.  Testing in a fixed order needs no further correction;
over rules and strata Bonferroni's holds.  So with probability ``1 - delta``
no stratum loses more than a share ``alpha`` of its good documents to the
rules.  A stratum with too few labelled documents has no cutoff and loses
none.

The shares of every whole text are measured once, in one pass of numpy over
Arrow batches; the tests are one aggregate over the labelled rows.

Defined cases: a null text has no words; a null stratum is a stratum of its
own; labels that are null or of unknown documents are ignored; a document id
labelled twice is good if any label says so, and one on several rows counts
once, as rejected if any of them is; a share of nothing is 0; other columns
are kept, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .frames import byte_offsets, column, fresh_name, slices, staged
from .tokens import row_of, split_words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_capitals")
SYMBOLS = b"#*$%&|<>"
#: strata up to this many are sent to every task; more are joined
BROADCAST_STRATA = 10_000


@dataclass(frozen=True)
class Rule:
    """Rejects where ``part`` / ``whole`` exceeds a cutoff; ``cutoffs`` are the
    candidates, lenient first."""
    name: str
    part: str
    whole: str
    cutoffs: tuple[float, ...]

    def share(self, m: Column) -> Column:
        return F.when(m[self.whole] > 0, m[self.part] / m[self.whole]).otherwise(F.lit(0.0))


RULES = (
    Rule("symbols", "n_symbols", "word_chars", (0.5, 0.3, 0.2, 0.1, 0.05, 0.02, 0.01)),
    Rule("capitals", "n_capitals", "word_chars", (0.7, 0.5, 0.4, 0.3, 0.2)),
    Rule("repeats", "n_repeat_words", "n_words", (0.45, 0.4, 0.3, 0.2, 0.15, 0.1)),
    Rule("lines", "n_dup_lines", "n_lines", (0.6, 0.5, 0.4, 0.3, 0.25, 0.2)),
)


# ------------------------------------------------------------------ measures

def _counted(texts: pa.Array, chars: bytes) -> np.ndarray:
    """Occurrences of the ASCII characters ``chars`` in every text."""
    offs = byte_offsets(texts)
    hit = np.zeros(256, bool)
    hit[list(chars)] = True
    data = texts.buffers()[2]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[
        int(offs[0]):int(offs[-1])]
    total = np.concatenate([[0], np.cumsum(hit[raw], dtype=np.int64)])
    return np.diff(total[offs - offs[0]])


def _per_row(rows: np.ndarray, n: int, weights=None) -> np.ndarray:
    return np.bincount(rows, weights, minlength=n).astype(np.int64)


def _dup_lines(texts: pa.Array):
    """(lines with a word, those equal to an earlier one) of every text."""
    lines = pc.split_pattern(texts, "\n")
    rows = row_of(np.concatenate([[0], np.cumsum(pc.list_value_length(lines).to_numpy(
        zero_copy_only=False))]).astype(np.int64))
    flat = lines.flatten()
    some = np.flatnonzero(pc.greater(pc.binary_length(pc.ascii_trim(
        flat, "\t\n\x0b\x0c\r ")), 0).to_numpy(zero_copy_only=False))
    codes = flat.take(pa.array(some)).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    rows = rows[some]
    first = np.unique(np.stack([rows, codes.astype(np.int64)], axis=1), axis=0)[:, 0]
    n = _per_row(rows, len(texts))
    return n, n - _per_row(first, len(texts))


def _repeat_words(words: pa.Array, offsets: np.ndarray) -> np.ndarray:
    """Words inside a 3-word window that its text holds twice or more."""
    n_texts = len(offsets) - 1
    if len(words) < 3:
        return np.zeros(n_texts, np.int64)
    rows = row_of(offsets)
    code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.flatnonzero(rows[:-2] == rows[2:])

    def joined(a, b):  # exact: the number of the distinct pair
        return np.unique(a * (b.max(initial=0) + 1) + b, return_inverse=True)[1]

    if not len(starts):
        return np.zeros(n_texts, np.int64)
    key = joined(joined(joined(rows[starts], code[starts]), code[starts + 1]), code[starts + 2])
    twice = starts[np.bincount(key)[key] > 1]
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[twice + k] = True
    return _per_row(rows[covered], n_texts)


def measured_batch(texts: pa.Array) -> dict[str, np.ndarray]:
    texts = texts.fill_null("") if texts.null_count else texts
    words, offsets = split_words(texts)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    lines, dup = _dup_lines(texts)
    return {"n_words": np.diff(offsets),
            "word_chars": np.diff(np.concatenate([[0], np.cumsum(chars)]).astype(np.int64)[offsets]),
            "n_symbols": _counted(texts, SYMBOLS), "n_dup_lines": dup,
            "n_repeat_words": _repeat_words(words, offsets), "n_lines": lines,
            "n_capitals": _counted(texts, bytes(range(65, 91)))}


def measures(docs: DataFrame, *, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` without the text, with a struct of :data:`MEASURES`; and the
    struct's name."""
    rest = [c for c in docs.columns if c != text_col]
    name = fresh_name(rest, "measures")
    at = len(rest)

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                got = measured_batch(column(part, at))
                cell = pa.StructArray.from_arrays([pa.array(got[m]) for m in MEASURES],
                                                  list(MEASURES))
                yield pa.RecordBatch.from_arrays(
                    [*[column(part, i) for i in range(at)], cell], [*rest, name])

    fields = StructType([StructField(m, LongType()) for m in MEASURES])
    kept = docs.select(*rest, text_col)
    return kept.mapInArrow(run, kept.select(*rest).schema.add(name, fields)), name


# ------------------------------------------------------------------- cutoffs

def base_failed(m: Column) -> Column:
    """The fixed rules: fewer than 50 words, or over half of them repeated."""
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1, dtype=np.float64)))])


def tail(x: int, n: int, p: float) -> float:
    """Probability of at most ``x`` of ``n`` at a rate of ``p``, exact up to
    rounding: the terms are added in logarithms."""
    f = log_factorials(n)
    i = np.arange(0, min(x, n) + 1)
    return float(np.exp(f[n] - f[i] - f[n - i] + i * np.log(p) + (n - i) * np.log1p(-p)).sum())


def false_rejections(measured: DataFrame, m: str, labels: DataFrame, *, id_col: str,
                     label_col: str, stratum_col: str, rules=RULES) -> DataFrame:
    """(stratum, n, r<rule>_<candidate>..): good labelled documents that the
    base rules keep, and how many of them every candidate rejects."""
    good = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")) \
        .agg(F.max(label_col).alias("good")).where("good = 1")
    rows = measured.select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"),
                           F.col(m).alias("m")).where(~base_failed(F.col("m")))
    per_doc = rows.select("id", "stratum", *[r.share(F.col("m")).alias(f"s{i}")
                                             for i, r in enumerate(rules)]) \
        .groupBy("id", "stratum").agg(*[F.max(f"s{i}").alias(f"s{i}") for i in range(len(rules))])
    return per_doc.join(good, "id").groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(f"s{i}") > c).alias(f"r{i}_{j}")
          for i, r in enumerate(rules) for j, c in enumerate(r.cutoffs)])


def certified(counts, n_strata: int, *, alpha: float, delta: float, rules=RULES):
    """{stratum: [cutoff or None per rule]} from the counted rows."""
    out = {}
    for row in counts:
        cut = []
        for i, rule in enumerate(rules):
            best = None
            for j, c in enumerate(rule.cutoffs):
                if tail(row[f"r{i}_{j}"], row["n"], alpha / len(rules)) \
                        > delta / (len(rules) * n_strata):
                    break
                best = c
            cut.append(best)
        out[row["stratum"]] = cut
    return out


def with_cutoffs(measured: DataFrame, m: str, labels: DataFrame, *, id_col: str = "doc_id",
                 label_col: str = "quality", stratum_col: str = "lang", alpha: float = 0.02,
                 delta: float = 0.05, rules=RULES) -> tuple[DataFrame, str]:
    """``measured`` with an array of its stratum's cutoffs (null: none), one per
    rule; and the array's name."""
    spark = measured.sparkSession
    n_strata = measured.select(stratum_col).distinct().count()
    counts = false_rejections(measured, m, labels, id_col=id_col, label_col=label_col,
                              stratum_col=stratum_col, rules=rules)
    kind = measured.schema[stratum_col].dataType.simpleString()
    schema = f"stratum {kind}, cutoffs array<double>"
    name = fresh_name(measured.columns, "cutoffs")

    def table(pdf_rows):
        return [(s, c) for s, c in certified(pdf_rows, max(n_strata, 1), alpha=alpha, delta=delta,
                                             rules=rules).items()]

    if n_strata <= BROADCAST_STRATA:
        # one row per stratum, at most BROADCAST_STRATA
        found = F.broadcast(spark.createDataFrame(table(counts.collect()), schema))
    else:
        def run(batches):
            for batch in batches:
                got = table(batch.to_pylist())
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s for s, _ in got], batch.schema.field("stratum").type),
                         pa.array([c for _, c in got], pa.list_(pa.float64()))],
                        ["stratum", "cutoffs"])
        found = staged(counts.mapInArrow(run, schema), "cutoffs")
    found = found.withColumnsRenamed({"stratum": "_stratum", "cutoffs": name})
    joined = measured.join(found, F.col(stratum_col).eqNullSafe(F.col("_stratum")), "left")
    return joined.drop("_stratum"), name


def rejected_by(m: Column, cutoffs: Column, rules=RULES) -> Column:
    """Names of the rules whose certified cutoff a document exceeds."""
    hits = [F.when(rule.share(m) > F.get(cutoffs, i), F.lit(rule.name)) for i, rule in enumerate(rules)]
    return F.array_compact(F.array(*hits))


def judged(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "quality", stratum_col: str = "lang", alpha: float = 0.02,
           delta: float = 0.05, rules=RULES) -> tuple[DataFrame, str, str]:
    """(``docs`` without the text but with its measures and the names of the
    rules that reject it, names of those two columns)."""
    got, m = measures(docs, text_col=text_col)
    got = staged(got, "measures")
    cut, c = with_cutoffs(got, m, labels, id_col=id_col, label_col=label_col,
                          stratum_col=stratum_col, alpha=alpha, delta=delta, rules=rules)
    name = fresh_name(cut.columns, "rejected_by")
    why = rejected_by(F.col(m), F.coalesce(F.col(c), F.array().cast("array<double>")), rules)
    return cut.withColumn(name, F.coalesce(why, F.array().cast("array<string>"))).drop(c), m, name
