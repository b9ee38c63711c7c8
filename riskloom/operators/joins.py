"""Point-in-time (as-of) join J3 and the online view S6.

J3 never runs an inequality join and never puts a whole key into one task:

* phase A: features and entities are cut into time buckets of width ``W``
  (the TTL when given, else a parameter); inside each (key, bucket) a window
  ordered by (time, side) carries the newest feature row forward to the
  entities (features first on equal times, so feature_ts <= entity_ts);
* phase B: for entities whose bucket holds no earlier feature, the newest
  feature of any earlier bucket comes from a carry-forward over the small
  per-(key, bucket) table of last features.

With a TTL no older bucket can qualify, so phase B is skipped.  A hot key is
spread over its buckets; only one bucket of one key ever meets in a task, and
``bucket_seconds`` below the TTL makes the buckets as narrow as a hot key
needs (a feature is then copied into every bucket its TTL reaches).

Feature rows of one key and time are ordered by their values, the largest
wins: the answer does not depend on how the rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_US = 1_000_000


def _micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def point_in_time(entities: DataFrame, view: DataFrame, key: str, entity_ts: str,
                  view_ts: str, values: list[str], ttl_seconds: float | None = None,
                  bucket_seconds: float | None = None, prefix: str = "") -> DataFrame:
    """Left as-of join: every entity row with the newest view row of the same
    key whose time is <= the entity time (and, with a TTL, not older than
    ``ttl_seconds``).  Adds ``values`` (prefixed) and ``feature_timestamp``."""
    width = int((bucket_seconds or ttl_seconds or 86400) * _US)
    fcols = [F.col(v).alias(v) for v in values]
    feat = view.select(F.col(key), _micros(view_ts).alias("_t"),
                       F.struct(_micros(view_ts).alias("_ft"), F.col(view_ts).alias("_fts"), *fcols)
                       .alias("_f"))
    feat = feat.withColumn("_b", F.floor(F.col("_t") / F.lit(width)))
    if ttl_seconds is not None:
        # a feature can serve its own bucket and those its TTL reaches into
        reach = -(-int(ttl_seconds * _US) // width)
        feat = feat.withColumn("_b", F.explode(F.sequence(F.col("_b"), F.col("_b") + reach)))
    ent = (entities.withColumn("_t", _micros(entity_ts))
           .withColumn("_b", F.floor(F.col("_t") / F.lit(width))))
    u = (ent.withColumn("_side", F.lit(1))
         .unionByName(feat.withColumn("_side", F.lit(0)), allowMissingColumns=True))
    w = (Window.partitionBy(key, "_b").orderBy("_t", "_side", "_f")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    a = u.withColumn("_a", F.last("_f", ignorenulls=True).over(w)).filter(F.col("_side") == 1)
    if ttl_seconds is None:
        last = view.select(F.col(key), _micros(view_ts).alias("_t"),
                           F.struct(_micros(view_ts).alias("_ft"), F.col(view_ts).alias("_fts"),
                                    *fcols).alias("_f")) \
            .withColumn("_b", F.floor(F.col("_t") / F.lit(width))) \
            .groupBy(key, "_b").agg(F.max("_f").alias("_last"))  # time, then values
        eb = ent.select(key, "_b").distinct()
        c = eb.join(last, [key, "_b"], "full")
        wb = (Window.partitionBy(key).orderBy("_b")
              .rowsBetween(Window.unboundedPreceding, -1))
        prev = c.select(key, "_b", F.last("_last", ignorenulls=True).over(wb).alias("_prev"))
        a = a.join(prev, [key, "_b"], "left").withColumn("_a", F.coalesce("_a", "_prev"))
    ok = F.col("_a").isNotNull()
    if ttl_seconds is not None:
        ok = ok & (F.col("_t") - F.col("_a._ft") <= F.lit(int(ttl_seconds * _US)))
    out_cols = [c for c in entities.columns]
    return a.select(*out_cols,
                    *[F.when(ok, F.col(f"_a.{v}")).alias(prefix + v) for v in values],
                    F.when(ok, F.col("_a._fts")).alias("feature_timestamp"))


def latest_per_entity(view: DataFrame, key: str, ts: str) -> DataFrame:
    """Online view: the newest row per entity, of rows at the same time the
    one with the largest values (a ``max`` with map-side partial aggregation;
    a hot entity is one partial row per task)."""
    cols = [ts, *(c for c in view.columns if c not in (key, ts))]
    newest = view.groupBy(key).agg(F.max(F.struct(*cols)).alias("_r"))  # null times are least
    return newest.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c)
                         for c in view.columns])
