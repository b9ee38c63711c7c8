"""The registered queries of the corpus operators (one per operator, over the
whole table it is meant for) and their DuckDB texts where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _register(sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# a text's words (letters, digits, non-ASCII) with A-Z lower-cased, in DuckDB
_ALNUM_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@_register(f"""
WITH d AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(
         w[s:s + least(10, len(w)) - 1], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s
             FROM b WHERE len(w) > 0) t),
dw AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s
       FROM d, (SELECT DISTINCT l FROM iw) ls WHERE len(w) >= l),
hits AS (SELECT doc_id, s, dw.l AS l, item_id FROM (
           SELECT doc_id, s, l, array_to_string(w[s:s + l - 1], ' ') AS k FROM dw) dw
         JOIN iw ON iw.k = dw.k AND iw.l = dw.l),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
            SELECT doc_id, unnest(range(s, s + l)) AS p FROM hits) t GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (
          SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) t GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN its USING (doc_id)
""")
def op9_benchmark_decontamination(spark, sf_dir):
    """Words of every document inside an occurrence of a benchmark window."""
    from .decontam import contamination
    marked, name = contamination(_table(spark, sf_dir, "documents"),
                                 _table(spark, sf_dir, "benchmark"))
    r = F.col(name)
    n_hit = F.aggregate(r["spans"], F.lit(0).cast("long"),
                        lambda a, s: a + s["end"] - s["start"])
    return marked.select(
        "doc_id", r["n_words"].alias("n_words"), n_hit.alias("n_hit"),
        F.size(r["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(r["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(r["spans"]) > 0).alias("contaminated"))


@_register("""
WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT page_id, strlen(b) AS payload_bytes, array_to_string(list_transform(range(0, 32),
        lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
          (CAST('0x' || substr(h, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS BIGINT)
           >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
        max(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to
FROM r
""")
def op1_warc_round_trip(spark, sf_dir):
    """Every page archived as a WARC record and read back."""
    from .frames import scratch_path
    from .warc import read_archives, typed_pages, write_archives
    path = scratch_path(spark, "warc")
    write_archives(typed_pages(_table(spark, sf_dir, "pages")), path)
    return read_archives(spark, path, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# a text's runs of non-white-space, unchanged or with A-Z lower-cased, in DuckDB
_SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_SPACE_WORDS_LOWER = r"""regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""


@_register()
def op2_quality_classifier(spark, sf_dir):
    """Quality score of every document by the byte-level network."""
    from .quality import held_out, quality_scores
    scored, name = quality_scores(_table(spark, sf_dir, "documents"),
                                  _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"),
                         F.col(name).alias("score"),
                         F.when(F.col(name) >= 0.3, 1).otherwise(0).alias("predicted"))


#: the key of the registered runs; a deployment passes its own secret
SURROGATE_KEY = b"riskloom registered query"


@_register()
def op3_pii_surrogates(spark, sf_dir):
    """Every document with its personal data replaced by keyed surrogates."""
    from .pii import pseudonymised
    out, spans = pseudonymised(_table(spark, sf_dir, "documents"), SURROGATE_KEY)
    kinds = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["kind"])))
    return out.select("doc_id", F.size(spans).cast("long").alias("n_entities"),
                      F.array_join(kinds, ",").alias("kinds"), "text")


def _op4_sql() -> str:
    from .licenses import BASE, NOTICES
    rows = []
    for i, t in enumerate((*BASE, *NOTICES)):
        w, (at, n) = t.words(), t.key_at()
        lit = "[" + ", ".join(f"'{x}'" for x in w) + "]"
        rows.append(f"({i}, '{t.label}', {str(t.base).lower()}, {lit}, {at}, {n})")
    return f"""
WITH t(i, label, base, tw, k, kn) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
p AS (SELECT doc_id, label, base, s - 1 AS word, list_sum(list_transform(range(1, len(tw) + 1),
        lambda x: CASE WHEN s - k - 1 + x BETWEEN 1 AND len(w) AND w[greatest(s - k - 1 + x, 1)] = tw[x]
                  THEN 1 ELSE 0 END)) / len(tw) AS share
      FROM (SELECT doc_id, w, i, label, base, tw, k, kn, unnest(range(1, len(w) - kn + 2)) AS s
            FROM d, t WHERE list_contains(w, tw[k + 1]) AND len(w) >= kn) c
      WHERE w[s:s + kn - 1] = tw[k + 1:k + kn]),
g AS (SELECT doc_id, count(DISTINCT (label, word)) FILTER (base) AS n_base,
        min(word) FILTER (base) AS first_word, max(word) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
      FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word,
       last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(coalesce(score, 0), 6) AS score
FROM d LEFT JOIN g USING (doc_id)
"""


@_register(_op4_sql())
def op4_license_scan(spark, sf_dir):
    """Licence phrases and notices of every document."""
    from .licenses import license_matches
    m = F.col("matches")
    base = F.filter(m, lambda x: x["base"])
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(
        F.transform(a, lambda x: x["label"]))), ",")
    words = F.transform(base, lambda x: x["word"])
    return license_matches(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        labels(base).alias("base_labels"), labels(m).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform(m, lambda x: x["score"])), F.lit(0.0)),
                6).alias("score"))


@_register(f"""
WITH d AS (SELECT doc_id, {_SPACE_WORDS} AS w FROM documents),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS rn FROM (
        SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM (
          SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20) a) b),
cov AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM f WHERE rn > 1),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM (
           SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) a
         ANTI JOIN cov USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""")
def op5_substring_dedup(spark, sf_dir):
    """Every document without the words of 20-word windows that start earlier."""
    from .substring import without_repeats
    return without_repeats(_table(spark, sf_dir, "documents"), with_text=False)


#: fixed values of the URL query
ALLOW = (("org", "/"), ("com", "/fr/"))
BLOCK = (("example.org", "/es/"), ("example.org", "/en/1"), ("com", "/de/"))


def _op6_sql() -> str:
    from .url_cascade import LOWER, SPAM_WORDS, UPPER
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for v, rs in (("allow", ALLOW), ("block", BLOCK))
                      for h, p in rs)
    words = "[" + ", ".join(f"'{w}'" for w in SPAM_WORDS) + "]"
    return f"""
WITH r(rh, rp, v) AS (VALUES {rules}),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0
        THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1),
        '{UPPER}', '{LOWER}'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
m AS (SELECT h.*, rh || rp AS rule, v, row_number() OVER (
        PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS n
      FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN list_has_any(
         regexp_split_to_array(host, '[^a-z0-9]+'), {words}) THEN 'block' ELSE 'allow' END)
       AS verdict
FROM m WHERE n = 1
"""


@_register(_op6_sql())
def op6_url_filter(spark, sf_dir):
    """Verdict on every page's url by rules and the Bloom filter cascade."""
    from .url_cascade import judge
    return judge(_table(spark, sf_dir, "pages"), ALLOW, BLOCK)


@_register("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE))
             AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding,
             lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1),
        lambda i: q.v[i] * e.v[i])) AS BIGINT) AS score
      FROM e q JOIN e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)
        AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op7_exact_top_k(spark, sf_dir):
    """The 5 best rows by inner product of every 50th vector."""
    from .topk import top_k
    return top_k(_table(spark, sf_dir, "embeddings"))


@_register(f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACE_WORDS_LOWER} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS k FROM (
         SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s
         FROM d WHERE len(w) > 0) t),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (k)
      WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
      WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY ALL
""")
def op8_ngram_jaccard_join(spark, sf_dir):
    """Components of documents whose 3-word shingle sets overlap by 0.9."""
    from .jaccard import components_of_similar
    return components_of_similar(_table(spark, sf_dir, "documents"), num=9, den=10,
                                 shingle=3).select(F.col("id").alias("doc_id"), "n_shingles",
                                                   "component_id")


TOKENIZER = "byte_bpe_50k.json"


@_register()
def op10_best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of at most 2048 tokens, with the
    token ids of every piece."""
    import public_tokenizers
    from .packing import pack, token_pieces
    return pack(token_pieces(_table(spark, sf_dir, "documents"),
                             public_tokenizers.path(TOKENIZER)))


def _op11_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    def assigned(c):
        return f"""SELECT i, id, v, least_of.c AS cluster, least_of.d AS distance FROM (
  SELECT r.i, any_value(r.id) AS id, any_value(r.v) AS v, min({{'d': list_sum(list_transform(
           range(1, {dims + 1}), lambda j: (r.v[j] - {c}.v[j]) * (r.v[j] - {c}.v[j]))),
           'c': {c}.c}}) AS least_of
  FROM kept r, {c} GROUP BY r.i)"""

    steps = [f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id AS id, list_transform(embedding,
    lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || id) NULLS LAST, v) - 1 AS c, v FROM kept
  QUALIFY c < {k})"""]
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED ({assigned(f'c{r}')}),
s{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM (
  SELECT cluster, j, sum(x) AS s, count(*) AS n FROM (
    SELECT cluster, unnest(range(1, {dims + 1})) AS j, unnest(v) AS x FROM a{r}) GROUP BY ALL)
  GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(s{r}.v, c{r}.v) AS v FROM c{r}
  LEFT JOIN s{r} ON cluster = c)""")
    steps.append(f"last AS MATERIALIZED ({assigned(f'c{rounds}')})")
    return ",\n".join(steps) + f"""
SELECT id AS vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM last JOIN c{rounds} ON c = cluster
"""


@_register(_op11_sql())
def op11_centroid_clustering(spark, sf_dir):
    """Every vector's cluster after five rounds from 40 hashed seeds."""
    from .centroids import cluster, with_inertia
    return with_inertia(cluster(_table(spark, sf_dir, "embeddings"))).select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
        "centroid_sha256")


#: CRC-32 of an ASCII text in DuckDB (reflected polynomial, bit by bit)
_CRC32 = """xor(list_reduce(list_transform(string_split({0}, ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
    lambda c, b: list_reduce(range(8), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)),
    4294967295), 4294967295)"""


def _op12_sql(fan: int = 16, depth: int = 6) -> str:
    def fields(text):
        parts = ["doc_id", "source", "lang", "n_chars", text]
        return "sha256(" + " || ".join(
            f"coalesce(strlen(CAST({p} AS VARCHAR)) || ':' || CAST({p} AS VARCHAR), '-')"
            for p in parts) + ")"

    lower = ("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    out = [f"""WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS i, doc_id, source, {fields('text')} AS leaf,
         CASE WHEN {_CRC32.format('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {fields(lower)}
              ELSE {fields('text')} END AS other FROM documents),
l0 AS MATERIALIZED (
  SELECT i, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, leaf AS h,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, i) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n FROM d)"""]

    def levels(name):
        # level t + 1 from level t; groups of one node stay
        for t in range(depth):
            out.append(f"""{name}{t + 1} AS MATERIALIZED (
  SELECT g, pos // {fan} AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos))
         ELSE any_value(h) END AS h, (any_value(n) + {fan - 1}) // {fan} AS n
  FROM {name}{t} GROUP BY g, pos // {fan})""")

    levels("l")
    out.append(f"""u0 AS MATERIALIZED (SELECT 0 AS g, g AS pos, h, count(*) OVER () AS n,
    g AS i FROM l{depth})""")
    levels("u")
    steps = []
    for name, group, start in (("l", "l0.g", "l0.pos"), ("u", "0", "l0.g")):
        for t in range(depth):
            at = f"({start} // {fan ** t})"
            out.append(f"""{name}s{t} AS MATERIALIZED (
  SELECT a.g, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r,
         any_value(a.n) AS n
  FROM {name}{t} a JOIN {name}{t} b ON a.g = b.g AND a.pos // {fan} = b.pos // {fan}
  GROUP BY a.g, a.pos)""")
            steps.append((f"{name}s{t}", group, at))
    joins = "\n".join(f"JOIN {s} ON {s}.g = {g} AND {s}.pos = {at}" for s, g, at in steps)
    proof = " || ".join(f"{s}.l || {s}.r" for s, _, _ in steps)
    prev = "d.other"
    for k, (s, _, _) in enumerate(steps):
        out.append(f"""f{k} AS MATERIALIZED (SELECT d.i, CASE WHEN {s}.n > 1
    THEN sha256({s}.l || {prev} || {s}.r) ELSE {prev} END AS x
  FROM d JOIN l0 USING (i) JOIN {s} ON {s}.g = {steps[k][1]} AND {s}.pos = {steps[k][2]}""" + (
            f" JOIN f{k - 1} ON f{k - 1}.i = d.i)" if k else ")"))
        prev = f"f{k}.x"
    return ",\n".join(out) + f"""
SELECT d.doc_id, d.leaf, l{depth}.h AS subroot, u{depth}.h AS root,
       sha256({proof}) AS proof_sha256, x AS folded_root, x = u{depth}.h AS verified
FROM d JOIN l0 USING (i) JOIN f{len(steps) - 1} USING (i)
JOIN l{depth} ON l{depth}.g = l0.g JOIN u{depth} ON true
{joins}
"""


@_register(_op12_sql())
def op12_merkle_manifest(spark, sf_dir):
    """Every document's proof to the root, a fifth of them tampered with."""
    from .merkle import folded, leaf_hash, manifest, sha, siblings
    docs = _table(spark, sf_dir, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    m = manifest(docs.select("doc_id", "source", leaf_hash(*rest, F.col("text")).alias("leaf"),
                             F.when(hit, leaf_hash(*rest, lower)).alias("other")),
                 group="source", key="doc_id")
    up = folded(F.coalesce("other", "leaf"), F.col("segments"))
    return m.proofs.select(
        "doc_id", "leaf", "subroot", F.lit(m.root).cast("string").alias("root"),
        sha(siblings(F.col("segments"))).alias("proof_sha256"), up.alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


def _op13_sql(alpha: float = 0.02, delta: float = 0.05) -> str:
    from .rules import RULES
    share = lambda r: f"CASE WHEN {r.whole} > 0 THEN {r.part} / {r.whole} ELSE 0 END"
    tests = " UNION ALL ".join(
        f"SELECT lang, {i} AS rule, {j} AS j, CAST({c} AS DOUBLE) AS c, count(*) AS n, "
        f"count(*) FILTER (s{i} > {c}) AS x FROM good GROUP BY lang"
        for i, r in enumerate(RULES) for j, c in enumerate(r.cutoffs))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS i, doc_id, lang, coalesce(text, '') AS text,
  {_SPACE_WORDS} AS w FROM documents),
rep AS (SELECT i, count(DISTINCT p) AS n FROM (
    SELECT i, unnest(range(s, s + 3)) AS p FROM (
      SELECT i, s, count(*) OVER (PARTITION BY i, k) AS m FROM (
        SELECT i, s, w[s:s + 2] AS k FROM (
          SELECT i, w, unnest(range(1, len(w) - 1)) AS s FROM d WHERE len(w) > 2))) WHERE m > 1)
  GROUP BY i),
ln AS (SELECT i, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (
    SELECT i, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY i),
m AS MATERIALIZED (SELECT d.i, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(ln.n, 0) AS n_lines,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals
  FROM d LEFT JOIN rep ON rep.i = d.i LEFT JOIN ln ON ln.i = d.i),
b AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    {", ".join(f"{share(r)} AS s{i}" for i, r in enumerate(RULES))} FROM m),
good AS MATERIALIZED (SELECT doc_id, lang, {", ".join(f"max(s{i}) AS s{i}" for i in range(len(RULES)))}
  FROM b SEMI JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1) USING (doc_id)
  WHERE NOT base_failed GROUP BY doc_id, lang),
t AS ({tests}),
p AS (SELECT *, list_sum(list_transform(range(0, x + 1), lambda i: exp(
        lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha / len(RULES)!r})
        + (n - i) * ln(1 - {alpha / len(RULES)!r})))) > {delta / len(RULES)!r} / (
          SELECT count(*) FROM (SELECT DISTINCT lang FROM documents)) AS bad FROM t),
cut AS (SELECT lang, rule, min(c) AS c FROM (SELECT *, max(CAST(bad AS INTEGER)) OVER (
    PARTITION BY lang, rule ORDER BY j) AS fails FROM p) WHERE fails = 0 GROUP BY lang, rule),
hit AS (SELECT DISTINCT i FROM b JOIN cut ON b.lang IS NOT DISTINCT FROM cut.lang
  AND CASE rule {" ".join(f"WHEN {i} THEN s{i}" for i in range(len(RULES)))} END > c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND hit.i IS NULL AS kept
FROM b LEFT JOIN hit ON hit.i = b.i
"""


@_register(_op13_sql())
def op13_quality_rules(spark, sf_dir):
    """Base rules and rules with certified cutoffs over every document."""
    from .rules import MEASURES, base_failed, judged
    got, m, why = judged(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"),
                         _table(spark, sf_dir, "labels"))
    bad = base_failed(F.col(m))
    return got.select("doc_id", *[F.col(m)[c].alias(c) for c in MEASURES[:5]],
                      bad.alias("base_failed"), (~bad & (F.size(why) == 0)).alias("kept"))
