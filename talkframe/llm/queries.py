"""The registered queries of the operators and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.llm.tables import documents, prepare, scratch, stored

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return run
    return add


@_query("op4_quality_rules")
def op4(spark, sf_dir):
    """Every document judged by the base limits and the learned decision list."""
    from talkframe.llm import quality_rules as Q
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = documents(spark, sf_dir, "doc_id", "text")
    out = Q.judged(docs, Q.fit(docs, labels))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    v = F.col("_judged")
    return out.select("doc_id", *[v.counts[c].alias(c) for c in names], v.base_failed.alias("base_failed"),
                      (~v.base_failed & v.rule.isNull()).alias("kept"), v.rule.alias("rejected_by"))


@_query("op9_quality_classifier")
def op9(spark, sf_dir):
    """Every document scored by the calibrated random-feature classifier."""
    from talkframe.llm import quality_classifier as C
    stats = stored(C.statistics(documents(spark, sf_dir, "doc_id", "text")), "op9-stats")
    names = [c for c in stats.columns if c != "_key"]
    train = stored(C.training(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")), "op9-train")
    model = C.fit(train, names)
    scored = stats.select(F.col("_key").alias("doc_id"), F.coalesce(C.fold("_key") == 1, F.lit(False)).alias("held_out"),
                          C.score_column(model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


_LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) u),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE holder IS NOT NULL AND holder <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i)
                       FILTER (WHERE holder IS NULL OR holder = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id
"""


@_query("op10_line_dedup", _LINES_SQL)
def op10(spark, sf_dir):
    """Every document without the lines that other documents hold as well."""
    from talkframe.llm import line_dedup as L
    out = L.dedup(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_SUBSTRING_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS content
  FROM words, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS p) u),
later AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY content ORDER BY doc_id, p) AS r FROM windows) t WHERE r > 1),
gone AS (
  SELECT DISTINCT doc_id, p + j AS i FROM later, LATERAL (SELECT unnest(range(0, 20)) AS j) u),
each_word AS (
  SELECT words.doc_id, i, w[i] AS word FROM words, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) u),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t
  FROM each_word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


@_query("op6_substring_dedup", _SUBSTRING_SQL)
def op6(spark, sf_dir):
    """Every document without the 20-word passages that start earlier elsewhere."""
    from talkframe.llm import substring_dedup as S
    out = S.dedup(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS s
  FROM words, LATERAL (SELECT unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p) u WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""


@_query("op2_ngram_jaccard_join", _JACCARD_SQL)
def op2(spark, sf_dir):
    """Every document with the component of its 3-shingle links at Jaccard 0.9."""
    from talkframe.llm import ngram_join as N
    out = N.groups(documents(spark, sf_dir, "doc_id", "text"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


_MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS key FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CAST([5, 2, 1][CAST(i % 3 + 1 AS INT)] AS DOUBLE) AS w, 3.0 * CAST(source_size AS DOUBLE) AS most FROM per),
levels AS (
  SELECT *, row_number() OVER (ORDER BY most / w, i) AS place,
         (CAST(sum(source_size) OVER () AS DOUBLE)
          - coalesce(sum(most) OVER (ORDER BY most / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER ()
            - coalesce(sum(w) OVER (ORDER BY most / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed),
plan AS (
  SELECT source, source_size,
         least(most, w * coalesce((SELECT level FROM levels WHERE level <= most / w ORDER BY place LIMIT 1), 0)) AS target
  FROM levels),
budget AS (
  SELECT *, CAST(round(target) AS BIGINT) AS words,
         CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM plan),
ordered AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes)
SELECT o.doc_id, o.source, o.size, b.source_size, b.target,
       CAST(epochs * size + least(size, greatest(0, words - epochs * b.source_size - before)) AS BIGINT) AS taken
FROM ordered o JOIN budget b ON o.source IS NOT DISTINCT FROM b.source
"""


@_query("op1_source_mix", _MIX_SQL)
def op1(spark, sf_dir):
    """Every document with the words that the mix takes of it."""
    from talkframe.llm import mixing as M
    sizes = stored(M.sized(documents(spark, sf_dir, "doc_id", "source", "text")), "mix-sizes")
    return M.taken(sizes).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


@_query("op5_bpe_round_trip")
def op5(spark, sf_dir):
    """Every document encoded and decoded with a public BPE vocabulary."""
    from talkframe.llm import bpe as B
    return B.encoded(documents(spark, sf_dir, "doc_id", "text"), with_ids=False).drop("text")


@_query("op8_token_counts")
def op8(spark, sf_dir):
    """Tokens of every line of every document, attributed by most bytes."""
    from talkframe.llm import token_counts as T
    return T.counted(documents(spark, sf_dir, "doc_id", "text"))


_WARC_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS winner FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 1000 OR page_id = winner THEN NULL ELSE winner END AS refers_to
FROM t
"""


@_query("op3_warc_round_trip", _WARC_SQL)
def op3(spark, sf_dir):
    """Every page written to WARC archives, read back and listed by the merged index."""
    from talkframe.llm import warc
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = warc.round_trip(pages, scratch(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op7_nearest_neighbours")
def op7(spark, sf_dir):
    """The five nearest vectors of every fiftieth one."""
    from talkframe.llm import ann
    return ann.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: CRC-32 of the bytes of a hex string ``{hex}``, by a table of 256 entries made from the polynomial.
_CRC_TABLE_SQL = """(SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n)
   FROM range(256) t(n))"""


def _crc_sql(hexed: str) -> str:
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all({hexed}, '..'), lambda x: ('0x' || x)::BIGINT)), "
            "lambda c, b: xor(c >> 8, crc_table[CAST(xor(c, b) & 255 AS INT) + 1])))")


_RUNS_SQL = r"""
WITH RECURSIVE crc AS (SELECT @TABLE@ AS crc_table),
numbers AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w, coalesce(@CRC@, 1) AS h FROM documents, crc),
cut AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS change, h // 10 AS g,
         CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM numbers),
altered AS (
  SELECT doc_id, CAST(n AS BIGINT) AS n,
         CASE WHEN change THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1])
              ELSE w END AS w FROM cut),
grams AS (
  SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS content FROM altered, LATERAL (SELECT unnest(range(0, n - 5)) AS i) u),
pairs AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.content = y.content AND x.i < y.i),
islands AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (
  SELECT doc_id, q, min(i) AS start, max(i) + 6 + q - min(i) AS length FROM islands GROUP BY doc_id, q, island),
runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS r FROM runs),
listed AS (
  SELECT doc_id, count(*) AS n_runs,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY doc_id),
gone AS (
  SELECT DISTINCT doc_id, i FROM runs, LATERAL (SELECT unnest(range(start + period, start + length)) AS i) u),
each_word AS (
  SELECT doc_id, i, w[i + 1] AS word FROM altered, LATERAL (SELECT unnest(range(0, n)) AS i) u),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM each_word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT a.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length,
       CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
       sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM altered a LEFT JOIN listed USING (doc_id) LEFT JOIN (SELECT * FROM best WHERE r = 1) b USING (doc_id) LEFT JOIN kept USING (doc_id)
""".replace("@TABLE@", _CRC_TABLE_SQL).replace("@CRC@", _crc_sql("hex(encode(CAST(doc_id AS VARCHAR)))"))


def _repeating(doc: pa.Array, text: pa.Array) -> pa.Array:
    """Texts whose id's CRC asks for it with the words from some word on repeating (null: as it was)."""
    out = []
    for d, t in zip(doc.to_pylist(), text.to_pylist()):
        h = zlib.crc32(str(d).encode())
        words = t.encode().split() if d is not None and t and h % 10 == 0 else []
        n, g = len(words), h // 10
        if not n:
            out.append(None)
            continue
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        out.append(b" ".join(words[i if i < a else a + (i - a) % p] for i in range(n)).decode())
    return pa.array(out, pa.string())


@_query("op11_periodic_runs", _RUNS_SQL)
def op11(spark, sf_dir):
    """Every document's periodic runs, a tenth of the documents made to repeat themselves."""
    from talkframe.llm import run_detection as R
    docs = documents(spark, sf_dir, "doc_id", "text")
    asked = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    altered = F.arrow_udf(_repeating, "string")(F.when(asked, F.col("doc_id")), F.when(asked, F.col("text")))
    out = R.detected(docs.select("doc_id", F.coalesce(altered, F.col("text")).alias("text")))
    out = out.withColumn("top", R.longest())
    line = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return out.select(F.col("doc").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), F.col("top.start").alias("start"),
                      F.col("top.length").alias("length"), F.col("top.period").alias("period"),
                      F.expr("1000 * top.length div top.period").alias("exponent_milli"),
                      F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


_NEGATIVES_SQL = """
WITH parts AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
r AS (
  SELECT id, label, list_transform(e, lambda x: floor(256 * x)) AS v FROM parts
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.id AS anchor, c.id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM r a JOIN r c ON a.id <> c.id AND len(a.v) = len(c.v) WHERE a.id % 100 = 0),
positives AS (
  SELECT anchor, id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS k FROM scores WHERE same) t WHERE k <= 5),
ranked AS (
  SELECT p.anchor AS anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM positives p JOIN scores n ON p.anchor = n.anchor AND NOT n.same
   AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""


@_query("op12_hard_negatives", _NEGATIVES_SQL)
def op12(spark, sf_dir):
    """Hard negatives of every hundredth vector, for each of its five positives."""
    from talkframe.llm import hard_negatives as H
    rows = H.rows_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return H.mined(rows, F.col("id") % 100 == 0)


def _sharding_sql() -> str:
    from talkframe.llm import sharding as S
    keys = ", ".join(map(str, S.round_keys(S.SEED)))

    def mixed(x):
        for shift, times in ((16, S._FIRST), (15, S._SECOND)):
            x = f"((xor({x}, ({x}) >> {shift}) * {times}) & 4294967295)"
        return f"xor({x}, ({x}) >> 16)"
    # one round of one number after another: a recursive table of (row, place, round)
    return f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE_SQL} AS crc_table),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {_crc_sql("hex(encode(coalesce(text, '')))")} AS text_crc32 FROM documents, crc),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row, count(*) OVER () AS n FROM d),
bits AS (
  SELECT *, greatest(1, CAST(ceil((SELECT count(*) FROM range(63) b(k) WHERE (1::BIGINT << k) <= n - 1) / 2) AS INT)) AS b FROM numbered),
walk(row, n, b, l, r, k) AS (
  SELECT row, n, b, CAST(row >> b AS UBIGINT), CAST(row & ((1::BIGINT << b) - 1) AS UBIGINT), 0 FROM bits
  UNION ALL
  SELECT row, n, b, r, CAST(xor(l, {mixed("xor(r, key)")} & ((1::UBIGINT << b) - 1)) AS UBIGINT), k % {S.ROUNDS} + 1
  FROM (SELECT *, CAST((list_value({keys}))[k % {S.ROUNDS} + 1] AS UBIGINT) AS key FROM walk) w
  WHERE k < {S.ROUNDS} OR (l << b) + r >= n),
place AS (SELECT row, CAST((l << b) + r AS BIGINT) AS p FROM walk WHERE k = {S.ROUNDS} AND (l << b) + r < n)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law,
       CAST(p % {S.SHARDS} AS INT) AS shard, CAST(p // {S.SHARDS} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM bits JOIN place USING (row)
"""


@_query("op13_sharding", _sharding_sql())
def op13(spark, sf_dir):
    """Every document's shard and slot in the reproducible shuffle."""
    from talkframe.llm import sharding as S
    return S.sharded(documents(spark, sf_dir, "doc_id", "text")).select(
        F.col("doc").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
