"""One registered query per operator, with production parameters, over its whole table; the
digest columns of the contract are derived here from the operators' real outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replicakit.llm import byte_bpe, pii, quality, secret_scan, toxicity
from replicakit.llm.block_nn import nearest
from replicakit.llm.block_topk import top_products
from replicakit.llm.common import crc_mod, table
from replicakit.llm.exact_dedup import exact_dedup
from replicakit.llm.filter_audit import audit_filters
from replicakit.llm.mixing import JUNK, mix
from replicakit.llm.prefix_trie import prefix_trie
from replicakit.llm.simhash import simhash_near_dedup
from replicakit.llm.substring_dedup import substring_dedup

#: The public vocabulary of op7 (a parameter; see load_ranks).
TOKENIZER = "byte_bpe_50k.tiktoken"


def _spans(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.secret_scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[_count(F.col("spans"), r.kind).alias(f"n_{r.kind}") for r in secret_scan.RULES],
                      _spans(F.col("spans")).alias("spans")).withColumn("base_sha256", F.sha2("spans", 256))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, base = pii.scan_pii(table(spark, sf_dir, "documents")), pii.KINDS[:4]
    plain = _spans(F.filter("spans", lambda s: s["kind"].isin(*base)))
    return out.select("doc_id", *[_count(F.col("spans"), k).alias(f"n_{k}") for k in base],
                      F.sha2(plain, 256).alias("base_sha256"), _spans(F.col("spans")).alias("spans"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_block_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.load_ranks(public_tokenizers.path(TOKENIZER))
    out = byte_bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scorer = toxicity.train(docs, labels.filter(crc_mod(F.col("doc_id"), 3) != 1))
    out = toxicity.score(docs, scorer)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = quality.train(docs, labels.filter(crc_mod(F.col("doc_id"), 5) != 0))
    out = quality.score(docs, weights)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_secret_scan, op3_pii, op4_mixing, op5_exact_dedup, op6_block_nn, op7_byte_bpe,
    op8_simhash, op9_toxicity, op10_quality, op11_prefix_trie, op12_block_topk,
    op13_filter_audit)}

WORDS = r"[^\x20\x09-\x0D]+"


def _op1_sql(window: int = 35) -> str:
    """Every window, compared whole."""
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS words FROM documents),
s AS (SELECT r, unnest(range(1, len(words) - {window} + 2)) AS i, words FROM w WHERE len(words) >= {window}),
k AS (SELECT r, i, md5(array_to_string(words[i:i + {window - 1}], ' ')) AS h FROM s),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM k) WHERE n > 1),
g AS (SELECT DISTINCT r, unnest(range(i, i + {window})) AS i FROM d),
a AS (SELECT w.r, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),
m AS (SELECT a.r, count(*) AS n FROM a JOIN g USING (r, i) GROUP BY a.r),
t AS (SELECT a.r, string_agg(word, ' ' ORDER BY a.i) AS kept FROM a ANTI JOIN g USING (r, i) GROUP BY a.r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(m.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN m USING (r) LEFT JOIN t USING (r)"""


def _op2_sql() -> str:
    parts = []
    for i, rule in enumerate(secret_scan.RULES):
        p = rule.pattern.replace("'", "''")
        parts.append(f"""
SELECT r, {i} AS rule, '{rule.kind}' AS kind, {rule.least} AS least, list_transform(string_split_regex(body, '{p}'), lambda x: length(x)) AS gap,
       list_transform(regexp_extract_all(body, '{p}'), lambda x: length(x)) AS len,
       list_transform(regexp_extract_all(body, '{p}', {rule.group}), lambda x: length(x)) AS inner_len FROM b""")
    return f"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
f AS ({" UNION ALL ".join(parts)}),
h AS (SELECT r, rule, kind, least, unnest(range(1, len(len) + 1)) AS i, unnest(gap[:len(len)]) AS gap, unnest(len) AS n, unnest(inner_len) AS inner_len FROM f),
p AS (SELECT *, sum(gap + n) OVER (PARTITION BY r, rule ORDER BY i) AS stop FROM h),
s AS (SELECT r, rule, kind, CAST(stop - n AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM p WHERE inner_len >= least),
a AS (SELECT r, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule) AS spans,
             count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM b LEFT JOIN a USING (r)"""


def _op4_sql() -> str:
    """Targets in one go: sources are capped in the order of size by weight."""
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    junk = "'" + JUNK.replace("'", "''") + "'"
    return f"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS BIGINT) AS size,
  length(translate(coalesce(text, ''), {spaces}, '')) AS solid, length(translate(coalesce(text, ''), {spaces} || {junk}, '')) AS plain,
  (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM documents),
q AS (SELECT *, -ln(u) / CASE WHEN solid > 0 THEN greatest(0.05, CAST(plain AS DOUBLE) / solid) ELSE 0.05 END AS key FROM b),
z AS (SELECT source, sum(size) AS source_size FROM q GROUP BY source),
n AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM z),
o AS (SELECT *, coalesce(sum(source_size * 3) OVER w, 0) AS held, coalesce(sum(weight) OVER w, 0) AS gone,
        sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM n
      WINDOW w AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min_by(total - held, k) AS words, min_by(weights - gone, k) AS parts FROM
      (SELECT *, CAST(source_size AS DOUBLE) / weight AS k FROM o WHERE CAST((total - held) * weight AS DOUBLE) / (weights - gone) <= 3 * source_size)),
t AS (SELECT n.*, least(CAST(words * weight AS DOUBLE) / CAST(parts AS DOUBLE), CAST(3 * source_size AS DOUBLE)) AS target FROM n, l),
e AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t),
x AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM e),
p AS (SELECT q.doc_id, q.size, x.source_size, x.target, x.epochs, x.budget - x.epochs * x.source_size AS rest,
        coalesce(sum(size) OVER (PARTITION BY q.source ORDER BY key, doc_id, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM q JOIN x ON q.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken FROM p"""


def _op11_sql() -> str:
    """Every prefix of every rebuilt conversation, grouped; crc32 bit by bit."""
    return f"""
WITH t AS (SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS sym,
        len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(sym ORDER BY turn NULLS FIRST, sym) AS sym, list(words ORDER BY turn NULLS FIRST, sym) AS words,
        list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
          lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
          lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS crc
      FROM t GROUP BY conv_id),
r AS (SELECT o.conv_id, coalesce(b.sym, [])[:xor(o.crc, 4294967295) % 4] || o.sym[xor(o.crc, 4294967295) % 4 + 1:] AS sym,
        coalesce(b.words, [])[:xor(o.crc, 4294967295) % 4] || o.words[xor(o.crc, 4294967295) % 4 + 1:] AS words
      FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 20),
p AS (SELECT conv_id, d, array_to_string(sym[:d], '') AS node, coalesce(words[d], 0) AS w, len(sym) = d AS ends
      FROM (SELECT *, unnest(range(0, len(sym) + 1)) AS d FROM r)),
n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w,
        string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS ends FROM p GROUP BY node, d),
c AS (SELECT left(node, 32 * (d - 1)) AS node, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
k AS (SELECT n.*, coalesce(c.n, 0) AS children FROM n LEFT JOIN c USING (node)),
s AS (SELECT left(node, 32 * e) AS node, sum((n - 1) * w) AS saved, sum(CAST(children = 0 AS INT)) AS leaves
      FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM k) GROUP BY 1)
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, k.n AS n_convs, CAST(k.children AS BIGINT) AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(k.ends, '')) AS ends_sha256
FROM k JOIN s USING (node) LEFT JOIN n u ON k.d > 0 AND u.node = left(k.node, 32 * (k.d - 1))"""


def _op13_sql() -> str:
    """Every order and step, counted over the masks of each part."""
    return f"""
WITH b AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN b.doc_id > min(b.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
      FROM b LEFT JOIN l ON b.doc_id = l.doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
i AS (SELECT unnest(range(0, 5)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e
      WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT list_aggregate(list_transform(o, lambda x: 'ABCDE'[x + 1]), 'string_agg', '') AS filter_order, k AS step,
        CAST(2 ** o[k] AS INT) AS own, CAST(coalesce(list_sum(list_transform(o[:k - 1], lambda x: 2 ** x)), 0) AS INT) AS before
      FROM o, (SELECT unnest(range(1, 6)) AS k)),
r AS (SELECT part, filter_order, step, own, sum(n) FILTER (mask & (own | before) = 0) AS kept,
        sum(n) FILTER (mask & before = 0 AND mask & own <> 0) AS removed,
        sum(n) FILTER (mask & before <> 0 AND mask & own <> 0) AS redundant, sum(n) FILTER (mask = own) AS unique_fails,
        sum(good) FILTER (mask & before = 0 AND mask & own <> 0) AS good_lost,
        sum(toxic) FILTER (mask & before = 0 AND mask & own <> 0) AS toxic_lost
      FROM m, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INT) AS step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in
    ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM r"""


ORACLE_SQL = {
    "op1_substring_dedup": _op1_sql(),
    "op2_secret_scan": _op2_sql(),
    "op4_mixing": _op4_sql(),
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (g ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op6_block_nn": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
      FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5""",
    "op11_prefix_trie": _op11_sql(),
    "op12_block_topk": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e
      FROM embeddings WHERE len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_inner_product(q.e, c.e), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM n WHERE n <= 5""",
    "op13_filter_audit": _op13_sql(),
}
