"""Queries op1 to op13 over whole tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, merkle, mixing, negatives, packing, quality, secrets, sharding, simhash, suffix, topk, warc, whitening

#: The tokenizer of packing; its file is a parameter of the operator.
TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), CAPACITY)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.summary(turns.unionByName(extra))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_packing, op3_suffix_dedup, op4_quality, op5_topk, op6_chat, op7_simhash, op8_secrets, op9_mixing, op10_fingerprints, op11_whitening, op12_hard_negatives, op13_sharding, pipeline)
}

_BASE32 = " || ".join(f"substr('{warc.BASE32}', ((('0x' || substr(h, {5 * g + 1}, 5))::INTEGER >> {shift}) & 31) + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0))

#: Kinds of secrets in DuckDB's dialect, where ignoring case would fold letters beyond ASCII: kind, pattern, group of the value.
_KINDS = (
    ("assign", "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key")) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1),
    ("access", "AKIA[A-Z0-9]+", 0),
    ("hex", "[0-9a-f]+", 0),
)
_FOUND = """SELECT r, {rank} AS rank, '{kind}' AS kind, unnest(range(0, len(g))) AS i, unnest(g) AS gap, unnest(m) AS whole, unnest(v) AS value
  FROM (SELECT r, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS v FROM d)"""

ORACLES: dict[str, str] = {
    "op1_warc": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = top OR top IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM p JOIN f USING (h)""",
    "op3_suffix_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT r, o, substr(h, 2 * o + 1, 1310) AS t FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399, 256)) AS o FROM d)),
p AS (SELECT r, o + j AS i, md5(substr(t, 2 * j + 1, 800)) AS k FROM (SELECT r, o, t, unnest(range(0, length(t) // 2 - 399)) AS j FROM b)),
c AS (SELECT k FROM p GROUP BY k HAVING count(*) > 1),
s AS (SELECT r, i, lag(i) OVER w AS before FROM p SEMI JOIN c USING (k) WINDOW w AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, sum((before IS NULL OR i > before + 400)::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM s),
x AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY r, run),
y AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS last FROM x),
u AS (SELECT row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS v FROM documents),
pw AS (SELECT r, j AS i, md5(array_to_string(v[j + 1:j + 51], ' ')) AS k FROM (SELECT r, v, unnest(range(0, len(v) - 50)) AS j FROM u)),
cw AS (SELECT k FROM pw GROUP BY k HAVING count(*) > 1),
sw AS (SELECT r, i, lag(i) OVER w AS before FROM pw SEMI JOIN cw USING (k) WINDOW w AS (PARTITION BY r ORDER BY i)),
zw AS (SELECT r, sum(least(51, i - coalesce(before, i - 51)))::BIGINT AS passage_words FROM sw GROUP BY r),
z AS (SELECT r, string_agg(a || ':' || b, ',' ORDER BY a) AS spans, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS stop, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS kept FROM y JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256, coalesce(spans, '') AS spans, coalesce(passage_words, 0)::BIGINT AS passage_words
FROM d LEFT JOIN z USING (r) LEFT JOIN zw USING (r)""",
    "op5_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, min({'label': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END, 'e': list_transform(embedding, lambda x: floor(256 * x::DOUBLE))}) AS r FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.r.label = c.r.label AS same, list_dot_product(a.r.e, c.r.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
    "op13_sharding": f"""
WITH k AS (SELECT list_transform(range(0, 256), lambda k: list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, k)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 1 AS size, sha256(coalesce(text, '')) AS digest,
  xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM documents, k),
g AS (SELECT digest, sum(size)::BIGINT AS group_bytes, min(doc_id) AS first, count(*) AS n FROM d GROUP BY digest),
a AS (SELECT sum(size)::BIGINT AS total, floor(sum(size)::DOUBLE / 8 * {sharding.WHOLE}) AS most FROM d),
o AS (SELECT r, doc_id, size, text_crc32, digest, total, CASE WHEN n > 1 AND group_bytes <= most THEN group_bytes END AS kept, CASE WHEN n > 1 THEN first ELSE doc_id END AS first FROM d JOIN g USING (digest), a),
p AS (SELECT *, (sum(size) OVER w)::BIGINT - size AS before, row_number() OVER w AS i FROM o WINDOW w AS (ORDER BY first NULLS LAST, digest, doc_id NULLS LAST, r ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, CASE WHEN kept IS NULL THEN 2 * before + size ELSE 2 * min(before) OVER (PARTITION BY digest) + kept END AS middle FROM p),
z AS (SELECT *, least(7, (middle * 8) // (2 * total))::INTEGER AS shard FROM q)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY i) - 1 AS slot, NULL::INTEGER AS grown_shard FROM z""",
    "op6_chat": r"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM t),
e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + list_sum(list_transform(['<s>', '</s>', '[TXT]', '[CONT]', '[INST]', '[/INST]'], lambda k: (length(text) - length(replace(text, k, ''))) // length(k))) AS n,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS joined FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE WHEN joined THEN 6 ELSE length(role) + 12 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op8_secrets": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_FOUND.format(rank=rank, kind=kind, pattern=pattern, group=group) for rank, (kind, pattern, group) in enumerate(_KINDS))}),
w AS (SELECT r, rank, kind, whole, value, (sum(length(gap) + coalesce(length(whole), 0)) OVER (PARTITION BY r, rank ORDER BY i))::BIGINT AS stop FROM f),
m AS (SELECT r, rank, kind, stop - length(whole) AS start, stop, stop - length(value) AS value_start, value FROM w
  WHERE whole IS NOT NULL AND CASE kind WHEN 'assign' THEN length(value) >= {secrets.VALUE_LENGTH} WHEN 'access' THEN length(whole) >= 16 ELSE length(whole) >= 32 END),
h AS (SELECT DISTINCT value, source, doc_id, CASE WHEN doc_id IS NULL THEN t END AS t FROM m JOIN d USING (r)),
o AS (SELECT value FROM h GROUP BY value HAVING count(DISTINCT source) + max((source IS NULL)::INT) >= {secrets.EXAMPLE_OWNERS} OR count(*) >= {secrets.EXAMPLE_REPOSITORIES}),
e AS (SELECT r, start, rank, kind, stop FROM m UNION ALL
  SELECT DISTINCT r, value_start, 3, CASE WHEN value IN (FROM o) THEN 'example' ELSE 'live' END, stop FROM m),
n AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, kind, stop) AS spans FROM e GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN n USING (r)""",
    "op9_mixing": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS rank,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS documents FROM d GROUP BY source),
w AS (SELECT *, {list(mixing.WEIGHTS)}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INT]::DOUBLE AS weight FROM s),
q AS (SELECT *, {mixing.CAP} * source_size / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum({mixing.CAP} * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q),
v AS (SELECT *, max(level) FILTER (level <= ratio) OVER () AS top FROM l),
t AS (SELECT source, source_size, documents, least({mixing.CAP} * source_size, coalesce(top * weight, {mixing.CAP} * source_size))::DOUBLE AS target FROM v),
a AS (SELECT source, ceil({mixing.CAP} * source_size / {mixing.BLOCK})::BIGINT AS most, target, round(sum(target) OVER () / {mixing.BLOCK})::BIGINT AS seats FROM t),
b AS (SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS place, seats FROM (SELECT *, unnest(range(0, most)) AS k FROM a)),
u AS (SELECT source, count(*) AS quota FROM b WHERE place <= seats GROUP BY source),
x AS (SELECT d.*, source_size, target, coalesce(quota, 0) AS quota, substr(rank, 1, greatest(0, ceil(ln(documents / {mixing.SHARD}) / ln(16)))::INT) AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN u ON d.source IS NOT DISTINCT FROM u.source),
h AS (SELECT source, shard, sum(size)::BIGINT AS shard_size, first(quota) AS quota FROM x GROUP BY source, shard),
i AS (SELECT source, shard, quota, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS place
  FROM (SELECT *, unnest(range(0, ceil({mixing.CAP} * shard_size / {mixing.BLOCK})::BIGINT)) AS k FROM h)),
j AS (SELECT source, shard, count(*) AS blocks FROM i WHERE place <= quota GROUP BY source, shard),
y AS (SELECT x.*, shard_size, least(coalesce(blocks, 0) * {mixing.BLOCK}, {mixing.CAP} * shard_size) AS budget,
  sum(size) OVER (PARTITION BY x.source, x.shard ORDER BY rank, doc_id, size, text ROWS UNBOUNDED PRECEDING) AS stop
  FROM x JOIN h ON x.source IS NOT DISTINCT FROM h.source AND x.shard = h.shard LEFT JOIN j ON x.source IS NOT DISTINCT FROM j.source AND x.shard = j.shard),
z AS (SELECT *, CASE WHEN shard_size > 0 THEN budget // shard_size ELSE 0 END AS passes FROM y)
SELECT doc_id, size::BIGINT AS size, source_size, target, (passes * size + least(size, greatest(0, budget - passes * shard_size - (stop - size))))::BIGINT AS taken FROM z""",
}
