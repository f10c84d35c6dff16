"""The registered queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm import (
    chat_format,
    decontaminate,
    line_dedup,
    near_dup,
    nearest,
    packing,
    pii,
    quality,
    resampling,
    sharding,
    structure_repair,
    suffix_dedup,
    url_rules,
)
from auditframe.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)],
        F.sha2(pii.spans_text(F.col("base_spans")), 256).alias("base_sha256"),
        pii.spans_text(F.col("pii_spans")).alias("spans"),
    )


@query
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_matches(docs, table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc_id", F.inline("matches"))


@query
def op4_sampled_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    placed = sharding.shard_records(docs, 24, F.xxhash64("text"), size, F.xxhash64("doc_id"))
    return placed.select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@query
def op6_collision_counting_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest_neighbours(vectors, vectors.filter("vec_id % 100 = 0"))


def word_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_vocabulary()).drop("ids")


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality.score_quality(docs, table(spark, sf_dir, "labels"), carry=["doc_id", "source", "lang"])


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query
def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = structure_repair.damage(table(spark, sf_dir, "conversations"))
    found = structure_repair.repair_conversations(damaged, present=F.col("present"))
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return found.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"),
    )


_CONTROL_TEXT = "\\### Assistant: </turn> ok"


@query
def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql("SELECT -7L AS conv_id, * FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    made = chat_format.format_conversations(rows.union(odd.withColumn("text", F.lit(_CONTROL_TEXT))))
    read = made.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.learned_text(F.col("segments")).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_FITS = lambda host, path: (
    f"(host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '{path}')"
)
CHECKS["op9_url_rules"] = rf"""
WITH rest AS (
 SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
 SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), {_AZ}) AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), ruled AS (
 SELECT *, CASE WHEN {_FITS('www.example.com', '/en/')} THEN 'www.example.com/en/'
  WHEN {_FITS('example.com', '/en/')} THEN 'example.com/en/'
  WHEN {_FITS('net', '/es/')} THEN 'net/es/' WHEN {_FITS('net', '/fr/')} THEN 'net/fr/'
  WHEN {_FITS('com', '/')} THEN 'com/' END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
 WHEN rule IS NOT NULL THEN 'block'
 WHEN regexp_matches(host || path, '^([^/]*[^a-z0-9/])?({'|'.join(url_rules.BLOCKED_WORDS)})([^a-z0-9]|$)') THEN 'block'
 ELSE 'allow' END AS verdict
FROM ruled
"""

CHECKS["op10_line_dedup"] = f"""
WITH split AS (
 SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), lines AS (
 SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM split
), keyed AS (
 SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_AZ}) AS k FROM lines
), common AS (
 SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
 SELECT doc_id, i, line, coalesce(doc_id <> keeper, false) AS gone FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

#: What escaping adds to a text: one character for each escape and each control string, overlapping ones too.
_ESCAPES = r"""length(t) - length(replace(t, chr(92), '')) + length(t) - length(replace(t, ']: ', ': ')) + length(t) - length(replace(t, '</turn>', '/turn>'))
 + coalesce(len(regexp_extract_all(t, '### ')), 0)"""
CHECKS["op13_chat_format"] = rf"""
WITH rows_ AS (
 SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
 UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok'
 UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'
), sized AS (
 SELECT *, length('### ') + length(role) + length(': ') + length(t) + {_ESCAPES} + length('</turn>') + 1 AS size FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
 CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _crc32(key: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, given a scalar list ``crc_table`` of 256 numbers."""
    octets = f"list_transform(range(CAST(length(hex({key})) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex({key}), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


_CRC_TABLE = """crc_bits AS (
 SELECT i, 0 AS k, i AS c FROM range(256) AS t(i)
 UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS crc_table FROM crc_bits WHERE k = 8)"""

_WORDS = rf"""unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'))"""
CHECKS["op11_importance_resampling"] = rf"""
WITH RECURSIVE {_CRC_TABLE}, said AS (
 SELECT doc_id, {_WORDS} AS w FROM documents
), wanted AS (
 SELECT {_WORDS} AS w FROM benchmark
), buckets AS (
 SELECT w, {_crc32('w')} % 10000 AS b FROM (SELECT w FROM said UNION SELECT w FROM wanted), crc
), raw AS (
 SELECT b, count(*) AS s FROM said JOIN buckets USING (w) GROUP BY b
), target AS (
 SELECT b, count(*) AS t FROM wanted JOIN buckets USING (w) GROUP BY b
), gains AS (
 SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM said) + 10000.0::DOUBLE)
  / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM wanted) + 10000.0::DOUBLE)))) AS BIGINT) AS gain
 FROM raw FULL JOIN target USING (b)
), weighed AS (
 SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM said JOIN buckets USING (w) JOIN gains USING (b) GROUP BY doc_id
), scored AS (
 SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
  (CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
 FROM documents d LEFT JOIN weighed USING (doc_id)
), ranked AS (
 SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r FROM scored
)
SELECT doc_id, n_features, weight, score,
 CASE WHEN n_features >= 20 AND r <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 THEN r END AS rank
FROM ranked
"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Turns that may be put in between two states of the machine over roles; longer ways only come back to a state.
_PUT_IN = """(VALUES ('', '', 0, ''), ('', 'I', 5, 'u'), ('', 'II', 10, 'a'), ('s', '', 0, 's'), ('s', 'I', 5, 'u'), ('s', 'II', 10, 'a'),
 ('u', '', 0, 'u'), ('u', 'I', 5, 'a'), ('a', '', 0, 'a'), ('a', 'I', 5, 'u')) AS put_in(q0, more, price, q1)"""
_READ = """(VALUES ('', 'K', 's', 's'), ('', 'K', 'u', 'u'), ('s', 'K', 'u', 'u'), ('u', 'K', 'a', 'a'), ('a', 'K', 'u', 'u'), ('', 'R', '', 'u'), ('s', 'R', '', 'u'),
 ('u', 'R', '', 'a'), ('a', 'R', '', 'u'), ('', 'D', '', ''), ('s', 'D', '', 's'), ('u', 'D', '', 'u'), ('a', 'D', '', 'a')) AS step(q, op, own, q0)"""
CHECKS["op12_structure_repair"] = rf"""
WITH RECURSIVE {_CRC_TABLE}, keyed AS (
 SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS t,
  {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS what FROM conversations, crc
), damaged AS (
 SELECT conv_id, turn, CASE what WHEN 4 THEN 'user' ELSE role END AS role,
  CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS t,
  unnest(CASE what WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM keyed WHERE what <> 0
), placed AS (
 SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t, copy) AS i, left(role, 1) AS own FROM damaged
), judged AS (
 SELECT *, CASE WHEN trim(t, {_BLANKS}) = '' THEN 'blank'
  WHEN row_number() OVER (PARTITION BY conv_id, role, t ORDER BY i) > 1 THEN 'duplicate'
  WHEN right(rtrim(t, {_BLANKS}), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(own) OVER (PARTITION BY conv_id ORDER BY i) || own AS pair FROM placed
), told AS (
 SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
), best AS (
 SELECT conv_id, CAST(0 AS BIGINT) AS i, q1 AS q, price AS cost, more AS audit FROM told, {_PUT_IN} WHERE q0 = ''
 UNION ALL
 SELECT conv_id, i, q, least_.c, least_.a FROM (
  SELECT j.conv_id, j.i, q1 AS q, min({{'c': b.cost + price + CASE op WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
    + CASE WHEN op <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END, 'a': b.audit || op || more}}) AS least_
  FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i + 1 JOIN {_READ} ON step.q = b.q AND (op <> 'K' OR step.own = j.own)
   JOIN {_PUT_IN} ON put_in.q0 = step.q0
  WHERE op = 'D' OR fault NOT IN ('blank', 'duplicate') GROUP BY j.conv_id, j.i, q1)
), chosen AS (
 SELECT t.*, min({{'c': cost, 'a': audit}}) AS e FROM told t JOIN best b ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND b.i = t.n AND b.q IN ('', 'a') GROUP BY ALL
), edits AS (
 SELECT conv_id, e.a AS audit, unnest(range(1, length(e.a) + 1)) AS p FROM chosen
), edited AS (
 SELECT conv_id, p, substr(audit, p, 1) AS op, length(regexp_replace(left(audit, p), 'I', '', 'g')) AS i, length(regexp_replace(left(audit, p), 'D', '', 'g')) AS o FROM edits
), made AS (
 SELECT e.conv_id, e.o, op, role, t, max(CASE WHEN o = 1 AND op = 'K' AND own = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
 FROM edited e LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.i = e.i AND op <> 'I' WHERE op <> 'D'
), repaired AS (
 SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(t, ''), chr(10) ORDER BY o) AS r
 FROM made GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
 coalesce(illegal, 0) AS illegal, CAST(coalesce(e.c, 0) AS BIGINT) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
