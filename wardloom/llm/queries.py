"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_digest
from .decontaminate import contained_items
from .hard_negatives import mine_hard_negatives
from .license_scan import scan_licenses
from .lm_score import base_scores, score_documents
from .mixing import mix_report
from .ngram_join import document_links
from .quality_rff import score_quality
from .quality_rules import apply_rules
from .sharding import assign_shards
from .toxicity import score_toxicity
from .vector_codes import encode_vectors
from .vp_search import nearest_neighbours

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy groups and each document's number of links by exact Jaccard of 4-word shingles, at 0.85 or more."""
    return document_links(table(spark, sf_dir, "documents"), k=4, pct=85)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents under an interpolated bigram model of the training documents."""
    return score_documents(table(spark, sf_dir, "documents"))


def op3_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, equal texts together."""
    return assign_shards(table(spark, sf_dir, "documents"), shards=40)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in all documents that match a licence template."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by random Fourier features and ridge regression."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in budgeted windows, read back; with one more whose texts look like the template's marks."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return format_digest(rows.unionByName(extra))


#: The windows by a walk over each conversation's turns, and the digests straight from the table. Lengths of a turn as written: 4
#: for "### ", 2 for ":\n", 8 for "</turn>\n".
OP6_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\0'), '#', '\1'), '<', '\2') AS safe,
    length(role) + len(regexp_extract_all(role, '[\\#<:\n]')) + 14 AS frame,
    len(regexp_extract_all(text, '[\p{L}\p{M}]+|\p{N}{1,3}|[^\x20\x09-\x0D\p{L}\p{M}\p{N}]')) + 4 AS tokens FROM raw
), placed AS (
  SELECT *, frame + length(safe) AS chars, row_number() OVER w - 1 AS i, sum(tokens) OVER w AS upto FROM escaped
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, safe ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), convs AS (
  SELECT conv_id, count(*) AS n, (max(role) FILTER (WHERE i = 0) = 'system')::INT AS lead, CASE WHEN max(role) FILTER (WHERE i = 0) = 'system' THEN max(tokens) FILTER (WHERE i = 0) ELSE 0 END AS head,
    CASE WHEN max(role) FILTER (WHERE i = 0) = 'system' THEN max(chars) FILTER (WHERE i = 0) ELSE 0 END AS lead_chars FROM placed GROUP BY conv_id
), t AS (
  SELECT p.conv_id, i, lead, head, upto, upto - tokens AS before, chars, lag(upto - tokens, 1) OVER w AS before1, lag(upto - tokens, 2) OVER w AS before2, lag(chars, 1) OVER w AS chars1, lag(chars, 2) OVER w AS chars2
  FROM placed p JOIN convs USING (conv_id) WINDOW w AS (PARTITION BY p.conv_id ORDER BY i)
), b AS (
  SELECT *, CASE WHEN i - 2 >= lead AND before - before2 <= 128 AND head + upto - before2 <= 512 THEN 2 WHEN i - 1 >= lead AND before - before1 <= 128 AND head + upto - before1 <= 512 THEN 1 ELSE 0 END AS back FROM t
), walk(conv_id, i, base, opens) AS (
  SELECT conv_id, i, before, FALSE FROM b WHERE i = lead
  UNION ALL
  SELECT b.conv_id, b.i, CASE WHEN head + upto - base <= 512 THEN base WHEN back = 2 THEN before2 WHEN back = 1 THEN before1 ELSE before END, head + upto - base > 512
  FROM walk JOIN b ON b.conv_id = walk.conv_id AND b.i = walk.i + 1
), windows AS (
  SELECT conv_id, count(*) FILTER (WHERE opens) AS more, sum(CASE WHEN opens AND back >= 1 THEN chars1 ELSE 0 END + CASE WHEN opens AND back = 2 THEN chars2 ELSE 0 END) AS again FROM walk JOIN b USING (conv_id, i) GROUP BY conv_id
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(chars) + coalesce(any_value(more * lead_chars + again), 0))::BIGINT AS formatted_chars, (1 + coalesce(any_value(more), 0))::BIGINT AS n_windows
FROM placed JOIN convs USING (conv_id) LEFT JOIN windows USING (conv_id) GROUP BY conv_id
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts of all documents, and which of them the rules and the n-gram model keep."""
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by gradient-boosted trees."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain at least 0.8 of a benchmark item's 5-word shingles."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=5, share=0.8)


OP7_SQL = r"""
WITH plain AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), words AS (
  SELECT kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM plain
), shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT kind, id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest(range(1, 6)) AS k)
    WHERE len(w) >= k AND (k = 5 OR kind = 'i' AND len(w) = k OR kind = 'd' AND k IN (SELECT len(w) FROM words WHERE kind = 'i')))
), items AS (
  SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE kind = 'i'
)
SELECT d.id AS doc_id, item_id, any_value(n)::BIGINT AS n_item_shingles, count(*)::BIGINT AS n_shared, count(*) / any_value(n)::DOUBLE AS containment
FROM shingles d JOIN items USING (s) WHERE d.kind = 'd'
GROUP BY d.id, item_id HAVING count(*) >= 0.8 * any_value(n)
"""


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of all sources at weights 3, 1, 2 takes of each document."""
    return mix_report(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; labels of every seventh move on by one."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")))


_FINITE = "len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP11_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND {_FINITE}
), pairs AS (
  SELECT a.rid AS a, a.vec_id AS anchor_id, a.label = b.label AS same, b.rid AS b, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0
), pos AS (
  SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER w)::INTEGER AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM pos p JOIN pairs n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id NULLS LAST) QUALIFY row_number() OVER w <= 5
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors: eight parts, sixteen entries each, six rounds."""
    return encode_vectors(table(spark, sf_dir, "embeddings"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds of assignment and of means, one pair of common table expressions for each."""
    apart = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [f"""WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding::DOUBLE[]) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_FINITE}
), parts AS (
  SELECT rid, p, v[p * w + 1 : (p + 1) * w] AS v FROM (SELECT rid, v, len(v) // {parts} AS w, unnest(range({parts})) AS p FROM kept)
), book0 AS (SELECT p, rid - 1 AS e, v AS c FROM parts WHERE rid <= {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"near{i} AS (SELECT rid, p, min((apart, e)) AS best FROM (SELECT rid, p, e, {apart} AS apart FROM parts JOIN book{i} USING (p)) GROUP BY rid, p)")
        if i < rounds:
            steps.append(f"""sums{i} AS (
  SELECT p, e, k, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT p, best[2] AS e, unnest(v) AS x, unnest(range(len(v))) AS k FROM near{i} JOIN parts USING (rid, p)) GROUP BY ALL
), book{i + 1} AS (
  SELECT p, e, coalesce(m, c) AS c FROM book{i} LEFT JOIN (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY k) AS m FROM sums{i} GROUP BY ALL) USING (p, e)
)""")
    steps.append(f"""codes AS (
  SELECT vec_id, label, code, error FROM kept JOIN (SELECT rid, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near{rounds} GROUP BY rid) USING (rid)
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM codes""")
    return ", ".join(steps)


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest neighbours by cosine of every fiftieth vector, by vantage-point trees."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def neighbour_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13's rows, with scores rounded as SQL adds products up in another order."""
    return op13_nearest_neighbours(spark, sf_dir).withColumn("score", F.round("score", 9) + 0.0)


NEIGHBOUR_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT a.vec_id AS query_id, (row_number() OVER w)::INTEGER AS rank, b.vec_id, round(list_cosine_similarity(a.x, b.x), 9) + 0.0 AS score
FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0
WINDOW w AS (PARTITION BY a.rid ORDER BY list_cosine_similarity(a.x, b.x) DESC, b.vec_id NULLS LAST) QUALIFY row_number() OVER w <= 5
"""


# --- the parts of operators 2, 3, 5, 8, 9 and 10 that SQL can express, as the operators themselves return them --------------

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
#: crc32 of an id's decimal text, by the table of its polynomial.
_CRC = """WITH steps AS (
  SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, x)) AS t
), folds AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT), lambda c, b: xor(t[xor(c % 256, b) + 1], c // 256), 4294967295)) AS crc FROM documents, steps
)"""


def lm_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2's folds, counts and unigram scores."""
    got = base_scores(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", (F.round("base_score", 3) + 0.0).alias("base_score"))


LM_SQL = _CRC + f""", tokens AS (
  SELECT doc_id, crc % 7 = 2 AS held_out, unnest(list_append({_WORDS.format(f"coalesce({_LOWER}, '')")}, '')) AS t FROM documents JOIN folds USING (doc_id)
), counts AS (SELECT t, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY t), whole AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM counts)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens, round(sum(log10((coalesce(c, 0) + 1.0::DOUBLE) / (n + v + 1))), 3) + 0.0 AS base_score
FROM tokens LEFT JOIN counts USING (t), whole GROUP BY ALL
"""


def shard_row_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3's sizes and law, and how many shards each document's text stands in."""
    got = op3_minimax_sharding(spark, sf_dir)
    spread = got.groupBy(F.col("text_crc32").alias("_crc"), F.col("size").alias("_size")).agg(F.countDistinct("shard").alias("shards"))
    return got.join(spread, F.col("text_crc32").eqNullSafe(F.col("_crc")) & (F.col("size") == F.col("_size"))).select("doc_id", "size", "law", "shards")


SHARD_SQL = "SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size, 'bytes' AS law, 1::BIGINT AS shards FROM documents"


def quality_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5's documents and folds."""
    return op5_quality_classifier(spark, sf_dir).select("doc_id", "held_out")


def toxicity_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10's documents and folds."""
    return op10_toxicity(spark, sf_dir).select("doc_id", "held_out")


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8's counts and base rules."""
    return op8_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


RULES_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
flat AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM d),
runs AS (SELECT doc_id, i, t || ' ' || lead(t, 1) OVER o || ' ' || lead(t, 2) OVER o AS run FROM flat WINDOW o AS (PARTITION BY doc_id ORDER BY i) QUALIFY run IS NOT NULL),
twice AS (SELECT doc_id, i FROM runs JOIN (SELECT doc_id, run FROM runs GROUP BY ALL HAVING count(*) > 1) USING (doc_id, run)),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) t(j) GROUP BY doc_id),
counts AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[ 	-
]+', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM d) LEFT JOIN covered USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
"""


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9's sizes and targets, and whether each source's taken words come within 2 % (or a word) of its target."""
    sized = table(spark, sf_dir, "documents").select("doc_id", "source")
    got = op9_source_mixing(spark, sf_dir).join(sized, "doc_id")
    sums = got.groupBy(F.col("source").alias("_s")).agg(F.sum("taken").alias("_all"))
    near = F.abs(F.col("_all") - F.col("target")) <= F.greatest(F.lit(1.0), 0.02 * F.col("target"))
    out = got.join(F.broadcast(sums), F.col("source").eqNullSafe(F.col("_s")))
    return out.select("doc_id", "size", "source_size", (F.round("target", 6) + 0.0).alias("target"), near.alias("near"), (F.col("taken") <= 2 * F.col("size")).alias("within"))


MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
levels AS (
  SELECT 2.0::DOUBLE * size / w AS r, (1.5::DOUBLE * sum(size) OVER () - coalesce(sum(2 * size) OVER (ORDER BY 2.0::DOUBLE * size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 2.0::DOUBLE * size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM sums WHERE size > 0
),
goals AS (SELECT source, size AS source_size, least(2.0::DOUBLE * size, w * (SELECT arg_min(level, r) FROM levels WHERE level <= r)) AS target FROM sums)
SELECT doc_id, size, source_size, round(target, 6) + 0.0 AS target, TRUE AS near, TRUE AS within FROM d JOIN goals ON d.source IS NOT DISTINCT FROM goals.source
"""


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_minimax_sharding": op3_minimax_sharding,
    "op4_license_scan": op4_license_scan,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_quality_rules": op8_quality_rules,
    "op9_source_mixing": op9_source_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_vector_codes": op12_vector_codes,
    "op13_nearest_neighbours": op13_nearest_neighbours,
    "neighbour_ranks": neighbour_ranks,
    "lm_base_counts": lm_base_counts,
    "shard_row_sizes": shard_row_sizes,
    "quality_folds": quality_folds,
    "rule_counts": rule_counts,
    "mix_targets": mix_targets,
    "toxicity_folds": toxicity_folds,
}

ORACLE_SQL: dict[str, str] = {
    "op6_chat_formatting": OP6_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_vector_codes": _codes_sql(),
    "neighbour_ranks": NEIGHBOUR_SQL,
    "lm_base_counts": LM_SQL,
    "shard_row_sizes": SHARD_SQL,
    "quality_folds": _CRC + " SELECT doc_id, crc % 5 = 0 AS held_out FROM folds",
    "rule_counts": RULES_SQL,
    "mix_targets": MIX_SQL,
    "toxicity_folds": _CRC + " SELECT doc_id, crc % 3 = 1 AS held_out FROM folds",
}
