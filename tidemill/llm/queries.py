"""Registered queries of this package: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat_trees, decontaminate, hard_negatives, langid, line_dedup, media_ts, mixing, packing, quality, simhash, substring_dedup, suffix_dedup, vector_codes
from ._base import table


def op1_quality_scores(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_repeated_bytes(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_repeated_passages(spark, sf_dir):
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op4_line_chunks(spark, sf_dir):
    out = line_dedup.deduplicate_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_chunks", F.sha2("text", 256).alias("kept_sha256"))


def op5_transport_streams(spark, sf_dir):
    return media_ts.digests(table(spark, sf_dir, "documents"))


def op6_benchmark_contamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_languages(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_mixed_sources(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_reply_trees(spark, sf_dir):
    return chat_trees.formatted_digests(chat_trees.with_trial(table(spark, sf_dir, "conversations")))


def op10_simhash_groups(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir):
    vectors, id_ = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    moved = vectors.withColumn("label", F.when(id_ % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(moved, id_ % 100 == 0)


def op12_packed_sequences(spark, sf_dir):
    cut = packing.pieces(table(spark, sf_dir, "documents"))
    return packing.place(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op13_vector_codes(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
items AS (SELECT item_id, w, least(len(w), 13) AS k, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM items),
sizes AS (SELECT DISTINCT k FROM wins),
places AS (SELECT doc_id, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k),
found AS (SELECT p.doc_id, p.i, p.k, wins.item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM places) p JOIN wins USING (k, win)),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS word FROM found) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""


OP9_SQL = r"""
WITH c AS (SELECT conv_id, 0 AS trial, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + 2 + length('<|im_start|><|im_end|>') + length(text) - length(replace(text, chr(92), '')) + (length(text) - length(replace(text, '<|', ''))) // 2) AS BIGINT) AS formatted_chars,
  count(CASE WHEN role = 'assistant' THEN 1 END) AS loss_spans
FROM c GROUP BY conv_id, trial
"""


OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b AS positive, p.score AS positive_score, s.b AS negative, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS r
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT a AS anchor_id, positive AS positive_id, CAST(r AS INTEGER) AS rank, negative AS negative_id, positive_score, negative_score FROM n WHERE r <= 10
"""

_NEAREST = "SELECT x.vec_id, x.part, min(x.d * 64 + x.entry) AS k FROM (SELECT x.vec_id, x.part, c.entry, sum((x.val - c.val) * (x.val - c.val)) AS d FROM x JOIN {c} c ON x.part = c.part AND x.pos = c.pos GROUP BY 1, 2, 3) x GROUP BY 1, 2"
_MOVED = "SELECT c.part, c.entry, c.pos, coalesce(m.val, c.val) AS val FROM {c} c LEFT JOIN (SELECT x.part, a.k % 64 AS entry, x.pos, CAST(floor(sum(x.val) / count(*)) AS BIGINT) AS val FROM x JOIN {a} a ON x.vec_id = a.vec_id AND x.part = a.part GROUP BY 1, 2, 3) m ON c.part = m.part AND c.entry = m.entry AND c.pos = m.pos"
OP13_SQL = f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, (i - 1) // (len(v) // 16) AS part, (i - 1) % (len(v) // 16) AS pos, v[i] AS val FROM (SELECT vec_id, v, unnest(generate_series(1, len(v))) AS i FROM e)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e QUALIFY entry < 64),
c0 AS (SELECT x.part, first.entry, x.pos, x.val FROM x JOIN first USING (vec_id)),
a0 AS ({_NEAREST.format(c="c0")}), c1 AS ({_MOVED.format(c="c0", a="a0")}),
a1 AS ({_NEAREST.format(c="c1")}), c2 AS ({_MOVED.format(c="c1", a="a1")}),
a2 AS ({_NEAREST.format(c="c2")}),
coded AS (SELECT vec_id, string_agg(lpad(lower(to_hex(k % 64)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(k // 64) AS BIGINT) AS error FROM a2 GROUP BY 1),
book AS (SELECT sha256(string_agg(CAST(val AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c2)
SELECT e.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN coded USING (vec_id), book
"""


def oracle_sql():
    return {"op9_reply_trees": OP9_SQL, "op6_benchmark_contamination": OP6_SQL, "op11_hard_negatives": OP11_SQL, "op13_vector_codes": OP13_SQL}
