"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import centroid_clustering, conversation_repair, decontamination, exact_dedup, html_extraction, jaccard_join, line_dedup, lm_scoring, minhash_dedup, packing, pii, token_output, toxicity
from marketlens.llm.common import table
from marketlens.sources import scratch

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.exact_dedup(spark, f"{folder}/documents.parquet")
    return found.selectExpr(
        "document.doc_id AS doc_id", "keep_id", "group_size", "kept", "digest AS text_sha256"
    )


def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = lm_scoring.score_documents(docs.select("doc_id", "text"))
    return found.select(F.col("document.doc_id").alias("doc_id"), "n_tokens", "log_probability", "mean_log_probability")


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), TOKENIZER)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """By document its numbers of lines and the text that is left, as SHA-256."""
    found = line_dedup.dedup_lines(table(spark, folder, "documents"))
    text = F.col("document.text")
    return found.select(
        F.col("document.doc_id").alias("doc_id"), "n_lines", "n_removed",
        F.length(text).alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256"),
    )


def op5_token_output(spark: SparkSession, folder: str) -> DataFrame:
    """Read back from the written matrix; the checksum is of the two-byte ids in it."""
    packed = token_output.write_packed(
        table(spark, folder, "documents"), TOKENIZER, scratch.new_path(spark, "packed")
    )
    return token_output.segments(packed).select(
        F.col("document").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, folder, "documents"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.judged(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        F.col("document.doc_id").alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.toxicity_scores(docs.select("doc_id", "text"), model).select(
        F.col("document.doc_id").alias("doc_id"),
        toxicity.held_out("document.doc_id").alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    found = html_extraction.main_text(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(table(spark, folder, "documents"))
    base = F.col("base")
    return found.select(
        F.col("document.doc_id").alias("doc_id"),
        *(pii.count_of(base, kind).alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.audit_conversations(table(spark, folder, "conversations"))


def op11_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.minhash_groups(table(spark, folder, "documents"))


def op12_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    found = centroid_clustering.with_inertia(*centroid_clustering.centroid_clusters(table(spark, folder, "embeddings")))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clustering_sql(rounds: int = centroid_clustering.ROUNDS) -> str:
    """Lloyd's rounds on plain components, written out one after the other."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = ["""WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, x
  FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 8)
)"""]  # fmt: skip
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT vec_id, x, d.k AS k, d.d AS d
  FROM (SELECT v.vec_id, v.x, min({{'d': {distance}, 'k': c.k}}) AS d FROM v, c{n} c GROUP BY v.vec_id, v.x)
)""")
        if n < rounds:
            steps.append(f"""m{n} AS (
  SELECT k, p, CAST(floor_div(sum(e), count(*)) AS HUGEINT) AS e
  FROM (SELECT k, unnest(x) AS e, unnest(range(64)) AS p FROM a{n}) GROUP BY k, p
), c{n + 1} AS MATERIALIZED (
  SELECT k, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (SELECT k, list(e ORDER BY p) AS x FROM m{n} GROUP BY k) m USING (k)
)""")
    last = f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (k)
"""
    floor_div = "((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*))"
    return ", ".join(steps).replace("floor_div(sum(e), count(*))", floor_div) + last


#: The checksum bit by bit, then the cheapest edits row by row: a cost, an audit and the lines by state of the roles.
REPAIR_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
      lambda c: CAST(ord(c) AS BIGINT)) AS bytes
  FROM conversations
), hit AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b:
    list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS hit
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, unnest(CASE hit WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copies(copy)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged
), faults AS (
  SELECT *, CASE WHEN body = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial, 'su') NOT IN ('su', 'ua', 'au') AS illegal
  FROM r
), dp AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]} AS s0,
    CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])) AS s1,
    {'c': 5::BIGINT, 'a': 'I', 't': ['user:']} AS s2, {'c': 10::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']} AS s3
  FROM (SELECT DISTINCT conv_id FROM faults)
  UNION ALL
  SELECT conv_id, i, n0, n1, m2,
    list_min([n3, {'c': m2.c + 5, 'a': m2.a || 'I', 't': list_append(m2.t, 'assistant:')}])
  FROM (
    SELECT *, list_min([n2, {'c': n0.c + 5, 'a': n0.a || 'I', 't': list_append(n0.t, 'user:')},
      CASE WHEN n1 IS NOT NULL THEN {'c': n1.c + 5, 'a': n1.a || 'I', 't': list_append(n1.t, 'user:')} END,
      CASE WHEN n3 IS NOT NULL THEN {'c': n3.c + 5, 'a': n3.a || 'I', 't': list_append(n3.t, 'user:')} END]) AS m2
    FROM (
      SELECT conv_id, i, d0 AS n0,
        list_min([d1, CASE WHEN kept AND initial = 's' THEN {'c': s0.c + e, 'a': s0.a || 'K', 't': list_append(s0.t, own)} END]) AS n1,
        list_min([d2, CASE WHEN kept THEN {'c': s0.c + cu, 'a': s0.a || lu, 't': list_append(s0.t, tu)} END,
          CASE WHEN kept AND s1 IS NOT NULL THEN {'c': s1.c + cu, 'a': s1.a || lu, 't': list_append(s1.t, tu)} END,
          CASE WHEN kept AND s3 IS NOT NULL THEN {'c': s3.c + cu, 'a': s3.a || lu, 't': list_append(s3.t, tu)} END]) AS n2,
        list_min([d3, CASE WHEN kept AND s2 IS NOT NULL THEN {'c': s2.c + ca, 'a': s2.a || la, 't': list_append(s2.t, ta)} END]) AS n3
      FROM (
        SELECT dp.conv_id, faults.i, initial, s0, s1, s2, s3, fault NOT IN ('blank', 'duplicate') AS kept, role || ':' || text AS own,
          CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS e,
          e + CASE WHEN initial = 'u' THEN 0 ELSE 1 END AS cu, e + CASE WHEN initial = 'a' THEN 0 ELSE 1 END AS ca,
          CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END AS lu, CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END AS la,
          CASE WHEN initial = 'u' THEN own ELSE 'user:' || text END AS tu,
          CASE WHEN initial = 'a' THEN own ELSE 'assistant:' || text END AS ta,
          {'c': s0.c + 2, 'a': s0.a || 'D', 't': s0.t} AS d0,
          CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 2, 'a': s1.a || 'D', 't': s1.t} END AS d1,
          CASE WHEN s2 IS NOT NULL THEN {'c': s2.c + 2, 'a': s2.a || 'D', 't': s2.t} END AS d2,
          CASE WHEN s3 IS NOT NULL THEN {'c': s3.c + 2, 'a': s3.a || 'D', 't': s3.t} END AS d3
        FROM dp JOIN faults ON dp.conv_id IS NOT DISTINCT FROM faults.conv_id AND faults.i = dp.i + 1
      )
    )
  )
), best AS (
  SELECT conv_id, arg_max(list_min([s0, s3]), i) AS b FROM dp GROUP BY conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit,
  sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
  LEFT JOIN counted ON o.conv_id IS NOT DISTINCT FROM counted.conv_id
  LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id
"""

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_packing": op3_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_output": op5_token_output,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_html_extraction": op9_html_extraction,
    "op10_pii": op10_pii,
    "op11_minhash_dedup": op11_minhash_dedup,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_conversation_repair": op13_conversation_repair,
}

SQL = {
    "op1_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)
""",
    "op6_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), links AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
""",
    "op7_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + 12], ' ') AS phrase, least(len(w), 13) AS size
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM p
), dw AS (
  SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes)
), hits AS (
  SELECT doc_id, item_id, s, p.size FROM dw JOIN p ON dw.phrase = p.phrase AND dw.size = p.size
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + size)) AS pos FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op12_centroid_clustering": clustering_sql(),
    "op13_conversation_repair": REPAIR_SQL,
}


NEAR = SQL["op6_jaccard_join"].replace("100 * c >= 80", "100 * c >= 85")
SQL["op11_minhash_dedup"] = f"SELECT *, doc_id = component_id AS kept FROM ({NEAR})"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
