"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm import (
    chat, decontaminate, exact_dedup, packing, pieces, quality, secret_scan, simhash, suffix_dedup, token_files, toxicity,
    turn_repair, vector_codes,
)
from tallygrove.llm.common import load, tokenizer_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def sha256(text) -> F.Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and failure bits, stored; the verdicts of policy v1 and of its successor from the bits."""
    stored = quality.store(load(spark, sf_dir, "documents"), quality.EXTENDED)
    judged = quality.apply_policy(stored, quality.V1)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.failed(quality.BASE).alias("base_failed"), "kept", "n_lines", "fail_bits", "policy",
        (~quality.failed(quality.V2)).alias("kept_v2"), *quality.MORE_MEASURES,
    )


SQL["op1_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text,
    list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), g AS (
  SELECT r, unnest(range(1, greatest(len(w) - 1, 1))) AS p, w FROM w
), s AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2]) AS n FROM g
), c AS (
  SELECT r, count(DISTINCT p + k) AS n FROM s, (VALUES (0), (1), (2)) AS t(k) WHERE n > 1 GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct_words,
    CAST(len(regexp_replace(text, '[^0-9]', '', 'g')) AS BIGINT) AS n_digits,
    CAST(len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS BIGINT) AS n_bullet_lines,
    CAST(len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS BIGINT) AS n_open_lines
  FROM w LEFT JOIN c USING (r)
), b AS (
  SELECT *,
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_distinct_words < 15 * n_words THEN 64 ELSE 0 END
    + CASE WHEN 100 * n_digits > 25 * word_chars THEN 128 ELSE 0 END
    + CASE WHEN 100 * n_bullet_lines > 80 * n_lines THEN 256 ELSE 0 END
    + CASE WHEN 100 * n_open_lines > 30 * n_lines THEN 512 ELSE 0 END
    + CASE WHEN word_chars > 8000 * n_lines THEN 1024 ELSE 0 END
    + CASE WHEN n_words > 100000 THEN 2048 ELSE 0 END AS bits
  FROM m
)
"""
_LEDGER_SQL = SQL["op1_quality_rules"]
SQL["op1_quality_rules"] = _LEDGER_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (bits & 3) <> 0 AS base_failed, (bits & 63) = 0 AS kept, n_lines, CAST(bits AS BIGINT) AS fail_bits, 'v1' AS policy,
  (bits & 1991) = 0 AS kept_v2, n_distinct_words, n_digits, n_bullet_lines, n_open_lines
FROM b
"""


@query
def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy removes, alone or with others, from one stored ledger."""
    stored = quality.store(load(spark, sf_dir, "documents"), quality.EXTENDED)
    parts = [quality.ablation(stored, p, quality.EXTENDED).withColumn("policy", F.lit(p.version)) for p in quality.POLICIES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _ablation_sql() -> str:
    bits = {r.name: 1 << r.bit for r in quality.EXTENDED}
    parts = []
    for p in quality.POLICIES:
        mask = sum(bits[r] for r in p.rules)
        parts += [
            f"SELECT '{p.version}' AS policy, '{r}' AS rule, count(*) FILTER (bits & {bits[r]} <> 0) AS n_failed, "
            f"count(*) FILTER (bits & {mask} = {bits[r]}) AS n_failed_alone, count(*) FILTER (bits & {mask} = 0) AS n_kept, "
            f"count(*) FILTER (bits & {mask - bits[r]} = 0) AS n_kept_without FROM b"
            for r in p.rules
        ]
    return _LEDGER_SQL + " UNION ALL ".join(parts)


SQL["quality_ablation"] = _ablation_sql()


@query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose turns hold control strings."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    back = chat.read_back(chat.format_conversations(rows.unionByName(extra)))
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        sha256(said_all).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        sha256(F.col("loss_text")).alias("loss_sha256"),
        "formatted_chars",
        "identical",
    )


SQL["op9_chat_formatting"] = r"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, len(text) + len(regexp_extract_all(text, '(<|\[)\\*(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|/?TURN\])'))
    + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 20 + len(role) + len(regexp_extract_all(role, '(<|\[)\\*(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|/?TURN\])')) END AS n
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars, TRUE AS identical
FROM f GROUP BY conv_id
"""


@query
def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as Huffman-coded ids and read back."""
    path = tokenizer_file("byte_bpe_50k.json")
    return token_files.round_trip(load(spark, sf_dir, "documents"), path, end_id=2)


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    packed = packing.pack(load(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 2048, 0)
    return packed.select(
        "doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "sequence_id", "offset"
    )


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, through a new blob ledger."""
    found = secret_scan.find_secrets(load(spark, sf_dir, "documents"))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = secret_scan.listed(F.col("spans"), secret_scan.BASE_KINDS)
    return found.select(
        "doc_id", *[count(k) for k in secret_scan.BASE_KINDS], sha256(base).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"), F.col("blob").alias("blob_sha256"),
    )


def _either_case(pattern: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


def _secret_sql() -> str:
    """Places of matches from the pieces between them."""
    keywords = _either_case("password|passwd|secret|token|api_?key")
    parts = []
    for k, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern
        if rule.kind == "assign":
            pattern = f"({keywords})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        quoted = pattern.replace("'", "''")
        parts.append(
            f"SELECT r, {k} AS k, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(text, '{quoted}') AS gaps, "
            f"regexp_extract_all(text, '{quoted}', 0) AS hits, regexp_extract_all(text, '{quoted}', {rule.group}) AS held FROM d"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
u AS (SELECT r, k, kind, least, gaps, hits, held, unnest(range(1, len(hits) + 1)) AS i FROM m),
s AS (
  SELECT r, k, kind,
    list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x))), 0) AS b,
    len(hits[i]) AS n
  FROM u WHERE len(held[i]) >= least
), g AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(b + n AS BIGINT), ',' ORDER BY b, k) FILTER (k < 3) AS base,
    string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(b + n AS BIGINT), ',' ORDER BY b, k) AS spans
  FROM s GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(text) AS blob_sha256
FROM d LEFT JOIN g USING (r)
"""


SQL["op2_secret_scan"] = _secret_sql()


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents is the snapshot, the others are the new batch."""
    is_new = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    rows = exact_dedup.deduplicate(load(spark, sf_dir, "documents"), is_new)
    return rows.withColumnRenamed("digest", "text_sha256")


SQL["op10_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, len(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
"""


@query
def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles, linked at 3 differing bits or fewer."""
    rows = simhash.near_duplicates(load(spark, sf_dir, "documents"), simhash.exact_scheme(64, 3), 3)
    return rows.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities of every document and the verdict on toxicity."""
    return toxicity.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document covered by repeated strings of 200 bytes."""
    rows = suffix_dedup.remove_repeats(load(spark, sf_dir, "documents"), 200)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])
    return rows.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of the 32k vocabulary, and back."""
    docs = load(spark, sf_dir, "documents")
    return pieces.digests(docs, tokenizer_file("piece_bpe_32k.model")).select(
        "doc_id", "n_tokens", "ids_crc32", "score", "n_chunks", "decoded_sha256"
    )


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors and their errors."""
    rows, books = vector_codes.compress(load(spark, sf_dir, "embeddings"))
    return vector_codes.label_errors(rows).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(vector_codes.codebooks_sha256(books)).alias("codebooks_sha256"),
    )


def _assigned_sql(k: int) -> str:
    """Nearest entry of round k for each part of each vector."""
    return f"""a{k} AS (
  SELECT r, part, arg_min(e, [d, e]) AS e, min(d) AS d FROM (
    SELECT p.r, p.part, b.e, list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(p.v, b.v)]) AS d
    FROM p JOIN b{k} b USING (part)
  ) GROUP BY r, part
)"""


def _moved_sql(k: int) -> str:
    """Codebooks after round k; unused entries stay."""
    return f"""m{k} AS (
  SELECT part, e, list(f ORDER BY i) AS v FROM (
    SELECT part, a.e, i, CAST(floor(sum(CAST(p.v[i] AS DOUBLE)) / count(*)) AS BIGINT) AS f
    FROM a{k} a JOIN p USING (r, part), range(1, w + 1) AS t(i) GROUP BY part, a.e, i
  ) GROUP BY part, e
), b{k + 1} AS (
  SELECT b.part, b.e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m ON b.part = m.part AND b.e = m.e
)"""


SQL["op11_vector_codes"] = f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), p AS (
  SELECT r, part, v[part * w + 1:part * w + w] AS v, w FROM (SELECT r, v, len(v) // 16 AS w FROM k), range(16) AS t(part)
), b0 AS (SELECT part, r - 1 AS e, v FROM p WHERE r <= 64),
{_assigned_sql(0)}, {_moved_sql(0)}, {_assigned_sql(1)}, {_moved_sql(1)}, {_assigned_sql(2)},
c AS (
  SELECT r, lower(string_agg(printf('%02x', e), '' ORDER BY part)) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) FROM b2) AS codebooks_sha256
FROM k JOIN c USING (r)
"""


@query
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged in a known way and repaired."""
    rows = load(spark, sf_dir, "conversations")
    return turn_repair.repair(rows, turn_repair.damage(rows))


SQL["op12_turn_repair"] = r"""
WITH RECURSIVE k AS (
  SELECT row_number() OVER () AS r, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn,
    coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
), h AS (
  SELECT *, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST((ord(x) >> b) & 1 AS BIGINT) FOR b IN range(8)] FOR x IN string_split(name, '')])),
    lambda a, b: xor(a >> 1, CASE WHEN xor(a & 1, b) = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END)
  ), CAST(4294967295 AS BIGINT)) % 20 AS kind
  FROM k
), d AS (
  SELECT c, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, range(2) AS t(i) WHERE kind <> 0 AND (i = 0 OR kind = 3)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(len(role) || ':' || role || ':' || text)) AS p FROM d
), f AS (
  SELECT c, turn, role, text, p, left(role, 1) AS ini, lead(left(role, 1)) OVER (PARTITION BY c ORDER BY p) AS next_ini,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY p) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault
  FROM o
), ins AS (
  SELECT * FROM (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
    (0, 2, 3, 'I', 'u'), (1, 2, 3, 'I', 'u'), (3, 2, 3, 'I', 'u'), (2, 3, 3, 'I', 'a'),
    (0, 3, 6, 'II', 'ua'), (1, 3, 6, 'II', 'ua')) AS t(a, b, cost, audit, roles)
), edit AS (
  SELECT * FROM (VALUES (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0), (3, 2, 'K', 'u', 0), (2, 3, 'K', 'a', 0),
    (0, 2, 'R', 'user', 3), (1, 2, 'R', 'user', 3), (3, 2, 'R', 'user', 3), (2, 3, 'R', 'assistant', 3),
    (0, 0, 'D', '', 4), (1, 1, 'D', '', 4), (2, 2, 'D', '', 4), (3, 3, 'D', '', 4)) AS t(b, z, op, role, cost)
), move AS (
  SELECT a, z, op, edit.role AS e_role, ins.cost + edit.cost AS cost, ins.audit || op AS audit,
    CASE roles WHEN '' THEN [] WHEN 'u' THEN ['user:'] WHEN 'a' THEN ['assistant:'] ELSE ['user:', 'assistant:'] END AS made
  FROM ins JOIN edit ON ins.b = edit.b
), s(c, p, z, best) AS (
  SELECT c, CAST(0 AS BIGINT), 0, {'cost': CAST(0 AS BIGINT), 'audit': '', 'rows': CAST([] AS VARCHAR[])} FROM (SELECT DISTINCT c FROM f)
  UNION ALL
  SELECT s.c, s.p + 1, m.z, min({
    'cost': CAST(s.best.cost + m.cost + CASE WHEN f.fault = 'truncated' AND m.op <> 'D' THEN 3 ELSE 0 END AS BIGINT),
    'audit': s.best.audit || m.audit,
    'rows': list_concat(s.best.rows, m.made, CASE m.op WHEN 'K' THEN [f.role || ':' || f.text] WHEN 'R' THEN [m.e_role || ':' || f.text] ELSE [] END)
  })
  FROM s JOIN f ON f.c = s.c AND f.p = s.p + 1 JOIN move m ON m.a = s.z
  WHERE m.op = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (m.op = 'R' OR m.e_role = f.ini))
  GROUP BY s.c, s.p, m.z
), g AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (next_ini IS NOT NULL AND ini || next_ini NOT IN ('su', 'ua', 'au')) AS illegal, max(p) AS n
  FROM f GROUP BY c
), e AS (
  SELECT g.c, min({'cost': s.best.cost + ins.cost, 'audit': s.best.audit || ins.audit,
    'rows': list_concat(s.best.rows, CASE roles WHEN '' THEN [] WHEN 'u' THEN ['user:'] WHEN 'a' THEN ['assistant:'] ELSE ['user:', 'assistant:'] END)}) AS best
  FROM g JOIN s ON s.c = g.c AND s.p = g.n JOIN ins ON ins.a = s.z WHERE ins.b IN (0, 3) GROUP BY g.c
)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.rows, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM k) LEFT JOIN g USING (c) LEFT JOIN e USING (c)
"""


@query
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in ten-word windows of the benchmark."""
    rows = decontaminate.find(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["word_end"] - s["word"])
    return rows.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
        sha256(F.array_join("item_ids", ",")).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


SQL["op13_decontamination"] = r"""
WITH s AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), t AS (
  SELECT row_number() OVER () AS r, side, id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'
  ), lambda x: x <> '') AS w FROM s
), p AS (
  SELECT DISTINCT coalesce(CAST(id AS VARCHAR), '') AS item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS phrase
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM t WHERE side = 'b' AND len(w) > 0)
), d AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM t, (SELECT DISTINCT n FROM p) WHERE side = 'd' AND len(w) >= n)
), h AS (
  SELECT r, d.n, i, item FROM d JOIN p ON d.n = p.n AND d.phrase = p.phrase
), c AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r
), g AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM t LEFT JOIN c USING (r) LEFT JOIN g USING (r) WHERE side = 'd'
"""
