"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm import (
    byte_bpe, cross_entropy, cutting_stock, fingerprints, jaccard_join, longest_previous, main_text, periodic_runs, personal_data,
    piece_codec, role_repair, rule_ledger, structure_repair,
)
from roadlens.llm.registry import query, table, tokenizer_path

OP10_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram
      FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, generate_series(0, 7) AS s(j) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT line) AS dups
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             coalesce(lines, 0) AS n_lines, CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper,
             len(list_filter(generate_series(2, len(ws)), lambda i: ws[i] = ws[i - 1])) AS stutters,
             length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters
      FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
        + CASE WHEN n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
        + CASE WHEN word_chars > 30 * n_words THEN 32 ELSE 0 END
        + CASE WHEN letters >= 20 AND 10 * upper > 4 * letters THEN 64 ELSE 0 END
        + CASE WHEN 10 * stutters > 3 * n_words THEN 128 ELSE 0 END AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failures & 3 <> 0 AS base_failed, failures = 0 AS kept, CAST(failures AS BIGINT) AS failures
FROM f"""


@query("op10_quality_rules", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_ledger.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rule_ledger.passes(rule_ledger.BASE)).alias("base_failed"),
        rule_ledger.passes(rule_ledger.STANDARD).alias("kept"), "failures")


ABLATION_SQL = f"""
SELECT rule, CAST(sum(CASE WHEN failures & bit <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS fails,
       CAST(sum(CASE WHEN failures = bit THEN 1 ELSE 0 END) AS BIGINT) AS only_this,
       CAST(sum(CASE WHEN failures & ~bit = 0 THEN 1 ELSE 0 END) AS BIGINT) AS kept_without
FROM ({OP10_SQL}), (VALUES {", ".join(f"('{r}', {rule_ledger.BITS[r]}::BIGINT)" for r in rule_ledger.STANDARD.rules)}) AS p(rule, bit)
GROUP BY rule"""


@query("op10_rule_ablations", ABLATION_SQL)
def op10_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_ledger.ledger(table(spark, sf_dir, "documents"))
    return rule_ledger.ablations(rows, rule_ledger.STANDARD).select("rule", "fails", "only_this", "kept_without")


@query("op4_document_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = fingerprints.with_next(
        docs, "doc_id", {"text": "next_text", "sketch": "next_sketch"},
        lambda df: fingerprints.with_sketch(df, "text", "sketch"))
    docs = docs.withColumn("edited", fingerprints.edited_text("text", "next_text"))
    docs = fingerprints.with_sketch(docs, "edited", "edited_sketch")
    return docs.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text("sketch").alias("fingerprint"),
        fingerprints.as_text("edited_sketch").alias("edited_fingerprint"),
        fingerprints.resemblance("sketch", "edited_sketch").alias("near_edited"),
        fingerprints.resemblance("sketch", "next_sketch").alias("near_next"),
        fingerprints.containment("edited_sketch", "sketch").alias("edited_contained"),
        fingerprints.distinct_count(F.col("sketch")).alias("n_shingles"))


@query("op2_personal_data")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.report(table(spark, sf_dir, "documents"))


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = cutting_stock.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encoded(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op6_ngram_jaccard_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_suffix_array_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return longest_previous.without_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_main_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op5_cross_entropy_difference")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy.cross_entropy_difference(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_role_repair")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_repair.repaired(table(spark, sf_dir, "conversations")).drop("place")


OP11_SQL = r"""
WITH RECURSIVE r AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
h AS (
  SELECT *, xor(list_reduce(list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda c, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384)
                                                                   ELSE d >> 1 END, xor(c, b)),
      CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS how FROM r),
d AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
         CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, generate_series(0, 1) AS s(copy) WHERE how <> 0 AND (copy = 0 OR how = 3)),
o AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before, rtrim(text, E' \t\n\x0b\f\r') AS kept
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (
  SELECT *, CASE WHEN kept = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                 WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM o),
ins(st, mid, c, a, said) AS (VALUES
  ('', '', 0, '', []::VARCHAR[]), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('a', 'a', 0, '', []),
  ('', 'u', 3, 'I', ['user:']), ('s', 'u', 3, 'I', ['user:']), ('a', 'u', 3, 'I', ['user:']), ('u', 'a', 3, 'I', ['assistant:']),
  ('', 'a', 6, 'II', ['user:', 'assistant:']), ('s', 'a', 6, 'II', ['user:', 'assistant:'])),
act(mid, edit, nxt, c, name) AS (VALUES
  ('', 'D', '', 4, ''), ('s', 'D', 's', 4, ''), ('u', 'D', 'u', 4, ''), ('a', 'D', 'a', 4, ''),
  ('', 'K', 's', 0, ''), ('', 'K', 'u', 0, ''), ('s', 'K', 'u', 0, ''), ('u', 'K', 'a', 0, ''), ('a', 'K', 'u', 0, ''),
  ('', 'R', 'u', 3, 'user'), ('s', 'R', 'u', 3, 'user'), ('u', 'R', 'a', 3, 'assistant'), ('a', 'R', 'u', 3, 'user')),
p AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, '' AS st, CAST(0 AS BIGINT) AS cost, '' AS audit, []::VARCHAR[] AS said FROM f
  UNION ALL
  SELECT conv_id, k, st, cost, audit, said FROM (
    SELECT f.conv_id, f.k, act.nxt AS st,
           p.cost + ins.c + act.c + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost,
           p.audit || ins.a || edit AS audit,
           p.said || ins.said || CASE edit WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text]
                                           ELSE [act.name || ':' || text] END AS said
    FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.k = p.k + 1
           JOIN ins ON ins.st = p.st JOIN act ON act.mid = ins.mid
    WHERE edit = 'D' OR fault IS DISTINCT FROM 'blank' AND fault IS DISTINCT FROM 'duplicate'
                        AND (edit = 'R' OR nxt = left(role, 1)))
  QUALIFY row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) = 1),
n AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
e AS (
  SELECT n.*, p.cost + ins.c AS cost, p.audit || ins.a AS audit, p.said || ins.said AS said
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.rows = p.k JOIN ins ON ins.st = p.st
  WHERE ins.mid IN ('', 'a')
  QUALIFY row_number() OVER (PARTITION BY n.conv_id ORDER BY p.cost + ins.c, p.audit || ins.a) = 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with some turns dropped, emptied, cut, repeated or given to the user, by a
    hash of conversation and turn."""
    space = F.lit(" ")
    turns = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    place = F.concat(*(F.coalesce(c, space) for c in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))))
    turns = turns.withColumn("_how", F.crc32(place.cast("binary")) % 20).filter("_how != 0")
    how = F.col("_how")
    turns = turns.withColumns({
        "text": F.when(how == 1, "").when(how == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "role": F.when(how == 4, "user").otherwise(F.col("role")),
        "_copy": F.explode(F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))})
    return turns.drop("_how", "_copy")


@query("op11_structure_repair", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = structure_repair.summaries(damaged(turns)).withColumnRenamed("conv_id", "_conv")
    rows = turns.select("conv_id").distinct()
    rows = rows.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return rows.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in structure_repair.NUMBERS),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id`` and text; of every tenth document, by a hash of its id, the words from a place
    on repeat with a period."""
    code = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))
    word = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), code.alias("_code"))
    docs = docs.withColumn("_words", F.when(F.col("_code") % 10 == 0, word)).withColumn("_n", F.size("_words").cast("long"))
    g = F.floor(F.col("_code") / 10)
    docs = docs.withColumn("_a", F.when(F.col("_n") > 0, g % F.col("_n")))
    docs = docs.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)))
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: F.get(
        "_words", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    return docs.select("doc_id", F.when(F.col("_n") > 0, F.concat_ws(" ", places)).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs.with_runs(with_periods(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = rows.withColumn("best", best)
    length = -F.col("best.short")
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(
        "", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query("op13_byte_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = byte_bpe.encoded(table(spark, sf_dir, "documents"), path, pattern)
    rows = byte_bpe.decoded(rows, path, pattern)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
