"""The dealt operators as queries over whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import alignment, decontamination, divergence, langid, lm_scoring, mixing, quality_rules, sharding, simhash, substring_dedup, toxicity, url_filter, word_bpe


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; the same on all executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return plan.taken().select("doc_id", "source", "size", "source_size", "target", "taken", "first_shard")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontamination.digest(decontamination.find_contamination(docs, benchmark))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    fingerprint = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", fingerprint.alias("fingerprint"), "component_id")


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    sharded = sharding.assign_shards(docs, "doc_id", (1.0,) * 16, tie_break=("text_crc32", "size"))
    grown = sharding.rendezvous(F.col("doc_id"), (1.0,) * 17)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard")
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op11_word_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    encoded = word_bpe.encode_words(table(spark, sf_dir, "documents"), tokenizer or vocabulary("word_bpe_49k.json"), stable=True)
    return word_bpe.digests(encoded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str, a: str | None = None, b: str | None = None) -> DataFrame:
    aligned = alignment.align(table(spark, sf_dir, "documents"), a or vocabulary("byte_bpe_50k.json"), b or vocabulary("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"), "n_overlaps")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets of operator 1, source by source."""
    plan = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return plan.sources.select("source", F.col("source_size").cast("long").alias("source_size"), F.round("target", 3).alias("target"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 5 reads from each url, and the listed rule that fits."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule")


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of operator 10 and its base rules."""
    found = quality_rules.statistics(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_url_templates": op5_url_templates,
    "op6_lm_score": op6_lm_score,
    "op7_rendezvous_shards": op7_rendezvous_shards,
    "op8_language_id": op8_language_id,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_word_bpe": op11_word_bpe,
    "op12_source_divergence": op12_source_divergence,
    "op13_token_alignment": op13_token_alignment,
    "mix_targets": mix_targets,
    "url_rules": url_rules,
    "quality_statistics": quality_statistics,
}

OP2_SQL = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM texts)
), firsts AS (
    SELECT s, min(doc_id) AS low FROM windows GROUP BY s
), gone AS (
    SELECT DISTINCT doc_id, i + k AS p
    FROM (SELECT doc_id, i, unnest(range(50)) AS k FROM windows JOIN firsts USING (s) WHERE doc_id > low)
), words AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM texts
), kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s
    FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT t.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""

OP3_SQL = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)
), lengths AS (
    SELECT DISTINCT n FROM windows
), parts AS (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM texts, lengths)
), found AS (
    SELECT doc_id, i, n, item_id FROM parts JOIN windows USING (n, s)
), hit AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_hit
    FROM (SELECT doc_id, i, unnest(range(n)) AS k FROM found) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts t LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP12_SQL = r"""
WITH docs AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS w
    FROM documents
), occurring AS (
    SELECT lang, source, r, unnest(w) AS term FROM docs
), kept AS (
    SELECT lang, term FROM occurring GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), sizes AS (
    SELECT lang, count(*) AS v FROM kept GROUP BY lang
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM occurring JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
    SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL
), cells AS (
    SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (t.total + v) AS p
    FROM totals t JOIN kept k ON t.lang = k.lang JOIN sizes s ON t.lang = s.lang
    LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), whole AS (
    SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 1) // (any_value(total) + any_value(v)) AS q
    FROM counts JOIN (SELECT lang, sum(total)::HUGEINT AS total FROM totals GROUP BY lang) USING (lang) JOIN sizes USING (lang) GROUP BY lang, term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN cells x ON x.lang = a.lang AND x.source = a.source LEFT JOIN cells y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
    GROUP BY ALL
), terms AS (
    SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM cells JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
    SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL
    SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

TARGETS_SQL = r"""
WITH sizes AS (
    SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS source_size FROM documents GROUP BY source
), weighted AS (
    SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight FROM sizes
), capped AS (
    SELECT *, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS everything, sum(weight) OVER () AS weights,
           coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0) AS full_before, coalesce(sum(weight) OVER before, 0) AS weight_before
    FROM weighted WINDOW before AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), leveled AS (
    SELECT *, (everything - full_before) / (weights - weight_before) AS level FROM capped
), settled AS (
    SELECT *, max(CASE WHEN most / weight > level THEN level END) OVER () AS final FROM leveled
)
SELECT source, source_size, round(least(most, coalesce(final * weight, most)), 3) AS target FROM settled
"""

URLS_SQL = r"""
WITH parts AS (
    SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
)
SELECT page_id, host, path,
    CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
         WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
FROM parts
"""

STATISTICS_SQL = r"""
WITH texts AS (
    SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM texts)
), repeated AS (
    SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, s) > 1
), covered AS (
    SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, unnest(range(5)) AS k FROM repeated) GROUP BY r
), lines AS (
    SELECT r, count(*) - count(DISTINCT line) AS n
    FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), counts AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
    FROM texts LEFT JOIN lines l USING (r) LEFT JOIN covered c USING (r)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
"""

ORACLES: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op3_decontaminate": OP3_SQL,
    "op12_source_divergence": OP12_SQL,
    "mix_targets": TARGETS_SQL,
    "url_rules": URLS_SQL,
    "quality_statistics": STATISTICS_SQL,
}
