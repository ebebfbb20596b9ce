"""The corpus queries that the entry module adds, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, mixing, periodic, phrases, quality_model, quality_rules, sharding, simhash, suffix_dedup, token_counts, token_files, toxicity, url_filters
from .common import spread

URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), url_filters.rules_frame(spark, URL_RULES))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select("doc_id", *quality_rules.RESULTS)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept_text")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    planned, n = mixing.plan_mix(docs)
    return planned.select("doc_id", "source", *[planned[n[c]].alias(c) for c in ("n_tokens", "weight", "epochs", "block", "order", "copies")])


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.read_documents(token_files.write_shards(docs, str(public_tokenizers.path("word_bpe_49k.json")), end_id=2))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("text_key")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.digests(periodic.find_runs(docs.withColumn("text", periodic.planted(docs["doc_id"], docs["text"])), digest=True))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_model.score(docs, quality_model.learn(docs, table(spark, sf_dir, "labels")))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_mixing": op2_mixing,
    "op3_url_filters": op3_url_filters,
    "op4_simhash": op4_simhash,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_files": op8_token_files,
    "op9_decontamination": op9_decontamination,
    "op10_sharding": op10_sharding,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_phrases": op13_phrases,
}

ORACLES = {
    "op3_url_filters": r"""
WITH cut AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1)) AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
found AS (SELECT page_id, host, path, max(struct_pack(n := length(h || p), rule := h || p, v := v)) FILTER (WHERE h IS NOT NULL) AS best
  FROM cut LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, host, path)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM found""",
    "op7_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
judged AS (SELECT doc_id, line, len(lw) AS n, len(lw) > 0 AND (len(regexp_extract_all(line, '[#*$%&|<>]')) * 10 > len(lw) * 3
    OR (len(lw) >= 5 AND line = upper(line) AND line <> lower(line)) OR (len(lw) >= 10 AND len(list_distinct(lw)) * 10 < len(lw) * 3)
    OR (len(lw) < 4 AND NOT regexp_matches(line, '[.!?:;…)"»]\s*$'))
    OR contains(lower(line), 'licensed under') OR contains(lower(line), 'all rights reserved') OR contains(lower(line), 'spdx-license') OR contains(lower(line), 'copyright (c)')
    OR contains(lower(line), 'cookie policy') OR contains(lower(line), 'accept cookies') OR contains(lower(line), 'privacy policy') OR contains(lower(line), 'terms of service')
    OR contains(lower(line), 'terms of use') OR contains(lower(line), 'sign in') OR contains(lower(line), 'click here')) AS fails FROM lines),
by_line AS (SELECT doc_id, count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines, CAST(coalesce(sum(n) FILTER (WHERE fails), 0) AS BIGINT) AS n_lost_words FROM judged GROUP BY doc_id),
windows AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) t(k) GROUP BY doc_id),
figures AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, n_lost_words
  FROM d JOIN by_line USING (doc_id) LEFT JOIN repeats r ON r.doc_id = d.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_lost_words <= n_words * 0.3 AS kept FROM figures""",
    "op9_decontamination": r"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (SELECT DISTINCT id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM (SELECT id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hits AS (SELECT doc_id, places.n, s, id FROM places JOIN wins ON places.win = wins.win AND places.n = wins.n),
covered AS (SELECT doc_id, count(DISTINCT s + k) AS n_hit FROM (SELECT doc_id, s, unnest(range(n)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op13_phrases": r"""
WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 5) t(k))),
counts AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
frequent AS (SELECT * FROM counts WHERE n >= 30),
candidates AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM frequent WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, cut, x.n AS l, y.n AS r, CAST(2000000 AS HUGEINT) * c.a // (x.n + y.n) AS score FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.w, 1, cut), ' ') JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.w, cut + 1, c.k), ' ')),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
held AS (SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS longer FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM candidates, range(2, 4) t(m) WHERE m < k) GROUP BY ALL),
free AS (SELECT w.* FROM weakest w LEFT JOIN held h ON h.lang = w.lang AND h.phrase = w.phrase WHERE h.longer IS NULL OR 100 * h.longer < 80 * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT ranked.lang, rank, phrase, a, l, r, totals.n AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000""",
}
