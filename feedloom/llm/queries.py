"""The registered queries of this package, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.alignment import align_tokenizers
from feedloom.llm.decontaminate import decontaminate
from feedloom.llm.license_scan import Template, scan_licenses
from feedloom.llm.line_dedup import dedup_lines
from feedloom.llm.ngram_model import held_out, score_texts, train
from feedloom.llm.pieces import encode_pieces
from feedloom.llm.quality_classifier import score_quality, train_classifier
from feedloom.llm.quality_rules import apply_quality_rules
from feedloom.llm.url_filter import judge_urls
from feedloom.llm.simhash import near_duplicates
from feedloom.llm.token_counts import token_counts
from feedloom.llm.toxicity import score_toxicity, train_tagger
from feedloom.llm.whitening import whiten
from feedloom.session import literal_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- 5: url filters

#: Host, path, verdict, tier; tier 0 decides before tier 1.
URL_RULES = [
    ("org", "/", "allow", 0),
    ("example.org", "/es/", "block", 0),
    ("example.org", "/en/1", "block", 0),
    ("com", "/fr/", "allow", 0),
    ("com", "/de/", "block", 0),
    ("adult-x.example.com", "/", "block", 1),
    ("ads-track.example.com", "/", "block", 1),
    ("casino-win.example.net", "/", "block", 1),
    ("cheap-pills.example.net", "/", "block", 1),
    ("free-bets.example.net", "/", "block", 1),
    ("spam-farm.example.org", "/", "block", 1),
]

URL_SQL = """
WITH u AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url FROM pages
), p AS (
  SELECT r, page_id,
         translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM u
), rules(h, q, v, tier) AS (VALUES """ + ", ".join(map(str, URL_RULES)) + """),
m AS (
  SELECT r, h || q AS rule, v, tier,
         row_number() OVER (PARTITION BY r ORDER BY tier, length(h || q) DESC, length(h) DESC, v DESC) AS k
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
)
SELECT page_id, host, path, CASE WHEN tier = 0 THEN rule END AS rule, coalesce(v, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (r)
"""


@query("op5_url_filter", URL_SQL)
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: the base rules decide, then the block list."""
    rules = literal_rows(spark, URL_RULES, "host string, path string, verdict string, tier int")
    judged = judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules)
    base = F.when(F.col("tier") == 0, F.col("rule"))
    return judged.select("page_id", "host", "path", base.alias("rule"), "verdict")


# ---- 10: quality rules

QUALITY_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), rep AS (
  SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1
), cov AS (
  SELECT r, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) o(o) GROUP BY r
), m AS (
  SELECT r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (r)
), f AS (
  SELECT *, CAST(n_words < 50 AS INT) AS f1, CAST(100 * n_repeat_words > 50 * n_words AS INT) AS f2,
         CAST(10 * n_symbols > word_chars AS INT) AS f3, CAST(10 * n_dup_lines > 3 * n_lines AS INT) AS f4
  FROM m
), h AS (
  SELECT source, count(*) AS n, k, sum(x) AS bad
  FROM (SELECT source, unnest([1, 2, 3, 4]) AS k, unnest([f1, f2, f3, f4]) AS x FROM f WHERE source IS NOT NULL)
  GROUP BY source, k
), pri AS (
  SELECT k, avg(bad / n) AS mean, avg(bad / n) * (1 - avg(bad / n)) AS spread,
         var_pop(bad / n) - avg(bad / n) * (1 - avg(bad / n)) * avg(1 / n) AS extra
  FROM h GROUP BY k
), wt AS (
  SELECT k, mean, spread, CASE WHEN extra > 0 THEN least(greatest(spread / extra - 1, 1.0), 1e6) ELSE 1e6 END AS weight FROM pri
), hv AS (
  SELECT source, bool_or((bad + weight * mean) / (n + weight) > least(0.5, mean + 4 * sqrt(spread / (weight + 1)))) AS host_bad FROM h JOIN wt USING (k) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, coalesce(host_bad, false) AS host_bad,
       f1 + f2 > 0 AS base_failed, f1 + f2 = 0 AND NOT coalesce(host_bad, false) AS kept
FROM f LEFT JOIN hv ON f.source = hv.source
"""


@query("op10_quality_rules", QUALITY_SQL)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, its base rules and the verdict on its source."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return apply_quality_rules(docs).drop("source")


# ---- 1: license scans

LICENSES = [
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
    ),
    Template(
        "mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"
    ),
]

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_ALNUM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LICENSE_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, {_ALNUM_WORDS} AS ws FROM documents
), t0(t, label, text, base) AS (VALUES """ + ", ".join(str((i, *t)) for i, t in enumerate(LICENSES)) + rf"""),
t AS (SELECT t, label, base, {_ALNUM_WORDS} AS tw FROM t0),
tg AS (
  SELECT t, label, base, len(tw) AS n, least(3, len(tw)) AS k, i AS tpos,
         array_to_string(tw[i + 1 : i + least(3, len(tw))], ' ') AS gram
  FROM (SELECT *, unnest(range(0, len(tw) - least(3, len(tw)) + 1)) AS i FROM t)
), dg AS (
  SELECT r, k, i AS pos, array_to_string(ws[i + 1 : i + k], ' ') AS gram
  FROM (SELECT r, ws, k, unnest(range(0, len(ws) - k + 1)) AS i FROM w, (VALUES (2), (3)) ks(k))
), hits AS (
  SELECT r, t, label, base, n, k, pos, tpos, pos - tpos AS diagonal FROM dg JOIN tg USING (k, gram)
), steps AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= CASE WHEN n <= 3 THEN 0 ELSE 3 END THEN 0 ELSE 1 END AS new
  FROM (SELECT r, t, label, base, n, k, diagonal, min(pos) AS pos, list(tpos) AS seen FROM hits GROUP BY ALL)
  WINDOW o AS (PARTITION BY r, t ORDER BY diagonal)
), numbered AS (
  SELECT *, sum(new) OVER (PARTITION BY r, t ORDER BY diagonal) AS grp FROM steps
), spans AS (
  SELECT r, t, label, base, min(pos) AS first_word,
         len(list_distinct(flatten(list(seen)))) / (any_value(n) - any_value(k) + 1) AS share
  FROM numbered GROUP BY r, t, label, base, grp
), s AS (SELECT * FROM spans WHERE share >= 0.6)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(coalesce(sum(CAST(base AS INT)), 0) AS BIGINT) AS n_base,
       CAST(min(first_word) FILTER (base) AS BIGINT) AS first_word,
       CAST(max(first_word) FILTER (base) AS BIGINT) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
       CAST(coalesce(max(share), 0) AS DOUBLE) AS score
FROM w LEFT JOIN s USING (r) GROUP BY r, doc_id, len(ws)
"""


@query("op1_license_scan", LICENSE_SQL)
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    return scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"), LICENSES)


# ---- 9: benchmark decontamination

CONTAMINATION_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_ALNUM_WORDS} AS ws FROM documents
), b AS (
  SELECT item_id, ws, least(10, len(ws)) AS n FROM (SELECT item_id, {_ALNUM_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0
), bw AS (
  SELECT item_id, n, i, array_to_string(ws[i + 1 : i + n], ' ') AS gram, ws[i + 1 : i + n] AS win
  FROM (SELECT *, unnest(range(0, len(ws) - n + 1)) AS i FROM b)
), dw AS (
  SELECT r, n, i, array_to_string(ws[i + 1 : i + n], ' ') AS gram
  FROM (SELECT r, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw))
), occ AS (
  SELECT DISTINCT r, dw.i, dw.n, item_id FROM dw JOIN bw USING (n, gram)
), hit AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM occ) GROUP BY r
), it AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id ) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY r
), v AS (
  SELECT win, n, row_number() OVER () AS w FROM (SELECT DISTINCT win, n FROM bw)
), vo AS (
  SELECT w, n, unnest(win) AS word, unnest(range(0, n)) AS o FROM v
), p AS (
  SELECT r, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM d
), rare AS (
  SELECT w, arg_min(o, c) AS o, arg_min(word, c) AS word
  FROM vo JOIN (SELECT word, count(*) AS c FROM p GROUP BY word) USING (word) GROUP BY w
), st AS (
  SELECT DISTINCT r, w, pos - o - j AS s FROM rare JOIN p USING (word), (VALUES (0), (1), (2), (3)) js(j)
), ok AS (
  SELECT st.r, w, s FROM st JOIN vo USING (w) JOIN p ON p.r = st.r AND p.word = vo.word AND p.pos BETWEEN s + o AND s + o + 3
  GROUP BY st.r, w, s, n HAVING count(DISTINCT o) = n
), near AS (
  SELECT r, count(DISTINCT w) AS n_near FROM ok GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r) LEFT JOIN near USING (r)
"""


@query("op9_decontaminate", CONTAMINATION_SQL)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document, word for word and by proximity."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


# ---- 8: simhash near-duplicates


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


# ---- 4: language-model scoring


@query("op4_lm_scores")
def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kneser-Ney bigram scores of every document; a tenth of the documents is held out of training."""
    docs = read(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    model = train(docs.filter(~F.col("held_out")), order=2)
    scored = score_texts(docs, model).withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


# ---- 7: toxicity


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a fifth of the labels is held out of training."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels")
    tagger = train_tagger(docs, labels.filter(~held_out(F.col("doc_id"), 5)))
    scored = score_toxicity(docs, tagger)
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "toxic_tokens",
        F.size("toxic_spans").cast("long").alias("n_spans"),
        F.get("toxic_spans", F.lit(0))["start"].cast("long").alias("first_offset"),
    )


# ---- 3: line dedup


@query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later copies of repeated runs of lines."""
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


# ---- 6: token counts


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files."""
    return token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"))


# ---- 2: sentencepiece encoding and decoding


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding of every document, whether it decodes to the text, and two sampled segmentations."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = encode_pieces(docs, k=2, decoded="decoded")
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
        F.transform("samples", lambda s: F.size(s["ids"]).cast("long")).alias("sample_ids"),
        F.transform("samples", lambda s: F.xxhash64(s["ids"])).alias("sample_hashes"),
        F.transform("samples", lambda s: s["log_prob"]).alias("log_probs"),
        F.transform("samples", lambda s: s["inclusion"]).alias("inclusions"),
    )


# ---- 12: embedding whitening


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding projected on the first 32 components of all of them, to unit variance."""
    return whiten(read(spark, sf_dir, "embeddings"))


# ---- 13: quality classifier


@query("op13_quality")
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a fifth of the labels is held out of training."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels")
    model = train_classifier(docs, labels.filter(~held_out(F.col("doc_id"), 5)))
    scored = score_quality(docs, model, name="score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


# ---- 11: cross-tokenizer alignment


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers' tokens cover every document, and how often their pairs meet in all documents."""
    found = align_tokenizers(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.withColumn("groups_sha256", digest).drop("groups")
