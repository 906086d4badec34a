"""Quality rules per document, and verdicts on whole hosts from shrunken failure rates.

Each document is measured in one pass over its whole text, without a shuffle. The narrow measures are
written to the shared folder once; failures are then summed by host (a row per host and task reaches
the shuffle, so a host with a third of all rows is no hot key), every host's failure rates are shrunk
towards a beta prior fitted to all hosts, and the host's verdict is joined back to its documents.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.words import SPACES, with_words
from feedloom.session import materialize

#: Hosts up to this many (about 64 MB of verdicts) are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 1_000_000
SYMBOLS = "[^#*$%&|<>]+"
RULES = ("short", "repeats", "symbols", "lines")


def _repeat_words() -> Column:
    """Words inside three-word windows that the text holds twice or more.

    ``_windows`` holds a hash per window and ``_packed`` the sorted hashes with the window's place in
    their low bits, so equal windows are neighbours; neighbours count when their words are equal too.
    """
    low = F.col("_low")
    place = lambda x: x.bitwiseAND(low - 1).cast("int")
    words = lambda x: F.slice("_words", place(x) + 1, F.lit(3))
    same = lambda x, y: (
        y.isNotNull() & (x.bitwiseAND(-low) == y.bitwiseAND(-low)) & (words(x) == words(y))
    )
    return F.filter(
        F.col("_packed"),
        lambda x, i: F.coalesce(same(x, F.get("_packed", i - 1)), F.lit(False))
        | F.coalesce(same(x, F.get("_packed", i + 1)), F.lit(False)),
    )


def document_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to every row.

    A null or empty text has zero of everything. Columns of ``docs`` with these names are replaced;
    other names that start with an underscore are reserved.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kept = [c for c in docs.columns if c not in made]
    whole = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    df = with_words(whole, F.col("_text"), SPACES, "_words")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines).withColumn(
        "_windows",
        F.when(
            F.size("_words") > 3,
            F.transform(
                F.sequence(F.lit(0), F.size("_words") - 3),
                lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
            ),
        ),
    )
    df = df.withColumn("_low", F.expr("shiftleft(1L, cast(ceil(log2(size(_words) + 1)) as int))"))
    df = df.withColumn(
        "_packed",
        F.when(
            F.size("_windows") > F.size(F.array_distinct("_windows")),
            F.sort_array(F.transform("_windows", lambda h, i: h.bitwiseAND(-F.col("_low")).bitwiseOR(i.cast("long")))),
        ),
    )
    df = df.withColumn(
        "_places",
        F.sort_array(F.transform(_repeat_words(), lambda x: x.bitwiseAND(F.col("_low") - 1))),
    )
    covered = F.aggregate(
        F.transform("_places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_places", i + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, b: a + b,
    )
    return df.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def failures() -> dict[str, Column]:
    """Which rules a measured document fails; the first two are the base rules."""
    return {
        "short": F.col("n_words") < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    }


def host_verdicts(measured: DataFrame, host: str, worst_rate: float, deviations: float = 4.0) -> tuple[DataFrame, int]:
    """One row per host: documents, shrunken failure rate by rule, whether the host is bad; and the number of hosts.

    The prior of a rule is the beta distribution with the mean and the variance of the hosts' rates,
    less the variance that sampling alone gives; its weight is kept between 1 and 1,000,000
    documents. A host is bad when a shrunken rate exceeds ``worst_rate``, or lies more than ``deviations``
    standard deviations of the prior above its mean: few hosts of the fitted kind do, and a small host is
    drawn to the mean before it is judged. Rows without a host have no verdict.
    """
    counts = measured.filter(F.col(host).isNotNull()).groupBy(host).agg(
        F.count("*").alias("n_docs"), *(F.sum(c.cast("long")).alias(r) for r, c in failures().items())
    )
    counts = materialize(counts, "hosts")
    rate = lambda r: F.col(r) / F.col("n_docs")
    sums = counts.agg(
        F.count("*").alias("hosts"),
        F.avg(1 / F.col("n_docs")).alias("noise"),
        *(F.avg(rate(r)).alias(f"mean_{r}") for r in RULES),
        *(F.var_pop(rate(r)).alias(f"var_{r}") for r in RULES),
    ).first()
    shrunk, limits = {}, {}
    for r in RULES:
        mean, var = sums[f"mean_{r}"] or 0.0, sums[f"var_{r}"] or 0.0
        spread = mean * (1 - mean)
        extra = var - spread * (sums["noise"] or 0.0)
        weight = min(max(spread / extra - 1, 1.0), 1e6) if extra > 0 else 1e6
        shrunk[r] = (F.col(r) + weight * mean) / (F.col("n_docs") + weight)
        limits[r] = min(worst_rate, mean + deviations * (spread / (weight + 1)) ** 0.5)
    verdicts = counts.select(
        host, "n_docs", *(c.alias(f"{r}_rate") for r, c in shrunk.items()),
        reduce(or_, (shrunk[r] > limits[r] for r in RULES)).alias("host_bad"),
    )
    return verdicts, sums["hosts"]


def apply_quality_rules(
    docs: DataFrame, host: str = "source", text: str = "text", worst_rate: float = 0.5, deviations: float = 4.0
) -> DataFrame:
    """Every row of ``docs`` without its text, its measures, base_failed, host_bad and kept.

    A row is kept when it fails no base rule and its host is not bad. Rows that repeat are measured and
    returned each; null and empty texts fail the length rule; a null host is never bad. An empty table
    gives an empty result. Columns called like a result column are replaced.
    """
    made = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "host_bad", "kept"}
    names = [c for c in docs.columns if c == text or c not in made]
    measured = materialize(document_measures(docs.select(*names), text).drop(text), "measures")
    verdicts, hosts = host_verdicts(measured, host, worst_rate, deviations)
    verdicts = verdicts.select(F.col(host).alias("_host"), "host_bad")
    if hosts <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    rules = failures()
    base = rules["short"] | rules["repeats"]
    joined = measured.join(verdicts, F.col(host) == F.col("_host"), "left").drop("_host")
    bad = F.coalesce("host_bad", F.lit(False))
    return joined.withColumn("host_bad", bad).withColumn("base_failed", base).withColumn("kept", ~base & ~bad)
