"""License scans by diagonal voting.

Every rolling word k-gram of a text is hashed and joined to the places that k-gram has in the license
templates. A hit votes for the diagonal (place in text minus place in template); votes are summed by
document, template and diagonal, neighbouring diagonals are merged (words put in or left out shift
them), and a span stands when it holds enough of its template's k-grams.

The templates are a list given by the caller, so the join broadcasts a table of proven size and only
hits travel: one shuffle by row, which serves the votes, the merging and the summary.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.words import NOT_ALNUM, UPPER, lower_ascii, with_row_key, with_words
from feedloom.session import literal_rows

#: The k-gram table is broadcast; longer template lists are refused.
MAX_TEMPLATE_WORDS = 100_000


class Template(NamedTuple):
    """``base`` templates are phrases of two or three words, counted place by place."""

    label: str
    text: str
    base: bool = False


def template_words(text: str) -> list[str]:
    lowered = text.translate(str.maketrans(UPPER, UPPER.lower()))
    return [w for w in re.split(NOT_ALNUM, lowered) if w]


def _postings(docs: DataFrame, templates: Sequence[Template]) -> dict[int, DataFrame]:
    """By k: one row per distinct k-gram with its places in templates. A short template is one k-gram."""
    words = [template_words(t.text) for t in templates]
    if any(len(w) < 2 for w in words):
        raise ValueError("a template needs two words at least")
    if any(t.base and len(w) > 3 for t, w in zip(templates, words)):
        raise ValueError("a base template has three words at most")
    if sum(map(len, words)) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words are not broadcast")
    rows: dict[int, list[tuple]] = defaultdict(list)
    for number, w in enumerate(words):
        k = min(3, len(w))
        rows[k] += [(" ".join(w[i : i + k]), *w[i : i + k], number, i) for i in range(len(w) - k + 1)]
    made = {}
    for k, grams in rows.items():
        parts = [f"w{i}" for i in range(k)]
        table = literal_rows(
            docs.sparkSession, grams, ", ".join(["gram string", *(f"{p} string" for p in parts), "t int", "at int"])
        )
        made[k] = (
            table.withColumn(f"_hash{k}", F.xxhash64(*parts))
            .groupBy(f"_hash{k}", "gram")
            .agg(F.collect_list(F.struct("t", "at")).alias("places"))
            .groupBy(f"_hash{k}")
            .agg(F.collect_list(F.struct("gram", "places")).alias(f"_places{k}"))
        )
    return made


def license_spans(
    docs: DataFrame,
    templates: Sequence[Template],
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    max_shift: int = 3,
    min_share: float = 0.6,
) -> DataFrame:
    """Verified spans, and one row with a null template for every row of ``docs``.

    Columns: ``_row``, those of ``keep``, n_words, template (its number), first_word, end_word,
    share (of the template's k-grams). A template of two or three words gives one span per place; a
    longer one gives a span per group of diagonals that are at most ``max_shift`` apart. Words are
    counted from 0. Null and empty texts have no words.
    """
    keep = list(keep)
    whole = with_row_key(docs.select(*keep, lower_ascii(F.col(text)).alias("_text")), "_row")
    df = with_words(whole, F.col("_text"), NOT_ALNUM, "_words")
    # a null word after the last keeps a row for every document
    shifted = [F.slice("_words", i + 1, F.size("_words")) for i in (1, 2)]
    zipped = F.arrays_zip(
        F.concat("_words", F.array(F.lit(None).cast("string"))), shifted[0].alias("b"), shifted[1].alias("c")
    )
    df = df.select("_row", *keep, F.posexplode(zipped).alias("_at", "_g"))
    df = df.select("_row", *keep, "_at", F.col("_g")["0"].alias("w0"), F.col("_g.b").alias("w1"), F.col("_g.c").alias("w2"))
    postings = _postings(docs, templates)
    for k, table in postings.items():
        parts = [F.col(f"w{i}") for i in range(k)]
        df = df.withColumn(f"_hash{k}", F.when(parts[-1].isNotNull(), F.xxhash64(*parts)))
        df = df.join(F.broadcast(table), f"_hash{k}", "left")
    end = F.col("w0").isNull()
    df = df.filter(reduce(lambda a, b: a | b, (F.col(f"_places{k}").isNotNull() for k in postings), end))
    equal = []
    for k in postings:
        own = F.concat_ws(" ", *(f"w{i}" for i in range(k)))
        same = F.filter(F.col(f"_places{k}"), lambda x: x["gram"] == own)  # noqa: B023
        equal.append(F.transform(same, lambda x: x["places"]))
    found = reduce(F.concat, (F.coalesce(F.flatten(e), F.array().cast("array<struct<t:int,at:int>>")) for e in equal))
    hits = df.select("_row", *keep, "_at", end.alias("_end"), found.alias("_found")).repartition("_row")
    hits = hits.select("_row", *keep, "_at", "_end", F.explode_outer("_found").alias("_f"))
    hits = hits.filter(F.col("_end") | F.col("_f").isNotNull())

    votes = hits.groupBy("_row", *keep, F.col("_f.t").alias("template"), (F.col("_at") - F.col("_f.at")).alias("_diagonal")).agg(
        F.collect_set("_f.at").alias("_seen"), F.min("_at").alias("_first"), F.max("_at").alias("_last")
    )
    sizes = [len(template_words(t.text)) for t in templates]
    value = lambda numbers: F.get(F.array(*map(F.lit, numbers)), F.col("template"))
    by_place = Window.partitionBy("_row", "template").orderBy("_diagonal")
    gap = F.col("_diagonal") - F.lag("_diagonal").over(by_place)
    shift = value([0 if n <= 3 else max_shift for n in sizes])
    groups = votes.withColumn("_new", F.when(gap <= shift, 0).otherwise(1))
    groups = groups.withColumn("_group", F.sum("_new").over(by_place))
    spans = groups.groupBy("_row", *keep, "template", "_group").agg(
        F.min("_first").alias("first_word"),
        F.max("_last").alias("_last"),
        F.size(F.array_distinct(F.flatten(F.collect_list("_seen")))).alias("_held"),
    )
    k = value([min(3, n) for n in sizes])
    share = F.col("_held") / value([n - min(3, n) + 1 for n in sizes])
    ends = F.when(F.col("template").isNull(), F.col("first_word"))  # the null word's place is the number of words
    by_row = Window.partitionBy("_row")
    return (
        spans.withColumn("n_words", F.max(ends).over(by_row).cast("long"))
        .filter(F.col("template").isNull() | (share >= min_share))
        .select(
            "_row", *keep, "n_words", "template",
            F.when(F.col("template").isNotNull(), F.col("first_word").cast("long")).alias("first_word"),
            F.when(F.col("template").isNotNull(), (F.col("_last") + k - 1).cast("long")).alias("end_word"),
            share.alias("share"),
        )
    )


def scan_licenses(
    docs: DataFrame, templates: Sequence[Template], keep: Sequence[str] = ("doc_id",), text: str = "text", **options
) -> DataFrame:
    """One row per row of ``docs``: ``keep`` and what its text says about licenses.

    n_words; n_base, first_word and last_word (places of base phrases, smallest and largest start, else
    null); base_labels and labels (distinct, sorted, comma-joined, empty if none); score (the greatest
    share of a template that the text holds, 0 to 1). Rows that repeat are scanned and returned each,
    null ids stay null, null and empty texts find nothing, an empty table gives an empty result;
    columns of ``docs`` outside ``keep`` and ``text`` are not looked at, whatever their names.
    """
    keep = list(keep)
    made = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}
    if clash := made & set(keep):
        raise ValueError(f"rename these kept columns: {sorted(clash)}")
    spans = license_spans(docs, templates, keep, text, **options)
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("template"))
    base, label = F.coalesce(of([t.base for t in templates]), F.lit(False)), of([t.label for t in templates])
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return (
        spans.groupBy("_row", *keep)
        .agg(
            F.max("n_words").alias("n_words"),
            F.sum(base.cast("long")).alias("n_base"),
            F.min(F.when(base, F.col("first_word"))).alias("first_word"),
            F.max(F.when(base, F.col("first_word"))).alias("last_word"),
            joined(F.when(base, label)).alias("base_labels"),
            joined(label).alias("labels"),
            F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        )
        .drop("_row")
    )
