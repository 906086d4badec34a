"""Benchmark decontamination over a distributed positional inverted index.

One pass over the corpus stores a posting (document, place, term) for every word that the benchmark
uses; other words cannot be part of a match. Each task writes the postings of its own documents, so the
index is built without a shuffle. Its term counts then order the words of every benchmark window, and
matching starts from the rarest: the postings of a window's few rarest terms are moved back by their places
in the item, which gives diagonals, and the lists of a document and item are intersected. Windows whose
lists meet on one diagonal are candidates for the exact phrase. Neighbouring windows share nine words, so
all candidates of a diagonal are verified at once, each word looked up once. Windows whose lists meet within
``slop`` diagonals, and are no exact match, are candidates for proximity, which the places of all their
other words decide. Common words are looked up only in documents that have a candidate.

Everything after the index is grouped by document, item and stretch of diagonals, so a passage that a third
of all documents share is spread like the documents are, and a group holds ``STRETCH`` diagonals at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.words import NOT_ALNUM, lower_ascii, with_row_key, with_words
from feedloom.session import materialize

#: Benchmark tables up to so many words are broadcast (about 100 MB); larger ones are shuffled.
BROADCAST_WORDS = 1_000_000
#: Up to so many documents with candidates are broadcast (about 40 MB of keys) to thin the index.
BROADCAST_DOCUMENTS = 1_000_000
#: Neighbouring diagonals that are looked at together.
STRETCH = 64


class Benchmark(NamedTuple):
    """Distinct word sequences of items and distinct windows.

    ``items``: item, item_ids; ``places``: item, place, term; ``spans``: item, i (place of the first word),
    window, size; ``words``: window, offset, term; ``sizes``: window, size; ``terms``: term, word.
    """

    items: DataFrame
    places: DataFrame
    spans: DataFrame
    words: DataFrame
    sizes: DataFrame
    terms: DataFrame
    n_words: int


def benchmark_windows(items: DataFrame, item: str = "item_id", text: str = "text", width: int = 10) -> Benchmark:
    """Distinct windows of ``width`` words; an item of fewer words, but not none, is one window."""
    whole = items.select(F.col(item).cast("string").alias("id"), lower_ascii(F.col(text)).alias("_text"))
    split = with_words(whole, F.col("_text"), NOT_ALNUM, "words").filter(F.size("words") > 0)
    # an item without an id has windows, but is no item
    once = split.groupBy("words").agg(F.sort_array(F.collect_set("id")).alias("item_ids"))
    once = materialize(once.select(F.monotonically_increasing_id().alias("item"), "item_ids", "words"), "benchmark-items")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))
    spans = once.select("item", "words", F.explode(starts).alias("i"))
    spans = spans.select("item", "i", F.slice("words", F.col("i") + 1, F.lit(width)).alias("gram"))
    windows = materialize(spans.select("gram").distinct().select(F.monotonically_increasing_id().alias("window"), "gram"), "benchmark-windows")
    spans = materialize(spans.join(windows, "gram").select("item", "i", "window", F.size("gram").alias("size")), "benchmark-spans")
    places = once.select("item", F.posexplode("words").alias("place", "word"))
    terms = materialize(
        places.select("word").distinct().select(F.monotonically_increasing_id().alias("term"), "word"), "benchmark-terms"
    )
    placed = materialize(places.join(terms, "word").select("item", "place", "term"), "benchmark-places")
    offsets = windows.select("window", F.posexplode("gram").alias("offset", "word"))
    words = materialize(offsets.join(terms, "word").select("window", "offset", "term"), "benchmark-words")
    sizes = windows.select("window", F.size("gram").alias("size"))
    return Benchmark(once.select("item", "item_ids"), placed, spans, words, sizes, terms, words.count())


def positional_index(
    docs: DataFrame, benchmark: Benchmark, keep: Sequence[str] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """The stored postings: _row, at (place in the document), term.

    Every document also has one row with a null term, whose place is its number of words; its _kept has ``keep``.
    """
    kept = F.struct(*(F.col(c) for c in keep)).alias("_kept") if keep else F.lit(None).alias("_kept")
    whole = with_row_key(docs.select(kept, lower_ascii(F.col(text)).alias("_text")), "_row")
    df = with_words(whole, F.col("_text"), NOT_ALNUM, "_words")
    end = F.concat("_words", F.array(F.lit(None).cast("string")))  # keeps a row for every document
    df = df.select("_row", F.posexplode(end).alias("at", "word"), "_kept")
    df = df.withColumn("_kept", F.when(F.col("word").isNull(), F.col("_kept")))  # once a document
    terms = F.broadcast(benchmark.terms) if benchmark.n_words <= BROADCAST_WORDS else benchmark.terms
    postings = df.join(terms, "word", "left").filter(F.col("term").isNotNull() | F.col("word").isNull())
    return materialize(postings.select("_row", "_kept", "at", "term"), "postings")


def _anchors(index: DataFrame, benchmark: Benchmark, lists: int) -> DataFrame:
    """Of every window of an item, the places of its ``lists`` rarest different terms: item, i, window, size, anchors.

    A window with a term that the corpus lacks is left out: it cannot occur.
    """
    counts = index.filter(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("n"))
    if benchmark.n_words <= BROADCAST_WORDS:  # a row per term at most
        counts = F.broadcast(counts)
    counted = benchmark.words.join(counts, "term", "left")
    by_window = Window.partitionBy("window")
    counted = counted.withColumn("_all", F.count("*").over(by_window) == F.count("n").over(by_window)).filter("_all")
    once = counted.groupBy("window", "term", "n").agg(F.min("offset").alias("offset"))
    ranked = once.withColumn("rank", F.row_number().over(by_window.orderBy("n", "term"))).filter(F.col("rank") <= lists)
    offsets = ranked.groupBy("window").agg(F.collect_set("offset").alias("offsets"))
    placed = benchmark.spans.join(offsets, "window").withColumn("anchors", F.transform("offsets", lambda o: o + F.col("i")))
    return materialize(placed.drop("offsets"), "anchors")


def _near(met: DataFrame, terms: DataFrame, words: DataFrame, sizes: DataFrame, slop: int) -> DataFrame:
    """Proximity matches (_row, window, spread) among the candidates ``met``, decided on every word of the window.

    The first of a match's rarest terms gives a start; all its words lie at most ``slop`` before or behind that.
    """
    shifts = F.explode(F.sequence(F.lit(-slop), F.lit(slop))).alias("shift")
    due = met.select("_row", "window", "start").join(words, "window")
    due = due.select("_row", "window", "start", "offset", "term", shifts)
    due = due.withColumn("at", F.col("start") + F.col("offset") + F.col("shift")).filter("at >= 0")
    held = due.join(terms, ["_row", "at", "term"]).select("_row", "window", "start", "offset", "shift")
    # a first place for all words, and behind it the nearest place of each
    first = F.explode(F.sequence(F.greatest(F.lit(-slop), F.col("shift") - slop), F.least(F.lit(0), F.col("shift")))).alias("first")
    behind = held.select("*", first).groupBy("_row", "window", "start", "first", "offset").agg(
        F.min(F.col("shift") - F.col("first")).alias("behind")
    )
    whole = behind.groupBy("_row", "window", "start", "first").agg(F.count("*").alias("_held"), F.max("behind").alias("spread"))
    whole = whole.join(sizes, "window").filter(F.col("_held") == F.col("size"))
    return whole.groupBy("_row", "window").agg(F.min("spread").alias("spread"))


def _candidates(terms: DataFrame, anchors: DataFrame, benchmark: Benchmark, slop: int) -> DataFrame:
    """Windows whose anchors meet: _row, item, i, window, size, diagonal (of the first anchor), exact (on one diagonal)."""
    small = benchmark.n_words <= BROADCAST_WORDS
    ones = anchors.select("item", F.explode("anchors").alias("place")).distinct().join(benchmark.places, ["item", "place"])
    windows = anchors.groupBy("item").agg(
        F.min(F.size("anchors")).alias("least"), F.collect_list(F.struct("i", "window", "size", "anchors")).alias("windows")
    )
    if small:
        ones, windows = F.broadcast(ones), F.broadcast(windows)
    hits = terms.join(ones, "term").select("_row", "item", "place", (F.col("at") - F.col("place")).alias("diagonal"))
    stretch = lambda d: F.floor(d / STRETCH)
    around = F.sequence(stretch(F.col("diagonal") - slop), stretch(F.col("diagonal") + slop))
    hits = hits.select("*", F.explode(around).alias("stretch"))
    met = hits.groupBy("_row", "item", "stretch").agg(F.collect_list(F.struct("diagonal", "place")).alias("hits"))
    met = met.join(windows, "item").filter(F.size("hits") >= F.col("least"))
    found = F.expr(
        f"""flatten(transform(windows, w -> transform(
            filter(hits, h -> h.place = w.anchors[0] AND floor(h.diagonal / {STRETCH}) = stretch
                   AND forall(w.anchors, p -> exists(hits, g -> g.place = p AND abs(g.diagonal - h.diagonal) <= {slop}))),
            h -> named_struct('i', w.i, 'window', w.window, 'size', w.size, 'diagonal', h.diagonal,
                              'exact', forall(w.anchors, p -> exists(hits, g -> g.place = p AND g.diagonal = h.diagonal))))))"""
    )
    return materialize(met.select("_row", "item", F.explode(found).alias("w")).select("_row", "item", "w.*"), "candidates")


def _exact(met: DataFrame, terms: DataFrame, benchmark: Benchmark) -> DataFrame:
    """Exact matches: _row, item, diagonal, windows (i, window, size). Every word of a diagonal is looked up once."""
    on = ["_row", "item", "diagonal"]
    starts = met.filter("exact AND diagonal + i >= 0").groupBy(*on).agg(F.collect_list(F.struct("i", "window", "size")).alias("windows"))
    starts = materialize(starts, "diagonals")
    rows = starts.select("_row").distinct()
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_DOCUMENTS else rows
    within = terms.join(rows, "_row", "left_semi")
    due = F.expr("array_distinct(flatten(transform(windows, w -> sequence(w.i, w.i + w.size - 1))))")
    places = F.broadcast(benchmark.places) if benchmark.n_words <= BROADCAST_WORDS else benchmark.places
    asked = starts.select(*on, F.explode(due).alias("place")).join(places, ["item", "place"])
    asked = asked.withColumn("at", F.col("diagonal") + F.col("place"))
    held = asked.join(within, ["_row", "at", "term"]).groupBy(*on).agg(F.collect_set("place").alias("held"))
    whole = F.expr("filter(windows, w -> forall(sequence(w.i, w.i + w.size - 1), p -> array_contains(held, p)))")
    windows = F.when(F.size("held") == F.size(due), F.col("windows")).otherwise(whole)
    return starts.join(held, on).select(*on, windows.alias("windows")).filter(F.size("windows") > 0)


def window_matches(index: DataFrame, benchmark: Benchmark, lists: int = 2, slop: int = 3) -> tuple[DataFrame, DataFrame]:
    """Exact matches (_row, item, diagonal, windows) and the windows that match by proximity (_row, window).

    A proximity match is a window whose words, all of them, stand at most ``slop`` words behind the places
    that one start gives them; exact matches are among them. ``lists`` changes the number of candidates,
    never the matches.
    """
    terms = index.filter(F.col("term").isNotNull()).select("_row", "at", "term")
    met = _candidates(terms, _anchors(index, benchmark, lists), benchmark, slop)
    exact = materialize(_exact(met, terms, benchmark), "exact")
    same = exact.select("_row", F.explode("windows.window").alias("window")).distinct()
    small = benchmark.n_words <= BROADCAST_WORDS
    words, sizes = ((F.broadcast(df) if small else df) for df in (benchmark.words, benchmark.sizes))
    open_ = met.select("_row", "window", (F.col("diagonal") + F.col("i")).alias("start")).distinct().join(same, ["_row", "window"], "left_anti")
    near = _near(open_, terms, words, sizes, slop).select("_row", "window")
    return exact, same.union(near)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    lists: int = 2,
    slop: int = 3,
) -> DataFrame:
    """One row per row of ``docs``: ``keep``, and how its text overlaps the benchmark.

    n_words; n_hit (words inside any occurrence of a window); n_items (items with occurring windows);
    items_sha256 (of their ids, sorted as strings and comma-joined; of the empty string if none);
    n_near (windows that match by proximity, the exact ones included); contaminated (n_hit > 0).
    Rows that repeat are matched and returned each and null ids stay null; null and empty texts have no
    words; items without words have no window, and a null item id counts as no item; an empty corpus or
    benchmark gives no matches. Columns outside ``keep``, whatever their names, are not looked at.
    """
    keep = list(keep)
    if clash := {"n_words", "n_hit", "n_items", "items_sha256", "n_near", "contaminated"} & set(keep):
        raise ValueError(f"rename these kept columns: {sorted(clash)}")
    benchmark = benchmark_windows(items, item, item_text, width)
    index = positional_index(docs, benchmark, keep, text)
    exact, near = window_matches(index, benchmark, lists, slop)
    covered = F.expr("array_distinct(flatten(transform(windows, w -> sequence(diagonal + w.i, diagonal + w.i + w.size - 1))))")
    hits = exact.select("_row", F.explode(covered).alias("at")).distinct().groupBy("_row").agg(F.count("*").alias("n_hit"))
    ids = F.broadcast(benchmark.items) if benchmark.n_words <= BROADCAST_WORDS else benchmark.items
    found = (
        exact.select("_row", "item").distinct().join(ids, "item")
        .select("_row", F.explode("item_ids").alias("item"))
        .groupBy("_row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    nearby = near.groupBy("_row").agg(F.count("*").alias("n_near"))
    ends = index.filter(F.col("term").isNull()).select("_row", "_kept", F.col("at").cast("long").alias("n_words"))
    joined = ends.join(hits, "_row", "left").join(found, "_row", "left").join(nearby, "_row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        *(F.col("_kept")[c].alias(c) for c in keep), "n_words", n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        (n_hit > 0).alias("contaminated"),
    )
