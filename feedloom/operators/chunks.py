"""Text chunks: cutting, ids, upsert, notes, profile documents, context packing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom import session
from feedloom.functions.meta import sha1_prefix
from feedloom.functions.names import dataset_tags
from feedloom.functions.text import check_window, collapse_whitespace, row_text, text_windows
from feedloom.operators.joins import upsert
from feedloom.operators.profile import top_by
from feedloom.types import col

# Fixed values: (max_chars, overlap) per kind of text.
WINDOW_SIZES = {"text": (800, 120), "row": (600, 80), "schema": (900, 120), "summary": (900, 0)}


def cut(df: DataFrame, text: str, max_chars: int = 800, overlap: int = 120) -> DataFrame:
    """One row per chunk: the other columns, ``chunk_index`` and ``text``.

    White space is collapsed first; neighbours share ``overlap`` characters.
    """
    check_window(max_chars, overlap)
    others = [col(c) for c in df.columns if c != text]
    collapsed = df.select(*others, collapse_whitespace(col(text)).alias("__text"))
    return collapsed.select(
        *others, F.posexplode(text_windows(F.col("__text"), max_chars, overlap)).alias("chunk_index", "text")
    )


def chunk_id(user: Column, source: Column, text: Column) -> Column:
    """Content id: the same user, source and text always give the same id."""
    return sha1_prefix(F.concat(user, source, text))


def with_ids(chunks: DataFrame, user: Column) -> DataFrame:
    """Add ``user_id`` and ``id``; exact duplicates collapse to their first row."""
    named = chunks.withColumn("user_id", user.cast("string"))
    named = named.withColumn("id", chunk_id(F.col("user_id"), F.col("source"), F.col("text")))
    return top_by(named, ["id"], [F.asc("row_index")], 1, "__rank").drop("__rank")


def upsert_chunks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """A chunk with a stored id overwrites it."""
    return upsert(stored, incoming, ["id"])


def row_chunks(
    df: DataFrame,
    source: Column,
    row_index: Column,
    columns: Sequence[str] | None = None,
    max_chars: int = 600,
    overlap: int = 80,
) -> DataFrame:
    """(source, row_index, type, chunk_index, text): every row as text, cut to size."""
    rows = df.select(
        source.alias("source"),
        row_index.cast("bigint").alias("row_index"),
        F.lit("sample_row").alias("type"),
        row_text(df, columns).alias("text"),
    )
    return cut(rows, "text", max_chars, overlap)


def _labels(top: Column) -> Column:
    return F.array_join(
        F.transform(top, lambda t: F.format_string("%s (%d)", t["label"], t["count"])), ", "
    )


def column_documents(profile: DataFrame, source: str) -> DataFrame:
    """One text per column of a profile: type, top values, statistics."""
    has_top = F.size(F.coalesce("top_values", F.array())) > 0
    stats = F.format_string(
        "Stats: min=%.2f, max=%.2f, mean=%.2f, median=%.2f.",
        F.col("min"), F.col("max"), F.col("mean"), F.coalesce("median", "mean"),
    )
    text = F.concat_ws(
        " ",
        F.format_string("Column %s (dtype %s).", F.col("column"), F.col("dtype")),
        F.when(has_top, F.concat(F.lit("Top values: "), _labels(F.slice("top_values", 1, 5)), F.lit("."))),
        F.when(F.col("min").isNotNull(), stats),
    )
    return profile.select(
        F.concat(F.lit(f"{source}:column:"), "column").alias("source"),
        F.lit(-1).cast("bigint").alias("row_index"),
        F.lit("column_profile").alias("type"),
        text.alias("text"),
        F.array(F.concat(F.lit("column:"), F.lower("column"))).alias("tags"),
    )


def table_document(profile: DataFrame, metrics: DataFrame | None, source: str) -> DataFrame:
    """One summary text per table, cut to windows without overlap, with its tags.

    The text has one line per column, so its size is bounded by the schema.
    """
    has_top = F.size(F.coalesce("top_values", F.array())) > 0
    line = (
        F.when(
            F.col("min").isNotNull(),
            F.format_string(
                "%s: numeric stats min=%.2f, median=%.2f, mean=%.2f, max=%.2f",
                F.col("column"), F.col("min"), F.coalesce("median", "mean"), F.col("mean"), F.col("max"),
            ),
        )
        .when(has_top, F.concat(F.col("column"), F.lit(": top values "), _labels(F.col("top_values"))))
        .otherwise(F.concat(F.col("column"), F.lit(": no frequent values identified")))
    )
    lines = profile.select(
        F.lit(0).alias("part"), F.col("ordinal").alias("position"), line.alias("line"), "column", "rows"
    )
    if metrics is not None:
        heads = metrics.where("rank <= 3").groupBy("column", "description").agg(
            F.sort_array(F.collect_list(F.struct("rank", "label", "count"))).alias("top")
        )
        preview = F.array_join(
            F.transform("top", lambda t: F.format_string("%s: %d", t["label"], t["count"])), ", "
        )
        lines = lines.unionByName(
            heads.select(
                F.lit(1).alias("part"),
                F.lit(0).alias("position"),
                F.concat("description", F.lit(": "), preview).alias("line"),
                F.lit(None).cast("string").alias("column"),
                F.lit(None).cast("bigint").alias("rows"),
            )
        )
    ordered = F.sort_array(F.collect_list(F.struct("part", "position", "line")))
    joined = lines.agg(
        F.max("rows").alias("rows"),
        F.count("column").alias("columns"),
        F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("body"),
        dataset_tags(F.coalesce("column", F.lit(""))).alias("tags"),
    )
    whole = F.concat(
        F.format_string("Dataset summary: rows=%d, columns=%d.\n", F.col("rows"), F.col("columns")), "body"
    )
    pieces = cut(joined.select("tags", whole.alias("text")), "text", *WINDOW_SIZES["summary"])
    return pieces.select(
        F.lit(f"{source}:summary").alias("source"),
        F.lit(-1).cast("bigint").alias("row_index"),
        F.lit("summary").alias("type"),
        F.concat(F.lit(f"Summary for {source}: "), "text").alias("text"),
        "tags",
    )


def add_notes(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """Add notes (user_id, source, text) as chunks of type ``note``."""
    rows = notes.select(
        "user_id", "source", F.lit(-1).cast("bigint").alias("row_index"), F.lit("note").alias("type"), "text",
        chunk_id(F.col("user_id"), F.col("source"), F.col("text")).alias("id"),
    )
    return upsert_chunks(chunks.select(*rows.columns), rows.dropDuplicates(["id"]))


def apply_edits(chunks: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace texts by id from (id, text, edited_at); the last edit wins, ids stay."""
    from feedloom.operators.latest import last_per_group

    newest = last_per_group(edits, ["id"], ["edited_at"]).select("id", F.col("text").alias("__new"))
    joined = chunks.join(newest, "id", "left")
    return joined.withColumn("text", F.coalesce("__new", "text")).select(*chunks.columns)


def edited_vectors(
    chunks: DataFrame, edits: DataFrame, encode: Callable[[DataFrame], DataFrame], vector: str = "vector"
) -> tuple[DataFrame, DataFrame]:
    """(all chunks after the edits, the changed ones): like :func:`apply_edits`, and vectors follow their texts.

    ``chunks`` has id, text and ``vector``; ``encode`` adds ``vector`` to a frame that has text. Only chunks
    whose text really changed are encoded again; the others keep their vectors as they are. Edits of unknown
    ids change nothing, an edit to NULL keeps the text.
    """
    from feedloom.operators.latest import last_per_group

    newest = last_per_group(edits, ["id"], ["edited_at"]).select("id", F.col("text").alias("__new"))
    differs = F.col("__new").isNotNull() & ~F.col("text").eqNullSafe(F.col("__new"))
    touched = chunks.drop(vector).join(newest, "id").where(differs).withColumn("text", F.col("__new")).drop("__new")
    changed = session.materialize(encode(touched).select(*chunks.columns), "edited")
    kept = chunks.join(changed.select("id"), "id", "left_anti").select(*chunks.columns)
    return kept.unionByName(changed), changed


def retrieve(
    chunks: DataFrame,
    questions: DataFrame,
    encode: Callable[[DataFrame], DataFrame],
    tenant: str,
    k: int = 5,
    limit_chars: int = 2500,
) -> DataFrame:
    """(query_id, segments, context): questions to vectors, the tenant's nearest chunks, their texts packed.

    ``chunks`` has user_id, a bigint id, source, row_index, text and vector; ``questions`` query_id and
    text. Rows of other tenants are filtered before the search, so none can take a rank.
    """
    from feedloom.operators.search import nearest

    own = chunks.where(F.col("user_id") == F.lit(tenant))
    asked = encode(questions.select("query_id", "text")).select("query_id", "vector")
    near = nearest(own.select("id", "vector"), asked, k)
    hits = own.select("id", "source", "row_index", "text").join(near.select("query_id", "id", "rank"), "id")
    return pack_context(hits, limit_chars=limit_chars)


def list_chunks(chunks: DataFrame, source: str | None = None, limit: int = 200) -> DataFrame:
    """Notes first, then by row and id; the limit applies after the order."""
    rows = chunks if source is None else chunks.where(F.col("source") == source)
    return rows.orderBy((F.col("type") != "note").asc(), "row_index", "id").limit(limit)


def most_segments(limit_chars: int) -> int:
    """How many segments can fit at most: each is at least as long as its frame."""
    return max(1, limit_chars // len("[1] source= row=0\n\n"))


def pack_context(hits: DataFrame, query: str = "query_id", limit_chars: int = 2500) -> DataFrame:
    """(query, segments, context): hits in rank order until the text budget is spent.

    Hits need rank (from 1), source, row_index and text. The first segment that
    does not fit ends the context. A segment has at least the length of its
    frame, so ranks beyond budget/frame can never fit and are dropped before
    the ordered sum.
    """
    window = Window.partitionBy(query).orderBy("rank")
    kept = hits.withColumn("position", F.row_number().over(window)).where(F.col("position") <= most_segments(limit_chars))
    segment = F.concat(
        F.lit("["), F.col("position").cast("string"), F.lit("] source="), F.coalesce("source", F.lit("?")),
        F.lit(" row="), F.coalesce(F.col("row_index").cast("string"), F.lit("?")),
        F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"),
    )
    measured = kept.withColumn("segment", segment)
    running = F.sum(F.length("segment")).over(
        Window.partitionBy(query).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    )
    fitting = measured.withColumn("upto", running).where(F.col("upto") <= limit_chars)
    ordered = F.sort_array(F.collect_list(F.struct("position", "segment")))
    return fitting.groupBy(query).agg(
        F.count(F.lit(1)).alias("segments"),
        F.array_join(F.transform(ordered, lambda s: s["segment"]), "\n").alias("context"),
    )
