"""Text functions, chunks, context, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom import session
from feedloom.functions import meta, text, vectors
from feedloom.functions.names import merge_tags
from feedloom.operators import chunks, encoder, quantised, search
from feedloom.operators.profile import column_profile, headline_metrics, top_by
from feedloom.suite.registry import query, table

# White space as the SQL engine's patterns can name it.
SPACE = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def collapsed(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}', ' ', 'g'))"


@query("collapse_whitespace", f"SELECT doc_id, md5({collapsed('text')}) AS digest, length({collapsed('text')}) AS chars FROM documents")
def collapse_whitespace(spark, sf_dir):
    c = text.collapse_whitespace(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(c).alias("digest"), F.length(c).cast("bigint").alias("chars"))


@query(
    "normalize_phrase",
    "SELECT doc_id, md5("
    + collapsed(r"regexp_replace(replace(lower(text), '_', ' '), '[^\p{L}\p{N}\s.%-]', ' ', 'g')")
    + ") AS digest FROM documents",
)
def normalize_phrase(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_phrase(F.col("text"))).alias("digest"))


@query("normalize_identifier", "SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS identifier FROM pages")
def normalize_identifier(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.normalize_identifier(F.col("url")).alias("identifier"))


@query(
    "row_text",
    """
    SELECT c_custkey, 'c_name: ' || c_name || ' | c_nationkey: ' || c_nationkey || ' | c_mktsegment: '
           || coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS row_text FROM customer
    """,
)
def row_text(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    return df.select("c_custkey", text.row_text(df, ["c_name", "c_nationkey", "c_mktsegment"]).alias("row_text"))


def windows_sql(source: str, c: str, keys: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""
    SELECT {keys}, i::INTEGER AS chunk_index, substring(t, (i * {step} + 1)::BIGINT, {size}) AS text
    FROM (SELECT {keys}, t, unnest(range(0, greatest(0, ceil((length(t) - {size}) / {step}.0))::BIGINT + 1)) AS i
          FROM (SELECT {keys}, {collapsed(c)} AS t FROM {source}))
    """


@query(
    "chunk_documents",
    f"SELECT doc_id, chunk_index, md5(text) AS digest, length(text) AS chars FROM ({windows_sql('documents', 'text', 'doc_id', 800, 120)})",
)
def chunk_documents(spark, sf_dir):
    cut = chunks.cut(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return cut.select("doc_id", "chunk_index", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("chars"))


@query(
    "chunk_ids",
    f"""
    SELECT substring(sha1('u1' || source || text), 1, 16) AS id, min(doc_id) AS row_index
    FROM ({windows_sql('documents', 'text', 'doc_id, source', 900, 0)}) GROUP BY 1
    """,
)
def chunk_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_index"), "source", "text")
    named = chunks.with_ids(chunks.cut(docs, "text", 900, 0), F.lit("u1"))
    return named.select("id", "row_index")


@query(
    "row_text_chunks",
    f"""
    SELECT row_index, chunk_index, md5(text) AS digest FROM ({windows_sql(
        "(SELECT conv_id * 1000 + turn AS row_index, 'role: ' || role || ' | text: ' || text AS x FROM conversations)",
        "x", "row_index", 600, 80)})
    """,
)
def row_text_chunks(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    cut = chunks.row_chunks(talk, F.lit("conversations"), F.col("conv_id") * 1000 + F.col("turn"), ["role", "text"])
    return cut.select("row_index", "chunk_index", F.md5("text").alias("digest"))


@query(
    "column_documents",
    """
    SELECT 'customer:column:c_acctbal' AS source,
           'Column c_acctbal (dtype double). Stats: ' || printf('min=%.2f, max=%.2f, mean=%.2f, median=%.2f.',
             round(min(c_acctbal), 2), round(max(c_acctbal), 2), round(avg(c_acctbal), 2), round(median(c_acctbal), 2)) AS text,
           'column:c_acctbal' AS tags FROM customer
    UNION ALL
    SELECT 'customer:column:c_mktsegment', 'Column c_mktsegment (dtype string). Top values: '
           || string_agg(c_mktsegment || ' (' || n || ')', ', ' ORDER BY n DESC, c_mktsegment) || '.',
           'column:c_mktsegment'
    FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_mktsegment LIMIT 5)
    """,
)
def column_documents(spark, sf_dir):
    found = column_profile(table(spark, sf_dir, "customer"), ["c_acctbal", "c_mktsegment"])
    return chunks.column_documents(found, "customer").select("source", "text", F.array_join("tags", ",").alias("tags"))


@query(
    "table_document",
    """
    SELECT 'tickets:summary' AS source,
           'Summary for tickets: Dataset summary: rows=' || (SELECT count(*) FROM orders) || ', columns=2. status: top values '
           || (SELECT string_agg(o_orderstatus || ' (' || n || ')', ', ' ORDER BY n DESC, o_orderstatus) FROM s)
           || printf(' hours: numeric stats min=%.2f, median=%.2f, mean=%.2f, max=%.2f',
                (SELECT round(min(o_totalprice), 2) FROM orders), (SELECT round(median(o_totalprice), 2) FROM orders),
                (SELECT round(avg(o_totalprice), 2) FROM orders), (SELECT round(max(o_totalprice), 2) FROM orders))
           || ' Most common status: '
           || (SELECT string_agg(o_orderstatus || ': ' || n, ', ' ORDER BY n DESC, o_orderstatus) FROM s) AS text,
           'status-tracking' AS tags
    FROM (SELECT 1)
    """.replace("SELECT 'tickets:summary'", "WITH s AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) SELECT 'tickets:summary'", 1),
)
def table_document(spark, sf_dir):
    named = table(spark, sf_dir, "orders").selectExpr("o_orderstatus AS status", "o_totalprice AS hours")
    found = chunks.table_document(column_profile(named), headline_metrics(named), "tickets")
    return found.select("source", "text", F.array_join("tags", ",").alias("tags"))


def _segments_sql(limit: int) -> str:
    return f"""
    WITH h AS (SELECT lang, source, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS rank
               FROM documents),
    s AS (SELECT lang, rank, '[' || rank || '] source=' || source || ' row=' || doc_id || chr(10) || text || chr(10) AS seg FROM h),
    r AS (SELECT *, sum(length(seg)) OVER (PARTITION BY lang ORDER BY rank) AS upto FROM s)
    SELECT lang, count(*) AS segments, md5(string_agg(seg, chr(10) ORDER BY rank)) AS digest FROM r WHERE upto <= {limit} GROUP BY lang
    """


@query("context_pack", _segments_sql(2500))
def context_pack(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # Ranking reads narrow columns; texts are fetched for ranked rows only.
    narrow = docs.select("lang", "doc_id", "n_chars")
    ranked = top_by(narrow, ["lang"], [F.asc("n_chars"), F.asc("doc_id")], chunks.most_segments(2500))
    hits = docs.join(ranked.select("doc_id", "rank"), "doc_id").withColumnRenamed("doc_id", "row_index")
    packed = chunks.pack_context(hits, "lang", 2500)
    return packed.select("lang", "segments", F.md5("context").alias("digest"))


@query(
    "notes_first",
    """
    SELECT id, type, row_index, source FROM (
      SELECT substring(sha1('u1' || source || text), 1, 16) AS id, type, row_index, source FROM (
        SELECT DISTINCT 'note' AS type, -1::BIGINT AS row_index, 'talk' AS source, text FROM conversations WHERE role = 'system'
        UNION ALL
        SELECT 'sample_row', min(conv_id * 1000 + turn), 'talk', text FROM conversations WHERE role <> 'system' GROUP BY text))
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY type) = 1
    ORDER BY type <> 'note', row_index, id LIMIT 200
    """,
)
def notes_first(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    rows = talk.where("role <> 'system'").select(
        F.lit("talk").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_index"),
        F.lit("sample_row").alias("type"), "text",
    )
    notes = talk.where("role = 'system'").select(F.lit("u1").alias("user_id"), F.lit("talk").alias("source"), "text")
    stored = chunks.add_notes(chunks.with_ids(rows, F.lit("u1")), notes)
    return chunks.list_chunks(stored, "talk").select("id", "type", "row_index", "source")


@query(
    "chunk_edits",
    """
    WITH c AS (SELECT substring(sha1('u1' || 'talk' || text), 1, 16) AS id, min(conv_id) AS conv_id, text FROM conversations GROUP BY text),
    e AS (SELECT DISTINCT substring(sha1('u1' || 'talk' || text), 1, 16) AS id, 'edited: ' || text AS new FROM conversations WHERE role = 'assistant')
    SELECT c.id, md5(coalesce(e.new, c.text)) AS digest FROM c LEFT JOIN e ON c.id = e.id
    """,
)
def chunk_edits(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    rows = talk.select(F.lit("talk").alias("source"), F.col("conv_id").alias("row_index"), "text", "role", "turn")
    stored = chunks.with_ids(rows.select("source", "row_index", "text"), F.lit("u1"))
    edits = rows.where("role = 'assistant'").select(
        chunks.chunk_id(F.lit("u1"), F.col("source"), F.col("text")).alias("id"),
        F.concat(F.lit("edited: "), "text").alias("text"), F.col("turn").alias("edited_at"),
    )
    return chunks.apply_edits(stored, edits).select("id", F.md5("text").alias("digest"))


@query(
    "tags_and_metadata",
    """
    SELECT event_id, event_type || ',' || user_id AS tags, -1 AS row_index, 'excel' AS type, 'default' AS user_id,
           (json_extract_string(props, '$.k'))::BIGINT AS k
    FROM events
    """,
)
def tags_and_metadata(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    listed = F.concat(F.lit(" "), "event_type", F.lit(" ,, "), F.col("user_id").cast("string"), F.lit(","))
    m = meta.read_metadata(F.col("props"))
    return events.select(
        "event_id", meta.join_tags(meta.split_tags(listed)).alias("tags"), m["row_index"].alias("row_index"),
        m["type"].alias("type"), m["user_id"].alias("user_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


@query(
    "tag_union",
    """
    SELECT user_id, string_agg(t, ',' ORDER BY t) AS tags FROM (
      SELECT DISTINCT user_id, unnest([event_type, lower(event_type), CASE WHEN value > 100 THEN 'high' ELSE 'low' END]) AS t FROM events)
    GROUP BY user_id
    """,
)
def tag_union(spark, sf_dir):
    per_user = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.collect_set("event_type").alias("a"),
        F.collect_set(F.when(F.col("value") > 100, "high").otherwise("low")).alias("b"),
    )
    return per_user.select("user_id", F.array_join(merge_tags(F.col("a"), F.col("b")), ",").alias("tags"))


@query("content_hashes", "SELECT doc_id, substring(sha1(text), 1, 16) AS sha1_16, substring(sha256(text), 1, 16) AS sha256_16 FROM documents")
def content_hashes(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", meta.sha1_prefix(c).alias("sha1_16"), meta.sha256_prefix(c).alias("sha256_16")
    )


# --- vectors ------------------------------------------------------------------

CENTROIDS_SQL = """
    SELECT label, list(m ORDER BY i) AS centroid FROM (
      SELECT label, i, avg(x::DOUBLE) AS m FROM (
        SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2)
    GROUP BY label
    """


def centroids(spark, sf_dir):
    """The mean vector of each label: queries that grow out of the whole table."""
    cells = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "m")))
    return means.groupBy("label").agg(F.transform(ordered, lambda s: s["m"]).alias("vector")).select(
        F.col("label").cast("bigint").alias("query_id"), "vector"
    )


@query(
    "cosine_distance",
    f"""
    SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], centroid), 6) AS distance
    FROM embeddings JOIN ({CENTROIDS_SQL}) c USING (label)
    """,
)
def cosine_distance(spark, sf_dir):
    joined = table(spark, sf_dir, "embeddings").join(
        centroids(spark, sf_dir), F.col("label") == F.col("query_id")
    )
    return joined.select("vec_id", F.round(vectors.cosine_distance(F.col("embedding"), F.col("vector")), 6).alias("distance"))


@query(
    "knn_exact",
    f"""
    SELECT query_id, id, rank::INTEGER AS rank, round(d, 6) AS distance FROM (
      SELECT c.label::BIGINT AS query_id, vec_id AS id, 1 - list_cosine_similarity(embedding::DOUBLE[], centroid) AS d,
             row_number() OVER (PARTITION BY c.label ORDER BY d, vec_id) AS rank
      FROM embeddings CROSS JOIN ({CENTROIDS_SQL}) c)
    WHERE rank <= 10
    """,
)
def knn_exact(spark, sf_dir):
    corpus = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = search.nearest(corpus, centroids(spark, sf_dir), 10)
    return found.withColumn("distance", F.round("distance", 6))


@query(
    "knn_approximate",
    "SELECT count(DISTINCT label) AS queries, true AS all_full, true AS mean_recall_reached FROM embeddings",
)
def knn_approximate(spark, sf_dir):
    """Every query gets its ten rows, and the mean recall against the exact search is 0.9 or more."""
    corpus = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path = session.scratch_path(spark, "vector-index")
    centres = search.fit_centres(corpus, 64, cells=64)
    search.write_index(corpus, path, 64, centres=centres)
    queries = centroids(spark, sf_dir)
    found = search.nearest_in_index(spark.read.parquet(path), queries, 10, probes=40, centres=centres)
    rows = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("rows"))
    recall = search.recall(found, search.nearest(corpus, queries, 10)).join(rows, "query_id", "left")
    return recall.agg(
        F.count(F.lit(1)).alias("queries"), F.bool_and(F.coalesce("rows", F.lit(0)) == 10).alias("all_full"),
        (F.avg("recall") >= 0.9).alias("mean_recall_reached"),
    )


@query(
    "knn_quantised",
    "SELECT count(DISTINCT label) AS queries, true AS all_full, true AS mean_recall_reached, true AS quarter_read "
    "FROM embeddings",
)
def knn_quantised(spark, sf_dir):
    """Ten rows for every query at a mean recall of 0.9 or more, and at most a quarter of the vector bytes read for it.

    A query reads all codes twice and the vectors that it lists; all are counted against the stored vectors.
    """
    corpus = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    dim, parts = 64, 16
    path = session.scratch_path(spark, "quantised-index")
    index = quantised.write_quantised(corpus, path, quantised.fit_codebook(corpus, dim, parts))
    queries = centroids(spark, sf_dir)
    measured = session.materialize(quantised.measured_rows(index, queries, 10), "measured")
    found = top_by(measured, ["query_id"], [F.asc("distance"), F.asc("id")], 10)
    rows = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("rows"))
    fetched = measured.groupBy("query_id").agg(F.count(F.lit(1)).alias("fetched"))
    scanned = F.sum(2 * F.length("code") + F.length("missing"))  # lengths in the second scan only
    n, code_bytes = index.codes(spark).agg(F.count(F.lit(1)), scanned).first()
    recall = search.recall(found, search.nearest(corpus, queries, 10)).join(rows, "query_id", "left")
    # four bytes an entry of a stored vector
    read = F.lit(code_bytes or 0) + F.col("fetched") * dim * 4
    return recall.join(fetched, "query_id", "left").agg(
        F.count(F.lit(1)).alias("queries"), F.bool_and(F.coalesce("rows", F.lit(0)) == 10).alias("all_full"),
        (F.avg("recall") >= 0.9).alias("mean_recall_reached"),
        F.bool_and(read * 4 <= n * dim * 4).alias("quarter_read"),
    )


LETTERS = "aeiounst"

#: Letter counts of a text, an encoder that SQL can repeat.
LETTERS_SQL = "[" + ", ".join(f"(length({{0}}) - length(replace({{0}}, '{c}', '')))::DOUBLE" for c in LETTERS) + "]"
EDITED_SQL = "CASE WHEN turn = 0 THEN 'sunset tea ' || text ELSE text END"


def letter_vectors(df):
    counts = [F.length("text") - F.length(F.replace("text", F.lit(c), F.lit(""))) for c in LETTERS]
    return df.withColumn("vector", F.array(*[n.cast("double") for n in counts]))


def _letter_ranks_sql(stage: str, shown: str) -> str:
    return f"""
    SELECT '{stage}' AS stage, rank::INTEGER AS rank, abs(round(d, 6)) AS distance FROM (
      SELECT d, row_number() OVER (ORDER BY d) AS rank FROM (
        SELECT 1 - list_cosine_similarity({LETTERS_SQL.format(shown)}, {LETTERS_SQL.format("'sunset tea'")}) AS d
        FROM conversations WHERE conv_id % 2 = 0 AND turn IS NOT NULL AND length(translate({shown}, '{LETTERS}', '')) < length({shown})))
    WHERE rank <= 20
    """


@query("edited_ranking", _letter_ranks_sql("before", "text") + " UNION ALL " + _letter_ranks_sql("after", f"({EDITED_SQL})"))
def edited_ranking(spark, sf_dir):
    """One tenant's 20 nearest chunks before and after edits; edited texts are encoded again and move up."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL AND turn IS NOT NULL")
    stored = letter_vectors(turns.select(
        F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd").alias("user_id"),
        F.xxhash64("conv_id", "turn", "role", "text").alias("id"), "turn", "text",
    ))
    stored = session.materialize(stored, "chunk-vectors")
    edits = stored.where("turn = 0").select("id", F.concat(F.lit("sunset tea "), "text").alias("text"), F.lit(1).alias("edited_at")).distinct()
    after, _ = chunks.edited_vectors(stored, edits, letter_vectors)
    asked = letter_vectors(session.literal_rows(spark, [(1, "sunset tea")], "query_id bigint, text string"))
    out = None
    for stage, df in (("before", stored), ("after", after)):
        # a text without any of the letters has no direction
        own = df.where(F.col("user_id") == "even").where(vectors.dot(F.col("vector"), F.col("vector")) > 0)
        near = search.nearest(own.select("id", "vector"), asked.select("query_id", "vector"), 20)
        part = near.select(F.lit(stage).alias("stage"), "rank", F.abs(F.round("distance", 6)).alias("distance"))
        out = part if out is None else out.unionAll(part)
    return out


@query("text_vectors", "SELECT doc_id, 384 AS dim, 1.0::DOUBLE AS norm FROM documents")
def text_vectors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encoder.fit_encoder(docs).encode(docs)
    return encoded.select("doc_id", F.size("vector").alias("dim"), F.round(vectors.norm(F.col("vector")), 6).alias("norm"))
