"""Sources, sinks, versions, jobs, refresh."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from feedloom import session
from feedloom.functions import meta
from feedloom.functions.numbers import iso
from feedloom.operators.steps import TransformDefinition
from feedloom.plans import ingest, jobs
from feedloom.sources import files, sinks, snapshots, versions, workbook
from feedloom.streaming import refresh
from feedloom.suite.profiling import iso_sql
from feedloom.suite.registry import dealt_anew, query, table


@query(
    "csv_round_trip",
    """
    SELECT p_partkey, p_name, nullif(p_brand, 'Brand#4') AS p_brand, p_size::BIGINT AS p_size, p_retailprice,
           nullif(p_type, 'SMALL') AS p_type, p_size > 25 AS is_large FROM part
    """,
)
def csv_round_trip(spark, sf_dir):
    part = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_name", "CASE WHEN p_brand = 'Brand#4' THEN 'NA' ELSE p_brand END AS p_brand", "p_size",
        "p_retailprice", "CASE WHEN p_type = 'SMALL' THEN 'None' ELSE p_type END AS p_type", "p_size > 25 AS is_large",
    )
    path = session.scratch_path(spark, "csv")
    part.write.option("header", True).csv(path)
    return files.read_csv(spark, path)


@query(
    "csv_with_schema",
    "SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
)
def csv_with_schema(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_totalprice", "date_format(o_orderdate, 'yyyy-MM-dd') AS day"
    )
    path = session.scratch_path(spark, "csv")
    orders.write.option("header", True).csv(path)
    return files.read_csv(spark, path, "o_orderkey bigint, o_totalprice double, day string")


def _as_workbook(rows: pd.DataFrame) -> bytes:
    """One sheet with a header row; numbers as numbers, the rest as inline text."""

    def cell(value) -> str:
        if isinstance(value, str):
            return f'<c t="inlineStr"><is><t>{escape(value)}</t></is></c>'
        return f"<c><v>{value!r}</v></c>"

    lines = [list(rows.columns), *rows.astype(object).values.tolist()]
    sheet = "".join("<row>" + "".join(map(cell, line)) + "</row>" for line in lines)
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    link = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} {link}><sheets><sheet name="Parts" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>")
    return buffer.getvalue()


@query("workbook_corpus", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def workbook_corpus(spark, sf_dir):
    """The part table as workbooks of one Arrow batch each, read back as one corpus."""

    def pack(batches):
        for batch in batches:
            content = _as_workbook(batch)
            path = f"parts-{batch['p_partkey'].min()}.xlsx"
            yield pd.DataFrame({"path": [path], "length": [len(content)], "content": [content]})

    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    books = part.mapInPandas(pack, "path string, length bigint, content binary")
    cells = workbook.read_workbooks(books)
    typed = {"p_partkey": "bigint", "p_name": "string", "p_size": "int", "p_retailprice": "double"}
    return workbook.sheet_table(cells, typed).select(*typed)


@query(
    "file_listing",
    """
    SELECT 'part' AS name, count(*) AS rows, true AS accepted, true AS digest_known FROM part
    UNION ALL SELECT 'supplier', count(*), true, true FROM supplier
    UNION ALL SELECT 'large', count(*), false, true FROM part
    """,
)
def file_listing(spark, sf_dir):
    """Two tables written as single files, listed by pattern; the third is over a limit of its own size less one."""
    folder = session.scratch_path(spark, "listing")
    for name in ("part", "supplier"):
        table(spark, sf_dir, name).coalesce(1).write.parquet(f"{folder}/{name}")
    table(spark, sf_dir, "part").coalesce(1).write.parquet(f"{folder}/large")
    listed = files.list_files(spark, folder, "*.parquet").withColumn("name", F.element_at(F.split("path", "/"), -2))
    least = listed.where("name = 'large'").agg(F.max("length")).first()[0] - 1
    accepted, rejected = files.split_by_size(listed.where("name = 'large'"), least)
    others, _ = files.split_by_size(listed.where("name <> 'large'"))
    digests = files.file_fingerprints(listed).select(F.col("path").alias("p"), F.col("digest").rlike("^[0-9a-f]{16}$").alias("digest_known"))
    sides = [(accepted.unionByName(others).drop("content"), True), (rejected, False)]
    marked = [side.select("path", "name", F.lit(ok).alias("accepted")) for side, ok in sides]
    counts = spark.read.parquet(f"{folder}/*").groupBy(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("n")).count()
    found = marked[0].unionByName(marked[1]).join(digests, F.col("path") == F.col("p")).join(counts, F.col("name") == F.col("n"))
    return found.select("name", F.col("count").alias("rows"), "accepted", "digest_known")


@query("table_fingerprint", "SELECT count(*) AS rows, true AS same_in_any_order, false AS same_after_a_change FROM lineitem")
def table_fingerprint(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    first = items.agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("k"), F.count(F.lit(1)).alias("n")).select("k.*", "n").first()
    moved = dealt_anew(items, first["n"], 7, "l_partkey", "l_orderkey")
    hit = (F.col("l_orderkey") == first[0]) & (F.col("l_linenumber") == first[1])
    changed = items.withColumn("l_quantity", F.when(hit, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    one, two, three = (files.table_fingerprint(df).withColumnRenamed("digest", f"d{i}") for i, df in enumerate((items, moved, changed)))
    return one.join(two, "rows").join(three, "rows").select(
        "rows", (F.col("d0") == F.col("d1")).alias("same_in_any_order"), (F.col("d0") == F.col("d2")).alias("same_after_a_change")
    )


@query(
    "version_decision",
    """
    WITH d AS (SELECT source AS feed, doc_id, lang, substring(sha256(text), 1, 16) AS digest FROM documents),
    latest AS (SELECT feed, max(doc_id) AS version, arg_max(digest, doc_id) AS digest FROM d GROUP BY 1),
    incoming AS (SELECT CASE WHEN lang = 'de' THEN feed || '-new' ELSE feed END AS feed, lang, arg_max(digest, doc_id) AS digest,
                        lang = 'en' AS confirmed FROM d GROUP BY feed, lang)
    SELECT i.feed, i.digest,
           CASE WHEN l.version IS NULL THEN 'create' WHEN i.digest = l.digest THEN 'reuse'
                WHEN confirmed THEN 'new_version' ELSE 'conflict' END AS action,
           (coalesce(l.version, 0) + CASE WHEN l.version IS NULL OR (i.digest <> l.digest AND confirmed) THEN 1 ELSE 0 END)::INTEGER AS version
    FROM incoming i LEFT JOIN latest l ON i.feed = l.feed
    """,
)
def version_decision(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("feed"), "doc_id", "lang", meta.sha256_prefix(F.col("text")).alias("digest")
    )
    known = docs.select("feed", F.col("doc_id").alias("version"), "digest")
    incoming = docs.groupBy("feed", "lang").agg(F.max_by("digest", "doc_id").alias("digest")).select(
        F.when(F.col("lang") == "de", F.concat("feed", F.lit("-new"))).otherwise(F.col("feed")).alias("feed"),
        "digest", (F.col("lang") == "en").alias("confirmed"),
    )
    return versions.decide_versions(incoming, known)


@query(
    "materialized_version",
    "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
)
def materialized_version(spark, sf_dir):
    root = session.scratch_path(spark, "feeds")
    orders = table(spark, sf_dir, "orders")
    sinks.write_version(orders, root, "Orders feed", 1)
    sinks.write_version(orders.where("o_orderstatus <> 'P'"), root, "Orders feed", 2)
    newest = sinks.read_version(spark, root, "Orders feed")
    return newest.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "ingested_feed",
    """
    SELECT * FROM (
      SELECT 0 AS step, 'create' AS action, 1 AS version, count(*) FILTER (o_orderstatus <> 'P') AS rows, 'baseline' AS drift, NULL::BIGINT AS delta FROM orders
      UNION ALL SELECT 1, 'reuse', 1, NULL, NULL, NULL FROM orders HAVING count(*) > 0
      UNION ALL SELECT 2, 'conflict', 1, NULL, NULL, NULL FROM orders HAVING count(*) > 0
      UNION ALL SELECT 3, 'new_version', 2, count(*), 'changed', count(*) FILTER (o_orderstatus = 'P') FROM orders)
    """,
)
def ingested_feed(spark, sf_dir):
    """A first version, the same again in another order, a change not confirmed, and confirmed."""
    root = session.scratch_path(spark, "ingest")
    orders = table(spark, sf_dir, "orders")
    closed = orders.where("o_orderstatus <> 'P'")
    steps = [
        ingest.ingest(closed, root, "orders"), ingest.ingest(dealt_anew(closed, closed.count(), 3, "o_custkey"), root, "orders"),
        ingest.ingest(orders, root, "orders"), ingest.ingest(orders, root, "orders", confirmed=True),
    ]
    rows = [
        (i, s["action"], s["version"], s.get("rows"), s.get("drift", {}).get("status"), s.get("drift", {}).get("row_delta"))
        for i, s in enumerate(steps)
    ]
    return session.literal_rows(spark, rows, "step int, action string, version int, rows bigint, drift string, delta bigint")


@query(
    "look_alike_feeds",
    """
    SELECT 'sales eu' AS feed, 2 AS version, count(*) AS n FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'sales_eu', 1, count(*) FROM orders WHERE o_orderstatus = 'O'
    """,
)
def look_alike_feeds(spark, sf_dir):
    """Two feeds with like names, a version written twice, and a load that is rejected for its size."""
    root = session.scratch_path(spark, "feeds")
    orders = table(spark, sf_dir, "orders")
    sinks.write_version(orders, root, "sales eu", 1)
    sinks.write_version(orders, root, "sales eu", 2)
    sinks.write_version(orders.where("o_orderstatus = 'F'"), root, "sales eu", 2)
    sinks.write_version(orders.where("o_orderstatus = 'O'"), root, "sales_eu", 1)
    sinks.write_version(orders, root, "sales_eu", 1, max_rows=1)
    sinks.write_version(orders, root, "sales_eu", 2, max_rows=1)
    newest = [
        sinks.read_version(spark, root, feed).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(feed).alias("feed"), F.lit(version).alias("version"), "n"
        )
        for feed, version in (("sales eu", 2), ("sales_eu", 1))
    ]
    return newest[0].unionAll(newest[1])


@query(
    "csv_folder",
    """
    SELECT (1000000000000000000 + o_orderkey)::BIGINT AS id, o_orderkey::DECIMAL(38, 0) + 12345678901234567890::DECIMAL(38, 0) AS wide,
           'line one' || chr(10) || 'order, ' || o_orderkey AS note, o_totalprice AS price
    FROM orders WHERE o_orderkey % 7 <> 0
    """,
)
def csv_folder(spark, sf_dir):
    """Long ids, quoted line breaks and commas; read from a folder by pattern, malformed rows left out."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "1000000000000000000 + o_orderkey AS id",
        "CAST(o_orderkey AS DECIMAL(20, 0)) + 12345678901234567890 AS wide", "concat('line one\\norder, ', o_orderkey) AS note",
        "o_totalprice AS price",
    )
    folder = session.scratch_path(spark, "csv-folder")
    orders.where("o_orderkey % 7 <> 0 AND o_orderkey % 2 = 0").drop("o_orderkey").write.option("header", True).csv(f"{folder}/even")
    orders.where("o_orderkey % 7 <> 0 AND o_orderkey % 2 <> 0").drop("o_orderkey").write.option("header", True).csv(f"{folder}/odd")
    ragged = orders.where("o_orderkey % 7 = 0").select(F.concat_ws(",", "id", "wide", F.lit("x"), "price", F.lit("more")).alias("value"))
    ragged = ragged.coalesce(1).select(F.concat(F.when(F.monotonically_increasing_id() == 0, "id,wide,note,price\n").otherwise(""), "value").alias("value"))
    ragged.write.text(f"{folder}/ragged")
    table(spark, sf_dir, "region").write.json(f"{folder}/other")
    good = files.read_csv(spark, [f"{folder}/even", f"{folder}/odd"], multi_line=True, pattern="*.csv")
    some = files.read_csv(spark, f"{folder}/ragged", multi_line=True, bad_rows="skip", infer=False)
    return good.unionByName(some.select(*[F.col(f.name).cast(f.dataType) for f in good.schema.fields]))


@query(
    "csv_rejects",
    "SELECT p_partkey || ',' || p_size || ',surplus' AS row FROM part WHERE p_size > 40",
)
def csv_rejects(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    lines = part.select(
        F.when(F.col("p_size") > 40, F.concat_ws(",", "p_partkey", "p_size", F.lit("surplus"))).otherwise(F.concat_ws(",", "p_partkey", "p_size")).alias("value")
    ).coalesce(1)
    lines = lines.select(F.concat(F.when(F.monotonically_increasing_id() == 0, "part,size\n").otherwise(""), "value").alias("value"))
    path = session.scratch_path(spark, "ragged")
    lines.write.text(path)
    return files.csv_rejects(spark, path)


@query(
    "load_strategies",
    """
    SELECT 'append' AS strategy, 2 * count(*) AS rows FROM supplier
    UNION ALL SELECT 'replace', count(*) FROM supplier
    """,
)
def load_strategies(spark, sf_dir):
    supplier, parts = table(spark, sf_dir, "supplier"), []
    for strategy in ("append", "replace"):
        path = session.scratch_path(spark, strategy)
        sinks.load(supplier, path, strategy)
        sinks.load(supplier, path, strategy)
        parts.append(
            spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(strategy).alias("strategy"), "rows")
        )
    return parts[0].unionAll(parts[1])


@query(
    "preview_rows",
    """
    SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderdate":"'
           || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '","note":null}' AS row
    FROM orders ORDER BY o_orderkey LIMIT 50
    """,
)
def preview_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("note", F.lit(float("nan")))
    rows = orders.orderBy("o_orderkey").limit(50)
    return rows.select(meta.json_row(rows, ["o_orderkey", "o_orderstatus", "o_orderdate", "note"]).alias("row"))


@query(
    "recent_uploads",
    f"SELECT event_id AS id, {iso_sql('ts')} AS uploaded_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
)
def recent_uploads(spark, sf_dir):
    uploads = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("uploaded_at"))
    return jobs.recent_uploads(uploads, 1000).withColumn("uploaded_at", iso(F.col("uploaded_at")))


@query(
    "iso_dates",
    f"SELECT event_id, {iso_sql('ts')} AS at FROM events",
)
def iso_dates(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", iso(F.col("ts")).alias("at"))


# A run log made of events: each event is a run of the job (user, type).
RUNS_SQL = """
    SELECT event_id AS run_id, user_id || '-' || event_type AS job_id, user_id,
           CASE WHEN value > 50 THEN 'failed' ELSE 'success' END AS status, ts AS started_at,
           ts + to_microseconds((event_id * 1500000)::BIGINT) AS finished_at
    FROM events
    """
JOBS_SQL = f"""
    SELECT job_id, any_value(user_id) AS user_id, min(started_at) AS created_at, count(*) > 20 AS is_active,
           CASE WHEN max(status) = 'success' THEN NULL ELSE '0 6 * * *' END AS schedule
    FROM ({RUNS_SQL}) GROUP BY job_id
    """


def run_log(spark, sf_dir):
    runs = table(spark, sf_dir, "events").selectExpr(
        "event_id AS run_id", "concat(user_id, '-', event_type) AS job_id", "user_id",
        "CASE WHEN value > 50 THEN 'failed' ELSE 'success' END AS status", "ts AS started_at",
        "ts + make_dt_interval(0, 0, 0, CAST(event_id * 1.5 AS DECIMAL(18, 6))) AS finished_at",
    )
    listed = runs.groupBy("job_id").agg(
        F.any_value("user_id").alias("user_id"), F.min("started_at").alias("created_at"),
        (F.count(F.lit(1)) > 20).alias("is_active"),
        F.when(F.max("status") != "success", "0 6 * * *").alias("schedule"),
    )
    return listed, runs


@query(
    "last_runs",
    f"""
    SELECT job_id, run_id, status FROM ({RUNS_SQL})
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY started_at DESC, run_id DESC) = 1
    """,
)
def last_runs(spark, sf_dir):
    return jobs.last_runs(run_log(spark, sf_dir)[1]).select("job_id", "run_id", "status")


@query(
    "job_listing",
    f"""
    SELECT j.job_id, j.is_active, r.run_id AS last_run_id, r.status AS last_status, {iso_sql('r.started_at')} AS last_started_at
    FROM ({JOBS_SQL}) j LEFT JOIN (
      SELECT * FROM ({RUNS_SQL}) QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY started_at DESC, run_id DESC) = 1) r
    ON j.job_id = r.job_id
    """,
)
def job_listing(spark, sf_dir):
    found = jobs.list_jobs(*run_log(spark, sf_dir))
    return found.select("job_id", "is_active", "last_run_id", "last_status", "last_started_at")


@query(
    "run_stats",
    f"""
    SELECT r.user_id, jobs_total, jobs_active, jobs_scheduled, runs_total, runs_success, runs_failed, last_status,
           {iso_sql('last_finished')} AS last_finished_at,
           round((epoch_us(last_finished) - epoch_us(last_started)) / 1e6, 3) AS last_seconds
    FROM (SELECT user_id, count(*) AS runs_total, count_if(status = 'success')::BIGINT AS runs_success,
                 count_if(status = 'failed')::BIGINT AS runs_failed, arg_max(status, started_at) AS last_status,
                 max(started_at) AS last_started, arg_max(finished_at, started_at) AS last_finished
          FROM ({RUNS_SQL}) GROUP BY user_id) r
    JOIN (SELECT user_id, count(*) AS jobs_total, count_if(is_active)::BIGINT AS jobs_active, count(schedule) AS jobs_scheduled
          FROM ({JOBS_SQL}) GROUP BY user_id) j ON r.user_id = j.user_id
    """,
)
def run_stats(spark, sf_dir):
    return jobs.run_stats(*run_log(spark, sf_dir))


@query(
    "job_run",
    """
    SELECT 'success' AS status, count(*) AS rows_in, count(*) FILTER (o_orderstatus <> 'P') AS rows_out,
           'columns_removed: o_orderpriority' AS warnings FROM orders
    """,
)
def job_run(spark, sf_dir):
    definition = TransformDefinition.from_dict(
        {
            "name": "finished", "feed_identifier": "orders", "target_table": "orders_clean", "load_strategy": "replace",
            "steps": [
                {"type": "filter", "column": "o_orderstatus", "op": "neq", "value": "P"},
                {"type": "drop", "columns": ["o_orderpriority"]},
            ],
        }
    )
    target, log = session.scratch_path(spark, "job"), session.scratch_path(spark, "runs")
    jobs.run_job(table(spark, sf_dir, "orders"), definition, target, log, run_id="r1", job_id="j1")
    return jobs.read_runs(spark, log).select("status", "rows_in", "rows_out", F.array_join("warnings", ",").alias("warnings"))


@query(
    "job_run_incremental",
    """
    SELECT o_orderkey, o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN '2' ELSE '1' END AS state FROM orders
    """,
)
def job_run_incremental(spark, sf_dir):
    """Two runs merged by key: the second brings new states of every other order; it runs twice."""
    definition = TransformDefinition.from_dict(
        {
            "name": "states", "feed_identifier": "orders", "target_table": "order_states", "incremental": True,
            "unique_key": ["o_orderkey"], "steps": [{"type": "trim", "column": "state"}],
        }
    )
    orders = table(spark, sf_dir, "orders")
    first = orders.select("o_orderkey", F.concat(F.col("o_orderstatus"), F.lit("1 ")).alias("state"))
    second = orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.concat(F.col("o_orderstatus"), F.lit("2")).alias("state"))
    target, log = session.scratch_path(spark, "job"), session.scratch_path(spark, "runs")
    jobs.run_job(first, definition, target, log, run_id="r1", job_id="j1")
    for _ in range(2):
        jobs.run_job(second.unionAll(second), definition, target, log, run_id="r2", job_id="j1")
    return snapshots.read_snapshot(spark, target).select("o_orderkey", "state")


@query(
    "merged_snapshots",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS before, o_totalprice > 100000 AS high,
           CASE WHEN o_orderkey % 5 = 0 THEN 'new' WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS after
    FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 5 = 0
    """,
)
def merged_snapshots(spark, sf_dir):
    """A table before and after a keyed merge that changes some rows and adds others; both snapshots are read."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"), (F.col("o_totalprice") > 100000).alias("high"))
    root = session.scratch_path(spark, "snapshots")
    first = snapshots.merge_snapshot(orders.where("o_orderkey % 3 <> 0"), root, ["o_orderkey"], label="first")
    changed = orders.where("o_orderkey % 5 = 0").withColumn("state", F.lit("new"))
    second = snapshots.merge_snapshot(changed.unionAll(changed), root, ["o_orderkey"], label="second")
    old = snapshots.read_snapshot(spark, root, first).select("o_orderkey", F.col("state").alias("before"))
    new = snapshots.read_snapshot(spark, root, second).withColumnRenamed("state", "after")
    return new.join(old, "o_orderkey", "left").select("o_orderkey", "before", "high", "after")


@query(
    "refreshed_feed",
    """
    SELECT upper(event_type) AS event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
    WHERE event_type <> 'error' GROUP BY 1
    """,
)
def refreshed_feed(spark, sf_dir):
    """The folder grows between two refreshes; a third finds nothing new."""
    events = table(spark, sf_dir, "events")
    folder, target, mark = (session.scratch_path(spark, n) for n in ("incoming", "refreshed", "mark"))
    steps = [
        {"type": "filter", "column": "event_type", "op": "neq", "value": "error"},
        {"type": "string_clean", "columns": ["event_type"], "operations": ["upper"]},
    ]
    for half in (F.col("value") < 10, F.col("value") >= 10, F.lit(False)):
        events.where(half).write.mode("append").parquet(folder)
        refresh.refresh_feed(spark, folder, events.schema, target, mark, steps)
    return refresh.read_refreshed(spark, target).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query(
    "refreshed_feed_by_key",
    """
    SELECT user_id, arg_max(event_type, event_id) AS event_type, count(*) FILTER (WHERE event_id >= 0) > 0 AS known
    FROM (SELECT user_id, event_type, event_id FROM events
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC, event_id DESC) = 1)
    GROUP BY user_id
    """,
)
def refreshed_feed_by_key(spark, sf_dir):
    """Two batches bring several states of every user; the newest batch's last one stays."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    folder, target, mark = (session.scratch_path(spark, n) for n in ("incoming", "refreshed", "mark"))
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).write.mode("append").parquet(folder)
        refresh.refresh_feed(spark, folder, events.schema, target, mark)
    return refresh.read_refreshed(spark, target, ["user_id"]).select(
        "user_id", "event_type", F.col("event_id").isNotNull().alias("known")
    )


@query(
    "refreshed_profile",
    """
    SELECT 'event_id' AS "column", count(*) AS rows, 0::BIGINT AS nulls, min(event_id)::DOUBLE AS min, max(event_id)::DOUBLE AS max,
           round(avg(event_id), 4) AS mean FROM events
    UNION ALL SELECT 'value', count(*), count_if(event_type = 'error')::BIGINT, min(value), max(value), round(avg(value), 4) FROM (
      SELECT event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)
    UNION ALL SELECT 'event_type', count(*), 0, NULL, NULL, NULL FROM events
    """,
)
def refreshed_profile(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE WHEN event_type <> 'error' THEN value END AS value", "event_type"
    )
    folder, state, mark = (session.scratch_path(spark, n) for n in ("incoming", "state", "mark"))
    for half in (F.col("event_type") < "d", F.col("event_type") >= "d"):
        events.where(half).write.mode("append").parquet(folder)
        merged = refresh.refresh_profile(spark, folder, events.schema, state, mark)
    return merged.select("column", "rows", "nulls", "min", "max", F.round("mean", 4).alias("mean"))


@query(
    "refreshed_feed_compacted",
    """
    SELECT user_id, event_type, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC, event_id DESC) = 1
    """,
)
def refreshed_feed_compacted(spark, sf_dir):
    """As by key, but each batch is merged into its key buckets; a batch that comes again changes nothing."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    folder, root, mark = (session.scratch_path(spark, n) for n in ("incoming", "compacted", "mark"))
    halves = [events.where(F.col("event_id") % 2 == half) for half in (0, 1)]
    for half in halves:
        half.write.mode("append").parquet(folder)
        refresh.refresh_keyed(spark, folder, events.schema, root, mark, ["user_id"], ["event_id"])
    refresh.merge_batch(halves[0], 0, root, ["user_id"], ["event_id"])
    return snapshots.read_snapshot(spark, root)


@query(
    "refreshed_sketches",
    """
    WITH e AS (SELECT event_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)
    SELECT 'event_id' AS "column", count(*) > 0 AS median_near, count(*) > 0 AS distinct_near, NULL AS top FROM e
    UNION ALL SELECT 'value', count(value) > 0, count(value) > 0, NULL FROM e
    UNION ALL SELECT 'event_type', NULL, count(*) > 0, string_agg(event_type || ':' || n, ',' ORDER BY n DESC, event_type) FROM (
      SELECT event_type, count(*) AS n FROM e WHERE event_type IS NOT NULL GROUP BY 1)
    """,
)
def refreshed_sketches(spark, sf_dir):
    """Merged sketches of three batches against all rows: ranks within 0.01 of the middle, distinct counts within a twentieth."""
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE WHEN event_type <> 'error' THEN value END AS value", "event_type"
    )
    folder, state, mark = (session.scratch_path(spark, n) for n in ("incoming", "state", "mark"))
    for part in range(3):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).write.mode("append").parquet(folder)
        merged = refresh.refresh_profile(spark, folder, events.schema, state, mark)
    merged = session.materialize(merged, "merged")
    found = {r["column"]: r for r in merged.collect()}  # a row per column
    tests = []
    for name in ("event_id", "value", "event_type"):
        middle, share = found[name]["approx_median"], F.lit(None).cast("boolean")
        if middle is not None:
            rows = F.count(name)
            share = (F.count_if(F.col(name) < middle) <= 0.51 * rows) & (F.count_if(F.col(name) <= middle) >= 0.49 * rows)
        near = F.abs(F.count_distinct(name) - F.lit(found[name]["approx_unique"])) <= 0.05 * F.count_distinct(name)
        tests.append(events.agg(share.alias("median_near"), near.alias("distinct_near")).withColumn("column", F.lit(name)))
    top = F.array_join(F.transform("top_values", lambda v: F.concat_ws(":", v["label"], v["count"])), ",")
    shown = merged.select("column", F.when(F.col("column") == "event_type", top).alias("top"))
    return tests[0].unionAll(tests[1]).unionAll(tests[2]).join(shown, "column").select("column", "median_near", "distinct_near", "top")
