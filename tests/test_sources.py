import io
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from feedloom.functions.meta import json_row
from feedloom.operators import joins
from feedloom.operators.related import foreign_key_candidates, similar_names
from feedloom.sources import catalog, files, sinks, versions, warehouse, workbook


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_csv_types_and_null_tokens(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,name,v,flag,mixed\n1,"a ""q"", b",1.5,true,1\n2,NA,None,FALSE,x\n3,,2,,2.5\n')
    df = files.read_csv(spark, path)
    assert [d for _, d in df.dtypes] == ["bigint", "string", "double", "boolean", "string"]
    rows = {r["id"]: r for r in df.collect()}
    assert rows[1]["name"] == 'a "q", b' and rows[2]["name"] is None and rows[2]["v"] is None and rows[3]["flag"] is None
    assert dict(files.read_csv(spark, path, infer=False).dtypes)["id"] == "string"
    typed = files.read_csv(spark, path, "id int, v double")
    assert dict(typed.dtypes)["id"] == "int" and typed.agg(F.sum("v")).first()[0] == 3.5
    with pytest.raises(PySparkException):
        files.read_csv(spark, path, "mixed int").collect()


def test_csv_line_breaks_and_globs(spark, tmp_path):
    write(tmp_path / "d" / "x" / "1.csv", 'a,b\n1,"two\nlines"\n')
    write(tmp_path / "d" / "y" / "2.csv", "a,b\n2,plain\n")
    df = files.read_csv(spark, str(tmp_path / "d"), recursive=True, multi_line=True)
    assert sorted(tuple(r) for r in df.collect()) == [(1, "two\nlines"), (2, "plain")]


def test_formats_and_uris():
    assert [files.infer_format(n) for n in ("a.CSV", "b.xlsx", "c.bin", None)] == ["csv", "excel", "excel", "excel"]
    assert files.infer_format("a.csv", "Excel") == "excel"
    assert files.object_uri("s3://bucket/a/b.csv") == "s3a://bucket/a/b.csv"
    assert files.object_uri("/a/b.csv", "mine") == "s3a://mine/a/b.csv"
    for bad in ("s3://bucket", "key.csv"):
        with pytest.raises(ValueError):
            files.object_uri(bad)


def test_size_guard_and_fingerprints(spark, tmp_path):
    write(tmp_path / "f" / "small.bin", b"abc")
    write(tmp_path / "f" / "sub" / "large.bin", b"x" * 100)
    listed = files.list_files(spark, str(tmp_path / "f"), "*.bin")
    accepted, rejected = files.split_by_size(listed, 10)
    assert [r["length"] for r in accepted.collect()] == [3] and [r["length"] for r in rejected.collect()] == [100]
    assert "content" not in rejected.columns
    assert files.file_fingerprints(accepted).first()["digest"] == "ba7816bf8f01cfea"


def test_table_fingerprint_ignores_order(spark):
    df = spark.range(100).selectExpr("id", "CASE WHEN id > 50 THEN 'x' END AS s")
    a = files.table_fingerprint(df).first()
    assert a == files.table_fingerprint(df.repartition(7).orderBy(F.desc("id"))).first()
    changed = df.withColumn("s", F.coalesce("s", F.lit("")))
    assert a["digest"] != files.table_fingerprint(changed).first()["digest"]
    assert a["digest"] != files.table_fingerprint(df.union(df)).first()["digest"]


def make_workbook(sheets):
    """A minimal .xlsx: shared and inline strings, numbers, a date style, booleans."""
    buffer = io.BytesIO()
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(buffer, "w") as z:
        entries = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {main} {rel}><sheets>{entries}</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si><si><r><t>Al</t></r><r><t>ex</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
    return buffer.getvalue()


def test_workbook_corpus(spark, tmp_path):
    people = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>when</t></is></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row>'
        '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" s="1"><v>45292.5</v></c><c r="C2"><v>3.0</v></c></row>'
        '<row r="3"><c r="A3" t="b"><v>1</v></c><c r="C3"><v>2.5</v></c></row>'
    )
    other = '<row r="1"><c r="A1" t="str"><v>x</v></c></row><row r="2"><c r="A2"><v>7</v></c></row>'
    write(tmp_path / "w" / "a.xlsx", make_workbook({"People": people, "Other": other}))
    write(tmp_path / "w" / "broken.xlsx", b"not a workbook")
    listed = files.list_files(spark, str(tmp_path / "w"), "*.xlsx")
    rows = {(r["sheet"], r["row_index"]): r for r in workbook.read_workbooks(listed).collect()}
    assert rows[("People", 0)]["cells"] == {"name": "Alex", "when": "2024-01-01T12:00:00", "n": "3"}
    assert rows[("People", 1)]["cells"] == {"name": "true", "when": None, "n": "2.5"}
    assert rows[(None, -1)]["error"]
    every = workbook.read_workbooks(listed, "*")
    assert every.where("sheet = 'Other'").first()["cells"] == {"x": "7"}
    wrong = workbook.read_workbooks(listed, "Nope").where("path LIKE '%a.xlsx'").first()
    assert "available sheets: People, Other" in wrong["error"]
    typed = workbook.sheet_table(workbook.read_workbooks(listed), {"name": "string", "n": "double"})
    assert sorted(r["n"] for r in typed.collect()) == [2.5, 3.0]


def test_warehouse_options_and_cap(spark):
    config = {"host": "h", "port": 5432, "database": "d", "user": "u", "password": "p"}
    options = warehouse.jdbc_options("postgres", config)
    assert options["url"].startswith("jdbc:postgresql://h:5432/d?") and options["fetchsize"] == "10000"
    assert "db=d" in warehouse.jdbc_options("snowflake", {"account": "a", "database": "d", "user": "u", "password": "p"})["url"]
    for kind, settings in (("oracle", config), ("postgres", {**config, "host": " "})):
        with pytest.raises(ValueError):
            warehouse.jdbc_options(kind, settings)
    # Exactly the limit is not truncated.
    assert warehouse.capped(spark.range(5), 5)[1] is False
    rows, more = warehouse.capped(spark.range(6), 5)
    assert len(rows) == 5 and more


def test_grants_and_inventory(spark):
    assert catalog.clean_grants([" finance", "Sales", "FINANCE", "", None]) == ["finance", "Sales"]
    rows = [("S", f"t{t:02d}", i, f"c{i}", "int", "integer") for t in range(30) for i in range(70, 0, -1)]
    listed = spark.createDataFrame(rows + [("other", "x", 1, "c", "int", "integer")], catalog.CATALOG_SCHEMA)
    allowed = catalog.granted(listed, ["s"])
    found = catalog.inventory(allowed).orderBy("table").collect()
    assert len(found) == 25 and found[0]["columns"][:2] == ["c1", "c2"] and len(found[0]["columns"]) == 64
    look = catalog.inventory_preview(allowed).first()
    assert look["table_count"] == 30 and len(look["tables"]) == 5 and len(look["tables"][0]["columns"]) == 6


def test_feed_columns_use_the_latest_version(spark):
    rows = [("a", 1, "x", "int"), ("a", 2, "y", "int"), ("b", 1, "z", "int")]
    df = spark.createDataFrame(rows, "feed string, version int, column string, dtype string")
    assert sorted(r["column"] for r in catalog.feed_columns(df).collect()) == ["y", "z"]
    assert [r["column"] for r in catalog.feed_columns(df, exclude="b").collect()] == ["y"]


def test_similar_names_equal_all_pairs(spark):
    from difflib import SequenceMatcher

    own = ["order_id", "user_id", "cust_id", "id", "aab_id", "identifier_id"]
    other = ["order_key_id", "userid", "customer_id", "order_ids", "ids", "id", "baa_id", "d_i", "rode_rid", "identity_id", "user_ids"]
    a, b = (spark.createDataFrame([(n,) for n in names], f"{c} string") for c, names in (("own", own), ("other", other)))
    got = {(r["own"], r["other"]): r["similarity"] for r in similar_names(a, b).collect()}
    want = {(x, y): SequenceMatcher(None, x, y).ratio() for x in own for y in other}
    assert got == {k: v for k, v in want.items() if v >= 0.78}
    assert ("cust_id", "customer_id") not in got and round(got[("user_id", "userid")], 3) == 0.923


def test_foreign_key_candidates(spark):
    profiles = spark.createDataFrame(
        [("t", "order_id", False), ("t", "id", True), ("t", "amount", False)], "feed string, column string, is_key_candidate boolean"
    )
    listed = [("t", "order_id"), ("o", "Order_ID"), ("p", "order_key_id")] + [(f"f{i}", "order_ids") for i in range(7)]
    found = foreign_key_candidates(profiles, spark.createDataFrame(listed, "feed string, column string"))
    rows = found.orderBy("rank").collect()
    assert len(rows) == 5 and rows[0]["other_feed"] == "o" and rows[0]["similarity"] == 1.0
    assert {r["column"] for r in rows} == {"order_id"}


def test_versions_are_published_after_the_write(spark, tmp_path):
    root = str(tmp_path / "feeds")
    df = spark.createDataFrame([("Alex", "Closed"), ("Priya", "Open")], "Agent string, Status string")
    info = sinks.write_version(df, root, "Agent Status!", 1)
    assert (info["rows"], info["columns"], info["table"]) == (2, 2, "feed_agent_status_v1")
    assert sinks.write_version(df.limit(0), root, "Agent Status!", 2) is None
    assert sinks.write_version(df, root, "Agent Status!", 3, max_rows=1) is None
    assert sinks.read_version(spark, root, "Agent Status!").count() == 2
    with pytest.raises(ValueError):
        sinks.read_version(spark, root, "Agent Status!", 3)
    assert len(sinks.table_name("x" * 100, 12)) == 60 and sinks.table_name("--", 1) == "feed_feed_v1"
    with pytest.raises(ValueError):
        sinks.load(df, root, "merge")


def test_incremental_load(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B", 1), (2, "BB", 2), (3, "c", 1)], "id int, v string, at int")
    merged = joins.upsert(old.withColumn("at", F.lit(0)), new, ["id"], ["at"])
    assert sorted((r["id"], r["v"]) for r in merged.collect()) == [(1, "a"), (2, "BB"), (3, "c")]
    stored = sinks.load_incremental(old, new.where("at = 1").drop("at"), ["id"])
    assert sorted((r["id"], r["v"]) for r in stored.collect()) == [(1, "a"), (2, "B"), (3, "c")]


def test_version_decisions(spark):
    known = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "feed string, version int, digest string")
    incoming = spark.createDataFrame(
        [("a", "y", False), ("a", "x", False), ("a", "w", True), ("new", "q", False)], "feed string, digest string, confirmed boolean"
    )
    got = {(r["feed"], r["digest"]): (r["action"], r["version"]) for r in versions.decide_versions(incoming, known).collect()}
    assert got == {
        ("a", "y"): ("reuse", 2), ("a", "x"): ("conflict", 2), ("a", "w"): ("new_version", 3), ("new", "q"): ("create", 1)
    }


def test_json_rows_are_safe(spark):
    df = spark.sql(
        "SELECT double('NaN') AS nan, timestamp_ntz'2024-01-01 10:00:00.5' AS at, date'2024-01-02' AS day, X'6869' AS raw, "
        "CAST(NULL AS STRING) AS none, true AS flag"
    )
    assert df.select(json_row(df)).first()[0] == (
        '{"nan":null,"at":"2024-01-01T10:00:00.500000","day":"2024-01-02","raw":"hi","none":null,"flag":true}'
    )
