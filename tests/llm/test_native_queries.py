"""The DataFrame-only operators: queries against their SQL, edge cases, and no Python in their plans."""

import oracle
import pytest
from conftest import ORACLE, SMALL

from feedloom.llm.decontaminate import decontaminate
from feedloom.llm.license_scan import Template, license_spans, scan_licenses
from feedloom.llm.quality_rules import apply_quality_rules, document_measures
from feedloom.llm.queries import LICENSES, ORACLES, QUERIES
from feedloom.llm.url_filter import judge_urls


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert oracle.compare(duck, ORACLES[name], QUERIES[name](spark, ORACLE)) == []


@pytest.mark.parametrize("name", ["op1_license_scan", "op5_url_filter", "op9_decontaminate", "op10_quality_rules"])
def test_plans_hold_no_python(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


# ---- licenses


def scanned(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tuple(r)[1:] for r in scan_licenses(docs, LICENSES, **options).orderBy("doc_id").collect()]


def test_license_phrases_and_places(spark):
    assert scanned(spark, ["CC-BY cc by, cc  by", "All rights  RESERVED.", "general public licences", None, ""]) == [
        (6, 3, 0, 4, "cc-by", "cc-by", 1.0),
        (3, 1, 0, 0, "reserved", "reserved", 1.0),
        (3, 0, None, None, "", "", 0.0),
        (0, 0, None, None, "", "", 0.0),
        (0, 0, None, None, "", "", 0.0),
    ]


def test_license_template_with_changed_words(spark):
    mit = next(t for t in LICENSES if t.label == "mit").text
    changed = mit.replace("hereby granted", "hereby kindly granted").replace("and associated ", "")
    half = " ".join(mit.split()[:8])
    docs = spark.createDataFrame([(1, "x y z " + changed + " end"), (2, half)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in scan_licenses(docs, LICENSES).collect()}
    assert found[1]["labels"] == "mit" and 0.6 <= found[1]["score"] < 1.0
    assert found[2]["labels"] == ""
    spans = license_spans(docs, LICENSES).filter("template IS NOT NULL").collect()
    assert [(r["doc_id"], r["first_word"], r["end_word"]) for r in spans] == [(1, 3, 2 + len(changed.replace(",", "").split()))]


def test_license_nulls_repeats_clashes(spark):
    rows = [(None, "cc by", 1), (4, "cc by", 2), (4, "cc by", 2), (5, "word " * 50_000 + "all rights reserved", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"]) for r in scan_licenses(docs, LICENSES).collect()), key=str)
    assert got == [(4, 2, 1), (4, 2, 1), (5, 50_003, 1), (None, 2, 1)]
    assert scan_licenses(docs.limit(0), LICENSES).count() == 0
    with pytest.raises(ValueError, match="rename"):
        scan_licenses(docs, LICENSES, keep=["doc_id", "n_words"])
    with pytest.raises(ValueError, match="three words"):
        scan_licenses(docs, [Template("long", "one two three four", True)])


# ---- urls


def test_url_parts_and_precedence(spark):
    rules = spark.createDataFrame(
        [
            ("org", "/", "allow", 0), ("b.org", "/x", "block", 0), ("b.org", "/x", "allow", 0), ("c.org", "/", "block", 1),
            ("net", "", "block", 0), (None, "/", "block", 0),
        ],
        "host string, path string, verdict string, tier int",
    )
    urls = [
        (1, "http://A.B.org/xyz?q#f"), (2, "https://org"), (3, "x://bb.org/x"), (4, "http://c.org/a"), (5, "no scheme"), (6, None),
        (7, "http://u.net"), (8, "a://b.org/X"), (9, "a://b://c/x"), (9, "a://b://c/x"), (None, "http://z.com/" + "p" * 50_000),
    ]
    pages = spark.createDataFrame([(*u, "old") for u in urls], "page_id long, url string, verdict string")
    got = judge_urls(pages, rules).drop("url", "tier").collect()
    by_id = {r["page_id"]: tuple(r)[1:] for r in got}
    assert len(got) == len(urls)
    assert by_id[1] == ("a.b.org", "/xyz", "b.org/x", "block")  # block wins over allow of the same rule
    assert by_id[2] == ("org", "", None, "allow")
    assert by_id[3] == ("bb.org", "/x", "org/", "allow")
    assert by_id[4] == ("c.org", "/a", "org/", "allow")  # the first tier decides
    assert by_id[5] == by_id[6] == ("", "", None, "allow")
    assert by_id[7] == ("u.net", "", "net", "block")
    assert by_id[8] == ("b.org", "/X", "org/", "allow")
    assert by_id[9] == ("b:", "//c/x", None, "allow")
    assert by_id[None][0] == "z.com" and len(by_id[None][1]) == 50_001
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


# ---- benchmark


def test_contamination_edges(spark):
    eleven = "a b c d e f g h i j k"
    items = spark.createDataFrame(
        [(1, eleven), (10, "short one"), (2, "Short, ONE"), (3, ""), (4, None), (None, "p q r")], "item_id long, text string"
    )
    rows = [
        (1, "x a b c d e f g h i j y"), (2, f"{eleven} {eleven}"), (3, "short one short one"), (4, None), (5, ""),
        (6, "a b c d e f g h i x j"), (7, "p q r"), (None, "short one"), (8, "x"), (8, "x"), (9, "a " * 40_000 + "short one"),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_hit int")
    got = {}
    for r in decontaminate(docs, items).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]))
    assert got == {
        1: [(12, 10, 1, True)], 2: [(22, 22, 1, True)], 3: [(4, 4, 2, True)], 4: [(0, 0, 0, False)], 5: [(0, 0, 0, False)],
        6: [(11, 0, 0, False)], 7: [(3, 3, 0, True)], None: [(2, 2, 2, True)], 8: [(1, 0, 0, False)] * 2,
        9: [(40_002, 2, 2, True)],
    }
    digests = {r["doc_id"]: r["items_sha256"] for r in decontaminate(docs, items).collect()}
    import hashlib

    assert digests[3] == hashlib.sha256(b"10,2").hexdigest() and digests[5] == hashlib.sha256(b"").hexdigest()
    assert decontaminate(docs.limit(0), items).count() == 0
    assert {r["contaminated"] for r in decontaminate(docs, items.limit(0)).collect()} == {False}


def test_proximity_matches(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "alpha beta gamma delta"), (2, "alpha x beta y gamma delta"), (3, "alpha " + "x " * 9 + "beta gamma delta")],
        "doc_id long, text string",
    )
    found = {r["doc_id"]: (r["contaminated"], r["n_near"]) for r in decontaminate(docs, items, lists=4, slop=3).collect()}
    assert found == {1: (True, 1), 2: (False, 1), 3: (False, 0)}


def test_proximity_takes_every_word_of_a_window(spark):
    window = "alpha beta gamma delta eps zeta eta theta iota kappa"
    items = spark.createDataFrame([(1, window), (2, "to be or not to be")], "item_id long, text string")
    texts = [
        window, window.replace("gamma", "gamma x y"), "alpha beta c d e f g h i j", window.replace("gamma", "x"),
        window.replace("kappa", "x x x x kappa"), "beta alpha gamma delta eps zeta eta theta iota kappa",
        "to be or x not to be", "to be or not", "kappa " * 30 + window.replace("zeta", "q zeta"), None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def plain(text):
        words = (text or "").split()
        near = 0
        for item in (window.split(), "to be or not to be".split()):
            places = [[at - o for at, w in enumerate(words) if w == term] for o, term in enumerate(item)]
            near += any(all(any(s <= p <= s + 3 for p in ps) for ps in places) for s in range(-20, len(words)))
        return near

    expected = {i: plain(t) for i, t in enumerate(texts)}
    assert expected == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1, 7: 0, 8: 1, 9: 0}
    for options in ({}, {"lists": 1}, {"lists": 4}):
        assert {r["doc_id"]: r["n_near"] for r in decontaminate(docs, items, **options).collect()} == expected


# ---- quality


def test_measures(spark):
    texts = [
        ("a b c a b c", (6, 6, 0, 0, 6)), ("a a a a", (4, 4, 0, 0, 4)), ("a b c d", (4, 4, 0, 0, 0)), ("é#\n\n \nx\nx", (3, 4, 1, 1, 0)),
        (None, (0, 0, 0, 0, 0)), ("", (0, 0, 0, 0, 0)), ("\x0b\x1f \x85", (2, 2, 0, 0, 0)), ("ab c ab c " * 30_000, (120_000, 180_000, 0, 0, 120_000)),
    ]
    docs = spark.createDataFrame([(i, t, 5) for i, (t, _) in enumerate(texts)], "doc_id long, text string, n_words int")
    rows = document_measures(docs).orderBy("doc_id").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(r[n] for n in names) for r in rows] == [expected for _, expected in texts]


def test_host_verdicts(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "good") for i in range(40)] + [(100 + i, "bad", "bad") for i in range(40)] + [(200, good, "bad"), (200, good, "bad")]
    rows += [(300, good, None), (None, None, "good"), (400, "few", "once")]
    kept = {}
    for r in apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        kept.setdefault(r["doc_id"], []).append((r["base_failed"], r["host_bad"], r["kept"]))
    assert kept[0] == [(False, False, True)] and kept[100] == [(True, True, False)]
    assert kept[200] == [(False, True, False)] * 2 and kept[300] == [(False, False, True)]
    assert kept[None] == [(True, False, False)]
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert apply_quality_rules(empty).count() == 0


def test_hosts_are_judged_against_the_prior(spark):
    good = " ".join(f"w{i}" for i in range(60))
    signs = good + " " + "#" * 60

    def verdicts(hosts):
        rows = [(h, signs if i < bad else good) for h, (n, bad) in hosts.items() for i in range(n)]
        frame = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
        found = apply_quality_rules(frame).collect()
        assert not any(r["base_failed"] for r in found) and all(r["kept"] == (not r["host_bad"]) for r in found)
        return {r["source"] for r in found if r["host_bad"]}

    usual = {f"h{i}": (100, 5) for i in range(30)}
    assert verdicts(usual) == set()
    assert verdicts({**usual, "worse": (100, 40)}) == {"worse"}  # below a half, far above the others
    assert verdicts({**usual, "once": (1, 1)}) == set()  # all of its documents fail, but one says little


def test_line_rule_counts_lines(spark):
    text = "\n".join(["a line of eight words stands here twice"] * 4 + [f"another line number {i}" for i in range(4)])
    row = document_measures(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_lines"], row["n_dup_lines"]) == (8, 3)
