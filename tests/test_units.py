"""Edge cases of the operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions import columns as C
from ledgerleaf.operators import extract as E
from ledgerleaf.operators import layout as Y
from ledgerleaf.operators import literature as L
from ledgerleaf.operators import match as M
from ledgerleaf.operators import rules as R
from ledgerleaf.operators import schedule as S
from ledgerleaf.operators import sync as Z


def one(spark, col, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(col(F.col("v")).alias("r")).first()["r"]


def test_clean_text(spark):
    assert one(spark, C.clean_text, "  a   b\n\tc ") == "a b c"
    assert one(spark, C.clean_text, None) == ""


def test_slug_and_fold(spark):
    assert one(spark, C.slugify, "Étude & R+D — ﬁn") == "etude-and-r-plus-d-fin" or one(spark, C.slugify, "Étude & R+D") == "etude-and-r-plus-d"
    assert one(spark, C.fold_accents, "Ǆéü") == "DZeu"


@pytest.mark.parametrize(("n", "ok"), [("943 476 5919", True), ("9434765918", False), ("0000000000", True), ("123", False), (None, False)])
def test_nhs(spark, n, ok):
    assert one(spark, C.nhs_valid, n) is ok


@pytest.mark.parametrize(
    ("text", "date"),
    [("1-Sept-52", dt.date(1952, 9, 1)), ("31/02/2024", None), ("2024-02-29", dt.date(2024, 2, 29)), ("3.4.24", dt.date(2024, 4, 3)), ("3/4/25", dt.date(1925, 4, 3)), ("x", None), ("", None)],
)
def test_dates(spark, text, date):
    assert one(spark, lambda c: C.parse_uk_date(c, F.lit("2024-06-01").cast("date")), text) == date


def test_terms(spark):
    df = spark.createDataFrame([(1, "Étion here"), (2, "a tion, b"), (3, "tional"), (4, None)], "id int, t string")
    hit = lambda spec: {r["id"] for r in df.filter(L.text_predicate(spec, F.col("t"))).collect()}
    assert hit("tion") == {2}
    assert hit("tion*") == {2, 3}
    assert hit({"all": [{"any": ["here", "b"]}, {"not": "tion"}]}) == {1}
    with pytest.raises(ValueError):
        L.text_predicate({"near": []}, F.col("t"))


def test_rules(spark):
    df = spark.createDataFrame([(1, "", "yes", "", "S"), (2, "p", "", "line", None)], "id int, prompt string, option string, line string, section string")
    rules = [R.Rule("empty", "always"), R.Rule("a", "never", "n", option="^YES$"), R.Rule("s", "always", section="s")]
    got = {r["id"]: (r["rule"], r["rule_tick"], r["by_section"]) for r in R.first_rule(df, rules).collect()}
    assert got == {1: ("a", "never", False), 2: (None, None, False)}


def test_schedule(spark):
    d = F.lit("2024-01-31").cast("date")
    assert one(spark, lambda c: S.offset(d, 1, "m")) == dt.date(2024, 2, 29)
    assert one(spark, lambda c: S.prefer_weekday(d, 3)) == dt.date(2024, 1, 31)
    with pytest.raises(ValueError, match="circle"):
        S.item_dates([{"n": 1, "u": "d", "label": "a", "ref": "b"}, {"n": 1, "u": "d", "label": "b", "ref": "a"}], {"index": d})
    with pytest.raises(ValueError, match="unknown"):
        S.item_dates([{"n": 1, "u": "d", "label": "a", "ref": "z"}], {"index": d})


PREV = "id string, source string, url string, title string, group string, sha string, analyser int, updated date"
NOW = "source string, ord int, url string, title string, group string, sha string, error string, file_present boolean"


def test_sync_one_to_one_and_rerun(spark):
    today = F.lit("2024-02-02").cast("date")
    old = dt.date(2024, 1, 1)
    prev = spark.createDataFrame([("p1", "s", "u1", "T", "g", "h1", 1, old), ("p2", "s", "u2", "T2", "g", "h2", 1, old)], PREV)
    # the first item could take p1 by title, the second has its url
    now = spark.createDataFrame([("s", 1, "new", "T", "g", "h9", None, True), ("s", 2, "u1", "X", "g", "h1", None, True), ("s", 3, "u9", "N", "g", None, "boom", True)], NOW)
    got = {r["ord"]: (r["id"], r["change"], r["kept"]) for r in Z.sync(now, prev, today).collect()}
    assert got == {1: ("s-g-t", "added", True), 2: ("p1", "unchanged", True), 3: ("s-g-n", "failed", False)}
    same = prev.select("source", F.expr("row_number() OVER (ORDER BY id)").alias("ord"), "url", "title", "group", "sha", F.lit(None).cast("string").alias("error"), F.lit(True).alias("file_present"))
    assert {r["change"] for r in Z.sync(same, prev, today).collect()} == {"unchanged"}
    assert Z.sync(same, prev.limit(0), today).filter("change = 'added'").count() == 2


def test_ids_clash(spark):
    df = spark.createDataFrame([("s", 1, "a", "g", None), ("s", 2, "a", "g", None), ("s", 3, "a 2", "g", None), ("s", 4, "a", "g", "s-g-a")], "source string, ord int, title string, group string, prev_id string")
    ids = [r["id"] for r in Z.assign_ids(df).collect()]
    assert len(set(ids)) == 4 and "s-g-a" in ids


def test_ids_never_repeat(spark):
    titles = ["x", "x", "x 2", "x 2", "x", "y"]
    rows = [("s", k, t, "g", None) for k, t in enumerate(titles)] + [("s", 9, "old", "g", "s-g-x-4"), ("s", 10, "old", "g", "s-g-y")]
    got = {r["ord"]: r["id"] for r in Z.assign_ids(spark.createDataFrame(rows, "source string, ord int, title string, group string, prev_id string")).collect()}
    assert got == {0: "s-g-x", 1: "s-g-x-3", 2: "s-g-x-2", 3: "s-g-x-2-2", 4: "s-g-x-5", 5: "s-g-y-2", 9: "s-g-x-4", 10: "s-g-y"}


def test_sources_that_shrink_or_list_nothing_are_held(spark):
    today, old = F.lit("2024-02-02").cast("date"), dt.date(2024, 1, 1)
    prev = spark.createDataFrame([(f"{s}{k}", s, f"{s}{k}", f"T{k}", "g", "h", 1, old) for s in "abc" for k in range(5)], PREV)
    now = spark.createDataFrame([("a", k, f"a{k}", f"T{k}", "g", "h", None, True) for k in range(3)] + [("b", 0, "b0", "T0", "g", "new", None, True)], NOW)
    out = Z.sync(now, prev, today)
    stats = {r["source"]: r for r in Z.run_stats(out, prev, now).withColumn("ok", Z.source_ok("forms")).collect()}
    assert (stats["a"]["unchanged"], stats["a"]["removed"], stats["a"]["ok"]) == (3, 2, True)
    assert (stats["b"]["held"], stats["b"]["listed"], stats["b"]["removed"], stats["b"]["ok"]) == (5, 1, 0, False)
    assert (stats["c"]["held"], stats["c"]["listed"], stats["c"]["removed"]) == (5, 0, 0) and stats["c"]["error"].startswith("0 listed")
    assert not Z.overall_ok(Z.run_stats(out, prev, now), "forms").first()["ok"]
    assert {r["id"] for r in Z.removed_rows(prev, out).collect()} == {"a3", "a4"}


def test_known_rules_and_anchors(spark):
    df = spark.createDataFrame([(1, "F"), (2, "M"), (3, "")], "id int, sex string").selectExpr("*", "'yes' AS option", "'' AS prompt", "'' AS line", "'' AS section", "false AS matrix", "cast(NULL AS string) AS `group`")
    got = {r["id"]: (r["on"], r["why"]) for r in R.resolve(R.first_rule(df, [R.Rule("k", "known", "all", option="yes")])).collect()}
    assert got == {1: (True, "all"), 2: (True, "all"), 3: (False, "choose by sex")}
    c = spark.createDataFrame([(1, "p", dt.date(2024, 1, 1), dt.date(2024, 3, 1)), (2, "p", dt.date(2024, 1, 1), None)], "id int, preset string, d date, t date")
    items = {"p": [{"n": 1, "u": "d", "label": "a"}, {"n": 1, "u": "d", "label": "b", "from": "treatment"}]}
    due = {(r["id"], r["label"]): r["due"] for r in S.expand_schedule(c, items, "id", "preset", "d", anchors={"treatment": "t"}).collect()}
    assert due == {(1, "a"): dt.date(2024, 1, 2), (1, "b"): dt.date(2024, 3, 2), (2, "a"): dt.date(2024, 1, 2), (2, "b"): None}


def test_match(spark):
    forms = spark.createDataFrame([(1, "CAPOX and Fluorouracil infusion"), (2, "nothing")], "form_id long, title string")
    leaflets = spark.createDataFrame([(1, 1, "Fluorouracil (5FU)"), (2, 2, "Fluorouracil infusion"), (3, 3, "CAPOX (XELOX)")], "leaflet_id long, leaflet_ord int, title string")
    assert [(r["rank"], r["leaflet_id"]) for r in M.suggest(forms, leaflets).orderBy("rank").collect()] == [(1, 3), (2, 2)]


def test_keys_of_many_words(spark):
    long = " ".join(f"w{k}" for k in range(12))
    forms = spark.createDataFrame([(1, f"Before {long} after"), (2, "w0 w1"), (3, "")], "form_id int, title string")
    keys = spark.createDataFrame([(7, 0, 0, long, False), (8, 0, 0, "w1", False)], "leaflet_id int, leaflet_ord int, key_ord int, key string, regimen boolean")
    assert sorted((r["form_id"], r["leaflet_id"], r["pos"]) for r in M.phrase_hits(forms, keys).collect()) == [(1, 7, 7), (1, 8, 10), (2, 8, 3)]
    assert M.phrase_hits(forms, keys.filter("leaflet_id = 9")).count() == 0


def test_identifiers(spark):
    notes = spark.createDataFrame([(1, "s", "SMITH, Mrs Ann (Annie)\r\nNHS no: 943 476 5919 DOB: 3/4/60 Sex: F"), (2, "s", None)], "note_id long, source string, text string")
    got = {r["note_id"]: r for r in E.extract_identifiers(notes, F.lit("2024-06-01").cast("date")).collect()}
    assert (got[1]["surname"], got[1]["forenames"], got[1]["nhs"], got[1]["dob"], got[1]["sex"]) == ("SMITH", "Ann", "9434765919", dt.date(1960, 4, 3), "F")
    assert got[2]["surname"] == "" and not got[2]["found_dob"]


def test_titles_of_names(spark):
    rows = [(1, "Name: Sir Ann, Dr Bob Mr"), (2, "BROWN, Ann Mr Brown"), (3, "Patient: nonsense\nSMITH, Jo (known as X)"), (4, "Lady Smith, Rev. Jo"), (5, "a: b, c")]
    df = spark.createDataFrame(rows, "note_id long, text string").withColumn("source", F.lit("s"))
    got = {r["note_id"]: (r["surname"], r["forenames"]) for r in E.extract_identifiers(df, F.lit("2024-06-01").cast("date")).collect()}
    assert got == {1: ("Ann", "Bob Mr"), 2: ("BROWN", "Ann Mr Brown"), 3: ("SMITH", "Jo"), 4: ("Smith", "Jo"), 5: ("", "")}


def test_headings_of_pages(spark):
    html = "<h2>Menu items</h2><h2>Good group</h2><a href='a.pdf'><h4>own title</h4></a><h3><a href='b.pdf'>wrapped</a></h3><h2>FAQs</h2><a href='c'>plain</a><h2><a href='x.html'>Other</a></h2><a href='d.pdf'>last</a>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = [(r["text"], r["href"], r["group"]) for r in E.inherit_group(E.page_tokens(df)).orderBy("pos").collect()]
    assert got == [("own title", "a.pdf", "Good group"), ("wrapped", "b.pdf", "Good group"), ("plain", "c", "Good group"), ("last", "d.pdf", "Other")]


def test_greedy_lines(spark):
    rows = [(1, 1, "a", 0.0, 5.0, 100.0, 10.0), (1, 1, "b", 10.0, 15.0, 97.0, 10.0), (1, 1, "c", 20.0, 25.0, 94.0, 10.0)]
    df = spark.createDataFrame(rows, "doc_id long, page int, str string, x0 double, x1 double, y double, fs double")
    assert {r["str"]: r["line"] for r in Y.assemble_lines(df).collect()} == {"a": 0, "b": 0, "c": 1}


ITEM = "doc_id long, page int, str string, x0 double, x1 double, y double, fs double"


def lines_by_hand(rows):
    """Item -> line, item by item: the topmost line within the item's reach, else a new one."""
    out = {}
    for key in {r[:2] for r in rows}:
        tops, on = [], []
        for r in sorted((r for r in rows if r[:2] == key and r[2].strip()), key=lambda r: (-r[5], r[3])):
            at = next((k for k, y in enumerate(tops) if abs(y - r[5]) <= max(2, 0.35 * r[6])), None)
            if at is None:
                at = len(tops)
                tops.append(r[5])
            on.append((r[2], at))
        out.update({(*key, s): k for s, k in on})
    return out


def test_lines_as_by_hand_on_crowded_pages(spark):
    rnd = random.Random(7)
    rows = [(d, p, f"i{k}" if rnd.random() < 0.95 else "  ", float(rnd.randrange(400)), 500.0, rnd.randrange(1200) / 4, rnd.choice([4.0, 10.0, 12.0, 40.0])) for d in range(3) for p in range(2) for k in range(150)]
    got = {(r["doc_id"], r["page"], r["str"]): r["line"] for r in Y.assemble_lines(spark.createDataFrame(rows, ITEM)).collect()}
    assert got == lines_by_hand(rows)


def test_phrases_leaders_and_headings(spark):
    rows = [
        (1, 1, "Name ", 0.0, 25.0, 100.0, 10.0), (1, 1, " of", 28.0, 38.0, 100.0, 10.0), (1, 1, "all", 41.0, 55.0, 99.0, 10.0), (1, 1, "______", 56.0, 200.0, 100.0, 10.0),
        (1, 1, "   ", 100.0, 110.0, 100.0, 10.0), (1, 1, "near", 120.0, 140.0, 100.0, 10.0), (1, 1, "far", 150.0, 160.0, 100.0, 10.0), (1, 1, "....", 204.0, 208.0, 100.0, 10.0), (1, 1, "Witness statement", 0.0, 80.0, 50.0, 12.0),
    ]
    lined = Y.assemble_lines(spark.createDataFrame(rows, ITEM).withColumn("leader", F.col("str").rlike("^(_+|[.]+)$")))
    phrases = Y.assemble_phrases(lined)
    got = [(r["line"], r["phrase"], r["text"], r["x0"], r["x1"]) for r in phrases.orderBy("line", "phrase").collect()]
    assert got == [(0, 0, "Name of all", 0.0, 55.0), (0, 1, "near", 120.0, 140.0), (0, 2, "far", 150.0, 160.0), (1, 0, "Witness statement", 0.0, 80.0)]
    assert [(r["x0"], r["x1"]) for r in Y.line_leaders(lined).collect()] == [(56.0, 208.0)]
    heads = Y.section_headings(Y.line_texts(phrases)).collect()
    assert [(r["x"], r["y"], r["section"]) for r in heads] == [(0.0, 50.0, "witness")]


def test_journal_and_citation(spark):
    a = spark.createDataFrame([(1, ""), (2, "Lancet Oncology")], "id int, journal string")
    j = spark.createDataFrame([(0, "Lancet", "L", "red")], "ord int, name string, short string, color string")
    assert {r["id"]: r["short"] for r in L.tag_journal(a, j, "id").collect()} == {1: None, 2: "L"}
