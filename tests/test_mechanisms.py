"""Stored versions, numbering, indexes and joins against plain brute force, and their plans."""

import datetime as dt
import random
import re
import statistics
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions.ordered import running_sum
from ledgerleaf.operators import extract as E
from ledgerleaf.operators import layout as Y
from ledgerleaf.operators import literature as L
from ledgerleaf.operators import match as M
from ledgerleaf.operators import search as S
from ledgerleaf.operators import sync as Z
from ledgerleaf.operators import terms as T
from ledgerleaf.sources import versions as V
from ledgerleaf.streaming import streams

OLD = dt.date(2024, 1, 1)


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- versions


def test_a_version_is_whole_or_absent(spark, root, monkeypatch):
    df = spark.range(10)
    assert V.newest(spark, root) is None and V.read(spark, None, "id long").count() == 0
    with monkeypatch.context() as m:
        m.setattr(V, "enter", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))  # stops between data and entry
        with pytest.raises(KeyboardInterrupt):
            V.commit(df, root)
    assert V.history(spark, root) == []
    first = V.commit(df, root, note={"batch": 7})
    assert [v.number for v in V.history(spark, root)] == [1] and V.newest(spark, root) == first and V.last_note(spark, root, "batch") == 7


def test_versions_keep_their_order_within_one_tick(spark, root, monkeypatch):
    monkeypatch.setattr(V.time, "time", lambda: 1.0)
    for k in range(12):
        V.commit(spark.range(k), root)
    assert [v.number for v in V.history(spark, root)] == [*range(1, 13)]
    assert V.read(spark, V.newest(spark, root), "id long").count() == 11


def test_of_two_writers_one_commits(spark, root):
    one = V.commit(spark.range(1), root)
    V.commit(spark.range(2), root, after=one.number)
    with pytest.raises(V.Conflict):
        V.commit(spark.range(3), root, after=one.number)
    assert V.read(spark, V.newest(spark, root), "id long").count() == 2


def test_readers_stay_with_their_version_and_old_ones_go(spark, root):
    one = V.commit(spark.range(1), root)
    held = V.read(spark, one, "id long")
    for k in (2, 3, 4):
        V.commit(spark.range(k), root)
    assert V.expire(spark, root, keep=2) == [] and held.count() == 1  # younger than the horizon
    assert V.expire(spark, root, keep=2, older_than=-1) == [1, 2]
    assert [v.number for v in V.history(spark, root)] == [3, 4] and V.read(spark, V.history(spark, root)[0], "id long").count() == 3
    assert V.commit(spark.range(9), root).number == 5
    with pytest.raises(ValueError):
        V.expire(spark, root, keep=0)


def test_a_batch_that_stopped_is_done_once(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}"
    rows = [(k, "s", f"T{k}", "g", f"u{k}", "h", None, True) for k in range(20)]
    spark.createDataFrame(rows, streams.LISTING).write.parquet(f"{at}/in")
    real = V.enter
    with monkeypatch.context() as m:
        m.setattr(V, "enter", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            streams.sync_stream(spark, f"{at}/in", f"{at}/state", F.lit("2024-02-02").cast("date")).awaitTermination()
    assert V.newest(spark, f"{at}/state/catalogue") is None
    streams.sync_stream(spark, f"{at}/in", f"{at}/state", F.lit("2024-02-02").cast("date")).awaitTermination()
    # a stop after the entry, before the stream's own note of it: the batch comes again and is passed over
    import shutil

    shutil.rmtree(f"{tmp_path}/state/checkpoint")
    streams.sync_stream(spark, f"{at}/in", f"{at}/state", F.lit("2024-02-02").cast("date")).awaitTermination()
    assert real is V.enter and [v.number for v in V.history(spark, f"{at}/state/catalogue")] == [1]
    assert Z.stored(spark, V.newest(spark, f"{at}/state/catalogue")).by_id.count() == 20


# ---- snapshots


def listing(spark, rows):
    return spark.createDataFrame(rows, "source string, ord int, url string, title string, `group` string, sha string, error string, file_present boolean")


def test_a_stored_snapshot_is_not_shuffled(spark, root):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        prev = spark.createDataFrame([(f"i{k}", f"s{k % 3}", f"u{k}", f"T{k}", None if k % 4 else "g", "h", 1, OLD) for k in range(500)], Z.STORED)
        one = Z.stored(spark, Z.store(prev, root, buckets=4))
        now = listing(spark, [(f"s{k % 3}", k, f"u{k}" if k % 5 else f"v{k}", f"T{k}", None if k % 4 else "g", "h", None, True) for k in range(40, 560)])
        for df in (Z.match_previous(now, one), Z.removed_rows(one, now.select(F.lit("i1").alias("id"), F.lit(True).alias("kept")))):
            plan = df._jdf.queryExecution().toString()
            physical = plan[plan.index("== Physical Plan ==") :]
            lines = physical.split("\n")
            depth = [re.search("[A-Za-z]", x).start() if re.search("[A-Za-z]", x) else 10**6 for x in lines]
            for k in (k for k, line in enumerate(lines) if "FileScan" in line):
                at = depth[k]
                for up in range(k - 1, -1, -1):  # from a scan of the snapshot up to the first join
                    if depth[up] < at:
                        at = depth[up]
                        assert "Exchange" not in lines[up], physical
                        if "Join" in lines[up]:
                            break
                else:
                    raise AssertionError(physical)
        got = sorted((r["ord"], r["prev_id"], r["tier"]) for r in Z.match_previous(now, one).collect() if r["prev_id"])
        assert got == sorted((k, f"i{k}", 1 if k % 5 else 2) for k in range(40, 500))
        same = sorted(map(str, Z.sync(now, one, F.lit("2024-02-02").cast("date")).collect()))
        assert same == sorted(map(str, Z.sync(now, prev, F.lit("2024-02-02").cast("date")).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def unique(base, taken):
    name, n = base, 2
    while name in taken:
        name, n = f"{base}-{n}", n + 1
    taken.add(name)
    return name


def test_ids_take_the_smallest_free_number(spark):
    rnd = random.Random(4)
    for trial in range(4):
        rows = []
        for k in range(220):
            title = rnd.choice(["x", "x 2", "x 3", "x 2 2", "y", "y 9", "z"])
            held = rnd.choice(["s-g-x", "s-g-x-2", "s-g-x-4", "s-g-x-7", "s-g-x-2-3", "s-g-y-2", "s-g-z-99999999999", "s-g-z-01", "other"])
            rows.append(("s", k, "g", title, held if rnd.random() < 0.03 else None))
        df = spark.createDataFrame(rows, "source string, ord int, `group` string, title string, prev_id string")
        taken = {r[4] for r in rows if r[4]}
        want = {r[1]: r[4] for r in rows if r[4]}
        new = [(k, "s-g-" + t.replace(" ", "-")) for _, k, _, t, h in rows if not h]
        for k, slug in new:  # each slug's first row
            if k == min(a for a, b in new if b == slug) and slug not in taken:
                want[k] = unique(slug, taken)
        for k, slug in new:
            if k not in want:
                want[k] = unique(slug, taken)
        for most in (1_000_000, 20):
            got = {r["ord"]: r["id"] for r in Z.assign_ids(df, most=most).collect()}
            assert got == want, trial


def test_running_sums_of_large_groups(spark):
    df = spark.range(3000).selectExpr("id % 3 = 0 AS g", "hash(id) AS o", "id % 5 AS v", "id")
    want, total = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r["o"], r["id"])):
        want[r["id"]] = total.get(r["g"], 0)
        total[r["g"]] = want[r["id"]] + r["v"]
    for most in (10_000, 100):
        assert {r["id"]: r["s"] for r in running_sum(df, ["g"], "v", ["o", "id"], "s", most).collect()} == want


# ---- terms, names, lists, search


def test_terms_are_found_as_one_by_one(spark):
    rnd = random.Random(9)
    words = ["lung", "Lung", "lungs", "cancer", "x_1", "é", "Été", "42", "c", "the", "of", "covid", "19", "naïve"]
    gaps = [" ", "  ", "-", ", ", "\n", ".", "++ ", "/", " (", ") "]
    texts = ["".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.randint(0, 14))).strip() if k % 5 else rnd.choice(gaps) + rnd.choice(words) for k in range(400)] + ["", None]
    terms = ["lung", "lung*", "lung cancer", "lung can*", "of the", "covid-19", "covid-1*", "c++", "été", "x_1", "the of lung*", "c", "42", "-19", "naïve/the", "*"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    for term in [t for t in terms if t != "*"]:
        want = {r["k"] for r in df.filter(L.term(F.col("t"), term)).collect()}
        assert {r["k"] for r in T.find_terms(df, [term], "t", "k").collect()} == want, term
    many = T.find_terms(df, terms[:-1], "t", "k").collect()
    assert len(many) == len(set(many)) > 300
    topics = {"a": {"all": ["lung*", {"not": "the"}]}, "b": {"any": ["of the", "c++"]}, "none": {"not": {"any": ["lung*", "the"]}}, "empty": {"any": []}}
    want = {(r["k"], n) for n, s in topics.items() for r in df.filter(F.col("t").isNotNull()).filter(L.text_predicate(s, F.col("t"))).collect()}
    assert {tuple(r) for r in T.topic_membership(df, topics, "t", "k").collect()} == want
    places = {(r["k"], r["pos"]) for r in T.find_terms(df, ["of the"], "t", "k", positions=True).collect()}
    for k, t in enumerate(texts):
        at = [m for m in re.finditer(r"\w+", (t or "").lower())]
        assert {p for d, p in places if d == k} == {i for i, m in enumerate(at[:-1]) if t.lower()[m.start() : at[i + 1].end()] == "of the"}
    with pytest.raises(ValueError):
        T.find_terms(df, ["c++"], "t", "k", positions=True)


def test_near_terms(spark):
    df = spark.createDataFrame([(1, "a x x b"), (2, "b x x x a"), (3, "a b"), (4, "a"), (5, "x b a a")], "k long, t string")
    assert {r["k"] for r in T.near(df, "a", "b", 3, "t", "k").collect()} == {1, 3, 5}


def test_journals_by_parts_of_names(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 5)))
    names = [" ".join([word(), word()]) if rnd.random() < 0.8 else word() for _ in range(120)]
    for extra in ([], [" blank first"]):
        j = [(k, n, f"s{k}", "c") for k, n in enumerate(names + extra)]
        own = ["".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 6))) for _ in range(150)] + ["Zq", "", "A b"]
        a = spark.createDataFrame([(k, x) for k, x in enumerate(own)], "k long, journal string")
        got = {r["k"]: r["short"] for r in L.tag_journal(a, spark.createDataFrame(j, "ord int, name string, short string, color string"), "k").collect()}
        for k, x in enumerate(own):
            first = lambda s: s.lower().split(" ")[0]
            want = next((s for _, n, s, _ in j if x and (first(n) in x.lower() or first(x) in n.lower())), None)
            assert got[k] == want, (x, got[k], want)


def test_journals_of_large_sides_meet_without_a_nested_loop(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(20_000).selectExpr("id AS k", "concat('Annals of ', md5(string(id))) AS journal")
        j = spark.range(20_000).selectExpr("id AS ord", "concat(substr(md5(string(id * 7)), 5, 9), ' letters') AS name", "string(id) AS short", "'c' AS color")
        df = L.tag_journal(a, j, "k")
        words, names = j.selectExpr("split(name, ' ')[0] AS word").distinct(), a.selectExpr("lower(journal) AS name").distinct()
        plan = plan_of(L.contained_words(words, names))
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        held = {r["journal"].lower(): r["k"] for r in a.collect()}
        want = {}
        for r in sorted(j.collect(), key=lambda r: -r["ord"]):
            w = r["name"].split(" ")[0]
            for n in held if r["ord"] % 500 == 0 else ():
                if w in n:
                    want[held[n]] = r["short"]
        got = {r["k"]: r["short"] for r in df.collect()}
        assert len(got) == 20_000 and all(got[k] is not None and int(got[k]) <= int(s) for k, s in want.items())
        assert sum(s is not None for s in got.values()) >= 20_000 // 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lists_within_lists(spark):
    loc = lambda *u: "".join(f"<loc> {x} </loc>" for x in u)
    rows = [("https://x/a.xml", loc("http://x/b.xml", "https://x/1")), ("https://x/b.xml", loc("https://x/c.xml", "https://x/a.xml", "https://x/2?x=1&amp;y=2")), ("https://x/c.xml", loc("https://x/b.xml", "https://x/1", "https://x/gone.xml"))]
    stored = spark.createDataFrame(rows, "url string, xml string")
    roots = spark.createDataFrame([("http://x/a.xml",)], "url string")
    got = {(r["url"], r["depth"], r["stored"]) for r in E.sitemap_tree(roots, stored, 5).collect()}
    assert got == {("http://x/a.xml", 0, True), ("http://x/b.xml", 1, True), ("https://x/1", 1, None), ("https://x/c.xml", 2, True), ("https://x/2?x=1&y=2", 2, None), ("https://x/gone.xml", 3, False)}
    with pytest.raises(ValueError):
        E.sitemap_tree(roots, stored, 2)


def test_search_reads_the_postings_asked_for(spark, root):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 6)))
    docs = [(k, " ".join(word() for _ in range(3)).title(), word() if k % 7 else None) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, title string, `group` string")
    index = S.build_index(df, root, buckets=16)
    for q in ["ab", "a b", "abca", "ca É", "zz", "", "bb aa c", "abcabcabc", "a"]:
        want = {k for k, t, g in docs if all(w in " ".join(x for x in (t, g) if x is not None).lower() for w in q.lower().split())}
        assert {r["doc_id"] for r in S.search(spark, index, q).collect()} == want, q
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # only then do plans tell the buckets
    try:
        assert "SelectedBucketsCount: 1 out of 16" in plan_of(S.search(spark, index, "abc"))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


# ---- layout


def kept_by_hand(boxes):
    out = []
    for y, x, glyph, box in sorted((-b[3], b[2], b[6], b[0]) for b in boxes if 5 <= b[4] <= 20 and 5 <= b[5] <= 20):
        if not any(abs(x - a) < (lim := 1.5 if glyph == g else 4.0) and abs(y - c) < lim for c, a, g, _ in out):
            out.append((y, x, glyph, box))
    return {b for *_, b in out}


def test_near_boxes_go_as_by_hand(spark):
    rnd = random.Random(6)
    schema = "box_id long, doc_id long, x double, y double, w double, h double, glyph boolean, page int"
    rows, want = [], set()
    for doc in range(12):
        page = [(doc * 1000 + k, doc, rnd.random() * 40 - 20, rnd.random() * 20, rnd.choice([4.0, 10.0]), 10.0, rnd.random() < 0.5, 1) for k in range(150)]
        page += [(doc * 1000 + 500 + k, doc, 60.0 + k, 5.0, 10.0, 10.0, True, 1) for k in range(25)]  # a chain
        rows += page
        want |= kept_by_hand(page)
    got = Y.dedupe_boxes(spark.createDataFrame(rows, schema))
    assert {r["box_id"] for r in got.collect()} == want
    assert Y.dedupe_boxes(spark.createDataFrame([], schema)).count() == 0


def test_a_hundred_thousand_boxes_on_one_page(spark):
    b = spark.range(100_000).selectExpr("id AS box_id", "1L AS doc_id", "1 AS page", "double(id % 250) * 3 AS x", "double(id div 250) * 12 AS y", "10.0D AS w", "10.0D AS h", "id % 2 = 0 AS glyph")
    # along a row boxes stand in pairs of two kinds, 3 apart, and pairs 5 further
    assert Y.dedupe_boxes(b.withColumn("x", F.expr("x + (box_id % 250 div 2) * 5"))).count() == 50_000


def test_body_size(spark):
    rnd = random.Random(8)
    rows = [(d, rnd.choice([8.0, 9.0, 10.0, 12.5, None])) for d in range(40) for _ in range(rnd.randint(1, 9))] + [(99, None)]
    got = {r["doc_id"]: r["fs"] for r in Y.body_font_size(spark.createDataFrame(rows, "doc_id long, fs double")).collect()}
    for d in {d for d, _ in rows}:
        sizes = sorted(f for k, f in rows if k == d and f is not None)
        assert got[d] == (statistics.median_high(sizes) if sizes else 10.0)


LABELLED = {
    "Date of Birth:": "dob", "D.O.B.": "dob", "D O B": "dob", "patient's date of birth": "dob", "DOBX": None, "NHS No.": "nhs", "NHS number *": "nhs", "Patient NHS No": "nhs", "NHS": "hospital", "Hospital number": "identifier",
    "Hospital no.": "identifier", "Hospital / NHS number": "identifier", "Unique patient identifier": "identifier", "MRN": "identifier", "Identifier (optional)": "identifier", "Surname": "surname", "Patient’s surname": "surname",
    "First name(s)": "forenames", "Forenames": "forenames", "Given names (optional, in full)": "forenames", "Full name of the patient": "patient_name", "Patient's full name": "patient_name", "Name of hospital": "hospital",
    "Hospital / Trust": "hospital", "NHS Trust": "hospital", "Hospital name / stamp": "hospital", "Trust/health board": "hospital", "Treating site": "hospital", "hospital car park": None, "Responsible health professional": "consultant", "Named oncologist": "consultant",
    "Job title": "title", "Gradeschool": None, "Name": "print_name", "Name (PRINT):": "print_name", "Name in block capitals": "print_name", "name of the dog": None, "Affix patient label here": "patient_label", "Patient ID / label": "patient_label", "": None, "Name" + " x" * 60: None,
}
HEADINGS = {
    "Statement of health professional": "professional", "1. Statement of patient": "patient", "2) Patient’s signature": "patient", "Patient details": "patient", "Responsible consultant:": "consultant", "Responsible clinicians": "consultant", "Section 3 interpreter": "interpreter",
    "Parental responsibility": "parent", "Confirmation of consent": "confirmation", "Witness": "witness", "To be completed by the nurse": "professional", "Partly": None, "The patient": None, "For the use of interpreters": "interpreter", "Person obtaining consent": "professional", "Part": None,
}


def test_labels_and_headings_by_words(spark):
    for table, fn in ((LABELLED, Y.classify_label), (HEADINGS, Y.section_heading)):
        got = {r["t"]: r["r"] for r in spark.createDataFrame([(t,) for t in table], "t string").select("t", fn(F.col("t")).alias("r")).collect()}
        assert got == table


NOTES = {
    "Patient: SMITH, John  MRN 1234567 NHS no. 943-476-5919 DOB 1/2/1950 Sex: m": ("SMITH", "John", dt.date(1950, 2, 1), "9434765919", "1234567", "M"),
    "Patient name : Mrs O'NEILL-Day, Ann (known as X) Age 40\nHospital No: ab12345.\nnhs number 9434765919, gender FEMALE": ("O'NEILL-Day", "Ann", None, "9434765919", "AB12345", "F"),
    "note: x\nDr BROWN, Sir Al\nUnit no #4444 D.O.B. 3 Sept 60": ("BROWN", "Al", dt.date(1960, 9, 3), "", "4444", ""),
    "Name: nobody\nJONES, Sue\nref 943 476 5919": ("JONES", "Sue", None, "9434765919", "", ""),
    "MRN: none MRN: ABCD12345 MRN AB1234 NHS 943 476 591 sex: unknown": ("", "", None, "", "AB1234", ""),
    "": ("", "", None, "", "", ""),
}


def test_details_by_labels(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(NOTES)], "note_id long, text string")
    got = {r["note_id"]: (r["surname"], r["forenames"], r["dob"], r["nhs"], r["mrn"], r["sex"]) for r in E.extract_identifiers(df, F.lit("2024-06-01").cast("date")).collect()}
    for k, (t, want) in enumerate(NOTES.items()):
        assert got[k] == want, t


REGIMENS = {
    "CAPOX-based treatment": True, "AC-based": True, "B-cell": False, "T-DM1": True, "X (CAPOX)": False, "Capox": False, "R and B": True, "Sandwich": False, "a - b": True, "PCV": True, "AB": False, "5-FU": False, "FEC75-T": True, "xCAPOX": False, "A1-": False, "A-1b": False, "AB-1b": True,
}


def test_regimens(spark):
    pattern = re.compile(r"\b[A-Z][A-Z0-9-]{2,}\b")
    got = {r["t"]: r["r"] for r in spark.createDataFrame([(t,) for t in REGIMENS], "t string").select("t", M.is_regimen(F.col("t")).alias("r")).collect()}
    assert got == REGIMENS
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ABx1- ") for _ in range(8)) for _ in range(500)]
    texts = [t for t in texts if " - " not in t]
    got = [r["r"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").orderBy("k").select(M.is_regimen(F.col("t")).alias("r")).collect()]
    assert got == [bool(pattern.search(t)) for t in texts]
