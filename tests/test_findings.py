"""Queries against their SQL on small tables that the given ones don't show: long keys, shared addresses, all links."""

import duckdb
import pytest
from test_catalogue import QUERIES, SQL, plain


def same_as_sql(name, spark, folder):
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.name[:-8]} AS SELECT * FROM '{f}/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(SQL[name])
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want
    return got


@pytest.fixture
def long_keys(spark, tmp_path):
    rows = [(k, f"Customer#{k:09d}", "BUILDING") for k in (7, 8, 99_999, 100_000, 100_001, 899_998, 1_000_000, 1_000_001, 1_000_002, 5_399_999)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    return tmp_path


def test_numbers_of_long_keys_are_whole(spark, long_keys):
    assert len(same_as_sql("id_extract", spark, long_keys)) == 10


def test_forms_are_filled_with_whole_numbers(spark, long_keys):
    assert same_as_sql("fill_table", spark, long_keys)


def test_arriving_notes_keep_whole_numbers(spark, long_keys):
    assert len(same_as_sql("stream_extract", spark, long_keys)) == 10


def test_pages_of_one_address_are_merged_each_for_itself(spark, tmp_path):
    rows = [(k, f"http{'s' * (k % 2)}://x.org/{'A' if k % 3 else 'a'}") for k in range(1, 14)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert len(same_as_sql("url_merge", spark, tmp_path)) == 12


def test_links_of_all_words_are_kept(spark, tmp_path):
    html = "<h1>One</h1><a href='/de/1'>the school</a><a href='/2'>2</a><a href='3'>free</a>"
    spark.createDataFrame([(1, "https://x.org/", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert len(same_as_sql("page_links", spark, tmp_path)) == 3


def plan_of(spark, column):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("x",)], "t string").select(column(F.col("t")))
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_label_is_made_into_words_once(spark):
    from ledgerleaf.operators.layout import classify_label

    assert plan_of(spark, classify_label).count("regexp_replace") <= 20


def test_a_heading_is_made_into_words_once(spark):
    from ledgerleaf.operators.layout import section_heading

    assert plan_of(spark, section_heading).count("regexp_replace") <= 20


def test_texts_are_cut_into_words_in_runs_of_bounded_size():
    import pyarrow as pa

    from ledgerleaf.operators import terms

    texts = ["é" * n if n else None for n in (0, 3, 40, 5, 0, 7, 200, 1, 1, 1)] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"])
    parts = [*terms.runs(batch, 100)]
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts and [k for p in parts for k in p.column(0).to_pylist()] == [*range(len(texts))]
    assert all(sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 100 + 400 for p in parts)


def test_words_are_not_passed_on_by_the_terms_beside_entities(spark):
    from pyspark.sql import functions as F

    from ledgerleaf.llm import pii

    text = "write to alpha beta a.b@x.org gamma delta"
    df = spark.createDataFrame([(1, text), (2, text), (3, text + " more"), (4, text + " other"), (5, "alpha epsilon")], "id long, text string")
    rows = df.select("id", F.xxhash64("text").alias("at"), "text")
    told = pii.disclosures(pii.entities(pii.base_spans(rows, "text", around=True), 8), rows, 3, 0.0)
    assert "LeftSemi, (t#" not in told._jdf.queryExecution().optimizedPlan().toString()
    # copies count once: three texts have the entity, one more has alpha
    got = {r["t"]: r["removed"] for r in told.collect()}
    assert got["beta"] and not got["alpha"]


def test_notes_of_a_small_file_are_read_by_all_cores(spark, sf):
    from ledgerleaf.plans import records

    assert records._notes(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_headings_and_labels_of_a_small_file_are_told_by_all_cores(spark, sf):
    for name in ("layout_headings", "layout_asked"):
        assert QUERIES[name](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name


def test_items_are_sorted_without_structs_in_structs(spark, sf):
    for name in ("layout_lines", "layout_phrases"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution()
        assert "array_sort" not in plan.optimizedPlan().toString() and plan.executedPlan().toString().count("Exchange") == 1, name


def test_postings_of_a_small_catalogue_are_made_by_all_cores(spark, monkeypatch):
    from ledgerleaf.operators import search

    made = {}
    monkeypatch.setattr(search.versions, "commit_tables", lambda spark, tables, root, note: made.update(tables))
    search.build_index(spark.createDataFrame([(1, "a title", "g")], "doc_id long, title string, `group` string").coalesce(1), "")
    assert made["postings"][0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_no_window_holds_the_words_of_a_line_or_page(spark, sf):
    """A window that buffers more than 4096 rows needs memory that a sort or an aggregate above it, still being filled, doesn't give back."""
    for name in ("layout_lines", "layout_phrases"):
        windows = [x for x in QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines() if " Window [" in x]
        assert windows and not any(f"{c}#" in x for x in windows for c in ("str", "x0", "x1", "i")), name


def test_more_text_makes_more_tasks(spark, sf, monkeypatch):
    from ledgerleaf.sources import shared

    monkeypatch.setattr(shared, "TASK_BYTES", 1000, raising=False)
    assert QUERIES["layout_phrases"](spark, sf).rdd.getNumPartitions() > 100


def test_values_of_a_fold_over_arrays_of_any_length(spark):
    from pyspark.sql import functions as F

    from ledgerleaf.functions.ordered import running

    df = spark.range(200).select("id", F.expr("if(id = 0, cast(array() AS array<bigint>), sequence(1, id))").alias("a"))
    got = df.select("id", running(F.col("a"), F.lit(0).cast("long"), lambda s, x: (s + x, s), "bigint").alias("v")).collect()
    assert all(r["v"] == [k * (k + 1) // 2 for k in range(r["id"])] for r in got)
