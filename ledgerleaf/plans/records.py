"""Queries over identifiers, packs and catalogue search; notes come from ``customer`` and ``orders``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import extract as E
from ..operators import pack as P
from ..operators import rules as R
from ..operators import search as S
from ..sources.shared import shared_folder, spread
from . import ruling
from .tables import table

AS_OF = "DATE '2024-06-01'"


def nhs_audit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") * 7919 + 400_000_000).cast("string"), 10, "9").alias("nhs"))
    return o.select("o_orderkey", C.nhs_valid(F.col("nhs")).alias("valid"), C.nhs_format(F.col("nhs")).alias("shown"))


def _dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    k = F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, F.date_format("d", "dd/MM/yyyy")).when(k == 1, F.date_format("d", "d-MMM-yy")).when(k == 2, F.date_format("d", "yyyy-MM-dd"))
        .when(k == 3, F.date_format("d", "d MMMM yyyy")).when(k == 4, F.concat(F.lit("31/02/"), F.year("d"))).otherwise(F.lit(""))
    )
    return o.withColumn("dob_text", text)


def date_parse(spark, sf_dir):
    d = C.parse_uk_date(F.col("dob_text"), F.expr(AS_OF))
    return _dates(spark, sf_dir).withColumn("parsed", d).select("o_orderkey", "parsed", C.age_on(F.col("parsed"), F.expr(AS_OF)).cast("int").alias("age"), C.format_uk_date(F.col("parsed")).alias("shown"))


def date_audit(spark, sf_dir):
    d = _dates(spark, sf_dir).withColumn("dob", C.parse_uk_date(F.col("dob_text"), F.expr(AS_OF))).withColumn("nhs", F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 5 == 1, "943 476 5919").when(F.col("o_orderkey") % 5 == 2, "9434765918").otherwise("12345"))
    return E.identifier_audit(d, F.expr(AS_OF))


def _notes(spark, sf_dir):
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    k, num = F.col("c_custkey"), F.regexp_extract("c_name", "([0-9]+)", 1)
    word = F.translate(num, "0123456789", "abcdefghij")
    text = F.concat(
        F.when(k % 3 == 0, F.concat(F.lit("Patient: "), F.upper(word), F.lit(", Mr Jo (known as X)  MRN: AB"), F.format_string("%06d", k), F.lit("\n")))
        .when(k % 3 == 1, F.concat(F.upper(word), F.lit(", Ann\nhospital no. "), F.format_string("%05d", k), F.lit("\n"))).otherwise(F.lit("no name here\n")),
        F.when(k % 4 == 0, F.lit("NHS number: 943 476 5919\n")).when(k % 4 == 1, F.lit("ref 943 476 5919 x\n")).when(k % 4 == 2, F.lit("ref 943 476 5918 x\n")).otherwise(F.lit("")),
        F.when(k % 5 == 0, F.lit("DOB: 1-Sep-1952\n")).when(k % 5 == 1, F.lit("Date of birth 03/04/1960\n")).when(k % 5 == 2, F.lit("DOB: 31/02/1960\n")).otherwise(F.lit("")),
        F.when(k % 2 == 0, F.lit("Sex: Female")).otherwise(F.lit("gender m")),
    )
    return c.select(F.col("c_custkey").alias("note_id"), F.col("c_mktsegment").alias("source"), text.alias("text"))


def id_extract(spark, sf_dir):
    return E.extract_identifiers(_notes(spark, sf_dir), F.expr(AS_OF)).select("note_id", "surname", "forenames", "dob", "nhs", "mrn", "sex")


def id_completeness(spark, sf_dir):
    return E.completeness(E.extract_identifiers(_notes(spark, sf_dir), F.expr(AS_OF)), "source")


def id_missing(spark, sf_dir):
    return E.extract_identifiers(_notes(spark, sf_dir), F.expr(AS_OF)).select("note_id", E.missing_details().alias("missing"))


ROLES = ("surname", "dob", "nhs", "identifier", "patient_label", "hospital", "consultant", "clin_role")


def _people(spark, sf_dir):
    ids = E.extract_identifiers(_notes(spark, sf_dir), F.expr(AS_OF)).withColumnRenamed("note_id", "person_id")
    clin = {"c_name": "Dr Who", "c_role": "Registrar", "c_site": "", "c_consultant": "Prof Y", "c_consultant_role": "Consultant"}
    return ids.withColumns({k: F.lit(v) for k, v in clin.items()})


def fill_table(spark, sf_dir):
    packs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pack_id"), F.lit(1).alias("ord"), (F.col("c_custkey") % 2).alias("doc_id"), F.col("c_custkey").alias("person_id"))
    fields = spark.createDataFrame([(d, f"{r}{d}", r) for d in (0, 1) for r in ROLES if d == 0 or r != "nhs"], "doc_id long, name string, role string")
    return P.fill_table(packs, fields, _people(spark, sf_dir)).select("pack_id", "name", "value")


def readiness(spark, sf_dir):
    """Packs of two forms of tick boxes each; every third person's sex is not known, and counts where a form's boxes ask for it."""
    p = _people(spark, sf_dir).withColumnRenamed("person_id", "pack_id").withColumn("n_docs", F.col("pack_id") % 7)
    p = p.withColumn("sex", F.when(F.col("pack_id") % 3 == 0, "").otherwise(F.col("sex")))
    forms = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pack_id"), F.explode(F.array(F.col("c_custkey") % 5, F.col("c_custkey") % 1000)).alias("doc_id"))
    needs = R.sex_needed(ruling._ticks(spark, sf_dir).withColumn("doc_id", F.floor(F.col("p_partkey") / 2)), ["doc_id"])
    return P.readiness_checks(p.join(P.pack_needs_sex(forms, needs), "pack_id", "left"))


def _catalogue(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_partkey").cast("int").alias("ord"), F.lit("shop").alias("source"), F.col("p_name").alias("title"), F.col("p_brand").alias("group"))


ITEMS = [
    {"preset": "a", "item_ord": 0, "source": "shop", "title": "^g"}, {"preset": "a", "item_ord": 1, "source": "shop", "title": "e", "group": "#2"},
    {"preset": "b", "item_ord": 0, "source": "shop", "title": "no such title"}, {"preset": "b", "item_ord": 1, "source": "shop", "title": "s$"},
]


def preset_resolve(spark, sf_dir):
    return P.resolve_presets(ITEMS, _catalogue(spark, sf_dir))


def _pack(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2")
    return li.groupBy(F.col("l_suppkey").alias("pack_id"), F.col("l_partkey").alias("doc_id")).agg(F.min("l_orderkey").cast("int").alias("ord"))


def pack_add(spark, sf_dir):
    more = table(spark, sf_dir, "lineitem").filter("l_linenumber > 2").select(F.col("l_suppkey").alias("pack_id"), F.col("l_partkey").alias("doc_id"), F.col("l_orderkey").cast("int").alias("ord"))
    return P.add_to_pack(_pack(spark, sf_dir), more)


def pack_added(spark, sf_dir):
    """Of all lines beyond the second: how many documents they add to the packs, and how many are in there already."""
    more = table(spark, sf_dir, "lineitem").filter("l_linenumber > 2").select(F.col("l_suppkey").alias("pack_id"), F.col("l_partkey").alias("doc_id"))
    return P.addition_counts(_pack(spark, sf_dir), more)


def saved_sets(spark, sf_dir):
    saved = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("doc_id"))
    return P.validate_saved_sets(saved, _catalogue(spark, sf_dir).filter("doc_id % 3 <> 0"))


def pack_manifest(spark, sf_dir):
    forms = _catalogue(spark, sf_dir).select("doc_id", "title", (F.col("doc_id") % 4 != 0).alias("fillable"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("dob"), F.lit("nhs"))).otherwise(F.array().cast("array<string>")).alias("missing"))
    return P.pack_manifest(_pack(spark, sf_dir), forms)


def doc_search(spark, sf_dir):
    return P.search_all_terms(_catalogue(spark, sf_dir), "E brand#1 s").select("doc_id", "title", P.initial_bucket(F.col("title")).alias("bucket"))


def doc_search_index(spark, sf_dir):
    """The same over a stored index of grams, of two searches; the second has a word of two letters and one that only groups hold."""
    index = S.build_index(_catalogue(spark, sf_dir), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    both = [S.search(spark, index, q).select(F.lit(q).alias("q"), "doc_id", "title") for q in ("E brand#1 s", "ee #23")]
    return both[0].unionByName(both[1])


def doc_group_counts(spark, sf_dir):
    c = _catalogue(spark, sf_dir)
    return P.group_counts(c, c.filter("doc_id % 6 = 0"))


def doc_items(spark, sf_dir):
    c = _catalogue(spark, sf_dir)
    forms = c.filter("doc_id % 2 = 0").withColumn("version", F.when(F.col("doc_id") % 4 == 0, "2"))
    return P.document_items(forms, c.filter("doc_id % 2 = 1").withColumn("review", F.lit("2025")))


_CHECK = " + ".join(f"cast(substr(nhs, {i + 1}, 1) AS INT) * {10 - i}" for i in range(9))
_NOTE = f"""n AS (SELECT c_custkey AS k, c_mktsegment AS source, upper(translate(regexp_extract(c_name, '[0-9]+'), '0123456789', 'abcdefghij')) AS w FROM customer),
i AS (SELECT k AS note_id, source, CASE WHEN k % 3 < 2 THEN w ELSE '' END AS surname, CASE k % 3 WHEN 0 THEN 'Jo' WHEN 1 THEN 'Ann' ELSE '' END AS forenames,
  CASE k % 5 WHEN 0 THEN DATE '1952-09-01' WHEN 1 THEN DATE '1960-04-03' END AS dob, CASE WHEN k % 4 < 2 THEN '9434765919' ELSE '' END AS nhs,
  CASE k % 3 WHEN 0 THEN 'AB' || right('000000' || k, greatest(6, length(k::VARCHAR))) WHEN 1 THEN right('00000' || k, greatest(5, length(k::VARCHAR))) ELSE '' END AS mrn, CASE WHEN k % 2 = 0 THEN 'F' ELSE 'M' END AS sex FROM n)"""
_SHOWN = "(substr(nhs, 1, 3) || ' ' || substr(nhs, 4, 3) || ' ' || substr(nhs, 7, 4))"
_D = "coalesce(strftime(dob, '%d/%m/%Y'), '')"
_VALUES = {
    "surname": "surname", "dob": _D, "nhs": f"CASE WHEN nhs <> '' THEN {_SHOWN} WHEN mrn <> '' THEN 'MRN ' || mrn ELSE '' END",
    "identifier0": "mrn", "identifier1": f"concat_ws('   ', CASE WHEN nhs <> '' THEN 'NHS ' || {_SHOWN} END, CASE WHEN mrn <> '' THEN 'MRN ' || mrn END)",
    "patient_label": f"concat_ws(chr(10), CASE WHEN surname <> '' THEN surname || ', ' || forenames END, CASE WHEN {_D} <> '' THEN 'DOB: ' || {_D} END, CASE WHEN nhs <> '' THEN 'NHS: ' || {_SHOWN} END, CASE WHEN mrn <> '' THEN 'MRN: ' || mrn END)",
    "hospital": "''", "consultant": "'Prof Y'", "clin_role": "'Registrar'",
}
_FILL = " UNION ALL ".join(f"SELECT note_id AS pack_id, '{r}{d}' AS name, {_VALUES.get(r, _VALUES.get(f'{r}{d}'))} AS value FROM i WHERE note_id % 2 = {d}" for d in (0, 1) for r in ROLES if d == 0 or r != "nhs")
_DATE = f"""d AS (SELECT o_orderkey, cast(o_orderdate AS DATE) AS d FROM orders), p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN d END AS parsed FROM d)"""
_AGE = f"cast(date_part('year', {AS_OF}) - date_part('year', parsed) - CASE WHEN strftime({AS_OF}, '%m%d') < strftime(parsed, '%m%d') THEN 1 ELSE 0 END AS INT)"

QUERIES = {f.__name__: f for f in (
    nhs_audit, date_parse, date_audit, id_extract, id_completeness, id_missing, fill_table, readiness, preset_resolve, pack_add, pack_added, saved_sets, pack_manifest, doc_search, doc_search_index, doc_group_counts, doc_items,
)}
ORACLE = {
    "nhs_audit": f"SELECT o_orderkey, (11 - ({_CHECK}) % 11) % 11 = cast(substr(nhs, 10, 1) AS INT) AS valid, {_SHOWN} AS shown FROM (SELECT o_orderkey, lpad(cast(o_orderkey * 7919 + 400000000 AS VARCHAR), 10, '9') AS nhs FROM orders)",
    "date_parse": f"WITH {_DATE} SELECT o_orderkey, parsed, {_AGE} AS age, strftime(parsed, '%d/%m/%Y') AS shown FROM p",
    "date_audit": f"""SELECT CASE o_orderkey % 6 WHEN 5 THEN 'missing' WHEN 4 THEN 'bad' ELSE 'ok' END AS dob_status,
        CASE o_orderkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'valid' WHEN 2 THEN 'check digit' ELSE 'length' END AS nhs_status, count(*) AS n FROM orders GROUP BY ALL""",
    "id_extract": f"WITH {_NOTE} SELECT note_id, surname, forenames, dob, nhs, mrn, sex FROM i",
    "id_completeness": f"""WITH {_NOTE} SELECT source, count(*) AS n, avg((surname <> '')::INT) AS share_name, avg((dob IS NOT NULL)::INT) AS share_dob, avg((nhs <> '')::INT) AS share_nhs, avg((mrn <> '')::INT) AS share_mrn,
        count(*) FILTER (surname <> '' AND dob IS NOT NULL AND nhs <> '' AND mrn <> '') AS n_complete FROM i GROUP BY source""",
    "id_missing": f"""WITH {_NOTE} SELECT note_id, concat_ws(', ', CASE WHEN surname = '' THEN 'name' END, CASE WHEN dob IS NULL THEN 'date of birth' END, CASE WHEN nhs = '' THEN 'NHS number' END, CASE WHEN mrn = '' THEN 'MRN' END) AS missing FROM i""",
    "fill_table": f"WITH {_NOTE} SELECT * FROM ({_FILL}) WHERE value <> ''",
    "readiness": f"""WITH {_NOTE}, s AS (SELECT p_partkey // 2 AS doc_id, bool_or(why = 'choose by sex') AS needs FROM ({ruling.ORACLE['tick_defaults']}) GROUP BY 1),
        w AS (SELECT note_id, coalesce(bool_or(s.needs), false) AS needs FROM i LEFT JOIN s ON s.doc_id IN (note_id % 5, note_id % 1000) GROUP BY 1)
        SELECT note_id AS pack_id, concat_ws('; ', CASE WHEN surname = '' THEN 'name is missing' END, CASE WHEN dob IS NULL THEN 'date of birth is missing or invalid' END,
        CASE WHEN nhs = '' AND mrn = '' THEN 'NHS number or MRN is missing' END, CASE WHEN note_id % 7 = 0 THEN 'no document is chosen' END) AS errors,
        CASE WHEN needs AND note_id % 3 = 0 THEN 'site is blank; sex is not set' ELSE 'site is blank' END AS warnings FROM i JOIN w USING (note_id)""",
    "preset_resolve": """SELECT 'a' AS preset, 0 AS item_ord, (SELECT min(p_partkey) FROM part WHERE p_name ILIKE 'g%') AS doc_id
        UNION ALL SELECT 'a', 1, (SELECT min(p_partkey) FROM part WHERE p_name ILIKE '%e%' AND p_brand LIKE '%#2%') UNION ALL SELECT 'b', 0, NULL
        UNION ALL SELECT 'b', 1, (SELECT min(p_partkey) FROM part WHERE p_name ILIKE '%s')""",
    "pack_add": """WITH p AS (SELECT l_suppkey AS pack_id, l_partkey AS doc_id, cast(min(l_orderkey) AS INT) AS ord FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL),
        m AS (SELECT l_suppkey AS pack_id, l_partkey AS doc_id, min(l_orderkey) AS ord FROM lineitem WHERE l_linenumber > 2 GROUP BY ALL),
        f AS (SELECT m.* FROM m ANTI JOIN p ON m.pack_id = p.pack_id AND m.doc_id = p.doc_id)
        SELECT * FROM p UNION ALL SELECT f.pack_id, doc_id, cast(coalesce(l.last, 0) + row_number() OVER (PARTITION BY f.pack_id ORDER BY ord, doc_id) AS INT) FROM f LEFT JOIN (SELECT pack_id, max(ord) AS last FROM p GROUP BY 1) l ON l.pack_id = f.pack_id""",
    "pack_added": """WITH p AS (SELECT DISTINCT l_suppkey AS pack_id, l_partkey AS doc_id FROM lineitem WHERE l_linenumber <= 2),
        m AS (SELECT l_suppkey AS pack_id, l_partkey AS doc_id, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY ALL)
        SELECT m.pack_id, count(*) FILTER (p.doc_id IS NULL) AS added, cast(sum(n) - count(*) FILTER (p.doc_id IS NULL) AS BIGINT) AS already FROM m LEFT JOIN p ON m.pack_id = p.pack_id AND m.doc_id = p.doc_id GROUP BY 1""",
    "saved_sets": "SELECT l_suppkey AS set_id, count(*) FILTER (l_partkey % 3 <> 0) AS n_kept, count(*) FILTER (l_partkey % 3 = 0) AS n_lost FROM lineitem GROUP BY 1",
    "pack_manifest": """WITH p AS (SELECT l_suppkey AS pack_id, l_partkey AS doc_id, cast(min(l_orderkey) AS INT) AS ord FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL)
        SELECT pack_id, ord, p_name AS title, CASE WHEN doc_id % 4 = 0 THEN 'fill by hand' WHEN doc_id % 3 = 0 THEN 'missing: dob, nhs' ELSE '' END AS problem FROM p JOIN part ON doc_id = p_partkey""",
    "doc_search": """SELECT p_partkey AS doc_id, p_name AS title, CASE WHEN regexp_matches(upper(substr(p_name, 1, 1)), '^[A-Z]$') THEN upper(substr(p_name, 1, 1)) ELSE '0–9' END AS bucket FROM part
        WHERE contains(lower(p_name || ' ' || p_brand), 'e') AND contains(lower(p_name || ' ' || p_brand), 'brand#1') AND contains(lower(p_name || ' ' || p_brand), 's')""",
    "doc_search_index": """SELECT 'E brand#1 s' AS q, p_partkey AS doc_id, p_name AS title FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'e') AND contains(lower(p_brand), 'brand#1') AND contains(lower(p_name || ' ' || p_brand), 's')
        UNION ALL SELECT 'ee #23', p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'ee') AND contains(lower(p_brand), '#23')""",
    "doc_group_counts": "SELECT p_brand AS \"group\", count(*) AS n, count(*) FILTER (p_partkey % 6 = 0) AS n_picked, cast(min(p_partkey) AS INT) AS first FROM part GROUP BY 1",
    "doc_items": "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'form' ELSE 'leaflet' END AS kind, p_partkey AS doc_id, p_name AS title, CASE WHEN p_partkey % 4 = 0 THEN p_brand || ' · 2' WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'shop · 2025' END AS meta FROM part",
}
