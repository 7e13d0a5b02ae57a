"""Packs of documents for people: values, readiness, presets; and catalogue search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_text, first_by, format_uk_date, nhs_format, nhs_valid
from .search import searched_text


def role_value(role: Column, has_nhs_box: Column) -> Column:
    """What a field of ``role`` holds, from columns surname, forenames, dob (date), nhs, mrn, c_name, c_role, c_site, c_consultant, c_consultant_role."""
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    have = lambda c: some(c) != ""
    last, dob, nhs, mrn = F.upper(some("surname")), F.coalesce(format_uk_date(F.col("dob")), F.lit("")), nhs_format(F.col("nhs")), some("mrn")
    lab = lambda on, k, v: F.when(on, F.concat(F.lit(k), v))
    ident = F.concat_ws("   ", lab(have("nhs"), "NHS ", nhs), lab(have("mrn"), "MRN ", mrn))
    name = F.array_join(F.filter(F.array(last, some("forenames")), lambda x: x != ""), ", ")
    label = F.concat_ws("\n", F.when(name != "", name), lab(dob != "", "DOB: ", dob), lab(have("nhs"), "NHS: ", nhs), lab(have("mrn"), "MRN: ", mrn))
    cases = {
        "surname": last, "forenames": some("forenames"), "patient_name": clean_text(F.concat_ws(" ", some("forenames"), last)), "dob": dob,
        "nhs": F.when(have("nhs"), nhs).when(have("mrn"), F.concat(F.lit("MRN "), mrn)).otherwise(""),
        "identifier": F.when(has_nhs_box, mrn).otherwise(ident), "patient_label": label, "hospital": some("c_site"),
        "consultant": F.when(have("c_consultant"), some("c_consultant")).otherwise(some("c_name")),
        "consultant_role": F.when(have("c_consultant"), some("c_consultant_role")).otherwise(some("c_role")),
        "clin_name": some("c_name"), "clin_role": some("c_role"),
    }
    return reduce(lambda a, kv: F.when(role == kv[0], kv[1]).otherwise(a), cases.items(), F.lit(""))


def fill_table(packs: DataFrame, fields: DataFrame, people: DataFrame) -> DataFrame:
    """pack_id, ord, doc_id, name, role, value of every field that gets one.

    packs: pack_id, ord, doc_id, person_id. fields: doc_id, name, role. people: person_id and the columns of ``role_value``.
    """
    box = fields.groupBy("doc_id").agg(F.bool_or(F.col("role") == "nhs").alias("has_nhs"))
    j = packs.join(fields.join(box, "doc_id"), "doc_id").join(people, "person_id")
    return j.select("pack_id", "ord", "doc_id", "name", "role", role_value(F.col("role"), F.col("has_nhs")).alias("value")).filter("value <> ''")


def readiness_checks(packs: DataFrame) -> DataFrame:
    """pack_id, errors, warnings. ``packs``: pack_id, n_docs, needs_sex, sex and the columns of ``role_value``."""
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    say = lambda tests: F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in tests])), "; ")
    errors = [
        (none("surname") & none("forenames"), "name is missing"), (F.col("dob").isNull(), "date of birth is missing or invalid"),
        (none("nhs") & none("mrn"), "NHS number or MRN is missing"), (none("c_name"), "clinician name is missing"),
        (F.col("n_docs") == 0, "no document is chosen"),
    ]
    warnings = [
        (~none("nhs") & ~nhs_valid(F.col("nhs")), "NHS number fails its check digit"), (none("c_site"), "site is blank"),
        (none("sex") & F.col("needs_sex"), "sex is not set"),
    ]
    return packs.select("pack_id", say(errors).alias("errors"), say(warnings).alias("warnings"))


def resolve_presets(items: list[dict], catalogue: DataFrame) -> DataFrame:
    """preset, item_ord, doc_id: the first document (by ord) that an item's patterns fit; doc_id is null where none does.

    Items are compiled to one array of tests, so the catalogue is read once, without a regex join.
    """
    tests = []
    for k, i in enumerate(items):
        c = (F.col("source") == i["source"]) & F.col("title").rlike(f"(?iu){i['title']}")
        if i.get("group"):
            c = c & F.coalesce(F.col("group"), F.lit("")).rlike(f"(?iu){i['group']}")
        tests.append(F.when(c, F.lit(k)))
    hits = catalogue.select("doc_id", "ord", F.explode(F.array_compact(F.array(*tests))).alias("k"))
    best = hits.groupBy("k").agg(F.min_by("doc_id", "ord").alias("doc_id"))
    all_ = catalogue.sparkSession.createDataFrame([(k, i["preset"], i["item_ord"]) for k, i in enumerate(items)], "k int, preset string, item_ord int")
    return all_.join(best, "k", "left").select("preset", "item_ord", "doc_id")


def add_to_pack(pack: DataFrame, more: DataFrame) -> DataFrame:
    """pack_id, doc_id, ord: ``more`` appended in order, documents already there skipped."""
    last = pack.groupBy("pack_id").agg(F.max("ord").alias("last"))
    fresh = first_by(more.join(pack, ["pack_id", "doc_id"], "left_anti"), ["pack_id", "doc_id"], ["ord"])
    nth = F.row_number().over(Window.partitionBy("pack_id").orderBy("ord", "doc_id"))
    new = fresh.withColumn("nth", nth).join(last, "pack_id", "left").withColumn("ord", (F.coalesce("last", F.lit(0)) + F.col("nth")).cast("int"))
    return pack.select("pack_id", "doc_id", "ord").unionByName(new.select("pack_id", "doc_id", "ord"))


def addition_counts(pack: DataFrame, more: DataFrame) -> DataFrame:
    """pack_id, added, already: what ``add_to_pack`` makes of ``more``. Of a document that ``more`` names twice the first is added, the second is in the pack by then."""
    have = pack.select("pack_id", "doc_id").distinct().withColumn("there", F.lit(True))
    each = more.groupBy("pack_id", "doc_id").agg(F.count("*").alias("n")).join(have, ["pack_id", "doc_id"], "left")
    return each.groupBy("pack_id").agg(F.count_if(F.col("there").isNull()).alias("added"), F.sum(F.col("n") - F.col("there").isNull().cast("int")).alias("already"))


def pack_needs_sex(packs: DataFrame, needs: DataFrame) -> DataFrame:
    """pack_id, needs_sex: one of the pack's forms needs the sex. ``packs``: pack_id, doc_id. ``needs``: doc_id, needs_sex (see ``rules.sex_needed``); leaflets have none."""
    return packs.join(needs, "doc_id", "left").groupBy("pack_id").agg(F.coalesce(F.bool_or("needs_sex"), F.lit(False)).alias("needs_sex"))


def validate_saved_sets(saved: DataFrame, catalogue: DataFrame) -> DataFrame:
    """set_id, n_kept, n_lost: members that the catalogue still has."""
    have = catalogue.select("doc_id", F.lit(True).alias("there")).distinct()
    return saved.join(have, "doc_id", "left").groupBy("set_id").agg(F.count_if(F.col("there")).alias("n_kept"), F.count_if(F.col("there").isNull()).alias("n_lost"))


def pack_manifest(packs: DataFrame, forms: DataFrame) -> DataFrame:
    """pack_id, ord, title, problem: what has to be filled by hand."""
    problem = F.when(~F.col("fillable"), "fill by hand").when(F.size("missing") > 0, F.concat(F.lit("missing: "), F.array_join("missing", ", "))).otherwise("")
    return packs.join(forms, "doc_id").select("pack_id", "ord", "title", problem.alias("problem"))


def search_all_terms(df: DataFrame, q: str) -> DataFrame:
    """Rows whose title and group hold every word of ``q``: one pass over them. For many searches of one table see ``search.build_index``."""
    return df.filter(reduce(lambda a, t: a & F.contains(searched_text(), F.lit(t)), q.lower().split(), F.lit(True)))


def group_counts(df: DataFrame, picked: DataFrame) -> DataFrame:
    """group, n, n_picked, first: in order of first appearance."""
    p = picked.select("doc_id", F.lit(True).alias("p")).distinct()
    return df.join(p, "doc_id", "left").groupBy("group").agg(F.count("*").alias("n"), F.count_if("p").alias("n_picked"), F.min("ord").alias("first"))


def initial_bucket(title: Column) -> Column:
    c = F.upper(F.substring(title, 1, 1))
    return F.when(c.rlike("^[A-Z]$"), c).otherwise("0–9")


def document_items(forms: DataFrame, leaflets: DataFrame) -> DataFrame:
    """kind, doc_id, title, meta: one view of both."""
    f = forms.select(F.lit("form").alias("kind"), "doc_id", "title", F.concat_ws(" · ", "group", "version").alias("meta"))
    return f.unionByName(leaflets.select(F.lit("leaflet").alias("kind"), "doc_id", "title", F.concat_ws(" · ", "source", "review").alias("meta")))
