"""Ordered rules as data: the first rule that fits decides."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Tests are regular expressions, case-insensitive; those that are None are not asked. A rule without a test never fires."""

    id: str
    tick: str
    note: str = ""
    match: str | None = None
    prompt: str | None = None
    option: str | None = None
    section: str | None = None


def rule_test(r: Rule) -> Column:
    """``match`` looks at prompt and option together (else the line), or at the option alone."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    has = lambda c, p: c.rlike(f"(?iu){p}")
    both = F.btrim(F.concat_ws(" ", "prompt", "option"))
    tests = []
    if r.match is not None:
        tests.append(has(F.when(both != "", both).otherwise(text("line")), r.match) | has(text("option"), r.match))
    if r.prompt is not None:
        tests.append(has(F.when(text("prompt") != "", text("prompt")).otherwise(text("line")), r.prompt))
    if r.option is not None:
        tests.append(has(text("option"), r.option))
    if r.section is not None:
        tests.append(has(text("section"), r.section))
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(False)


def first_rule(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds rule (null where none fits), rule_tick, rule_note, by_section (the rule tests the section alone).

    The rules become one CASE at planning time: no join, patterns compiled once.
    """
    at = reduce(lambda a, kr: F.when(rule_test(kr[1]), F.lit(kr[0])).otherwise(a), [*enumerate(rules)][::-1], F.lit(None).cast("int"))
    df = df.withColumn("__at", at)
    pick = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("__at"))
    only = [r.section is not None and r.match is r.prompt is r.option is None for r in rules]
    return df.withColumns({
        "rule": pick([r.id for r in rules], "string"), "rule_tick": pick([r.tick for r in rules], "string"),
        "rule_note": pick([r.note for r in rules], "string"), "by_section": F.coalesce(pick(only, "boolean"), F.lit(False)),
    }).drop("__at")


def rule_coverage(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule, n_first, n_any: rows that each rule decides, and rows that it would fit."""
    any_ = F.array_compact(F.array(*[F.when(rule_test(r), F.lit(r.id)) for r in rules]))
    hit = first_rule(df, rules).select(F.coalesce("rule", F.lit("")).alias("first"), F.explode(any_).alias("rule"))
    return hit.groupBy("rule").agg(F.sum((F.col("first") == F.col("rule")).cast("long")).alias("n_first"), F.count("*").alias("n_any"))


def default_action(df: DataFrame) -> Column:
    """Action before the sex is known: always, never, female, male, known, review."""
    words = F.size(F.filter(F.split(F.coalesce("option", "line", F.lit("")), r"\s+"), lambda w: w != ""))
    free = ~F.coalesce(F.col("matrix"), F.lit(False)) & F.col("group").isNull()
    base = F.when(F.col("rule").isNotNull(), F.col("rule_tick")).when(free & (words >= 5), "always").otherwise("review")
    grouped = F.when(F.col("group").isNotNull() & F.col("by_section") & (base == "always"), "review").otherwise(base)
    other = ((grouped == "female") & (F.col("sex") == "M")) | ((grouped == "male") & (F.col("sex") == "F"))
    return F.when(F.coalesce(F.col("matrix"), F.lit(False)) & (grouped != "never") & ~other, "review").otherwise(grouped)


def resolve(df: DataFrame) -> DataFrame:
    """Adds action, on, why from default_action and the column sex (F, M or ''). ``known`` is on once the sex is set, whichever it is."""
    df = df.withColumn("action", default_action(df))
    mine = ((F.col("action") == "female") & (F.col("sex") == "F")) | ((F.col("action") == "male") & (F.col("sex") == "M"))
    sexed = F.col("action").isin("female", "male", "known")
    mine = mine | ((F.col("action") == "known") & F.col("sex").isin("F", "M"))
    return df.withColumn("on", (F.col("action") == "always") | mine).withColumn(
        "why", F.when(sexed & (F.col("sex") == ""), "choose by sex").when(sexed & ~mine, "other sex").when(F.col("action") == "review", "review").otherwise(F.coalesce("rule_note", F.lit("")))
    )


def exclusive_group(df: DataFrame, form: list[str], order: str) -> DataFrame:
    """Of the boxes of a group only the first that is on stays on."""
    w = Window.partitionBy(*form, "group").orderBy(order)
    nth = F.sum(F.col("on").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("on", F.col("on") & (F.col("group").isNull() | (nth == 1)))


def tick_key(df: DataFrame) -> Column:
    return F.when(F.col("kind") == "radio", F.concat_ws("#", "name", "value")).otherwise(F.col("name"))


def tick_label(df: DataFrame) -> Column:
    prompt = F.regexp_replace(F.coalesce("prompt", F.lit("")), r"[:\s]+$", "")
    both = F.array_join(F.filter(F.array(prompt, F.coalesce("option", F.lit(""))), lambda x: x != ""), " — ")
    return F.when(both != "", both).otherwise(F.coalesce("line", "name"))


def apply_overrides(defaults: DataFrame, overrides: DataFrame, key: list[str]) -> DataFrame:
    """``on`` replaced by the override's where there is one (the last by ord); changed tells where that differs."""
    last = overrides.groupBy(*key).agg(F.max_by("on", "ord").alias("__on"))
    out = defaults.join(last, key, "left")
    return out.withColumn("changed", F.col("__on").isNotNull() & (F.col("__on") != F.col("on"))).withColumn("on", F.coalesce("__on", "on")).drop("__on")


def tick_summary(df: DataFrame, form: list[str]) -> DataFrame:
    review = ~F.col("on") & (F.col("action") == "review") & ~F.col("changed")
    return df.groupBy(*form).agg(F.count_if("on").alias("n_on"), F.count_if(review).alias("n_review"), F.count("*").alias("n_total"))


def bulk_tick_review(df: DataFrame, key: list[str]) -> DataFrame:
    """Overrides that tick what is off, to review, and in no group or grid."""
    return df.filter(~F.col("on") & (F.col("action") == "review") & F.col("group").isNull() & ~F.coalesce(F.col("matrix"), F.lit(False))).select(*key, F.lit(True).alias("on"))


def exclusive_override(df: DataFrame, turned_on: DataFrame, form: list[str]) -> DataFrame:
    """Overrides for boxes turned on, and off for the others of their groups. Both have form, key; df has group."""
    of = df.select(*form, "key", "group")
    mine = turned_on.join(of, [*form, "key"])
    rest = of.join(mine.filter(F.col("group").isNotNull()).select(*form, "group").distinct(), [*form, "group"], "left_semi").join(mine.select(*form, "key"), [*form, "key"], "left_anti")
    return mine.select(*form, "key", F.lit(True).alias("on")).unionByName(rest.select(*form, "key", F.lit(False).alias("on")))


def section_breaks(df: DataFrame, form: list[str], order: str) -> DataFrame:
    """Adds heading: the page or the first part of the section changes here."""
    part = F.element_at(F.split(F.coalesce("section", F.lit("")), " / "), 1)
    w = Window.partitionBy(*form).orderBy(order)
    now, before = F.struct("page", part.alias("p")), F.lag(F.struct("page", part.alias("p"))).over(w)
    return df.withColumn("heading", ~now.eqNullSafe(before))


def radio_choice(df: DataFrame, form: list[str], order: str) -> DataFrame:
    return df.filter("on AND kind = 'radio'").groupBy(*form, "name").agg(F.min_by("value", order).alias("value"))


def sex_needed(df: DataFrame, form: list[str]) -> DataFrame:
    """form, needs_sex: some box of the form is decided by the sex and left open without it. ``df`` has what ``default_action`` reads; rows of any sex count."""
    df = df.withColumn("sex", F.lit(""))
    return df.groupBy(*form).agg(F.bool_or(default_action(df).isin("female", "male", "known")).alias("needs_sex"))
