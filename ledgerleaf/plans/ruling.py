"""Queries over the ordered rules; tick rows come from ``lineitem`` and ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from .tables import table

RULES = [
    R.Rule("r1", "never", "not used", match="promo"),
    R.Rule("r2", "female", "women only", prompt="^standard", option="[aeiou]d"),
    R.Rule("r3", "male", "men only", prompt="^small"),
    R.Rule("r4", "always", "by brand", section="brand#1"),
    R.Rule("r5", "always", "steel", match="steel"),
    R.Rule("none", "always", "no test"),
    R.Rule("r6", "review", "look", option="[xyz]"),
    R.Rule("r7", "known", "everyone", section="brand#2"),
]


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("option"), F.col("p_type").alias("prompt"), F.col("p_brand").alias("section"), F.lit("").alias("line"), "p_size")


def rule_first(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    # rules read the part alone, so they are decided once a part and then joined
    return li.join(R.first_rule(_part(spark, sf_dir), RULES).select("p_partkey", "rule", "rule_tick"), "p_partkey").select("l_orderkey", "l_linenumber", "rule", "rule_tick")


def rule_coverage(spark, sf_dir):
    return R.rule_coverage(_part(spark, sf_dir), RULES)


def _ticks(spark, sf_dir):
    sexes = F.explode(F.array(F.lit("F"), F.lit("M"), F.lit("")))
    p = R.first_rule(_part(spark, sf_dir), RULES).withColumn("sex", sexes)
    p = p.withColumn("form", F.floor(F.col("p_partkey") / 20)).withColumn("matrix", F.col("p_size") > 45)
    return p.withColumn("group", F.when(F.col("p_partkey") % 5 == 0, F.lit("g"))).withColumn("page", F.floor(F.col("p_partkey") / 7).cast("int"))


def _defaults(spark, sf_dir):
    return R.exclusive_group(R.resolve(_ticks(spark, sf_dir)), ["form", "sex"], "p_partkey")


def tick_defaults(spark, sf_dir):
    return _defaults(spark, sf_dir).select("p_partkey", "sex", "action", F.col("on").alias("is_on"), "why")


def _overridden(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_quantity") > 25).alias("on"))
    return R.apply_overrides(_defaults(spark, sf_dir), li, ["p_partkey"])


def tick_overrides(spark, sf_dir):
    return _overridden(spark, sf_dir).select("p_partkey", "sex", F.col("on").alias("is_on"), "changed")


def tick_summary(spark, sf_dir):
    return R.tick_summary(_overridden(spark, sf_dir), ["form", "sex"])


def tick_breaks(spark, sf_dir):
    t = _ticks(spark, sf_dir).filter("sex = ''")
    return R.section_breaks(t, ["form"], "p_partkey").select("p_partkey", "heading")


def tick_names(spark, sf_dir):
    """Keys and labels of boxes; some are radio buttons, some lack a prompt or an option."""
    p = _part(spark, sf_dir).withColumn("kind", F.when(F.col("p_partkey") % 3 == 0, "radio").otherwise("check")).withColumn("name", F.col("section")).withColumn("value", F.col("p_size").cast("string"))
    p = p.withColumn("prompt", F.when(F.col("p_partkey") % 4 > 0, F.concat("prompt", F.lit(": "))).otherwise("")).withColumn("option", F.when(F.col("p_partkey") % 5 > 0, F.col("option"))).withColumn("line", F.lit("the line"))
    return p.select("p_partkey", R.tick_key(p).alias("tick_key"), R.tick_label(p).alias("label"))


def tick_bulk(spark, sf_dir):
    return R.bulk_tick_review(_defaults(spark, sf_dir), ["p_partkey", "sex"]).withColumnRenamed("on", "is_on")


def tick_siblings(spark, sf_dir):
    """Every part of size 7 is turned on; the others of its group and form go off."""
    t = _ticks(spark, sf_dir).filter("sex = ''").select("form", F.col("p_partkey").alias("key"), "group", "p_size")
    return R.exclusive_override(t, t.filter("p_size = 7").select("form", "key"), ["form"]).withColumnRenamed("on", "is_on")


def tick_radio(spark, sf_dir):
    t = _defaults(spark, sf_dir).withColumns({"kind": F.when(F.col("p_partkey") % 2 == 0, "radio").otherwise("check"), "name": F.col("section"), "value": F.col("option")})
    return R.radio_choice(t, ["form", "sex"], "p_partkey")


_TEXT = "(p_type || ' ' || p_name)"
_FIRST = f"""CASE WHEN {_TEXT} ILIKE '%promo%' THEN 1 WHEN regexp_matches(p_type, '(?i)^standard') AND regexp_matches(p_name, '(?i)[aeiou]d') THEN 2
  WHEN regexp_matches(p_type, '(?i)^small') THEN 3 WHEN p_brand ILIKE '%brand#1%' THEN 4 WHEN {_TEXT} ILIKE '%steel%' THEN 5 WHEN regexp_matches(p_name, '(?i)[xyz]') THEN 6 WHEN p_brand ILIKE '%brand#2%' THEN 7 END"""
_TICK = "CASE f WHEN 1 THEN 'never' WHEN 2 THEN 'female' WHEN 3 THEN 'male' WHEN 4 THEN 'always' WHEN 5 THEN 'always' WHEN 6 THEN 'review' WHEN 7 THEN 'known' END"
_NOTE = "CASE f WHEN 1 THEN 'not used' WHEN 2 THEN 'women only' WHEN 3 THEN 'men only' WHEN 4 THEN 'by brand' WHEN 5 THEN 'steel' WHEN 6 THEN 'look' WHEN 7 THEN 'everyone' ELSE '' END"
_DEF = f"""
t AS (SELECT p_partkey, p_size, p_name, p_brand, {_FIRST} AS f, sex, p_partkey // 20 AS form, p_size > 45 AS matrix, p_partkey % 5 = 0 AS grouped FROM part, (VALUES ('F'), ('M'), ('')) s(sex)),
b AS (SELECT *, {_NOTE} AS note, CASE WHEN f IS NOT NULL THEN {_TICK} WHEN NOT matrix AND NOT grouped AND len(string_split(trim(p_name), ' ')) >= 5 THEN 'always' ELSE 'review' END AS base FROM t),
g AS (SELECT *, CASE WHEN grouped AND f = 4 AND base = 'always' THEN 'review' ELSE base END AS g1 FROM b),
a AS (SELECT *, CASE WHEN matrix AND g1 <> 'never' AND NOT ((g1 = 'female' AND sex = 'M') OR (g1 = 'male' AND sex = 'F')) THEN 'review' ELSE g1 END AS action FROM g),
o AS (SELECT *, action = 'always' OR (action = 'female' AND sex = 'F') OR (action = 'male' AND sex = 'M') OR (action = 'known' AND sex <> '') AS on0,
  CASE WHEN action IN ('female', 'male', 'known') AND sex = '' THEN 'choose by sex' WHEN (action = 'female' AND sex = 'M') OR (action = 'male' AND sex = 'F') THEN 'other sex' WHEN action = 'review' THEN 'review' ELSE note END AS why FROM a),
x AS (SELECT *, on0 AND (NOT grouped OR sum(on0::INT) OVER (PARTITION BY form, sex, grouped ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) = 1) AS is_on FROM o),
v AS (SELECT l_partkey AS p_partkey, arg_max(l_quantity > 25, l_orderkey * 10 + l_linenumber) AS w FROM lineitem GROUP BY 1),
y AS (SELECT x.*, coalesce(w, is_on) AS on1, w IS NOT NULL AND w <> is_on AS changed FROM x LEFT JOIN v USING (p_partkey))"""
_ANY = {"r1": f"{_TEXT} ILIKE '%promo%'", "r2": "regexp_matches(p_type, '(?i)^standard') AND regexp_matches(p_name, '(?i)[aeiou]d')", "r3": "regexp_matches(p_type, '(?i)^small')", "r4": "p_brand ILIKE '%brand#1%'", "r5": f"{_TEXT} ILIKE '%steel%'", "r6": "regexp_matches(p_name, '(?i)[xyz]')", "r7": "p_brand ILIKE '%brand#2%'"}

QUERIES = {f.__name__: f for f in (rule_first, rule_coverage, tick_defaults, tick_overrides, tick_summary, tick_breaks, tick_names, tick_bulk, tick_siblings, tick_radio)}
ORACLE = {
    "rule_first": f"SELECT l_orderkey, l_linenumber, 'r' || f AS rule, {_TICK} AS rule_tick FROM lineitem JOIN (SELECT p_partkey, {_FIRST} AS f FROM part) ON l_partkey = p_partkey",
    "rule_coverage": " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS rule, coalesce(sum(({_FIRST} IS NOT DISTINCT FROM {k[1]})::INT), 0)::BIGINT AS n_first, count(*) AS n_any FROM part WHERE {v}) WHERE n_any > 0" for k, v in _ANY.items()),
    "tick_defaults": f"WITH {_DEF} SELECT p_partkey, sex, action, is_on, why FROM x",
    "tick_overrides": f"WITH {_DEF} SELECT p_partkey, sex, on1 AS is_on, changed FROM y",
    "tick_summary": f"WITH {_DEF} SELECT form, sex, count(*) FILTER (on1) AS n_on, count(*) FILTER (NOT on1 AND action = 'review' AND NOT changed) AS n_review, count(*) AS n_total FROM y GROUP BY form, sex",
    "tick_breaks": """SELECT p_partkey, (p_partkey // 7, p_brand) IS DISTINCT FROM lag((p_partkey // 7, p_brand)) OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) AS heading FROM part""",
    "tick_names": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand || '#' || p_size ELSE p_brand END AS tick_key,
        coalesce(nullif(concat_ws(' — ', CASE WHEN p_partkey % 4 > 0 THEN p_type END, CASE WHEN p_partkey % 5 > 0 THEN p_name END), ''), 'the line') AS label FROM part""",
    "tick_bulk": f"WITH {_DEF} SELECT p_partkey, sex, true AS is_on FROM x WHERE NOT is_on AND action = 'review' AND NOT grouped AND NOT matrix",
    "tick_siblings": """WITH t AS (SELECT p_partkey // 20 AS form, p_partkey AS key, p_partkey % 5 = 0 AS grouped, p_size = 7 AS turned FROM part)
        SELECT form, key, turned AS is_on FROM t WHERE turned OR (grouped AND form IN (SELECT form FROM t WHERE turned AND grouped))""",
    "tick_radio": f"WITH {_DEF} SELECT form, sex, p_brand AS name, arg_min(p_name, p_partkey) AS value FROM x WHERE is_on AND p_partkey % 2 = 0 GROUP BY form, sex, p_brand",
}
