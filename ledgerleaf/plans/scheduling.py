"""Queries over schedules; index dates come from ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import schedule as S
from .tables import table

PRESETS = {
    "1-URGENT": [{"n": 1, "u": "w", "label": "first look"}, {"n": 6, "u": "w", "label": "six weeks", "day": 4}, {"n": 3, "u": "m", "label": "three months", "day": 4}],
    "2-HIGH": [{"n": 2, "u": "w", "label": "call"}, {"n": 10, "u": "d", "label": "after call", "ref": "call"}, {"n": 12, "u": "m", "label": "year", "day": 1}],
    "3-MEDIUM": [{"n": k, "u": "m", "label": f"month {k}", "day": 2} for k in (3, 6, 9, 12)],
    "4-NOT SPECIFIED": [{"n": 30, "u": "d", "label": "thirty"}],
    "5-LOW": [{"n": 6, "u": "m", "label": "half a year", "day": 5}, {"n": 1, "u": "d", "label": "next", "ref": "half a year"}],
}
EXTRA = [{"n": 24, "u": "m", "label": "two years"}]
HOLIDAYS = ("1995-12-25", "1995-12-26", "1996-01-01", "1997-12-25", "1998-12-25")


def _cohort(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("index_date"))


def schedule(spark, sf_dir):
    return S.expand_schedule(_cohort(spark, sf_dir), PRESETS, "o_orderkey", "o_orderpriority", "index_date", EXTRA)


def schedule_workdays(spark, sf_dir):
    days = spark.sql("SELECT explode(sequence(DATE '1990-01-01', DATE '2004-12-31')) AS day")
    off = spark.createDataFrame([(h,) for h in HOLIDAYS], "day string").select(F.col("day").cast("date").alias("day"))
    return S.skip_holidays(schedule(spark, sf_dir), S.working_days(days, off), "due").select("o_orderkey", "item_ord", "due")


ANCHORED = {
    "1-URGENT": [{"n": 2, "u": "w", "label": "after treatment", "from": "treatment", "day": 0}, {"n": 3, "u": "d", "label": "then", "ref": "after treatment"}],
    "2-HIGH": [{"n": 1, "u": "m", "label": "month", "day": 0}, {"n": 1, "u": "w", "label": "week"}, {"n": 6, "u": "m", "label": "late", "from": "treatment", "day": 2}],
    "3-MEDIUM": [{"n": 10, "u": "d", "label": "ten", "from": "treatment"}],
}


def schedule_anchored(spark, sf_dir):
    """Items from the end of treatment, the first shipment, which some orders lack; the page's weekday is Wednesday."""
    first = table(spark, sf_dir, "lineitem").filter("l_orderkey % 4 <> 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").cast("date").alias("treated"))
    cohort = _cohort(spark, sf_dir).join(first, "o_orderkey", "left")
    return S.expand_schedule(cohort, ANCHORED, "o_orderkey", "o_orderpriority", "index_date", anchors={"treatment": "treated"}, default_day=3)


def _due(start: str, i: dict) -> str:
    d = f"cast({start} + INTERVAL ({i['n']}) {dict(d='DAY', w='WEEK', m='MONTH')[i['u']]} AS DATE)"
    day = i.get("day") if i.get("day") != 0 else 3
    return f"cast({d} + cast(({day} - isodow({d}) + 7) % 7 AS INT) AS DATE)" if day else d


def _rows(presets=PRESETS, extra=EXTRA, of="orders") -> str:
    out = []
    for p, items in presets.items():
        made: dict[str, str] = {}
        for k, i in enumerate([*items, *extra]):
            made[i["label"]] = _due(made[i["ref"]] if i.get("ref") else "treated" if i.get("from") else "cast(o_orderdate AS DATE)", i)
            out.append(f"SELECT o_orderkey, {k} AS item_ord, '{i['label']}' AS label, {made[i['label']]} AS due FROM {of} WHERE o_orderpriority = '{p}'")
    return " UNION ALL ".join(out)


_OFF = ", ".join(f"DATE '{h}'" for h in HOLIDAYS)
QUERIES = {f.__name__: f for f in (schedule, schedule_workdays, schedule_anchored)}
ORACLE = {
    "schedule": _rows(),
    "schedule_anchored": f"""WITH t AS (SELECT o.*, f.treated FROM orders o LEFT JOIN (SELECT l_orderkey, cast(min(l_shipdate) AS DATE) AS treated FROM lineitem WHERE l_orderkey % 4 <> 1 GROUP BY 1) f ON o.o_orderkey = f.l_orderkey)
        {_rows(ANCHORED, [], "t")}""",
    "schedule_workdays": f"""WITH d AS (SELECT cast(range AS DATE) AS day FROM range(DATE '1990-01-01', DATE '2005-01-01', INTERVAL 1 DAY)),
        w AS (SELECT day FROM d WHERE isodow(day) < 6 AND day NOT IN ({_OFF})), n AS (SELECT d.day, min(w.day) AS working FROM d LEFT JOIN w ON w.day BETWEEN d.day AND d.day + 15 GROUP BY 1)
        SELECT o_orderkey, item_ord, coalesce(n.working, s.due) AS due FROM ({_rows()}) s LEFT JOIN n ON s.due = n.day""",
}
