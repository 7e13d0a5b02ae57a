"""Schedules from index dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Monday to Sunday, as Spark's next_day names them.
DAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def offset(d: Column, n: int, unit: str) -> Column:
    """``n`` days, weeks or months later; a month's end is not overrun."""
    return {"d": lambda: F.date_add(d, n), "w": lambda: F.date_add(d, 7 * n), "m": lambda: F.add_months(d, n)}[unit]()


def prefer_weekday(d: Column, day: int) -> Column:
    """The same day or the next that is weekday ``day`` (1 Monday to 7 Sunday); 0 keeps the date."""
    return F.next_day(F.date_sub(d, 1), DAYS[day - 1]) if day else d


def item_dates(items: list[dict], anchors: dict[str, Column], default_day: int = 0) -> dict[str, Column]:
    """A date for each item by label. An item starts at an anchor, which its ``from`` names (index if it has none), or with ``ref`` at another
    item, by its label. Its ``day`` is the weekday wanted: 0 the caller's ``default_day``; without one the date stays."""
    done: dict[str, Column] = {}
    by = {i["label"]: i for i in items}

    def of(label: str, path: tuple[str, ...]) -> Column:
        if label in done:
            return done[label]
        if label not in by:
            raise ValueError(f"unknown item {label!r}")
        if label in path:
            raise ValueError("items refer to each other in a circle: " + " > ".join([*path, label]))
        i = by[label]
        if i.get("ref"):
            start = of(i["ref"], (*path, label))
        elif (name := i.get("from", "index")) in anchors:
            start = anchors[name]
        else:
            raise ValueError(f"unknown anchor {name!r}")
        done[label] = prefer_weekday(offset(start, i["n"], i["u"]), default_day if i.get("day") == 0 else i.get("day") or 0)
        return done[label]

    return {label: of(label, ()) for label in by}


def expand_schedule(
    cohort: DataFrame, presets: dict[str, list[dict]], key: str, preset: str, index: str, extra: list[dict] = (), anchors: dict[str, str] | None = None, default_day: int = 0,
) -> DataFrame:
    """key, item_ord, label, due: one row for each subject and item of its preset, extra items last.

    ``anchors`` names the columns of further starting dates, such as ``treatment``; an item without a date there is due on none (null).
    Presets become one CASE of arrays at planning time, so the job is narrow: no join, no shuffle.
    """
    case = None
    for name, items in presets.items():
        all_items = [*items, *extra]
        dates = item_dates(all_items, {"index": F.col(index), **{k: F.col(c) for k, c in (anchors or {}).items()}}, default_day)
        rows = F.array(*[F.struct(F.lit(k).alias("item_ord"), F.lit(i["label"]).alias("label"), dates[i["label"]].alias("due")) for k, i in enumerate(all_items)])
        case = F.when(F.col(preset) == name, rows) if case is None else case.when(F.col(preset) == name, rows)
    return cohort.select(key, F.explode(case).alias("i")).select(key, "i.*")


def working_days(days: DataFrame, holidays: DataFrame, day: str = "day") -> DataFrame:
    """day, working: each day and itself or the next that is neither a weekend's nor a holiday's. ``days`` must
    run without gaps; it has a row a day, so the one window over it stays small."""
    free = F.dayofweek(day).isin(1, 7) | F.col("holiday")
    marked = days.select(day).join(holidays.select(F.col(day), F.lit(True).alias("holiday")).distinct(), day, "left").fillna(False, ["holiday"])
    w = Window.orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, 0)
    return marked.select(day, F.last(F.when(~free, F.col(day)), ignorenulls=True).over(w).alias("working"))


def skip_holidays(df: DataFrame, calendar: DataFrame, col: str) -> DataFrame:
    """``col`` rolled forward by ``working_days``'s table; dates beyond it stay."""
    c = calendar.select(F.col("day").alias("__day"), "working")
    return df.join(F.broadcast(c) if c.count() <= 100_000 else c, F.col(col) == F.col("__day"), "left").withColumn(col, F.coalesce("working", col)).drop("__day", "working")
