"""Snapshots of catalogues: what changed, with stable ids and guards."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import first_by, slugify
from ..functions.ordered import running_sum
from ..sources import versions
from ..sources.shared import kept, small


class Snapshot(NamedTuple):
    """A previous snapshot in three layouts of the same rows, each for a join of its own.

    As stored by ``store``, each is bucketed by the join's columns, so that none of these rows is shuffled.
    """

    by_url: DataFrame
    by_title: DataFrame
    by_id: DataFrame


#: Columns by which the layouts of a stored snapshot are bucketed.
LAYOUTS = {"by_url": ["source", "url"], "by_title": ["source", "title_key"], "by_id": ["id"]}
STORED = "id string, source string, url string, title string, `group` string, sha string, analyser int, updated date"


def title_key() -> Column:
    """One text for title and group; groups that are null are equal, titles that are null are not."""
    return F.concat("title", F.lit("\x1f"), F.coalesce("group", F.lit("\x1e")))


def store(rows: DataFrame, root: str, buckets: int = 8, note: dict | None = None, after: int | None = None) -> versions.Version:
    """Commits ``rows`` (the columns of ``STORED``) as the next version of the snapshot under ``root``.

    ``buckets`` grows with the data: such that one bucket's rows fit a task. ``note`` is committed with the version, in one step.
    """
    layouts = {name: (columns, buckets) for name, columns in LAYOUTS.items()}
    return versions.commit(rows.withColumn("title_key", title_key()), root, layouts, note, after)


def stored(spark: SparkSession, version: versions.Version | None) -> Snapshot:
    """A version that ``store`` has committed; an empty one for none."""
    return Snapshot(*[versions.read(spark, version, f"{STORED}, title_key string", name) for name in LAYOUTS])


def snapshot(prev: DataFrame | Snapshot) -> Snapshot:
    """Rows that are not stored, as a snapshot."""
    if isinstance(prev, Snapshot):
        return prev
    rows = prev.withColumn("title_key", title_key())
    return Snapshot(rows, rows, rows)


def match_previous(now: DataFrame, prev: DataFrame | Snapshot) -> DataFrame:
    """``now`` (source, ord, url, title, group) with tier, 1 by url, 2 by title and group, within the source, and the previous row's
    prev_id and, where they are known, prev_sha, prev_analyser, prev_updated.

    One to one: of several items that fit a previous row the best tier, then the first wins; the rest
    count as new. Only ``now`` is shuffled for the two joins where the snapshot is stored.
    """
    prev = snapshot(prev)
    n = now.select("source", "ord", "url", title_key().alias("title_key"))
    told = [F.col("id").alias("prev_id"), *[F.col(c).alias(f"prev_{c}") for c in ("sha", "analyser", "updated") if c in prev.by_url.columns]]

    def by(rows: DataFrame, on: str, tier: int) -> DataFrame:
        return n.select("source", "ord", on).join(rows.select("source", on, *told), ["source", on]).drop(on).withColumn("tier", F.lit(tier))

    pairs = by(prev.by_url, "url", 1).unionByName(by(prev.by_title, "title_key", 2))
    best = first_by(pairs, ["source", "ord"], ["tier", "prev_id"])
    best = first_by(best, ["source", "prev_id"], ["tier", "ord"])
    return now.join(best, ["source", "ord"], "left")


def free_numbers(rows: DataFrame, used: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``rows`` (slug, nth from 1) with number: the nth of the numbers from 2 on that ``used`` (slug, number, all different) leaves free.

    Before the jth used number u stand u - 1 - j free ones, so a row's number is nth + 1 plus the used ones with fewer than nth before
    them: a running count over both, merged by that measure. No slug's rows are collected.
    """
    place = running_sum(used.withColumn("one", F.lit(1).cast("long")), ["slug"], "one", ["number"], "j", most)
    marks = place.select("slug", (F.col("number") - 1 - F.col("j")).alias("at"), F.lit(0).alias("kind"), F.col("number").alias("tie"), F.lit(1).cast("long").alias("one"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
    asks = rows.select("slug", F.col("nth").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("tie"), F.lit(0).cast("long").alias("one"), "row")
    both = running_sum(marks.unionByName(asks), ["slug"], "one", ["at", "kind", "tie"], "passed", most)
    return both.filter("kind = 1").select("row", (F.col("at") + 1 + F.col("passed")).alias("number"))


def assign_ids(df: DataFrame, have: str = "prev_id", max_group: int = 28, max_title: int = 60, most: int = 1_000_000) -> DataFrame:
    """Adds id: the previous one, else source-group-title as a slug, else that slug with the smallest number from 2 on that no id has.

    Ids are given in this order: previous ones; then each slug to its first row (by source and ord), if no previous id is that slug; then
    numbers to the other rows, slug by slug and in the same order. So no two rows get one new id, an id does not depend on how
    other slugs are numbered, and gaps are filled. ``df``: source, ord (together unique), group, title. Slugs of ``most`` rows and more are numbered over many tasks.
    """
    slug = F.concat_ws("-", slugify(F.col("source")), slugify(F.col("group"), max_group), slugify(F.col("title"), max_title))
    old = df.filter(F.col(have).isNotNull()).withColumn("id", F.col(have))
    new = kept(df.filter(F.col(have).isNull()).withColumn("slug", slug))
    own = new.groupBy("slug").agg(F.min(F.struct("source", "ord")).alias("first"), F.count("*").alias("n"))
    own = kept(own.join(old.select(F.col("id").alias("slug")).distinct().withColumn("held", F.lit(True)), "slug", "left"))
    named = new.join(own, "slug")
    first = F.col("held").isNull() & (F.struct("source", "ord") == F.col("first"))
    plain = named.filter(first).withColumn("id", F.col("slug"))
    crowd = own.filter("held OR n > 1")
    if crowd.isEmpty():
        return old.unionByName(plain.select(*old.columns))
    rest = named.filter(~first).select(*new.columns, F.struct("source", "ord").alias("row"), F.lit(1).cast("long").alias("one"))
    rest = kept(running_sum(rest, ["slug"], "one", ["source", "ord"], "before", most))
    number = F.regexp_extract("id", "-([1-9][0-9]{0,17})$", 1).try_cast("long")
    taken = old.select("id").unionByName(own.filter("held IS NULL").select(F.col("slug").alias("id")))
    used = taken.select(F.regexp_replace("id", "-[1-9][0-9]{0,17}$", "").alias("slug"), number.alias("number")).filter("number > 1").distinct().join(crowd.select("slug"), "slug", "left_semi")
    given = free_numbers(rest.select("slug", "row", (F.col("before") + 1).alias("nth")), used, most)
    made = rest.join(given, "row").withColumn("id", F.concat_ws("-", "slug", "number"))
    return old.unionByName(plain.select(*old.columns)).unionByName(made.select(*old.columns))


def shrink_guard(now: DataFrame, prev: DataFrame, share: float = 0.6) -> DataFrame:
    """source, n_now, n_prev, held: the listing fell below ``share`` of the previous one, which then stays."""
    a = now.groupBy("source").agg(F.count("*").alias("n_now"))
    b = prev.groupBy("source").agg(F.count("*").alias("n_prev"))
    both = a.join(b, "source", "full").fillna(0, ["n_now", "n_prev"])
    return both.withColumn("held", (F.col("n_prev") > 0) & (F.col("n_now") < share * F.col("n_prev")))


def classify_change(analyser: int, force: bool = False) -> Column:
    """failed, unchanged, updated or added, from error, prev_id, sha, prev_sha, prev_analyser, file_present."""
    same = (F.col("sha") == F.col("prev_sha")) & (F.col("prev_analyser") == analyser) & F.col("file_present") & F.lit(not force)
    return F.when(F.col("error").isNotNull(), "failed").when(F.coalesce(same, F.lit(False)), "unchanged").when(F.col("prev_id").isNotNull(), "updated").otherwise("added")


def carry_updated(today: Column) -> Column:
    return F.when(F.col("sha").eqNullSafe(F.col("prev_sha")), F.coalesce("prev_updated", today)).otherwise(today)


def sync(now: DataFrame, prev: DataFrame | Snapshot, today: Column, analyser: int = 1, share: float = 0.6) -> DataFrame:
    """The change of every item: source, ord, id, prev_id, change, kept, updated, url, title, group, sha, error. It is written once, so reading it again costs no join.

    ``now``: source, ord, url, title, group, sha, error, file_present. ``prev``: id, source, url, title,
    group, sha, analyser, updated, or a stored snapshot, whose rows the joins do not shuffle. A failed item keeps its previous row's sha and date; one that has
    none is reported and not kept (kept is false). A source that lists nothing, or less than ``share`` of its
    previous rows, is held: its listing is left out and its previous rows stay as they are, with change ``held``. The held
    sources are one row each, counted and then broadcast: nothing is dealt out by source alone.
    """
    prev = snapshot(prev)
    held = small(shrink_guard(now, prev.by_id, share).filter("held").select("source"))
    m = match_previous(now.join(held, "source", "left_anti"), prev).withColumn("change", classify_change(analyser))
    m = m.withColumn("kept", (F.col("change") != "failed") | F.col("prev_id").isNotNull())
    m = m.withColumn("updated", F.when(F.col("change") == "failed", F.col("prev_updated")).otherwise(carry_updated(today)))
    m = m.withColumn("sha", F.when(F.col("change") == "failed", F.col("prev_sha")).otherwise(F.col("sha")))
    out = assign_ids(kept(m)).select("source", "ord", "id", "prev_id", "change", "kept", "updated", "url", "title", "group", "sha", "error")
    stay = prev.by_id.join(held, "source", "left_semi").select(
        "source", F.lit(None).cast("int").alias("ord"), "id", F.col("id").alias("prev_id"), F.lit("held").alias("change"), F.lit(True).alias("kept"),
        "updated", "url", "title", "group", "sha", F.lit(None).cast("string").alias("error"),
    )
    return kept(out.unionByName(stay))


def next_rows(changes: DataFrame, analyser: int = 1) -> DataFrame:
    """The rows of ``sync``'s result that the next snapshot has."""
    return changes.filter("kept").select("id", "source", "url", "title", "group", "sha", F.lit(analyser).alias("analyser"), "updated")


def removed_rows(prev: DataFrame | Snapshot, out: DataFrame) -> DataFrame:
    """Previous rows that no kept row goes on from. A stored snapshot is read by id and not shuffled."""
    prev = snapshot(prev)
    return prev.by_id.drop("title_key").join(out.filter("kept").select("id"), "id", "left_anti")


def run_stats(changes: DataFrame, prev: DataFrame | Snapshot, now: DataFrame) -> DataFrame:
    """source, listed, added, updated, unchanged, failed, held, removed, error: a held source says how much it listed."""
    one = lambda k: F.count_if(F.col("change") == k).alias(k)
    a = changes.groupBy("source").agg(one("added"), one("updated"), one("unchanged"), one("failed"), one("held"))
    n = now.groupBy("source").agg(F.count("*").alias("listed"))
    r = removed_rows(prev, changes).groupBy("source").agg(F.count("*").alias("removed"))
    s = a.join(n, "source", "full").join(r, "source", "full").fillna(0)
    return s.withColumn("error", F.when(F.col("held") > 0, F.format_string("%d listed, %d before: kept as before", "listed", "held")))


def source_ok(kind: str) -> Column:
    """Forms allow no failure; leaflets 3 or a twentieth of the list. A held source is not in order."""
    few = F.col("failed") == 0 if kind == "forms" else F.col("failed") <= F.greatest(F.lit(3.0), F.col("listed") * 0.05)
    return few & F.col("error").isNull()


def overall_ok(stats: DataFrame, kind: str) -> DataFrame:
    """One row: ok where every source is, n_sources, n_bad."""
    s = stats.withColumn("ok", source_ok(kind))
    return s.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"), F.count("*").alias("n_sources"), F.count_if(~F.col("ok")).alias("n_bad"))


def union_catalogue(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def gap_report(forms: DataFrame, names: dict[str, str]) -> DataFrame:
    """id, gaps: forms that cannot be filled or miss roles, with the roles' display names, in order."""
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    bad = forms.filter(~F.col("fillable") | (F.size("missing") > 0))
    return bad.select("id", F.when(~F.col("fillable"), "not fillable").otherwise(F.array_join(F.transform("missing", lambda m: F.coalesce(lookup[m], m)), ", ")).alias("gaps"))


def no_tick_report(forms: DataFrame) -> DataFrame:
    return forms.filter(F.size("ticks") == 0).select("id")


def failure_report(changes: DataFrame) -> DataFrame:
    """source, ord, title, error of the items that failed, one row each, whether or not a previous row stays for them."""
    return changes.filter("change = 'failed'").select("source", "ord", "title", "error")


def freshness(status: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    """age_days, stale, failing: of the last run of each source; failing names the sources, in order."""
    last = status.groupBy("source").agg(F.max_by(F.struct("run", "ok"), "run").alias("s")).select("source", "s.*")
    return last.agg(
        F.datediff(as_of, F.max("run").cast("date")).alias("age_days"),
        (F.datediff(as_of, F.max("run").cast("date")) > limit).alias("stale"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("source")))), ", ").alias("failing"),
    )


def merge_unchanged(new: DataFrame, old: DataFrame, key: str, fresh: list[str], else_old: list[str]) -> DataFrame:
    """The unchanged rows of ``old`` with the columns ``fresh`` from ``new``, and ``else_old`` from it where it has a value."""
    n = new.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in [*fresh, *else_old]])
    cols = {c: F.col(f"new_{c}") for c in fresh} | {c: F.coalesce(f"new_{c}", c) for c in else_old}
    return old.join(n, key).select(*[cols[c].alias(c) if c in cols else F.col(c) for c in old.columns])


def yield_gate(df: DataFrame, floors: dict[str, int]) -> DataFrame:
    """source, n, error: sources that list fewer rows than their floor, also those that list none."""
    spark = df.sparkSession
    want = spark.createDataFrame([*floors.items()], "source string, floor int")
    n = df.groupBy("source").agg(F.count("*").alias("n"))
    return want.join(n, "source", "left").fillna(0, ["n"]).select("source", "n", F.when(F.col("n") < F.col("floor"), F.format_string("only %d rows, expected %d", "n", "floor")).alias("error"))
