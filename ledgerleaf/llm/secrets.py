"""Secret scans: patterns, and how widely the corpus owns each candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import reliable, text_or_empty
from .spans import joined, tagged, with_matches

#: Key words of an assignment, in either case (spelled out, as engines fold cases differently).
WORDS = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = f"({'|'.join(map(_either_case, WORDS))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: The next two have their least length in the pattern; a run that is too short has no longer part, so the
#: matches are those of the plain patterns that are long enough.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}+"
#: Any other long run that may be a credential; letters of both cases or with digits (tested after).
CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"


def base_spans(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``base``: array of (s, e, k, kind, x) of the kinds assign, access and hex."""
    df = with_matches(df, text_col, "__assign", ASSIGN, group=2)
    df = with_matches(df, text_col, "__access", ACCESS, trigger="AKIA")
    df = with_matches(df, text_col, "__hex", HEX)
    base = F.concat(tagged("__assign", "assign", 0, "length(i.x) >= 6"), tagged("__access", "access", 1), tagged("__hex", "hex", 2))
    return df.withColumn("base", base).drop("__assign", "__access", "__hex")


def candidates(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``loose``: long runs with a digit and a letter that no single kind of character makes up."""
    df = with_matches(df, text_col, "__loose", CANDIDATE)
    test = "i.x RLIKE '[0-9]' AND i.x RLIKE '[A-Za-z]'"
    return df.withColumn("loose", tagged("__loose", "owned", 3, test)).drop("__loose")


def ownership(found: DataFrame) -> DataFrame:
    """h, n_repos, n_owners, n_docs (occurrences) for every candidate hash of ``found`` (h, repo, owner, n).

    Occurrences are added up by (hash, repository, owner) before the shuffle by hash, so a value that
    a third of the corpus copies arrives as a few rows.
    """
    small = found.groupBy("h", "repo", "owner").agg(F.sum("n").alias("n"))
    return small.groupBy("h").agg(F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"), F.sum("n").alias("n_docs"))


def entropy(x: Column) -> Column:
    """Bits a character of the string's own character counts."""
    n = F.length(x)
    chars = F.split(x, "")
    each = F.array_distinct(chars)
    return -F.aggregate(
        F.transform(each, lambda c: F.size(F.filter(chars, lambda d: d == c)) / n), F.lit(0.0), lambda acc, p: acc + p * F.log2(p)
    )


def scan(
    df: DataFrame, repo: Column, owner: Column, max_owners: int = 1, max_repos: int = 2, min_entropy: float = 3.0,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows' spans, each with how widely the corpus owns its value: id, base, owned, judged, n_copied.

    base: array of (s, e, k, kind, x). Candidates are the values of base spans (of an assignment the assigned value) and other long mixed runs that do
    not lie inside a base span. Their hashes are counted by distinct repositories and owners over the whole corpus. judged:
    array of (s, e, k, kind, n_owners, n_repos, verdict) of all candidates; the verdict is ``live`` where at most ``max_owners`` owners
    and ``max_repos`` repositories hold the value and its characters have ``min_entropy`` bits each, ``copied`` where more hold it (an example
    copied about), else ``plain``. owned: the further spans, of kind ``owned``, that are live. n_copied: different copied values of the row.

    Only hashes are counted and joined; the text is read twice and never shuffled.
    Null and empty texts have no spans. A null repository or owner counts as one of its own name, ''.
    Rows that repeat an id with the same text have the same spans each; their owners all count. Null ids are kept.
    An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"))
    based = base_spans(rows, "t").withColumn("at", F.xxhash64("t"))
    wide = candidates(base_spans(rows, "t"), "t")
    each = wide.select("id", F.xxhash64("t").alias("at"), "repo", "owner", F.explode_outer(F.concat("base", "loose")).alias("c")).filter("c IS NOT NULL")
    each = each.select("id", "at", "repo", "owner", *[f"c.{c}" for c in ("s", "e", "k", "kind")], F.xxhash64("c.x").alias("h"), entropy(F.col("c.x")).alias("bits"))
    # a run inside a base span is that span's value; spans are told apart by place, so the window is over one text's candidates
    before = Window.partitionBy("id", "at", "repo", "owner").orderBy("s", "k").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("covered", F.max(F.when(F.col("k") < 3, F.col("e"))).over(before)).filter("k < 3 OR covered IS NULL OR covered < e").drop("covered")
    each = reliable(each)  # read twice: to count owners and to mark
    told = each.join(ownership(each.select("h", "repo", "owner", F.lit(1).alias("n"))), "h")
    few = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    told = told.withColumn("verdict", F.when(~few, "copied").when(F.col("bits") >= min_entropy, "live").otherwise("plain"))
    judged = F.struct("s", "k", "e", "kind", "n_owners", "n_repos", "verdict")
    by_row = told.groupBy(F.col("id").alias("j_id"), F.col("at").alias("j_at")).agg(
        F.array_sort(F.collect_set(judged)).alias("judged"), F.countDistinct(F.when(F.col("verdict") == "copied", F.col("h"))).alias("n_copied")
    )
    out = based.drop("t").join(by_row, based["id"].eqNullSafe(by_row["j_id"]) & (based["at"] == by_row["j_at"]), "left")
    none = F.expr("cast(array() AS array<struct<s:int,k:int,e:int,kind:string,n_owners:bigint,n_repos:bigint,verdict:string>>)")
    out = out.withColumn("judged", F.coalesce("judged", none))
    owned = F.expr("transform(filter(judged, j -> j.k = 3 AND j.verdict = 'live'), j -> named_struct('s', j.s, 'e', j.e, 'k', j.k, 'kind', j.kind, 'x', cast(NULL AS string)))")
    return out.select(F.col("id").alias(id_col), "base", owned.alias("owned"), "judged", F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest and list of ``scan``'s spans; n_live counts live base spans; verdicts: kind:start:end:owners:repositories:verdict of all candidates."""
    of = lambda kind: F.size(F.filter("base", lambda i: i["kind"] == kind)).cast("long").alias(f"n_{kind}")
    said = F.transform("judged", lambda j: F.concat_ws(":", j["kind"], j["s"].cast("string"), j["e"].cast("string"), j["n_owners"].cast("string"), j["n_repos"].cast("string"), j["verdict"]))
    return scanned.select(
        id_col, of("assign"), of("access"), of("hex"),
        F.sha2(joined(F.col("base"), False), 256).alias("base_sha256"), joined(F.concat("base", "owned"), False).alias("spans"),
        F.size("owned").cast("long").alias("n_owned"), "n_copied",
        F.size(F.filter("judged", lambda j: (j["k"] < 3) & (j["verdict"] == "live"))).cast("long").alias("n_live"), F.array_join(said, ",").alias("verdicts"),
    )
