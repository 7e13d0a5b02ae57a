"""Links, dates and fingerprints of pages; identifiers of notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import canonical_url, clean_text, let, nhs_digits, nhs_valid, parse_uk_date
from ..sources.shared import kept, small


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", " ")


#: First words of headings that open no group.
BOILERPLATE = (
    "show", "hide", "open", "close", "skip", "menu", "back", "faq", "faqs", "supporting documents", "consent form downloads", "project acknowledgements", "our services",
)


def page_tokens(pages: DataFrame, headings: tuple[str, ...] = ("h1", "h2", "h3", "h4", "title")) -> DataFrame:
    """page_id, pos, kind (heading or link), text, href: headings and links in document order.

    A heading inside a link is part of the link. A heading that wraps links to PDF files is none: its links count.
    """
    tags = "|".join(headings)
    # tags and stretches between: a link is taken whole; a heading only up to the first link to a PDF file inside it
    link, pdf = r"<a\b[^>]*>.*?</a>", r"""<a\b[^>]*\bhref\s*=\s*["']?[^"'\s>]*\.pdf["'\s>]"""
    found = F.regexp_extract_all("html", F.lit(rf"(?is)<(?:{tags})\b[^>]*>(?:(?!{pdf}|</(?:{tags})>).)*+</(?:{tags})>|{link}"), F.lit(0))
    t = pages.select("page_id", F.posexplode_outer(found).alias("pos", "raw")).filter("raw IS NOT NULL")
    kind = F.when(F.col("raw").rlike("(?i)^<a[^a-z]"), "link").otherwise("heading")
    href = F.regexp_extract("raw", r"""(?i)\bhref\s*=\s*["']?([^"'\s>]*)""", 1)
    return t.select("page_id", "pos", kind.alias("kind"), clean_text(strip_tags(F.col("raw"))).alias("text"), F.when(kind == "link", href).alias("href"))


def inherit_group(tokens: DataFrame, longest: int = 90) -> DataFrame:
    """Links with the text of the nearest heading above; empty, overlong and boilerplate headings open no group."""
    usual = F.lower("text").rlike(f"^({'|'.join(BOILERPLATE)})([^a-z0-9_]|$)")
    opens = (F.col("kind") == "heading") & (F.col("text") != "") & (F.length("text") <= longest) & ~usual
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("group", F.last(F.when(opens, F.col("text")), ignorenulls=True).over(w)).filter("kind = 'link'").drop("kind")


def filter_links(links: DataFrame, include: list[str] = (), exclude: list[str] = (), cols: tuple[str, ...] = ("text", "href")) -> DataFrame:
    """Links whose columns match one of ``include`` (if any) and none of ``exclude``; groups that end in '?' go."""
    both = F.concat_ws(" ", *cols)
    out = links.filter(~F.coalesce(F.col("group"), F.lit("")).endswith("?")) if "group" in links.columns else links
    if include:
        out = out.filter(both.rlike(f"(?iu){'|'.join(include)}"))
    return out.filter(~both.rlike(f"(?iu){'|'.join(exclude)}")) if exclude else out


def absolute_url(href: Column, base: Column) -> Column:
    host = F.regexp_extract(base, r"^([a-zA-Z]+://[^/]+)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z]+:)", 1)
    folder = F.regexp_replace(base, r"(?<![:/])/[^/]*$", "/")
    return F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(host, href)).otherwise(F.concat(folder, href))


def sitemap_urls(xml: DataFrame, exclude: str | None = None) -> DataFrame:
    """doc, url, is_index: the <loc> entries of sitemaps; index entries end in .xml."""
    locs = xml.select("doc", F.explode(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url"))
    out = locs.withColumn("url", F.regexp_replace("url", "&amp;", "&")).withColumn("is_index", F.col("url").rlike(r"\.xml(\.gz)?$"))
    return out.filter(~F.col("url").rlike(exclude)) if exclude else out


def sitemap_tree(roots: DataFrame, stored: DataFrame, deepest: int = 10, exclude: str | None = None, page: str | None = None) -> DataFrame:
    """url, is_index, depth, stored: all lists and pages that the lists of ``roots`` (url) name, over any number of lists, each with its least depth.

    ``stored``: url, xml, the lists that have been fetched. The lists found last are joined with it, and what they name and was not met before
    goes on, until nothing new comes; lists that name each other in a circle are read once. Roots have depth 0; lists that are not stored are told by
    stored = false. Pages must fit the pattern ``page``, if there is one. More than ``deepest`` rounds of lists are an error.
    """
    have = stored.select(canonical_url(F.col("url")).alias("key"), "xml")
    front = kept(roots.select(canonical_url(F.col("url")).alias("key"), "url").groupBy("key").agg(F.min("url").alias("url")))
    seen = front.select("key", "url", F.lit(True).alias("is_index"), F.lit(0).alias("depth"))
    depth = 0
    while not front.isEmpty():
        if (depth := depth + 1) > deepest:
            raise ValueError(f"lists within lists go deeper than {deepest}")
        lists = have.join(small(front.select("key")), "key", "left_semi").select(F.col("key").alias("doc"), "xml")
        named = sitemap_urls(lists, exclude).select(canonical_url(F.col("url")).alias("key"), "url", "is_index")
        if page:
            named = named.filter(F.col("is_index") | F.col("url").rlike(page))
        new = named.groupBy("key").agg(F.min("url").alias("url"), F.bool_or("is_index").alias("is_index")).join(seen, "key", "left_anti")
        new = kept(new.withColumn("depth", F.lit(depth)))
        seen = kept(seen.unionByName(new))
        front = new.filter("is_index")
    there = have.select("key").distinct().withColumn("there", F.lit(True))
    return seen.join(there, "key", "left").select("url", "is_index", "depth", F.when(F.col("is_index"), F.coalesce("there", F.lit(False))).alias("stored"))


def merge_listings(a: DataFrame, b: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """key, ``also``, url, title: the union by canonical url; b's title where it has one.

    ``also``: further columns of both by which entries are the same; without them entries of one url are told apart by nothing, and all of a's meet all of b's.
    """
    x = a.select(canonical_url(F.col("url")).alias("key"), *also, F.col("url").alias("ua"), F.col("title").alias("ta"))
    y = b.select(canonical_url(F.col("url")).alias("key"), *also, F.col("url").alias("ub"), F.col("title").alias("tb"))
    return x.join(y, ["key", *also], "full").select("key", *also, F.coalesce("ua", "ub").alias("url"), F.coalesce(F.nullif("tb", F.lit("")), "ta", F.lit("")).alias("title"))


def page_fingerprint(pages: DataFrame, least: int = 400) -> DataFrame:
    """page_id, n_chars, sha: of the cleaned text; pages of fewer than ``least`` characters have no sha."""
    text = clean_text(strip_tags(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " ")))
    t = pages.select("page_id", text.alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n_chars"), F.when(F.length("t") >= least, F.sha2("t", 256)).alias("sha"))


def extract_dates(text: Column) -> list[Column]:
    """review, next_review, version as printed, null where absent."""
    date = r"\s*:?\s*((?:\d{1,2}\s+)?[A-Za-z]+\s+\d{4}|\d{1,2}/\d{1,2}/\d{2,4})"
    get = lambda p, n: F.nullif(F.regexp_extract(text, p, 1), F.lit("")).alias(n)
    return [
        get(rf"(?i)(?:^|[^A-Za-z])(?:last reviewed|reviewed|review date){date}", "review"),
        get(rf"(?i)(?:next review(?: due)?|due for review){date}", "next_review"),
        get(r"(?i)(?:^|[^A-Za-z])version\s*:?\s*(\d+(?:\.\d+)*)", "version"),
    ]


def sentence_case(c: Column) -> Column:
    """First word capitalised, others lower-case. As printed stay words without lower-case letters, of two characters or more, and words with
    two capitals behind their first character."""
    capitals = lambda w: F.length(F.regexp_replace(w, "[^A-Z]", ""))
    rest = lambda w: F.substring(w, 2, 1_000_000)
    shouted = lambda w: (F.length(w) >= 2) & (F.length(F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789()/–-", "")) == 0)
    word = lambda w, i: F.when(shouted(w) | (capitals(rest(w)) >= 2), w).otherwise(F.when(i == 0, F.concat(F.upper(F.substring(w, 1, 1)), F.lower(rest(w)))).otherwise(F.lower(w)))
    return F.array_join(F.transform(F.split(c, " "), word), " ")


#: Kinds and units of files as titles name them.
FILE_KINDS, FILE_UNITS = ("pdf", "doc", "docx"), ("kb", "mb", "k b", "m b")


def clean_title(c: Column, drop: list[str] = ()) -> Column:
    """Cleaned, without the phrases ``drop`` (patterns) and file kinds and sizes, in sentence case; never empty if the title isn't."""
    kind, unit = "|".join(FILE_KINDS), "|".join(FILE_UNITS)
    t = clean_text(c)
    for file in (rf"\(({kind})( [^)]*|,[^)]*)?\)", rf"(?<![a-z])({kind}),? ?[0-9.]+ ?({unit})(?![a-z])"):
        t = F.regexp_replace(t, f"(?i){file}", "")
    for p in drop:
        t = F.regexp_replace(t, f"(?iu){p}", " ")
    t = clean_text(F.regexp_replace(t, " +- +", " – "))
    return sentence_case(F.when(t == "", clean_text(c)).otherwise(t))


#: Titles before a name, the labels of a person's details, and other words that end a name.
TITLES = ("mr", "mrs", "ms", "miss", "mx", "dr", "prof", "professor", "sir", "dame", "rev", "revd", "lord", "lady")
LABELS = {
    "name": ("patient name", "patient", "name"),
    "mrn": ("MRN", "hospital no", "hospital number", "unit no", "unit number"),
    "nhs": ("NHS", "NHS no", "NHS number"),
    "dob": ("DOB", "D.O.B", "date of birth"),
    "sex": ("sex", "gender"),
    "": ("FIN", "Age"),
}
SEXES = ("female", "male", "f", "m")
NAME_MARKS = "'’. -"


def labelled_parts(text: Column) -> Column:
    """A text cut once at all labels: array of (kind, said), said being what stands behind a label up to the next."""
    names = sorted(((n, kind) for kind, ns in LABELS.items() for n in ns), key=lambda x: -len(x[0]))
    one = "|".join(n.replace(".", "[.]").replace(" ", "\\s*" if kind in ("mrn", "nhs") else "\\s+") for n, kind in names)
    marked = F.regexp_replace(text, f"(?i)(?<![A-Za-z0-9_])({one})(?![A-Za-z0-9_])", "\x01$1\x02")
    found = F.slice(F.split(marked, "\x01"), 2, 1_000_000)
    kinds = F.create_map(*[F.lit(x) for n, kind in names for x in (n.lower().replace(" ", ""), kind)])

    def part(p: Column) -> Column:
        at = F.instr(p, "\x02")
        label = F.lower(F.regexp_replace(F.substr(p, F.lit(1), at - 1), "\\s", ""))
        return F.struct(kinds[label].alias("kind"), F.substr(p, at + 1).alias("said"))

    return F.transform(found, part)


def first_value(parts: Column, kind: str, value) -> Column:
    """The first of ``value(said)`` of the parts of a kind that is not null; '' where there is none."""
    all_ = F.transform(F.filter(parts, lambda p: p["kind"] == kind), lambda p: value(p["said"]))
    return F.coalesce(F.get(F.array_compact(all_), 0), F.lit(""))


def said_name(said: Column) -> Column:
    """What follows a colon, up to the line's end or a gap of two blanks."""
    line = F.element_at(F.split(F.ltrim(F.regexp_replace(said, "^\\s+", "")), "\n"), 1)
    rest = F.ltrim(F.substr(line, F.lit(2)))
    return F.when(line.startswith(":") & (rest != ""), clean_text(F.element_at(F.split(rest, "\\s\\s"), 1)))


def said_number(said: Column) -> Column:
    """Up to three letters and 4 to 12 digits, in capitals."""

    def check(w: Column) -> Column:
        digits = F.ltrim(w, F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        return F.when((F.length(w) - F.length(digits) <= 3) & F.length(digits).between(4, 12) & (F.translate(digits, "0123456789", "") == ""), w)

    return let(F.upper(F.element_at(F.split(F.ltrim(said, F.lit(" \t\n.:#")), "[^A-Za-z0-9_]"), 1)), check)


def said_ten_digits(said: Column) -> Column:
    """The first ten digits, in groups with a blank or hyphen between, if a group ends there."""
    # of the group that makes ten, what is no part of the number may follow it: a comma, a bracket
    plain = lambda u: F.element_at(F.split(u, "[^A-Za-z0-9_]"), 1)
    upto = lambda g: F.transform(g, lambda x, i: plain(F.array_join(F.slice(g, 1, i + 1), "")))
    groups = F.slice(F.split(F.ltrim(said, F.lit(" \t\n.:#")), "[\\s-]"), 1, 10)
    return F.get(F.filter(let(groups, upto), lambda u: (F.length(u) == 10) & (F.translate(u, "0123456789", "") == "")), 0)


def said_date(said: Column, as_of: Column) -> Column:
    """A date from the first three parts, day first."""
    line = F.element_at(F.split(F.ltrim(said, F.lit(" \t\n.:")), "[^A-Za-z0-9/.,\\- ]"), 1)
    parts = F.filter(F.split(line, "[-/., ]+"), lambda x: x != "")
    year = F.element_at(F.split(F.coalesce(F.get(parts, 2), F.lit("")), "[^0-9]"), 1)
    return parse_uk_date(F.concat_ws(" ", F.get(parts, 0), F.get(parts, 1), year), as_of)


def said_sex(said: Column) -> Column:
    word = F.lower(F.element_at(F.split(F.ltrim(said, F.lit(" \t\n:")), "[^A-Za-z0-9_]"), 1))
    return let(word, lambda w: F.when(w.isin(*SEXES), F.upper(F.substring(w, 1, 1))))


def without_title(c: Column) -> Column:
    """A name without one title at its beginning."""
    return F.regexp_replace(c, f"(?i)^({'|'.join(TITLES)})[.]?\\s+", "")


def name_line(line: Column) -> Column:
    """A line is a name: letters and the marks of names on both sides of its first comma, brackets behind it alone."""
    at = F.instr(line, ",")
    bare = lambda c, more: F.translate(F.lower(c), "abcdefghijklmnopqrstuvwxyz" + NAME_MARKS + more, "") == ""
    return (at > 1) & (at < F.length(line)) & bare(F.substr(line, F.lit(1), at - 1), "") & bare(F.substr(line, at + 1), "()")


def split_name(c: Column) -> Column:
    """(last, first) of ``SURNAME, First``, without titles and bracketed parts; null where one has no letter."""
    letter = lambda x: F.length(F.translate(F.lower(x), "abcdefghijklmnopqrstuvwxyz", "")) < F.length(x)

    def cut(x: Column) -> Column:
        at = F.instr(x, ",")
        last = without_title(clean_text(F.substr(x, F.lit(1), at - 1)))
        first = clean_text(F.regexp_replace(without_title(clean_text(F.substr(x, at + 1))), "[(][^)]*[)]", " "))
        return F.when(at > 1, F.struct(last.alias("last"), first.alias("first")))

    return let(let(c, cut), lambda n: F.when(letter(n["last"]) & letter(n["first"]), n))


def extract_identifiers(notes: DataFrame, as_of: Column) -> DataFrame:
    """note_id, surname, forenames, dob, nhs, mrn, sex and found_* of each note's text.

    The text is cut once at its labels; each detail is the first value behind one of its labels that passes the detail's check. A labelled
    name, else the first line shaped ``SURNAME, First``. An unlabelled 3-3-4 number counts only if its check digit fits; a birth
    date only if it parses.
    """
    own = [c for c in notes.columns if c != "text"]
    t = F.translate(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")), "\u00a0", " ")
    n = notes.select(*own, t.alias("t"))
    named = F.get(F.filter(F.transform(F.split("t", "\n"), clean_text), name_line), 0)
    n = n.select(*own, "t", labelled_parts(F.col("t")).alias("parts"), split_name(named).alias("line"))
    parts = F.col("parts")
    n = n.withColumn("said", split_name(F.nullif(first_value(parts, "name", said_name), F.lit(""))))
    name = F.coalesce("said", "line")
    loose = F.regexp_extract("t", r"(?<![A-Za-z0-9_])([0-9]{3}[\s-][0-9]{3}[\s-][0-9]{4})(?![A-Za-z0-9_])", 1)
    nhs = first_value(parts, "nhs", said_ten_digits)
    births = F.transform(F.filter(parts, lambda p: p["kind"] == "dob"), lambda p: said_date(p["said"], as_of))
    out = n.select(
        *own, F.coalesce(name["last"], F.lit("")).alias("surname"), F.coalesce(name["first"], F.lit("")).alias("forenames"), F.get(births, 0).alias("dob"),
        nhs_digits(F.when(nhs != "", nhs).when(nhs_valid(loose), loose).otherwise("")).alias("nhs"),
        first_value(parts, "mrn", said_number).alias("mrn"), first_value(parts, "sex", said_sex).alias("sex"),
    )
    return out.withColumns({"found_name": F.col("surname") != "", "found_dob": F.col("dob").isNotNull(), "found_nhs": F.col("nhs") != "", "found_mrn": F.col("mrn") != "", "found_sex": F.col("sex") != ""})


FOUND = {"name": "name", "dob": "date of birth", "nhs": "NHS number", "mrn": "MRN"}


def completeness(ids: DataFrame, by: str) -> DataFrame:
    """by, n, share_* of notes with each detail, n_complete."""
    share = [F.avg(F.col(f"found_{k}").cast("double")).alias(f"share_{k}") for k in FOUND]
    full = F.count_if(F.col("found_name") & F.col("found_dob") & F.col("found_nhs") & F.col("found_mrn"))
    return ids.groupBy(by).agg(F.count("*").alias("n"), *share, full.alias("n_complete"))


def missing_details() -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"found_{k}"), F.lit(v)) for k, v in FOUND.items()])), ", ")


def identifier_audit(ids: DataFrame, as_of: Column) -> DataFrame:
    """dob_status, nhs_status, n. ``ids``: dob (date), dob_text, nhs."""
    from ..functions.columns import age_on

    dob = F.when(F.coalesce(F.btrim("dob_text"), F.lit("")) == "", "missing").when(F.col("dob").isNull(), "bad").when(F.col("dob") > as_of, "future").when(age_on(F.col("dob"), as_of) > 115, "too old").otherwise("ok")
    d = nhs_digits(F.col("nhs"))
    nhs = F.when(d == "", "missing").when(F.length(d) != 10, "length").when(~nhs_valid(F.col("nhs")), "check digit").otherwise("valid")
    return ids.groupBy(dob.alias("dob_status"), nhs.alias("nhs_status")).agg(F.count("*").alias("n"))


