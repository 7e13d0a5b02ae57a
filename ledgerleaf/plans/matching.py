"""Queries over phrases, pages and layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import clean_text, has_text
from ..functions.ordered import running
from ..operators import extract as E
from ..operators import layout as Y
from ..operators import match as M
from ..sources.shared import spread, spread_texts
from .tables import table


def _forms(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("form_id"), F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("title"))


def _leaflets(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    words = names.select(F.explode(F.split("p_name", " ")).alias("p_name")).filter("length(p_name) >= 3")
    t = names.unionByName(words).distinct().select(F.col("p_name").alias("leaflet_id"), F.col("p_name").alias("leaflet_ord"), F.concat(F.initcap("p_name"), F.lit(" ("), F.upper(F.substring("p_name", 1, 4)), F.lit("q)")).alias("title"))
    return t


def match_keys(spark, sf_dir):
    return _leaflets(spark, sf_dir).select("leaflet_id", F.array_join(M.leaflet_keys(F.col("title")), "|").alias("keys"), M.is_regimen(F.col("title")).alias("regimen"))


#: How titles are joined: with which words behind a type's first two letters in capitals.
ENDS = (" therapy", "-based therapy", "X-based therapy", " plus", "-", "--x", "1 2", "-1b", " and rest", " - rest")


def match_regimens(spark, sf_dir):
    """Titles of parts that are regimens, among them words with hyphens and in brackets."""
    k = F.col("p_partkey")
    end = F.element_at(F.array(*[F.lit(e) for e in ENDS]), (k % 10 + 1).cast("int"))
    t = F.concat(F.initcap("p_name"), F.when(k % 3 == 0, " (").otherwise(" "), F.upper(F.substring("p_type", 1, 2)), end, F.when(k % 3 == 0, ")").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", M.is_regimen(t).alias("regimen"))


def match_suggest(spark, sf_dir):
    return M.suggest(_forms(spark, sf_dir), _leaflets(spark, sf_dir))


def page_links(spark, sf_dir):
    t = E.page_tokens(table(spark, sf_dir, "pages"), ("h1", "title"))
    return E.filter_links(E.inherit_group(t), exclude=["no-such-word"]).select("page_id", "pos", "text", "href", "group")


def page_groups(spark, sf_dir):
    t = E.page_tokens(table(spark, sf_dir, "pages"), ("h1", "title"))
    return E.inherit_group(t).groupBy("page_id", "group").agg(F.count("*").alias("n_links"))


def page_urls(spark, sf_dir):
    t = E.page_tokens(table(spark, sf_dir, "pages"), ("h1", "title")).filter("kind = 'link'")
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return t.join(p, "page_id").select("page_id", "pos", E.absolute_url(F.col("href"), F.col("url")).alias("target"))


def page_fingerprint(spark, sf_dir):
    return E.page_fingerprint(table(spark, sf_dir, "pages"))


def page_dates(spark, sf_dir):
    """Dates and versions that go by the page, behind the page's own title, in five wordings, one of them without any."""
    k = F.col("page_id")
    month = F.element_at(F.array(*[F.lit(m) for m in ("January", "May", "September")]), (k % 3 + 1).cast("int"))
    day, year = k % 28 + 1, k % 30 + 1995
    said = (
        F.when(k % 5 == 0, F.concat(F.lit("Last reviewed: "), day, F.lit(" "), month, F.lit(" "), year, F.lit(". Next review due: "), month, F.lit(" "), year + 3, F.lit(". Version "), k % 7, F.lit("."), k % 4))
        .when(k % 5 == 1, F.concat(F.lit("Reviewed "), F.lpad(day.cast("string"), 2, "0"), F.lit("/02/"), year)).when(k % 5 == 2, F.concat(F.lit("review date: "), month, F.lit(" "), year, F.lit("; VERSION: "), k % 9))
        .when(k % 5 == 3, F.concat(F.lit("Due for review "), day, F.lit("/11/"), year % 100 + 10, F.lit(" previewed 2001"))).otherwise("conversion 3, nothing due")
    )
    text = F.concat(F.regexp_extract("html", "<title>([^<]*)", 1), F.lit(" "), said)
    return table(spark, sf_dir, "pages").select("page_id", *E.extract_dates(text))


def page_titles(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("The "), F.upper("p_brand"), F.lit(" Consent Form for "), F.initcap("p_name"), F.lit(" (PDF, 20kB)")).alias("t"))
    return d.select("p_partkey", E.clean_title(F.col("t"), [r"\s*consent\s+form\s*(for\s+)?"]).alias("title"))


def _lists(spark, sf_dir):
    """Lists of ten pages each, in lists of ten lists, in lists of ten of those; every tenth list of pages names a list that was not fetched, and all name a list above, in a circle."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    at = lambda kind, k: F.concat(F.lit(f"https://x/{kind}-"), k, F.lit(".xml"))
    ten = lambda c: F.floor(c / 10)
    loc = lambda u: F.concat(F.lit("<url><loc> "), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    rows = p.select(at("pages", ten(F.col("page_id"))).alias("url"), F.inline(F.array(*[F.struct(x.alias("named")) for x in (
        F.concat("url", F.lit("?a=1&b="), "page_id"), F.when(ten(F.col("page_id")) % 10 == 3, at("gone", ten(F.col("page_id")))), at("top", F.floor(F.col("page_id") / 1000)),
    )])))
    mids = p.select(at("mid", F.floor(F.col("page_id") / 100)).alias("url"), at("pages", ten(F.col("page_id"))).alias("named"))
    tops = p.select(at("top", F.floor(F.col("page_id") / 1000)).alias("url"), at("mid", F.floor(F.col("page_id") / 100)).alias("named"))
    named = rows.filter("named IS NOT NULL").unionByName(mids).unionByName(tops).distinct()
    return named.groupBy("url").agg(F.concat(F.lit("<urlset>"), F.array_join(F.array_sort(F.collect_list(loc(F.col("named")))), ""), F.lit("</urlset>")).alias("xml"))


def sitemap(spark, sf_dir):
    return E.sitemap_urls(_lists(spark, sf_dir).withColumnRenamed("url", "doc"), exclude="gone-3[.]")


def sitemap_nested(spark, sf_dir):
    """All that the topmost lists lead to."""
    lists = _lists(spark, sf_dir)
    return E.sitemap_tree(lists.select("url").filter("url LIKE '%/top-%'"), lists, page="b=[0-9]*[0-8]$")


def _items(spark, sf_dir):
    """Words on a grid: a line each 12 points down, 5 points a character, one space between."""
    # texts are dealt by document once: all that follows is by document and line or page, and is not shuffled again
    docs = spread_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")
    d = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line")).filter(has_text(F.col("line")))
    d = d.select("doc_id", F.lit(1).alias("page"), "ln", F.split(clean_text(F.col("line")), " ").alias("w"))
    d = d.withColumn("x", running(F.col("w"), F.lit(0), lambda x, w: (x + F.length(w) + 1, x), "int"))
    t = d.select("doc_id", "page", "ln", F.inline(F.arrays_zip("w", "x"))).withColumnRenamed("w", "str")
    return t.select("doc_id", "page", "str", (F.col("x") * 5.0).alias("x0"), ((F.col("x") + F.length("str")) * 5.0).alias("x1"), (-12.0 * F.col("ln")).alias("y"), F.lit(10.0).alias("fs"))


def layout_lines(spark, sf_dir):
    t = Y.assemble_lines(_items(spark, sf_dir))
    return t.groupBy("doc_id", "line").agg(F.count("*").alias("n"), F.max("x1").alias("right"))


def layout_phrases(spark, sf_dir):
    p = Y.assemble_phrases(Y.assemble_lines(_items(spark, sf_dir)))
    return p.select("doc_id", "line", "phrase", F.sha2("text", 256).alias("sha"), "x0", "x1")


LABELS = [("date", r"^the (and|of)"), ("name", r"^(is|in) "), ("other", r"^[a-m]")]


def layout_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    return d.select("doc_id", "ln", Y.classify_label(F.col("line"), LABELS).alias("role")).filter("role IS NOT NULL")


def layout_leaders(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), F.concat(F.lit("Name ______ "), "c_mktsegment", F.lit("....")).alias("str"))
    t = c.withColumns({"x0": F.lit(0.0), "x1": F.length("str") * 5.0, "y": F.lit(1.0), "fs": F.lit(10.0)})
    return Y.split_leaders(t).select("doc_id", "str", "x0", "x1", "leader")


def layout_gaps(spark, sf_dir):
    """Phrases of part names whose words stand 0, 4, 8 or 12 points apart, by the word before, at heights of one line."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.posexplode(F.split("p_name", " ")).alias("i", "str"))
    wide = F.length("str") * 5.0
    end = F.sum(wide + F.length("str") % 4 * 4).over(Window.partitionBy("doc_id").orderBy("i"))
    t = t.withColumn("x0", end - wide - F.length("str") % 4 * 4).withColumn("x1", F.col("x0") + wide)
    t = t.withColumn("y", F.col("i") % 2 * -1.5).withColumn("fs", F.lit(10.0))
    return Y.assemble_phrases(Y.assemble_lines(t)).select("doc_id", "line", "phrase", "text", "x0", "x1")


def layout_blanks(spark, sf_dir):
    """Blank lines from three leaders a line, whose distance and width go by key."""
    k = F.col("c_custkey")
    x = F.array(*[F.struct(a.alias("x0"), z.alias("x1")) for a, z in ((F.lit(0.0), F.lit(10.0)), (k % 10 + 10.0, k % 10 + 20.0), (F.lit(100.0), k % 8 + 108.0))])
    t = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("line"), F.lit(True).alias("leader"), F.inline(x))
    return Y.line_leaders(t).select("doc_id", "x0", "x1")


def layout_headings(spark, sf_dir):
    """Sections of lines that begin by key and end with a part's name."""
    starts = ("Statement of Health Professional ", "2) Patient’s signature ", "Section 3 interpreter ", "parental responsibility ", "Confirmation of consent ", "The patient ", "To be completed by nurse ", "1. Witness ", "Part ")
    t = F.concat(F.element_at(F.array(*[F.lit(x) for x in starts]), (F.col("p_partkey") % 9 + 1).cast("int")), F.col("p_name"))
    t = F.when(F.col("p_size") == 1, "Responsible consultants :").when(F.col("p_size") == 2, F.rpad(t, 161, "x")).otherwise(t)
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    lines = parts.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0.0).alias("x"), F.col("p_size").cast("double").alias("y"), t.alias("text"))
    return Y.section_headings(lines).select("doc_id", "y", "section")


ASKED = ("Date of Birth:", "NHS no.", "Patient’s surname *", "First name(s)", "Full name of patient", "Hospital / NHS Trust", "Hospital number", "Job title", "Name (print)", "Affix patient label here", "Named oncologist", "Signature")


def layout_asked(spark, sf_dir):
    """Roles of the forms' own labels, by key, some with the segment behind them."""
    k = F.col("c_custkey")
    said = F.element_at(F.array(*[F.lit(x) for x in ASKED]), (k % 12 + 1).cast("int"))
    t = F.when(k % 5 == 0, F.concat(said, F.lit(" "), "c_mktsegment")).otherwise(said)
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select("c_custkey", Y.classify_label(t).alias("role"))


def layout_sections(spark, sf_dir):
    """All orders as headings and all customers as spots, on documents whose number grows with the tables."""
    k = F.col("o_orderkey")
    h = table(spark, sf_dir, "orders").select(F.floor(k / 40).alias("doc_id"), (k % 4).cast("int").alias("page"), k.cast("double").alias("y"), (k % 3 * 50.0).alias("x"), F.concat(F.lit("s"), "o_orderkey").alias("section"))
    c = F.col("c_custkey")
    s = table(spark, sf_dir, "customer").select(c.alias("spot_id"), F.floor(c / 4).alias("doc_id"), (c % 5).cast("int").alias("page"), (c * 10.0).alias("y"), (c % 3 * 50.0 + 20).alias("x"))
    return Y.section_at(s, h).select("spot_id", "section")


def layout_glyphs(spark, sf_dir):
    """First characters from names, in fonts by key."""
    k = F.col("c_custkey")
    t = F.element_at(F.array(*[F.lit(x) for x in ("c yes", "o no", "£ x", "☐ y", "q z", "R w", "", "❐", "\uf06f", "\uf0a3 a")]), (k % 10 + 1).cast("int"))
    font = F.element_at(F.array(*[F.lit(x) for x in ("Webdings", "Wingdings", "Wingdings 2", "Arial", "Symbol")]), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", Y.box_glyph(t, font).alias("box"))


def layout_colons(spark, sf_dir):
    t = F.concat(F.lit("Signed: Date: "), "c_mktsegment", F.lit(": x: Y"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(Y.split_colon_runs(t), "|").alias("labels"))


def layout_roles(spark, sf_dir):
    role = F.when(F.col("p_size") % 3 == 0, "print_name").when(F.col("p_size") % 3 == 1, "title").otherwise("dob")
    section = F.element_at(F.array(*[F.lit(x) for x in ("professional", "consultant", "witness", "patient")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", Y.resolve_role(role, section).alias("role"))


def layout_box_lines(spark, sf_dir):
    """Each box with the line nearest to its middle; lines stand 7 apart, boxes 20."""
    b = _boxes(spark, sf_dir).filter("box_id >= 0")
    top = b.groupBy("doc_id", "page").agg(F.max("y").alias("top"))
    lines = top.select("doc_id", "page", F.explode(F.sequence(F.lit(0), F.floor(F.col("top") / 7).cast("int") + 1)).alias("line")).select("doc_id", "page", "line", (F.col("line") * 7.0).alias("y"), F.concat(F.lit("l"), "line").alias("text"))
    return Y.box_lines(b, lines).select("box_id", "line", "text")


def layout_fonts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_quantity").alias("fs"))
    return Y.body_font_size(li)


def layout_missing(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat("l_returnflag", "l_linestatus").alias("role"))
    return Y.missing_roles(li, [["AF", "RF"], ["NO"], ["NF"]]).select("doc_id", F.array_join("missing", ",").alias("missing"))


def _boxes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    b = c.select(F.col("c_custkey").alias("box_id"), F.floor(F.col("c_custkey") / 40).alias("doc_id"), F.lit(1).alias("page"), ((F.col("c_custkey") % 4) * 100.0).alias("x"), (F.floor((F.col("c_custkey") % 40) / 4) * 20.0).alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"), (F.col("c_custkey") % 2 == 0).alias("glyph"))
    again = b.filter("box_id % 7 = 0").withColumn("box_id", -1 - F.col("box_id")).withColumn("x", F.col("x") + 1)
    return b.unionByName(again)


def layout_boxes(spark, sf_dir):
    """Pages whose options stand right of their boxes, left of them, or nowhere: grids."""
    b = Y.dedupe_boxes(_boxes(spark, sf_dir))
    kind = F.col("doc_id") % 3
    x = F.when(kind == 0, F.col("x") + 15).otherwise(F.col("x") - 40)
    p = _boxes(spark, sf_dir).filter("box_id >= 0").filter(kind < 2).select("doc_id", "page", x.alias("x0"), (x + 35).alias("x1"), (F.col("y") + 1).alias("y"), F.concat(F.lit("t"), "box_id").alias("text"))
    return Y.box_options(b, p).select("box_id", "option", "side", "grid")


def layout_grid(spark, sf_dir):
    """Headers of grids of 4 rows and 3 columns; every second page's upper header stands too far above the lower."""
    k = F.col("c_custkey")
    b = table(spark, sf_dir, "customer").select(
        k.alias("box_id"), F.floor(k / 12).alias("doc_id"), F.lit(1).alias("page"), (k % 3 * 100.0 + 200).alias("x"),
        (F.floor(k % 12 / 3) * 20.0).alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"),
    )
    col = F.floor((F.col("x") - 200) / 100)
    said = lambda line, x0, y, text: F.struct(line.cast("int").alias("line"), x0.alias("x0"), (x0 + 30).alias("x1"), y.cast("double").alias("line_y"), text.alias("text"))
    heads = b.select("doc_id", "page", F.inline(F.array(
        said(F.lit(1), F.col("x") - 10, F.lit(90), F.concat(F.lit("h"), col)), said(F.lit(0), F.col("x") - 10, F.when(F.col("doc_id") % 2 == 0, 110).otherwise(120), F.concat(F.lit("top"), col)),
        said(F.col("y") / 20 + 2, F.lit(0.0), F.col("y"), F.lit("row")),
    ))).distinct()
    p = heads.withColumn("fs", F.lit(10.0)).withColumn("phrase", F.col("x0").cast("long"))
    return Y.grid_headers(b, p).select("box_id", "header")


def layout_prompts(spark, sf_dir):
    """Pairs of boxes, yes and no, under a question, one too far above, or one that asks nothing."""
    k = F.col("c_custkey")
    b = table(spark, sf_dir, "customer").select(
        k.alias("box_id"), F.floor(k / 2).alias("doc_id"), F.lit(1).alias("page"), (k % 2 * 100.0 + 50).alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"),
        F.when(k % 7 == 0, "an option of five words").otherwise("Yes").alias("option"),
    )
    kind = F.col("doc_id") % 3
    said = lambda line, x0, y, text: F.struct(F.lit(line).alias("line"), F.lit(x0).alias("x0"), F.lit(x0 + 60).alias("x1"), y.cast("double").alias("line_y"), text.alias("text"))
    asked = F.concat(F.lit("Leaflet "), "doc_id", F.when(kind == 2, "").otherwise(" given?"))
    p = b.select("doc_id", "page").distinct().select("doc_id", "page", F.inline(F.array(said(1, 70.0, F.lit(0), F.lit("Yes")), said(0, 130.0, F.when(kind == 1, 30).otherwise(20), asked), said(0, 500.0, F.when(kind == 1, 30).otherwise(20), F.lit("aside")))))
    p = p.withColumn("fs", F.lit(10.0)).withColumn("phrase", F.col("x0").cast("long"))
    return Y.box_prompts(b, b.select("box_id", "option"), p)


def layout_fields(spark, sf_dir):
    b = _boxes(spark, sf_dir).filter("box_id >= 0")
    f = b.select(F.col("box_id").alias("field_id"), "doc_id", "page", (F.col("x") + 65).alias("x0"), (F.col("x") + 95).alias("x1"), "y")
    p = b.filter("box_id % 3 = 0").select("doc_id", "page", "x", F.col("x").alias("x0"), (F.col("x") + 60).alias("x1"), "y", F.concat(F.lit("l"), "box_id").alias("text")).drop("x")
    return Y.field_labels(f, p)


_W = "(SELECT DISTINCT w FROM (SELECT p_name AS w FROM part UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part) WHERE length(w) >= 3)"
_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_TOK = r"""t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(?:h1|title)\b[^>]*>.*?</(?:h1|title)>|<a\b[^>]*>.*?</a>')) AS raw, generate_subscripts(regexp_extract_all(html, '(?is)<(?:h1|title)\b[^>]*>.*?</(?:h1|title)>|<a\b[^>]*>.*?</a>'), 1) - 1 AS pos FROM pages),
k AS (SELECT page_id, pos, regexp_matches(raw, '(?i)^<a[^a-z]') AS link, trim(regexp_replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text, regexp_extract(raw, '(?i)\bhref\s*=\s*["'']?([^"''\s>]*)', 1) AS href FROM t),
l AS (SELECT *, last_value(CASE WHEN NOT link AND text <> '' AND length(text) <= 90 THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS grp FROM k)"""
_LN = r"""ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
c AS (SELECT doc_id, n, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM ln), o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS line_no, line FROM c WHERE line <> '')"""

_NAMED = """named AS (SELECT DISTINCT *, regexp_matches(named, '[.]xml$') AS is_index FROM (
  SELECT 'https://x/pages-' || page_id // 10 || '.xml' AS url, url || '?a=1&b=' || page_id AS named FROM pages UNION ALL SELECT 'https://x/pages-' || page_id // 10 || '.xml', 'https://x/top-' || page_id // 1000 || '.xml' FROM pages
  UNION ALL SELECT 'https://x/pages-' || page_id // 10 || '.xml', 'https://x/gone-' || page_id // 10 || '.xml' FROM pages WHERE page_id // 10 % 10 = 3
  UNION ALL SELECT 'https://x/mid-' || page_id // 100 || '.xml', 'https://x/pages-' || page_id // 10 || '.xml' FROM pages UNION ALL SELECT 'https://x/top-' || page_id // 1000 || '.xml', 'https://x/mid-' || page_id // 100 || '.xml' FROM pages))"""

QUERIES = {f.__name__: f for f in (
    match_keys, match_regimens, match_suggest, page_links, page_groups, page_urls, page_fingerprint, page_dates, page_titles, sitemap, sitemap_nested,
    layout_lines, layout_phrases, layout_labels, layout_leaders, layout_gaps, layout_blanks, layout_headings, layout_asked, layout_sections, layout_glyphs, layout_colons, layout_roles, layout_box_lines, layout_fonts, layout_missing, layout_boxes, layout_grid, layout_prompts, layout_fields,
)}
ORACLE = {
    "match_keys": f"SELECT w AS leaflet_id, {_NORM.format('w')} || CASE WHEN {_NORM.format('w')} <> lower(substr(w, 1, 4) || 'q') THEN '|' || {_NORM.format('''substr(w, 1, 4) || 'q' ''')} ELSE '' END AS keys, regexp_matches(w, '(?i)\\b(and|with)\\b') AS regimen FROM {_W}",
    "match_suggest": f"""WITH f AS (SELECT p_partkey AS form_id, {_NORM.format("p_brand || ' ' || p_type || ' ' || p_name")} AS t FROM part),
        k AS (SELECT w AS leaflet_id, {_NORM.format('w')} AS key, 0 AS key_ord, regexp_matches(w, '(?i)\\b(and|with)\\b') AS regimen FROM {_W} UNION ALL SELECT w, {_NORM.format("substr(w, 1, 4) || 'q'")}, 1, regexp_matches(w, '(?i)\\b(and|with)\\b') FROM {_W}),
        h AS (SELECT form_id, leaflet_id, regimen, key_ord, length(key) AS len, strpos(' ' || t || ' ', ' ' || key || ' ') - 1 AS pos FROM f JOIN k ON contains(' ' || t || ' ', ' ' || key || ' ')),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY form_id, leaflet_id ORDER BY len DESC, key_ord, pos) AS rn FROM h) WHERE rn = 1),
        s AS (SELECT * FROM b WHERE regimen OR NOT EXISTS (SELECT 1 FROM b o WHERE o.form_id = b.form_id AND o.len > b.len AND b.pos >= o.pos AND b.pos + b.len <= o.pos + o.len))
        SELECT form_id, rank, leaflet_id FROM (SELECT form_id, leaflet_id, cast(row_number() OVER (PARTITION BY form_id ORDER BY regimen DESC, pos, leaflet_id) AS INT) AS rank FROM s) WHERE rank <= 5""",
    "match_regimens": f"""WITH t AS (SELECT p_partkey, p_name AS a, CASE WHEN p_partkey % 3 = 0 THEN ' (' ELSE ' ' END || upper(substr(p_type, 1, 2)) || [{", ".join(f"'{e}'" for e in ENDS)}][p_partkey % 10 + 1] || CASE WHEN p_partkey % 3 = 0 THEN ')' ELSE '' END AS b FROM part),
        u AS (SELECT p_partkey, array_to_string(list_transform(string_split(a, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || b AS t FROM t)
        SELECT p_partkey, regexp_matches(regexp_replace(t, '\\(.*?\\)', '', 'g'), '\\b[A-Z][A-Z0-9-]{{2,}}\\b') OR regexp_matches(t, '(?i)\\b(and|with)\\b') OR contains(t, ' - ') AS regimen FROM u""",
    "page_links": f"WITH {_TOK} SELECT page_id, cast(pos AS INT) AS pos, text, href, grp AS \"group\" FROM l WHERE link AND coalesce(grp, '') NOT LIKE '%?'",
    "page_groups": f"WITH {_TOK} SELECT page_id, grp AS \"group\", count(*) AS n_links FROM l WHERE link GROUP BY ALL",
    "page_urls": f"""WITH {_TOK} SELECT page_id, cast(pos AS INT) AS pos, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^[a-zA-Z]+:') || href
        WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-zA-Z]+://[^/]+') || href ELSE regexp_replace(url, '([^:/])/[^/]*$', '\\1/') || href END AS target FROM l JOIN pages USING (page_id) WHERE link""",
    "page_fingerprint": r"""SELECT page_id, length(t) AS n_chars, CASE WHEN length(t) >= 400 THEN sha256(t) END AS sha FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[\s\x0B\x{85}\p{Z}]+', ' ', 'g')) AS t FROM pages)""",
    "page_dates": """WITH k AS (SELECT page_id, page_id % 5 AS r, ['January', 'May', 'September'][page_id % 3 + 1] AS m, page_id % 28 + 1 AS d, page_id % 30 + 1995 AS y FROM pages)
        SELECT page_id, CASE r WHEN 0 THEN d || ' ' || m || ' ' || y WHEN 1 THEN lpad(d::VARCHAR, 2, '0') || '/02/' || y WHEN 2 THEN m || ' ' || y END AS review,
        CASE r WHEN 0 THEN m || ' ' || (y + 3) WHEN 3 THEN d || '/11/' || (y % 100 + 10) END AS next_review, CASE r WHEN 0 THEN page_id % 7 || '.' || page_id % 4 WHEN 2 THEN (page_id % 9)::VARCHAR END AS version FROM k""",
    "page_titles": """SELECT p_partkey, 'The ' || upper(p_brand) || ' ' || lower(p_name) AS title FROM part""",
    "sitemap": f"WITH {_NAMED} SELECT url AS doc, named AS url, is_index FROM named WHERE NOT regexp_matches(named, 'gone-3[.]')",
    "sitemap_nested": f"""WITH RECURSIVE {_NAMED}, t(url, is_index, depth) AS (SELECT DISTINCT url, true, 0 FROM named WHERE url LIKE '%/top-%'
        UNION SELECT n.named, n.is_index, t.depth + 1 FROM t JOIN named n ON n.url = t.url WHERE t.depth < 4 AND (n.is_index OR regexp_matches(n.named, 'b=[0-9]*[0-8]$')))
        SELECT url, is_index, cast(min(depth) AS INT) AS depth, CASE WHEN is_index THEN url IN (SELECT url FROM named) END AS stored FROM t GROUP BY ALL""",
    "layout_lines": f"WITH {_LN} SELECT doc_id, cast(line_no AS INT) AS line, len(string_split(line, ' ')) AS n, length(line) * 5.0::DOUBLE AS right FROM o",
    "layout_phrases": f"WITH {_LN} SELECT doc_id, cast(line_no AS INT) AS line, 0 AS phrase, sha256(line) AS sha, 0.0::DOUBLE AS x0, length(line) * 5.0::DOUBLE AS x1 FROM o",
    "layout_labels": r"""WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS ln FROM documents),
        c AS (SELECT doc_id, ln, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(raw, '\s+', ' ', 'g'))), '[:*]+$', ''), '\s*\(.*?optional.*?\)$', '')) AS t FROM ln)
        SELECT * FROM (SELECT doc_id, ln, CASE WHEN t = '' OR length(t) > 110 THEN NULL WHEN regexp_matches(t, '^the (and|of)') THEN 'date' WHEN regexp_matches(t, '^(is|in) ') THEN 'name' WHEN regexp_matches(t, '^[a-m]') THEN 'other' END AS role FROM c) WHERE role IS NOT NULL""",
    "layout_leaders": """SELECT c_custkey AS doc_id, 'Name ' AS str, 0.0::DOUBLE AS x0, 25.0::DOUBLE AS x1, false AS leader FROM customer UNION ALL SELECT c_custkey, '______', 25.0, 55.0, true FROM customer
        UNION ALL SELECT c_custkey, ' ' || c_mktsegment, 55.0, 60.0 + 5 * length(c_mktsegment), false FROM customer UNION ALL SELECT c_custkey, '....', 60.0 + 5 * length(c_mktsegment), 80.0 + 5 * length(c_mktsegment), true FROM customer""",
    "layout_gaps": """WITH w AS (SELECT p_partkey AS doc_id, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part),
        g AS (SELECT *, length(lag(w) OVER o) % 4 * 4 AS gap, sum(length(w) * 5 + length(w) % 4 * 4) OVER o - length(w) * 5 - length(w) % 4 * 4 AS x FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        n AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 9 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS phrase FROM g)
        SELECT doc_id, cast(0 AS INT) AS line, cast(phrase AS BIGINT) AS phrase, trim(string_agg(CASE WHEN gap IN (4, 8) THEN ' ' ELSE '' END || w, '' ORDER BY i)) AS text, min(x)::DOUBLE AS x0, max(x + length(w) * 5)::DOUBLE AS x1 FROM n GROUP BY doc_id, phrase""",
    "layout_blanks": """SELECT c_custkey AS doc_id, 0.0::DOUBLE AS x0, (c_custkey % 10 + 20)::DOUBLE AS x1 FROM customer WHERE c_custkey % 10 < 6 UNION ALL SELECT c_custkey, 100.0, (c_custkey % 8 + 108)::DOUBLE FROM customer WHERE c_custkey % 8 >= 4""",
    "layout_headings": """SELECT p_partkey AS doc_id, p_size::DOUBLE AS y, CASE WHEN p_size = 1 THEN 'consultant' ELSE ['professional', 'patient', 'interpreter', 'parent', 'confirmation', NULL, 'professional', 'witness', NULL][p_partkey % 9 + 1] END AS section
        FROM part WHERE p_size = 1 OR p_size <> 2 AND p_partkey % 9 NOT IN (5, 8)""",
    "layout_asked": """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 12 IN (5, 8, 9) THEN NULL ELSE ['dob', 'nhs', 'surname', 'forenames', 'patient_name', 'hospital', 'identifier', 'title', 'print_name', 'patient_label', 'consultant', NULL][c_custkey % 12 + 1] END AS role FROM customer""",
    "layout_sections": """WITH h AS (SELECT o_orderkey // 40 AS doc_id, o_orderkey % 4 AS page, o_orderkey::DOUBLE AS y, o_orderkey % 3 * 50.0 AS x, 's' || o_orderkey AS section FROM orders),
        s AS (SELECT c_custkey AS spot_id, c_custkey // 4 AS doc_id, c_custkey % 5 AS page, c_custkey * 10.0 AS y, c_custkey % 3 * 50.0 + 20 AS x FROM customer),
        a AS (SELECT spot_id, arg_min(section, h.y) FILTER (abs(h.x - s.x) < 60) AS s1, arg_min(section, h.y) AS s2 FROM s JOIN h ON h.doc_id = s.doc_id AND h.page = s.page AND h.y >= s.y - 1 GROUP BY 1),
        b AS (SELECT spot_id, arg_min(section, (-h.page) * 1e12 + h.y) AS s3 FROM s JOIN h ON h.doc_id = s.doc_id AND h.page < s.page GROUP BY 1)
        SELECT s.spot_id, coalesce(s1, s2, s3) AS section FROM s LEFT JOIN a USING (spot_id) LEFT JOIN b USING (spot_id)""",
    "layout_glyphs": """SELECT c_custkey, CASE c_custkey % 10 WHEN 3 THEN true WHEN 7 THEN true WHEN 8 THEN true WHEN 9 THEN true WHEN 0 THEN c_custkey % 5 = 0 WHEN 1 THEN c_custkey % 5 = 1 WHEN 2 THEN c_custkey % 5 = 2 WHEN 4 THEN c_custkey % 5 = 1 ELSE false END AS box FROM customer""",
    "layout_colons": "SELECT c_custkey, 'Signed:|Date:|' || c_mktsegment || ': x:|Y' AS labels FROM customer",
    "layout_roles": """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN CASE p_partkey % 4 WHEN 0 THEN 'clin_name' WHEN 1 THEN 'consultant' END WHEN 1 THEN CASE p_partkey % 4 WHEN 0 THEN 'clin_role' WHEN 1 THEN 'consultant_role' END
        ELSE CASE WHEN p_partkey % 4 <> 2 THEN 'dob' END END AS role FROM part""",
    "layout_box_lines": """WITH b AS (SELECT c_custkey AS box_id, (c_custkey % 40) // 4 * 20 AS y FROM customer), m AS (SELECT box_id, cast(floor((y + 5) / 7.0) AS INT) AS k, y + 5 AS mid FROM b),
        r AS (SELECT box_id, CASE WHEN abs(k * 7 - mid) <= abs((k + 1) * 7 - mid) THEN k ELSE k + 1 END AS line FROM m) SELECT box_id, line, 'l' || line AS text FROM r""",
    "layout_fonts": "SELECT l_suppkey AS doc_id, list_sort(list(l_quantity))[cast(floor(count(*) / 2) AS INT) + 1] AS fs FROM lineitem GROUP BY 1",
    "layout_missing": """SELECT l_orderkey AS doc_id, concat_ws(',', CASE WHEN NOT bool_or(l_returnflag || l_linestatus IN ('AF', 'RF')) THEN 'AF' END, CASE WHEN NOT bool_or(l_returnflag || l_linestatus = 'NO') THEN 'NO' END,
        CASE WHEN NOT bool_or(l_returnflag || l_linestatus = 'NF') THEN 'NF' END) AS missing FROM lineitem GROUP BY 1""",
    "layout_boxes": """SELECT c_custkey AS box_id, CASE WHEN c_custkey // 40 % 3 < 2 THEN 't' || c_custkey ELSE '' END AS option, CASE WHEN c_custkey // 40 % 3 = 1 THEN 'left' ELSE 'right' END AS side,
        c_custkey // 40 % 3 = 2 AND count(*) OVER (PARTITION BY c_custkey // 4) >= 3 AS grid FROM customer""",
    "layout_grid": "SELECT c_custkey AS box_id, CASE WHEN c_custkey // 12 % 2 = 0 THEN 'top' || c_custkey % 3 || ' ' ELSE '' END || 'h' || c_custkey % 3 AS header FROM customer",
    "layout_prompts": "SELECT c_custkey AS box_id, 'Leaflet ' || c_custkey // 2 || ' given?' AS prompt FROM customer WHERE c_custkey // 2 % 3 = 0 AND c_custkey % 7 <> 0",
    "layout_fields": """WITH b AS (SELECT c_custkey AS id, c_custkey // 40 AS d, (c_custkey % 40) // 4 AS r, c_custkey % 4 AS x FROM customer)
        SELECT b.id AS field_id, 'l' || arg_max(p.id, p.x) AS label FROM b LEFT JOIN b p ON p.d = b.d AND p.r = b.r AND p.id % 3 = 0 AND p.x <= b.x AND b.x * 100 + 65 - p.x * 100 - 60 <= 320 GROUP BY b.id""",
}
