"""Queries over the literature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import literature as L
from ..operators import terms as T
from .tables import table

AS_OF = "DATE '2024-12-31'"
SEARCH = {"all": [{"any": ["the", "tion*"]}, {"not": "worthless"}]}
TOPICS = {
    "common": {"any": ["the", "and"]},
    "stem": "tion*",
    "phrase": "of the",
    "accented": {"any": ["étre*", "que"]},
    "german": {"all": ["der", {"any": ["die", "das"]}]},
    "spanish": {"all": ["de", "que", {"not": "la"}]},
}
#: Terms whose places are counted: words, phrases, stems.
PLACED = ["the", "of the", "with", "from the", "der", "que", "en*", "wh*", "it is on*", "étre*", "and th*"]
JOURNALS = [(0, "Src1 Annals", "Ann", "blue"), (1, "Src Letters", "Let", "red"), (2, "src12 Review", "Rev", "green"), (3, "Other", "Oth", "grey")]


def _docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.withColumn("pub_date", F.expr("date_add(DATE '2024-01-01', cast(doc_id % 365 AS INT))"))


def lit_search_latest(spark, sf_dir):
    hits = _docs(spark, sf_dir).filter(L.text_predicate(SEARCH, F.col("text"))).filter(L.published_within(F.col("pub_date"), 180, F.expr(AS_OF)))
    return L.latest(hits.select("doc_id", "lang", "pub_date"), "pub_date", "doc_id", 40)


def lit_topic_membership(spark, sf_dir):
    return T.topic_membership(table(spark, sf_dir, "documents"), TOPICS, "text", "doc_id")


def lit_topic_counts(spark, sf_dir):
    return lit_topic_membership(spark, sf_dir).groupBy("topic").agg(F.count("*").alias("n"))


def lit_term_places(spark, sf_dir):
    """How often each of a list of terms occurs, and at which word at the earliest."""
    found = T.find_terms(table(spark, sf_dir, "documents"), PLACED, "text", "doc_id", positions=True)
    return found.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first"))


def lit_near(spark, sf_dir):
    """Documents in which two terms begin at most six words apart."""
    return T.near(table(spark, sf_dir, "documents"), "with", "from the", 6, "text", "doc_id")


def lit_journal_index(spark, sf_dir):
    """Pages' hosts and paths as journals of articles, customers' and suppliers' names as the dimension: as many names on either side as the tables have."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.lit(" "), F.col("p_partkey") % 1000).alias("journal"))
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.concat(F.substring(F.md5("c_name"), 1, 2), F.lit("-"), F.col("c_custkey") % 1000, F.lit(" "), "c_name").alias("name"))
    s = s.unionByName(table(spark, sf_dir, "part").select((F.col("p_partkey") + 100_000_000).alias("ord"), F.concat(F.substring(F.element_at(F.split("p_name", " "), -1), 2, 4), F.lit(" x")).alias("name")))
    return L.tag_journal(p, s.select("ord", "name", F.col("name").alias("short"), F.lit("c").alias("color")), "doc_id").select("doc_id", "short")


def _typed(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    types = F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit("review")), F.when(F.col("quality") == 0, F.lit("guideline")), F.when(F.col("toxic") == 1, F.lit("letter"))))
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(lab, "doc_id").select("doc_id", "source", types.alias("types"))


def lit_type_filter(spark, sf_dir):
    t = _typed(spark, sf_dir).filter(L.publication_type(F.col("types"), ["guideline", "letter"]) & L.journal_in(F.col("source"), ["src1", "src2", "src3"]))
    return t.select("doc_id", "source", F.array_join("types", "; ").alias("type"))


def _articles(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    names = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: F.struct(x["c_name"].alias("name")))
    by = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(names.alias("authors"))
    ids = F.array(F.struct(F.lit("pii").alias("idtype"), F.lit("x").alias("value")), F.struct(F.lit("doi").alias("idtype"), F.concat(F.lit("10.1/"), "n_nationkey").alias("value")))
    return n.join(by, "n_nationkey").select(
        F.col("n_nationkey").cast("string").alias("pmid"), F.when(F.col("n_nationkey") % 9 == 8, "").otherwise(F.concat("n_name", F.lit("."))).alias("title"),
        F.concat(F.lit("src"), "n_regionkey").alias("source"), F.lit("2024 Jan").alias("pubdate"), "authors",
        F.when(F.col("n_nationkey") % 2 == 0, ids).otherwise(F.slice(ids, 1, 1)).alias("articleids"), F.array(F.lit("Review"), F.lit("Journal Article")).alias("pubtype"),
    )


def lit_article_summary(spark, sf_dir):
    return L.summarise_articles(_articles(spark, sf_dir)).withColumn("high_impact", L.high_impact(F.col("journal"), ["src1", "src3"]))


def lit_citation(spark, sf_dir):
    s = L.summarise_articles(_articles(spark, sf_dir))
    return s.select("pmid", L.citation(s).alias("citation"))


def lit_journal_tag(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("journal"))
    j = spark.createDataFrame(JOURNALS, "ord int, name string, short string, color string")
    return L.tag_journal(d, j, "doc_id")


def lit_feed_sort(spark, sf_dir):
    d = _docs(spark, sf_dir).filter(L.filter_any(["source", "lang"], "SRC1"))
    return L.sort_feed(d.select("doc_id", "source", "pub_date"), "journal", "pub_date", "source", "doc_id").limit(80)


def lit_presets(spark, sf_dir):
    """Suppliers as journals, nations as categories."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("key"), F.concat(F.lit("c"), "s_nationkey").alias("category"), (F.col("s_suppkey") % 3 == 0).alias("default_on"))
    return L.journal_presets(s).select("preset", F.array_join("keys", "|").alias("keys"))


def lit_days_ago(spark, sf_dir):
    """Documents of the 90 days up to a day."""
    from ..functions.columns import days_ago

    return _docs(spark, sf_dir).filter(F.col("pub_date") >= days_ago(90, F.expr(AS_OF))).groupBy("lang").agg(F.count("*").alias("n"))


def lit_feed_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("journal"), "lang").agg(F.count("*").alias("n"))


def lit_abstract(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return L.assemble_abstract(c.select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("label"), "text"), "conv_id")


def _term(text: str) -> str:
    body = text.rstrip("*")
    tail = r"[\p{L}\p{N}_]*" if text.endswith("*") else ""
    return rf"regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_]){body}{tail}([^\p{{L}}\p{{N}}_]|$)')"


def _sql(spec) -> str:
    if isinstance(spec, str):
        return _term(spec)
    (kind, value), = spec.items()
    if kind == "not":
        return f"NOT {_sql(value)}"
    return "(" + {"any": " OR ", "all": " AND "}[kind].join(map(_sql, value)) + ")"


_MEMBERS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS topic FROM documents WHERE {_sql(v)}" for k, v in TOPICS.items())
_ARTICLES = """
  SELECT cast(n_nationkey AS VARCHAR) AS pmid, CASE WHEN n_nationkey % 2 = 0 THEN '10.1/' || n_nationkey ELSE '' END AS doi, n_name AS title,
         array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ' et al.' ELSE '' END AS authors_short,
         array_to_string(names, ', ') AS authors_full, 'src' || n_regionkey AS journal, '2024 Jan' AS date, 'Review; Journal Article' AS type
  FROM nation JOIN (SELECT c_nationkey, list(c_name ORDER BY c_custkey) AS names FROM customer GROUP BY 1) ON n_nationkey = c_nationkey
  WHERE n_nationkey % 9 <> 8"""
_DOCS = "(SELECT *, DATE '2024-01-01' + cast(doc_id % 365 AS INT) AS pub_date FROM documents)"
_J = ", ".join(f"({o}, '{n}', '{s}', '{c}')" for o, n, s, c in JOURNALS)

QUERIES = {f.__name__: f for f in (
    lit_search_latest, lit_topic_membership, lit_topic_counts, lit_term_places, lit_near, lit_journal_index, lit_type_filter, lit_article_summary, lit_citation, lit_journal_tag, lit_feed_sort, lit_presets, lit_days_ago, lit_feed_counts, lit_abstract,
)}
ORACLE = {
    "lit_search_latest": f"SELECT doc_id, lang, pub_date FROM {_DOCS} WHERE {_sql(SEARCH)} AND pub_date >= {AS_OF} - 180 ORDER BY pub_date DESC, doc_id LIMIT 40",
    "lit_topic_membership": _MEMBERS,
    "lit_topic_counts": f"SELECT topic, count(*) AS n FROM ({_MEMBERS}) GROUP BY topic",
    "lit_term_places": f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS k FROM documents),
        w AS (SELECT doc_id, k, unnest(range(1, len(k) + 1)) AS i, CASE WHEN regexp_matches(k[1], '^[\\p{{L}}\\p{{N}}_]') THEN 1 ELSE 2 END AS lead FROM t),
        x AS (SELECT doc_id, (i - lead) // 2 AS pos, k[i] AS one, array_to_string(k[i:i + 2], '') AS two, array_to_string(k[i:i + 4], '') AS three, len(k) - i AS more FROM w WHERE (i - lead) % 2 = 0)
        SELECT doc_id, term, count(*) AS n, min(pos) AS first FROM x JOIN (VALUES {", ".join(f"('{t}', '{t.rstrip('*')}', {t.endswith('*')}, {len(t.split())})" for t in PLACED)}) v(term, body, stem, words)
          ON CASE words WHEN 1 THEN CASE WHEN stem THEN starts_with(one, body) ELSE one = body END WHEN 2 THEN more >= 2 AND CASE WHEN stem THEN starts_with(two, body) ELSE two = body END
             ELSE more >= 4 AND CASE WHEN stem THEN starts_with(three, body) ELSE three = body END END GROUP BY doc_id, term""",
    "lit_near": """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+') AS k FROM documents),
        w AS (SELECT doc_id, k, unnest(range(1, len(k) + 1)) AS i, CASE WHEN regexp_matches(k[1], '^[\\p{L}\\p{N}_]') THEN 1 ELSE 2 END AS lead FROM t),
        x AS (SELECT doc_id, (i - lead) // 2 AS pos, k[i] AS one, array_to_string(k[i:i + 2], '') AS two FROM w WHERE (i - lead) % 2 = 0)
        SELECT DISTINCT a.doc_id FROM x a JOIN x b USING (doc_id) WHERE a.one = 'with' AND b.two = 'from the' AND abs(a.pos - b.pos) <= 6""",
    "lit_journal_index": """WITH a AS (SELECT p_partkey AS doc_id, lower(p_name || ' ' || p_partkey % 1000) AS journal FROM part),
        j AS (SELECT c_custkey AS ord, substr(md5(c_name), 1, 2) || '-' || c_custkey % 1000 || ' ' || c_name AS name FROM customer UNION ALL SELECT p_partkey + 100000000, substr(string_split(p_name, ' ')[-1], 2, 4) || ' x' FROM part),
        d AS (SELECT journal, split_part(journal, ' ', 1) AS w FROM (SELECT DISTINCT journal FROM a)), e AS (SELECT lower(name) AS name, split_part(lower(name), ' ', 1) AS w, min(ord) AS ord FROM j GROUP BY ALL),
        m AS (SELECT journal, min(ord) AS ord FROM d JOIN e ON contains(journal, e.w) OR contains(e.name, d.w) GROUP BY journal)
        SELECT doc_id, name AS short FROM a LEFT JOIN m USING (journal) LEFT JOIN j USING (ord)""",
    "lit_type_filter": """SELECT doc_id, source, CASE WHEN quality = 1 THEN 'review; letter' WHEN toxic = 1 THEN 'guideline; letter' ELSE 'guideline' END AS type
        FROM documents JOIN labels USING (doc_id) WHERE (quality = 0 OR toxic = 1) AND source IN ('src1', 'src2', 'src3')""",
    "lit_article_summary": f"SELECT *, (journal LIKE '%src1%' OR journal LIKE '%src3%') AS high_impact FROM ({_ARTICLES})",
    "lit_citation": f"SELECT pmid, authors_full || '. ' || title || '. ' || journal || '. ' || date || '. PMID: ' || pmid || CASE WHEN doi <> '' THEN '. doi:' || doi ELSE '' END || '.' AS citation FROM ({_ARTICLES})",
    "lit_journal_tag": f"""WITH j(ord, name, short, color) AS (VALUES {_J}), m AS (
        SELECT doc_id, source AS journal, min(ord) AS ord FROM documents JOIN j ON contains(lower(source), split_part(lower(name), ' ', 1)) OR contains(lower(name), split_part(lower(source), ' ', 1)) GROUP BY ALL)
        SELECT d.doc_id, d.source AS journal, j.short, j.color FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id LEFT JOIN j ON m.ord = j.ord""",
    "lit_feed_sort": f"SELECT doc_id, source, pub_date FROM {_DOCS} WHERE contains(lower(source || ' ' || lang), 'src1') ORDER BY source, pub_date DESC, doc_id LIMIT 80",
    "lit_presets": """WITH s AS (SELECT s_suppkey AS o, s_name AS k, 'c' || s_nationkey AS c FROM supplier), a AS (SELECT 'all' AS preset, * FROM s UNION ALL SELECT c, * FROM s UNION ALL SELECT 'default', * FROM s WHERE o % 3 = 0)
        SELECT preset, string_agg(k, '|' ORDER BY o) AS keys FROM a GROUP BY preset""",
    "lit_days_ago": f"SELECT lang, count(*) AS n FROM {_DOCS} WHERE pub_date >= {AS_OF} - 90 GROUP BY lang",
    "lit_feed_counts": "SELECT source AS journal, lang, count(*) AS n FROM documents GROUP BY ALL",
    "lit_abstract": """SELECT conv_id, CASE WHEN a = '' THEN 'No abstract.' ELSE a END AS abstract FROM (
        SELECT conv_id, string_agg(CASE WHEN coalesce(role, '') <> '' THEN role || ': ' || text ELSE text END, chr(10) || chr(10) ORDER BY turn) AS a FROM conversations GROUP BY conv_id)""",
}
