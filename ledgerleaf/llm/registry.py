"""Queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.tables import table
from .common import reliable
from . import alignment, collocations, decontaminate, linededup, media, mixing, packing, pii, quality, secrets, simhash, tokens, toxicity


def op1_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark, sf_dir):
    """n_lines, n_dropped and the digest of the lines kept, of every document."""
    kept = linededup.apply_bitmaps(linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return kept.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_secrets(spark, sf_dir):
    """Secrets of every document; its owner is ``source``, its repository ``source/lang``, as the table has no other."""
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source")))


def op7_media(spark, sf_dir):
    return media.stored_texts(table(spark, sf_dir, "documents"))


def op8_pii(spark, sf_dir):
    """Personal data of every document, and the digest of its text without them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = reliable(pii.find(docs))
    clean = pii.sanitised(docs.withColumn("at", F.xxhash64(F.coalesce("text", F.lit("")))), found)
    clean = clean.select(F.col("doc_id").alias("id"), F.col("at").alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sanitised_sha256")).distinct()
    told = pii.digest(found)
    return told.join(clean, told["doc_id"].eqNullSafe(clean["id"]) & (told["at"] == clean["row"])).drop("at", "id", "row")


def op9_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark, sf_dir):
    """Perplexity, limit and verdict of every document; trusted are those labelled of quality 1."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    scored = quality.classify(table(spark, sf_dir, "documents"), trusted)
    return scored.select("doc_id", "lang", "n_symbols", "perplexity", "threshold", "keep")


def op11_collocations(spark, sf_dir):
    """The first 2000 phrases of each language, by score."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_alignment(spark, sf_dir):
    """Links between the tokens of two vocabularies, added up for every document."""
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_mixing(spark, sf_dir):
    """Words of every document that the mix takes, and where in training; in the order of their first places, those not taken last."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    places = F.transform("pieces", lambda p: p["position"]).alias("positions")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", places).orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id")


LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, list_extract(parts, pos) AS line,
         translate(regexp_replace(list_extract(parts, pos), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, (c.key IS NOT NULL AND c.keeper <> l.doc_id) AS lost
  FROM lines l LEFT JOIN common c ON l.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


COLLOCATIONS_SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts)
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k) GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, g, f, string_split(g, ' ') AS w FROM grams WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT lang, k, g, f, c, array_to_string(w[1:c], ' ') AS p, array_to_string(w[c + 1:], ' ') AS q
  FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates)
), scored AS (
  SELECT c.lang, c.g, c.f AS a, c.c, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN grams x ON c.lang = x.lang AND c.p = x.g JOIN grams y ON c.lang = y.lang AND c.q = y.g
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1
), longer AS (
  SELECT lang, g, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS g FROM candidates WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longer o ON b.lang = o.lang AND b.g = o.g WHERE o.f IS NULL OR 100 * o.f < 50 * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept
)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


#: In the operators' order.
QUERIES = (op1_token_counts, op2_toxicity, op3_packing, op4_line_dedup, op5_simhash, op6_secrets, op7_media, op8_pii, op9_decontamination, op10_quality, op11_collocations, op12_alignment, op13_mixing)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": LINE_DEDUP_SQL, "op11_collocations": COLLOCATIONS_SQL}
