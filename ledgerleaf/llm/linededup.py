"""Removal of lines that many documents share, by range-partitioned hashes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, reliable, shuffle_partitions, text_or_empty


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\f\r")), UPPER, LOWER)


def line_hashes(df: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each line with a key of at least ``min_chars``: h1, h2 (128 bits of its key), doc, row, pos.

    ``row`` is a hash of the whole text: it tells apart different texts under one id. Texts are split
    in a projection that the scan feeds, so that only hashes and positions go on.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = df.filter(F.col(id_col).isNotNull() & (F.length(text_col) >= min_chars)).select(
        F.col(id_col).alias("doc"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")
    )
    return (
        lines.filter(F.length("line") >= min_chars)
        .withColumn("key", line_key(F.col("line")))
        .filter(F.length("key") >= min_chars)
        .select(F.xxhash64(F.lit(7), "key").alias("h1"), F.xxhash64("key").alias("h2"), "doc", "row", "pos")
    )


def _runs(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by (h1, h2, doc descending): number of the hash's run, of the document in it (from 0), run starts."""
    h1, h2, doc = (pdf[c].to_numpy() for c in ("h1", "h2", "doc"))
    new = np.ones(len(pdf), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    other = new.copy()
    other[1:] |= doc[1:] != doc[:-1]
    run, starts, docs = np.cumsum(new) - 1, np.flatnonzero(new), np.cumsum(other) - 1
    return run, docs - docs[starts][run], starts


def edge_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a sorted partition, its first and last hash: documents and largest document there. Two rows at most."""
    found: list[list] = []  # [h1, h2, documents, largest, last document seen]
    for pdf in batches:
        if not len(pdf):
            continue
        _, nth, starts = _runs(pdf)
        ends = np.append(starts[1:], len(pdf)) - 1
        for k in dict.fromkeys((0, len(starts) - 1)):
            a, z = starts[k], ends[k]
            row = [int(pdf[c].iat[a]) for c in ("h1", "h2")] + [int(nth[z]) + 1, pdf["doc"].iat[a], pdf["doc"].iat[z]]
            if found and k == 0 and found[-1][:2] == row[:2]:
                last = found[-1]
                last[2] += row[2] - (last[4] == row[3])
                last[4] = row[4]
            else:
                found.append(row)
        del found[1:-1]
    if found:
        yield pd.DataFrame([r[:4] for r in found], columns=["h1", "h2", "n_docs", "keeper"])


def dropped_lines(batches: Iterator[pd.DataFrame], edges: dict[tuple[int, int], tuple[int, object]], min_docs: int) -> Iterator[pd.DataFrame]:
    """Stream a sorted partition: the first document of a hash keeps its lines, the others lose theirs once
    ``min_docs`` documents are seen. ``edges`` has the totals of hashes that go past a partition's ends.

    Held between batches: the lines of the last hash's first ``min_docs`` - 1 documents, or only the
    fact that it is common.
    """
    held, common = None, None  # rows of the unfinished hash; (h1, h2) of an unfinished hash known to be common
    for pdf in batches:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
            held = None
        if not len(pdf):
            continue
        run, nth, starts = _runs(pdf)
        n_runs = len(starts)
        ends = np.append(starts[1:], len(pdf)) - 1
        enough, first = nth[ends] + 1 >= min_docs, pdf["doc"].to_numpy()[starts].copy()
        keep_first = np.ones(n_runs, bool)
        heads = list(zip(pdf["h1"].to_numpy()[starts].tolist(), pdf["h2"].to_numpy()[starts].tolist(), strict=True))
        if common == heads[0]:
            enough[0], keep_first[0] = True, False
        for k in dict.fromkeys((0, n_runs - 1)):
            if heads[k] in edges:
                total, keeper = edges[heads[k]]
                enough[k], first[k], keep_first[k] = total >= min_docs, keeper, True
        lost = enough[run] & ~((pdf["doc"].to_numpy() == first[run]) & keep_first[run])
        last = n_runs - 1
        common = None
        if heads[last] not in edges:
            if enough[last]:
                common = heads[last]  # its keeper has gone by
            else:
                held = pdf.iloc[starts[last] :]
                lost[starts[last] :] = False
        if lost.any():
            yield pdf.loc[lost, ["doc", "row", "pos"]]


def keep_bitmap(n_lines: int, dropped: np.ndarray) -> bytes:
    """A compressed bitmap, a bit for each line: 1 keeps it."""
    bits = np.ones(n_lines, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def kept_lines(lines: list[str], bitmap: bytes | None) -> list[str]:
    """The lines that a bitmap keeps; all where there is none."""
    if bitmap is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    return [line for line, bit in zip(lines, bits.tolist(), strict=True) if bit]


def line_bitmaps(
    df: DataFrame, min_chars: int = 40, min_docs: int = 5, rows_each: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Lines lost by the documents that lose some: doc, row (hash of the whole text), lost (array of positions).

    A key of ``min_chars`` code points or more that ``min_docs`` documents hold keeps its lines in the
    largest id only. Hashes are range-partitioned by (hash, document), about ``rows_each`` to a partition or less, and sorted by hash, document
    (largest first) and position, so a line that a third of all documents hold goes over many
    partitions; each partition's first and last hash are summed up beforehand (two rows a partition).

    Ids may be numbers or texts (compared by code points). Rows with a null id hold no line and lose none; null and empty texts hold one
    empty line. Rows that repeat an id count as one document; equal rows lose equal lines. An empty
    table gives an empty result. Other columns are ignored.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    hashes = reliable(line_hashes(df, min_chars, id_col, text_col))  # else the sample for the ranges splits all texts once more
    order = ["h1", "h2", F.desc("doc"), "pos"]
    parts = max(shuffle_partitions(spark), -(-hashes.count() // rows_each))
    ranged = reliable(hashes.repartitionByRange(parts, "h1", "h2", F.desc("doc")).sortWithinPartitions(*order))
    ends = ranged.select("h1", "h2", "doc").mapInPandas(edge_hashes, f"h1 long, h2 long, n_docs long, keeper {kind}").collect()
    edges: dict[tuple[int, int], tuple[int, object]] = {}
    for r in ends:
        n, keeper = edges.get((r["h1"], r["h2"]), (0, r["keeper"]))
        edges[r["h1"], r["h2"]] = (n + r["n_docs"], max(keeper, r["keeper"]))
    shared = spark.sparkContext.broadcast(edges)
    lost = ranged.mapInPandas(lambda batches: dropped_lines(batches, shared.value, min_docs), f"doc {kind}, row long, pos int")
    return lost.groupBy("doc", "row").agg(F.collect_set("pos").alias("lost"))


def dedup_lines(
    df: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", into: str = "line_dedup"
) -> DataFrame:
    """The rows of ``df``, whole, with a last column ``into``: n_lines, n_dropped and keep (bitmap; null: all stay). See ``line_bitmaps``.

    Only rows that lose lines have a bitmap, so the join needs their texts and the bitmaps together. An
    own column of the name ``into`` gives way to it; all others stay as they are, whatever their names.
    """
    lost = line_bitmaps(df, min_chars, min_docs, id_col=id_col, text_col=text_col).select(F.col("doc").alias("lost_doc"), F.col("row").alias("lost_row"), "lost")

    @F.pandas_udf("binary")
    def bitmap(n_lines: pd.Series, lost: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else keep_bitmap(n, np.asarray(x, np.int64)) for n, x in zip(n_lines, lost, strict=True)])

    text = text_or_empty(text_col)
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != into]).alias("own"), F.col(id_col).alias("own_id"), F.xxhash64(text).alias("own_row"))
    joined = own.join(lost, (F.col("own_id") == F.col("lost_doc")) & (F.col("own_row") == F.col("lost_row")), "left")
    lines = F.size(F.split(F.coalesce(F.col("own")[text_col].cast("string"), F.lit("")), "\n", -1))
    added = F.struct(lines.cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"), bitmap(lines, "lost").alias("keep"))
    return joined.select("own.*", added.alias(into))


def apply_bitmaps(df: DataFrame, text_col: str = "text", of: str = "line_dedup") -> DataFrame:
    """``dedup_lines``'s rows with the text cut down to the lines kept; other columns stay, also ``of``."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, keep: pd.Series) -> pd.Series:
        return pd.Series([t if k is None or t is None else "\n".join(kept_lines(t.split("\n"), k)) for t, k in zip(text, keep, strict=True)], dtype=object)

    return df.withColumn(text_col, cut(F.col(text_col).cast("string"), F.col(of)["keep"]))
