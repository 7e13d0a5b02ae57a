"""SimHash fingerprints and their links by covering locality-sensitive hashing."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import counted, give_back, per_text, reliable, text_or_empty, with_id_type
from .components import components

#: A-Z lower-cased, byte by byte; UTF-8's other bytes stay.
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingles whose bits are summed at a time.
BLOCK = 65_536


def shingle_hashes(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of the text's word shingles, repeats included; fewer words are one shingle, none are no shingle."""
    canon = b" ".join(text.encode().translate(LOWERED).split())  # splits at space and TAB to CR
    if not canon:
        return np.zeros(0, "<u8")
    ends = np.append(np.flatnonzero(np.frombuffer(canon, np.uint8) == 32), len(canon))
    starts = np.append(0, ends[:-1] + 1)
    k = min(words, len(ends))
    starts, ends = starts[: len(starts) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(canon[a:z], seed) for a, z in zip(starts, ends, strict=True)], "<u8")


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """64 bits; a bit is 1 if set in over half the XXH64 values of the text's word shingles."""
    hashes, counts = shingle_hashes(text, words, seed), np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        h = hashes[at : at + BLOCK]
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprints(df: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp: the fingerprint's 64 bits as a signed long. A null text has no words, so fingerprint 0."""

    def rows(key, text):
        fp = fingerprint(text, words, seed)
        return [(key, fp - (fp >> 63 << 64))]

    return per_text(df, rows, with_id_type(df, "fp long", id_col), id_col, text_col)


def masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks; any two fingerprints within ``radius`` bits agree under one of them.

    Bit i stands at the non-zero vector v(i) of radius+1 bits, in turn. Mask u (not 0) holds the bits
    with an odd inner product of u and v(i). At most ``radius`` differing bits span less than the
    whole space, so some u is orthogonal to all of them: that mask holds no differing bit.
    """
    size = 1 << (radius + 1)
    point = [i % (size - 1) + 1 for i in range(64)]
    return [sum(1 << i for i in range(64) if (u & point[i]).bit_count() & 1) for u in range(1, size)]


def signed(x: int) -> int:
    return x - (x >> 63 << 64)


def bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, radius: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """Links a < b between distinct fingerprints (column fp) that connect all within ``radius`` bits (1 or 2).

    With ``by``, only fingerprints of equal columns ``by`` are compared, and links carry these.
    Every pair within the radius shares the masked value of a table. Values held by two fingerprints
    give their pair, checked by its bits. For values held by more, each member is listed under itself
    and its one-bit changes outside the mask: two members within two bits share such a neighbour, and
    all that share one are within two bits of each other, so a star over them (at most 65) says all.
    With radius 1, members and neighbours are told apart instead. No pairs of a group are spelled out,
    whatever its size.
    """
    if radius not in (1, 2):
        raise ValueError("radius 1 or 2")
    tables, by = masks(radius), [*by]
    table = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("v")) for k, m in enumerate(tables)])
    keyed = fps.select(*by, "fp", F.explode(table).alias("k")).select(*by, "fp", "k.t", "k.v")
    held = keyed.groupBy(*by, "t", "v").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    held = reliable(held.filter("n > 1"))
    pairs = held.filter("n = 2").filter(bits_apart(F.col("a"), F.col("b")) <= radius).select(*by, "a", "b")
    many = keyed.join(held.filter("n > 2").select(*by, "t", "v"), [*by, "t", "v"], "left_semi")
    free = F.element_at(F.array(*[F.array(*[F.lit(signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in tables]), F.col("t") + 1)
    if radius == 2:
        near = many.select(*by, "fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), free)).alias("flip"))
        stars = near.select(*by, "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at")).groupBy(*by, "at").agg(F.collect_set("fp").alias("all"))
        stars = stars.filter(F.size("all") > 1).select(*by, F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a < b")
    else:
        near = many.select(*by, F.col("fp").alias("a"), F.explode(free).alias("flip")).select(*by, "a", F.col("a").bitwiseXOR(F.col("flip")).alias("b"))
        stars = near.filter("a < b").join(fps.select(*by, F.col("fp").alias("b")), [*by, "b"], "left_semi").select(*by, "a", "b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(
    df: DataFrame, words: int = 3, seed: int = 42, radius: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprint and group of every document: id, fingerprint (16 hex digits), component_id.

    Documents link at ``radius`` or fewer differing bits; component_id is the smallest id that links
    reach. Equal fingerprints are merged first, so a group of exact copies is one node however large.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows give a row each.
    Null ids are kept; they join their group and never name it (a group of null ids has a null name).
    An empty table gives an empty result. Other columns are ignored.
    """
    fp = reliable(fingerprints(df, words, seed, id_col, text_col))
    nodes = reliable(fp.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(links(nodes.select("fp"), radius).select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = nodes.join(roots, nodes["fp"] == roots["u"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(names, "root").select(F.col("fp").alias("node"), "component_id")
    return fp.join(by_fp, fp["fp"] == by_fp["node"]).select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# ---- near copies by the similarity of their shingle sets ----

#: A search fingerprint has PARTS parts of WIDE bits, each covered for radius NEAR, and one of 64 bits that candidates are compared by.
#: A key is two thirds of a part's bits, 26 or 27: other texts agree in it by chance once in 2 ** 26 pairs, so few do however large the table.
PARTS, WIDE, NEAR = 28, 40, 1
#: Words of the shingles that a search fingerprint adds up: a changed word changes few of them, so near copies differ in few bits.
SHORT = 2
#: Bits of 64 in which candidates may differ. Near copies differ in 6 on average, other texts in 32.
APART = 20
#: Shingles, with AS_WELL more a node, of a block: pairs are checked in places of two blocks of a group, so none grows with its group. A bin has the places of EACH.
TOGETHER, AS_WELL, EACH = 200_000, 256, 1_000_000
#: Characters of texts whose sets are passed on together.
RUN = 500_000

_rnd = np.random.default_rng(42)
_TIMES = _rnd.integers(0, 1 << 64, -(-PARTS * WIDE // 64) + 1, np.uint64) | np.uint64(1)
_FEW = 2_048


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(shingle_hashes(text, words, 0))


def node_of(found: np.ndarray) -> int:
    """The set's own number, signed; texts of equal sets are one node."""
    return signed(xxhash.xxh64_intdigest(found.tobytes(), 7))


def search_fingerprint(found: np.ndarray) -> tuple[list[int], int]:
    """(words, whole): the signs of the sums of the shingles' bits over all shingles of a set, unweighted: words of 32 bits, and 64 bits."""
    counts = np.zeros(64 * len(_TIMES), np.int64)
    for at in range(0, len(found), _FEW):
        h = found[at : at + _FEW, None] * _TIMES
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        counts += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    bits = np.packbits(2 * counts > len(found), bitorder="little")
    return bits[:-8].view("<u4").tolist(), int(bits[-8:].view("<i8")[0])


def parts_of(words: list[int]) -> list[int]:
    """The PARTS numbers of WIDE bits that the bits of the words give, one after the other."""
    bits = sum(w << 32 * k for k, w in enumerate(words))
    return [bits >> WIDE * k & (1 << WIDE) - 1 for k in range(PARTS)]


def part_masks(radius: int, wide: int) -> list[int]:
    """``masks`` for numbers of ``wide`` bits."""
    return [m & (1 << wide) - 1 for m in masks(radius)]


def by_hash(df: DataFrame, text_col: str) -> DataFrame:
    """row (hash of the text) and text."""
    text = text_or_empty(text_col)
    return df.select(F.xxhash64(text).alias("row"), text.alias("text"))


def block_of(node: str, size: str) -> Column:
    """The block of a node in a group of ``size``: as many blocks as hold TOGETHER each."""
    return F.pmod(F.xxhash64(node), F.ceil(F.col(size) / TOGETHER))


def in_runs(df: DataFrame, fn: Callable[[int, str], list[tuple]], schema: StructType) -> DataFrame:
    """Rows that ``fn(row, text)`` returns, passed on after each RUN characters, so that a batch's sets never stand in memory together."""
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, size = [], 0
            for k in range(len(batch)):
                text = batch.column(1)[k].as_py() or ""
                made += fn(batch.column(0)[k].as_py(), text)
                size += len(text)
                if size > RUN or k == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)
                    made, size = [], 0
                    give_back()

    return df.select("row", "text").mapInArrow(run, schema)


def similar(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Those of the ``pairs`` (a, b, bin) whose shingle sets (node, s: sorted hashes as bytes, bin) have a Jaccard similarity of ``least`` or more, as u, v.

    A bin holds its sets once each, however many pairs they are in, so what is shuffled grows with the sets of a bin and not with its pairs.
    """

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        at = dict(zip(sets["node"].to_pylist(), sets["s"], strict=True))
        own = lambda node: np.frombuffer(at[node].as_buffer(), "<u8")
        pairs = pairs.sort_by([("a", "ascending"), ("b", "ascending")])
        a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
        good = np.zeros(len(a), bool)
        for part in np.split(np.arange(len(a)), np.flatnonzero(a[1:] != a[:-1]) + 1):
            if not len(part):
                continue
            mine = own(int(a[part[0]]))
            for k in range(0, len(part), _FEW):
                some = part[k : k + _FEW]
                others = [own(x) for x in b[some].tolist()]
                sizes = np.array([len(x) for x in others])
                every = np.concatenate(others)
                hit = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
                met = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
                good[some] = met >= least * (len(mine) + sizes - met)
        out = pa.table({"u": pa.array(a[good], pa.int64()), "v": pa.array(b[good], pa.int64())})
        del at, pairs, sets
        give_back()
        return out

    return pairs.groupBy("bin").cogroup(sets.groupBy("bin")).applyInArrow(run, "u long, v long")


def similar_groups(df: DataFrame, least: float = 0.8, words: int = 5, most_rows: int = 2_000_000, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, roots) of near copies. texts: row (hash) and node of every distinct text; roots: u, root for every linked node.

    Texts link where the Jaccard similarity of their sets of word shingles is ``least`` or more. Texts of
    equal sets (so all exact copies) are one node. Candidates come from SimHash fingerprints of PARTS times WIDE bits, signs of sums over all
    shingles of SHORT words: two nodes that agree in a part under one of its covering masks, so in any case those that differ in fewer than
    PARTS * (NEAR + 1) bits, and that differ in at most APART bits of another 64. All candidates are checked exactly, whatever the size of their group.

    To spare the pairs of a group that is one anyway, nodes are first checked with the hubs of their groups, the most usual nodes there. Then
    all candidates are checked that are not linked so far: those between different components. A group of copies is then one component and
    makes no pair; pairs grow with the square of a group only as far as its nodes are no copies of its hub. Pairs are checked by blocks of their
    group, where each set stands once, so sets are shuffled as often as they are in groups and never once a pair.

    Null and blank texts are one node that links to no other. The texts of candidates are read again for
    their sets: up to ``most_rows`` hashes are broadcast for that, else shuffled.
    """

    def marks(row, text):
        found = shingle_set(text, words)
        short = shingle_set(text, SHORT)
        if not len(short):
            return [(row, node_of(found), 0, 0, [])]
        own, whole = search_fingerprint(short)
        keys = [xxhash.xxh64_intdigest(struct.pack("<IQ", k, x & m), j) for k, x in enumerate(parts_of(own)) for j, m in enumerate(tables)]
        return [(row, node_of(found), len(found), whole, [signed(k) for k in keys])]

    tables = part_masks(NEAR, WIDE)
    made = in_runs(by_hash(df, text_col), marks, StructType.fromDDL("row long, node long, n int, fp long, keys array<long>"))
    texts = reliable(made.dropDuplicates(["row"]))
    nodes = reliable(texts.groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    keyed = nodes.select("node", "n", "fp", F.explode("keys").alias("key"))
    held = counted(keyed.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1").select("key"), most_rows)
    keyed = reliable(keyed.join(held, "key", "left_semi"))  # only nodes that may have a near copy
    both = lambda x, y: (F.least(x["n"], y["n"]) >= least * F.greatest(x["n"], y["n"])) & (bits_apart(x["fp"], y["fp"]) <= APART)
    # a node once for each hub of its groups: most groups of near copies have the same
    usual = keyed.groupBy("node").agg(F.count("*").alias("usual"))
    hub, size = F.max(F.struct("usual", "node", "n", "fp")).alias("hub"), F.sum(F.col("n") + AS_WELL).alias("size")
    hubs = counted(keyed.join(usual, "node").groupBy("key").agg(hub, size), most_rows)
    star = keyed.join(hubs, "key").filter((F.col("node") != F.col("hub.node")) & both({"n": F.col("n"), "fp": F.col("fp")}, {"n": F.col("hub.n"), "fp": F.col("hub.fp")}))
    star = star.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"), F.xxhash64("hub.node", block_of("node", "size")).alias("place"))
    pairs = reliable(star.groupBy("a", "b").agg(F.min("place").alias("place")))

    def sets_of(row, text):
        found = shingle_set(text, words)
        return [(node_of(found), found.tobytes())]

    def checked(pairs: DataFrame) -> DataFrame:
        """Links among the pairs (a, b, place). Sets are made of their texts alone."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node"), "place").distinct()
        wanted = reliable(wanted.join(nodes.select("node", "row", "n"), "node"))
        total = wanted.agg(F.sum(F.col("n") + AS_WELL)).first()[0] or 0
        bin_ = F.pmod("place", F.lit(1 + total // EACH)).alias("bin")
        rows = counted(wanted.select(F.col("row").alias("wanted_row")).distinct(), most_rows)
        again = by_hash(df, text_col).join(rows, F.col("row") == F.col("wanted_row"), "left_semi")
        sets = in_runs(again, sets_of, StructType.fromDDL("node long, s binary")).dropDuplicates(["node"])
        return reliable(similar(sets.join(wanted.select("node", bin_).distinct(), "node"), pairs.select("a", "b", bin_), least))

    done = checked(pairs)
    roots = components(done)
    # candidates between different components: of each group the nodes, as members of theirs
    state = keyed.join(roots.withColumnRenamed("u", "node"), "node", "left").select("key", "node", "n", "fp", F.coalesce("root", "node").alias("root"))
    open_ = state.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), size).filter("x <> y").select("key", "size")
    state = reliable(state.join(open_, "key").withColumn("block", block_of("node", "size")))
    one = state.select("key", "size", *[F.col(c).alias(f"{c}1") for c in ("node", "n", "fp", "root", "block")])
    two = state.select("key", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "fp", "root", "block")])
    fit = both({"n": F.col("n1"), "fp": F.col("fp1")}, {"n": F.col("n2"), "fp": F.col("fp2")})
    rest = one.join(two, "key").filter((F.col("node1") < F.col("node2")) & (F.col("root1") != F.col("root2")) & fit)
    # a pair is checked in the largest group that it is in, beside the other pairs of its nodes there
    place = F.xxhash64("key", F.least("block1", "block2"), F.greatest("block1", "block2")).alias("place")
    rest = rest.select(F.col("node1").alias("a"), F.col("node2").alias("b"), F.struct("size", "key", place).alias("at"))
    rest = reliable(rest.groupBy("a", "b").agg(F.max("at")["place"].alias("place")).join(pairs, ["a", "b"], "left_anti"))
    if not rest.isEmpty() and not (more := checked(rest)).isEmpty():
        roots = components(done.unionByName(more))
    return texts.select("row", "node"), roots


def without_copies(
    df: DataFrame, least: float = 0.8, words: int = 5, most_rows: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each group of near copies (see ``similar_groups``): the one with the smallest id, then the least hash of its text.

    A row without an id stays only where its group has no row with one. Of rows with equal id and text one
    stays. Null, empty and blank texts are copies of each other. An empty table gives an empty result;
    all columns of ``df`` are kept as they are, whatever their names.
    """
    texts, roots = similar_groups(df, least, words, most_rows, text_col)
    row = F.xxhash64(text_or_empty(text_col))
    group = texts.join(roots.select(F.col("u").alias("node"), "root"), "node", "left").select("row", F.coalesce("root", "node").alias("root"))
    keys = df.select(F.col(id_col).alias("id"), row.alias("row")).groupBy("id", "row").agg(F.count("*").alias("n"))
    keys = reliable(keys.join(group, "row"))
    # groups of one row need no verdict; those of more are counted, so that the rows of a large group needn't meet in one task
    first = keys.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.sum("n").alias("total"))
    first = counted(first.filter("total > 1").drop("total"), most_rows)
    judged = keys.join(first, "root").select("id", "row", "n", (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("row") == F.col("first.row"))).alias("stays"))
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own"), F.col(id_col).alias("own_id"), row.alias("own_row"))
    same = lambda ids: F.col("own_id").eqNullSafe(ids["id"]) & (F.col("own_row") == ids["row"])
    judged = reliable(judged.filter("NOT stays OR n > 1"))
    gone = counted(judged.filter("NOT stays").select("id", "row"), most_rows)
    kept = own.join(gone, same(gone), "left_anti")
    twice = counted(judged.filter("stays").select("id", "row"), most_rows)
    if not twice.isEmpty():
        kept = kept.join(twice, same(twice), "left_anti").unionByName(own.join(twice, same(twice), "left_semi").dropDuplicates(["own_id", "own_row"]))
    return kept.select("own.*")
