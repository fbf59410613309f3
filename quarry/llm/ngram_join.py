"""N-gram Jaccard self-join: size-banded tiles, hashed bitmaps, exact intersections.

A document's set holds its distinct shingles of n words (lower-cased A-Z), as 64-bit
hashes; a document of fewer words has one shingle, all of them.  Two documents link if
den * |intersection| >= num * |union|.  Documents with equal sets are one node.

1. Every set is ordered by (how frequent a shingle is, hash); linked sets share one of
   their first |set| - ceil(num/den * |set|) + 1 shingles.  Those prefixes are grouped by
   shingle; shingles of one node are dropped.  Within a shingle, sizes fall into
   bands of ratio den/num, and linked sets are in the same band or in neighbouring ones.
   A shingle of at most ``PAIRED`` nodes gives its pairs of such nodes as they are: each node is a cell with
   its later partners.  Of the other shingles, nodes are tied to their band's smallest node, and neighbouring
   bands to each other, so chance meetings of rare shingles never chain documents into one huge component.
2. Connected components of these ties hold every other link.  A component's nodes are cut, in
   order of size, into tiles; only pairs of tiles whose sizes can link meet, each in one
   task.  A large component thus is many small tasks; no pairs of its rows are emitted.
3. In a cell of partners or a pair of tiles, parity bitmaps of the sets give a lower bound of the symmetric
   difference by counting bits of an exclusive or, so an upper bound of the overlap.  A first pass
   moves bitmaps only, wider ones for larger sets; nodes that keep a possible partner send their sets, and survivors of
   the bound are intersected exactly.  Pairs already connected there are skipped, and only the links that
   connect are returned: at most one a node and tile pair.
4. Connected components of the links are the result.

"How frequent" is a list of at most ``MAX_FREQUENT`` hashes counted over all documents.  The list only
orders shingles, the same way for all documents: any list gives the same links.

Defined results: null or empty texts have no shingles and link with nothing; rows with a null
id take no part and get a null component; rows that repeat an id are in one component; other
columns are ignored.  Nodes are told apart by 64 bits of their set's hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import text as tx
from quarry.llm.common import connected_components, cut, join_grouped, most_frequent, release, written

#: Frequent shingles that executors are told of, at most; and shingles counted at a time.
MAX_FREQUENT, COUNTED = 200_000, 1_000_000
#: Nodes of a tile: a share of its component within these bounds.
TILE_MIN, TILE_MAX, TILES = 64, 2048, 32
#: Nodes of a shingle whose pairs are written out, at most.
PAIRED = 64
#: Bits of the bitmap that screens pairs before any set travels, at least; a larger set has about one for each element, as a full bitmap tells nothing apart.
SCREEN_BITS = 2048
#: Bits, 64 a row, of the table that tells which texts are asked for again.
ASKED_BITS = 1 << 23


def _sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents of a chunk, sorted within each, and where each begins."""
    w = tx.words(column, lower=True)
    rows = len(w.bounds) - 1
    hashes = tx.grams(w, n)
    good = tx.inside(w, n)
    owner = w.owner
    at = np.flatnonzero(good)
    values, owners = hashes[at], owner[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        extra = []
        for r in short.tolist():
            one = w.hashes[w.bounds[r] : w.bounds[r + 1]]
            h = np.uint64(len(one))
            with np.errstate(over="ignore"):
                for x in one:
                    h = tx.mix(np.array([h * np.uint64(0x9E3779B97F4A7C15) ^ x], np.uint64))[0]
            extra.append(h)
        values, owners = np.concatenate([values, np.array(extra, np.uint64)]), np.concatenate([owners, short])
    order = np.argsort(values)
    # documents of a chunk are few enough for a radix sort
    order = order[np.argsort(owners[order].astype(np.uint16 if rows < 1 << 16 else np.int64), kind="stable")]
    values, owners = values[order], owners[order]
    if len(values):
        first = np.concatenate([[True], (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])])
        values, owners = values[first], owners[first]
    return values, np.searchsorted(owners, np.arange(rows + 1))


def _node(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Order-free hash of each set."""
    with np.errstate(over="ignore"):
        one = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix(values ^ np.uint64(0x2545F4914F6CDD1D)))])
        return tx.mix((one[bounds[1:]] - one[bounds[:-1]]) ^ np.diff(bounds).astype(np.uint64))


DESCRIBED = "doc_id long, n long, node long, bitmap binary, token long, times long"


def _describe(n: int):
    """A row for each document (n is set), and rows of shingles that occur often in a stretch of documents (times is set)."""

    def counted(held):
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        keep = counts >= 3
        empty = pa.nulls(int(keep.sum()), pa.int64())
        return pa.RecordBatch.from_arrays(
            [empty, empty, empty, pa.nulls(len(empty), pa.binary()), tx.as_long(values[keep]), pa.array(counts[keep].astype(np.int64))], ["doc_id", "n", "node", "bitmap", "token", "times"]
        )

    def run(batches):
        held, size = [], 0
        for batch in tx.chunks(batches, "text"):
            values, bounds = _sets(batch.column("text"), n)
            maps = [_bitmaps([values[a:b]], _screen_bits(int(b - a))) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)), tx.as_long(_node(values, bounds)), pa.array([m.tobytes() for m in maps], pa.binary()), none, none],
                ["doc_id", "n", "node", "bitmap", "token", "times"],
            )
            held.append(values)
            size += len(values)
            if size >= COUNTED:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    return run


def _prefixes(n: int, num: int, den: int, tokens: np.ndarray, classes: np.ndarray):
    edges = np.array(bands(num, den))

    def run(batches):
        for batch in tx.chunks(batches, "text"):
            values, bounds = _sets(batch.column("text"), n)
            if not len(values):
                continue
            sizes = np.diff(bounds)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            rank = np.zeros(len(values), np.int64)
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, values), len(tokens) - 1)
                rank = np.where(tokens[at] == values, classes[at], 0)
            # hashes are in order within a document already, and few shingles have a rank
            order = np.argsort(owner * 64 + rank, kind="stable")
            place = np.arange(len(values)) - bounds[owner]  # owner is sorted, so places count within it
            keep = place < (sizes - -(-num * sizes // den) + 1)[owner]
            chosen = values[order][keep]
            mine = owner[keep]
            yield pa.RecordBatch.from_arrays(
                [tx.as_long(chosen), pa.array((np.searchsorted(edges, sizes, "right") - 1)[mine].astype(np.int32)), tx.as_long(_node(values, bounds)[mine])], ["token", "band", "node"]
            )

    return run


def bands(num: int, den: int, top: int = 1 << 40) -> list[int]:
    """Smallest sizes of the bands: linked sizes are in one band or in neighbouring ones."""
    out = [1]
    while out[-1] < top:
        out.append(out[-1] * den // num + 1)
    return out


def _with_sets(n: int):
    def run(batches):
        for batch in tx.chunks(batches, "text"):
            values, bounds = _sets(batch.column("text"), n)
            cells = batch.column("cells")
            lengths = np.asarray(cells.value_lengths())
            rows = np.repeat(np.arange(batch.num_rows), lengths)
            sets = pa.array([values[bounds[r] : bounds[r + 1]].tobytes() for r in range(batch.num_rows)], pa.binary())
            flat = cells.flatten()
            for start in range(0, len(rows), 4096):  # a set goes to several cells
                part = pa.array(rows[start : start + 4096])
                cell = flat.slice(start, len(part))
                yield pa.RecordBatch.from_arrays(
                    [cell.field("bin"), cell.field("cell"), cell.field("side"), batch.column("node").take(part), sets.take(part)], ["bin", "cell", "side", "node", "shingles"]
                )

    return run


def _bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Parity bitmaps: the exclusive or of two has at most as many bits as the symmetric difference has elements."""
    out = np.zeros((len(sets), bits), np.uint8)
    for i, s in enumerate(sets):
        out[i] = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(out, axis=1).view(np.uint64)


def _screen_bits(n: int) -> int:
    return max(SCREEN_BITS, 1 << max(0, n - 1).bit_length())


def _folded(bitmap: bytes, width: int) -> np.ndarray:
    """The parity bitmap of fewer bits, of the same set."""
    out = np.frombuffer(bitmap, np.uint64)
    while out.nbytes > width:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def _partners(i: int, sizes: np.ndarray, sides: np.ndarray, maps: np.ndarray, num: int, den: int) -> np.ndarray:
    """Later rows that row i may link with, by size, side and the bitmaps' bound; rows are in order of size."""
    end = int(np.searchsorted(sizes, sizes[i] * den // num, "right"))  # larger sets can't link
    js = np.arange(i + 1, end)
    if sides[i] != 2:
        js = js[sides[js] != sides[i]]
    if not len(js):
        return js
    apart = np.bitwise_count(maps[js] ^ maps[i]).sum(1, dtype=np.int64)
    total = sizes[js] + sizes[i]
    overlap = (total - apart) // 2  # an upper bound
    return js[den * overlap >= num * (total - overlap)]


def _by_cell(table: pa.Table):
    """Rows of each pair of tiles in a bin."""
    cells = np.asarray(table.column("cell"))
    order = np.argsort(cells, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(cells[order]) != 0])) if len(order) else []
    for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
        yield order[a:b]


def _screen(num: int, den: int):
    """Keeps the rows that have a possible partner in their pair of tiles."""

    def run(table: pa.Table) -> pa.Table:
        sizes, sides = np.asarray(table.column("n")), np.asarray(table.column("side"))
        maps = table.column("bitmap").to_pylist()
        keep = np.zeros(table.num_rows, bool)
        for rows in _by_cell(table):
            rows = rows[np.argsort(sizes[rows], kind="stable")]
            n, s, width = sizes[rows], sides[rows], 0
            for i in range(len(rows) - 1):
                if len(maps[rows[i]]) != width:  # later rows are as wide or wider, and are folded to this row's width
                    width = len(maps[rows[i]])
                    m = np.zeros((len(rows), width // 8), np.uint64)
                    m[i:] = [_folded(maps[r], width) for r in rows[i:]]
                js = _partners(i, n, s, m, num, den)
                if len(js):
                    keep[rows[i]] = True
                    keep[rows[js]] = True
        return table.filter(pa.array(keep)).select(["bin", "cell", "side", "node"])

    return run


def _links(nodes: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect the nodes of one pair of tiles: between the tiles, or within one (side 2)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    nodes, sides, sizes = nodes[order], sides[order], sizes[order]
    sets = [sets[i] for i in order]
    most = max(1, int(sizes[-1]))
    allowed = 2 * most - 2 * num * most // (num + den) + 2
    maps = _bitmaps(sets, min(16384, max(512, 1 << int(4 * allowed - 1).bit_length())))
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in range(len(sets) - 1):
        for j in _partners(i, sizes, sides, maps, num, den).tolist():
            a, b = find(i), find(j)
            if a == b:
                continue
            at = np.searchsorted(sets[j], sets[i])
            at[at == len(sets[j])] = 0
            common = int((sets[j][at] == sets[i]).sum())
            if den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                root[max(a, b)] = min(a, b)
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def _verify(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        nodes, sides = np.asarray(table.column("node")), np.asarray(table.column("side"))
        raw = table.column("shingles").to_pylist()
        for rows in _by_cell(table):
            found += _links(nodes[rows], sides[rows], [np.frombuffer(raw[r], np.uint64) for r in rows], num, den)
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def _shared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The shingles of several nodes: (token, held) of those of at most ``PAIRED`` nodes, held: (band, node) of each; (token, band, node) of the others."""
    multi = rows.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("token")
    shared = cut(join_grouped(rows, multi, ["token"]).select("token", "band", "node").distinct())
    held = cut(shared.groupBy("token").agg(F.count(F.lit(1)).alias("held")))
    small = shared.join(held.where(F.col("held") <= PAIRED).select("token"), "token").groupBy("token").agg(F.collect_list(F.struct("band", "node")).alias("held"))
    # few shingles are frequent
    large = join_grouped(shared, held.where(F.col("held") > PAIRED).select("token"), ["token"]).select("token", "band", "node")
    return small, large


def _pairs(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes, a < b, that a shingle and their bands let link; from (token, held) of shingles of few nodes, held: (band, node) of each."""
    one = lists.select("held", F.explode("held").alias("x"))
    later = F.filter("held", lambda y: (F.col("x.node") < y["node"]) & (F.abs(F.col("x.band") - y["band"]) <= 1))
    return one.select(F.col("x.node").alias("a"), F.explode(F.transform(later, lambda y: y["node"])).alias("b")).distinct()


def _asked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among the ids, and few others: a bit for each id's hash is told to every task, so that other texts need not travel."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(ASKED_BITS))
    bit = F.expr("shiftleft(1L, cast(_place % 64 as int))")
    word = F.floor(F.col("_place") / 64)
    bits = ids.select(place.alias("_place")).groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))  # ASKED_BITS / 64 rows at most
    return rows.withColumn("_place", place).join(F.broadcast(bits), word == F.col("_word")).where(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def _ties(shared: DataFrame) -> DataFrame:
    """Edges (a, b) whose components hold every possible link; from (token, band, node) of shingles of several nodes."""
    groups = shared.groupBy("token", "band").agg(F.min("node").alias("lead"))
    next_band = F.lead(F.struct("band", "lead")).over(Window.partitionBy("token").orderBy("band"))  # at most one row a band
    across = groups.withColumn("next", next_band).where(F.col("next.band") == F.col("band") + 1).select(F.col("lead").alias("a"), F.col("next.lead").alias("b"))
    within = join_grouped(shared, groups, ["token", "band"]).where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    return across.union(within).distinct()


def _stars(pairs: DataFrame) -> DataFrame:
    """(node, bin, cell, side): a cell for each first node of pairs, with its partners on the other side."""
    bins = max(1, pairs.count() // (2 * TILE_MIN))
    placed = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(bins)).alias("bin"), F.xxhash64(F.lit("pairs"), "a").alias("cell"))
    first = placed.select(F.col("a").alias("node"), "bin", "cell", F.lit(0).alias("side")).distinct()
    return first.union(placed.select(F.col("b").alias("node"), "bin", "cell", F.lit(1).alias("side")))


def _cells(members: DataFrame, num: int, den: int) -> DataFrame:
    """(node, bin, cell, side): the tile pairs of each node; from (node, root, n)."""
    by_size = members.groupBy("root", "n").agg(F.count(F.lit(1)).alias("held"))
    w = Window.partitionBy("root").orderBy("n")  # one row a size
    by_size = by_size.withColumn("before", F.sum("held").over(w) - F.col("held")).withColumn("all", F.sum("held").over(Window.partitionBy("root")))
    tile = F.least(F.lit(TILE_MAX), F.greatest(F.lit(TILE_MIN), F.ceil(F.col("all") / TILES)))
    by_size = by_size.withColumn("tile_size", tile).select(
        "root", "n", "all", F.floor(F.col("before") / F.col("tile_size")).alias("slot"), F.ceil(F.col("held") / F.col("tile_size")).alias("parts")
    )
    placed = join_grouped(members, by_size, ["root", "n"]).withColumn(
        "tile", F.when(F.col("parts") > 1, F.concat_ws(".", "slot", "n", F.pmod(F.xxhash64("node"), F.col("parts")))).otherwise(F.col("slot").cast("string"))
    )
    placed = cut(placed.select("node", "root", "n", "tile", "all"))
    tiles = placed.groupBy("root", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.first("all").alias("all"))
    other = tiles.select(F.col("root").alias("o_root"), F.col("tile").alias("o_tile"), F.col("low").alias("o_low"), F.col("high").alias("o_high"))
    can = (F.col("low") * num <= F.col("o_high") * den) & (F.col("o_low") * num <= F.col("high") * den)
    pairs = tiles.join(other, (F.col("root") == F.col("o_root")) & (F.col("tile") <= F.col("o_tile")) & can)
    total = placed.count()
    # small components share bins of about TILE_MIN rows; a pair of a large component's tiles is a bin of its own
    bins = max(1, total // (4 * TILE_MIN))
    cell = F.xxhash64("root", "tile", "o_tile")
    bin_of = F.when(F.col("all") <= TILE_MIN, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(cell)
    pairs = pairs.select("root", "tile", "o_tile", bin_of.alias("bin"), cell.alias("cell"))
    same = F.col("tile") == F.col("o_tile")
    sides = pairs.select("root", "tile", F.struct("bin", "cell", F.when(same, 2).otherwise(0).alias("side")).alias("c")).union(
        pairs.where(~same).select("root", F.col("o_tile").alias("tile"), F.struct("bin", "cell", F.lit(1).alias("side")).alias("c"))
    )
    return placed.join(sides, ["root", "tile"]).select("node", "n", "c.bin", "c.cell", "c.side")


def link_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row; component_id is the smallest id reachable by links."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = cut(base.mapInArrow(_describe(n), DESCRIBED))
    rows = described.where("n is not null").select("doc_id", "n", "node", "bitmap")
    known = base.where("doc_id is not null")
    counted = described.where("times is not null").groupBy("token").agg(F.sum("times").alias("times"))
    frequent = most_frequent(counted, MAX_FREQUENT, "times")
    tokens = np.array([r.token for r in frequent], np.int64).view(np.uint64)
    classes = np.array([1 + int(math.log2(r.times)) for r in frequent], np.int64)
    order = np.argsort(tokens)
    prefix = written(known.mapInArrow(_prefixes(n, num, den, tokens[order], classes[order]), "token long, band int, node long"), "prefixes")
    small, large = _shared(prefix)
    pairs = cut(_pairs(small))
    components = connected_components(_ties(large))
    # one document stands for each node
    nodes = rows.where("doc_id is not null and n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    placed = cut(components.join(nodes.select("node", "n"), "node").select("node", "root", "n"))
    del components, small, large
    release(placed)  # the ties' shuffle files have served
    cells = _cells(placed, num, den).select("node", "bin", "cell", "side").union(_stars(pairs))
    involved = placed.select("node").union(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    members = cut(nodes.join(involved, "node").select("node", "n", "rep"))
    # bitmaps first: sets travel only for nodes that have a possible partner, and only to those cells
    maps = rows.select("doc_id", F.col("node").alias("m_node"), "bitmap").join(members, (F.col("doc_id") == F.col("rep")) & (F.col("m_node") == F.col("node"))).groupBy("node").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap"))
    screened = cells.join(maps, "node").groupBy("bin").applyInArrow(_screen(num, den), "bin long, cell long, side int, node long")
    wanted = screened.groupBy("node").agg(F.collect_list(F.struct("bin", "cell", "side")).alias("cells")).join(members.select("node", "rep"), "node").select(F.col("rep").alias("doc_id"), F.col("node").alias("want"), "cells")
    wanted = cut(wanted)
    release(wanted)  # bitmaps have served
    texts = _asked(known, wanted).join(wanted, "doc_id").select("text", F.col("want").alias("node"), "cells")
    pieces = texts.mapInArrow(_with_sets(n), "bin long, cell long, side int, node long, shingles binary")
    links = pieces.groupBy("bin").applyInArrow(_verify(num, den), "a long, b long")
    linked = connected_components(links).select("node", "root")
    labelled = rows.join(linked, "node", "left").withColumn("label", F.coalesce("root", "node"))
    # ids that repeat tie their nodes together as well
    first = labelled.where("doc_id is not null and n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    joined = labelled.select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("label")).alias("label"))
    right = first.withColumnRenamed("label", "r_label")
    out = joined.join(right, (F.col("label") == F.col("r_label")) & (F.pmod("label", F.lit(2)) == F.pmod("r_label", F.lit(2))), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, num=85, den=100)
