"""Near copies by the Jaccard similarity of five-word shingle sets: prefix join, exact verification, components.

Two sets at 4/5 or more share a shingle among the first n - ceil(4n/5) + 1 of each, in whatever order all sets keep, so
only these are joined and no pair is lost. The order puts shingles that are frequent in a sample last, then goes by hash;
the sample decides on cost only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.llm.common import mixed, slices, stored, utf8
from recspark.llm.components import components
from recspark.llm.simhash import RADIUS, _spaced, fingerprints, links
from recspark.llm.xxh64 import xxh64

SHINGLE = 5
# Fifths of Jaccard that link, and those of a pivot's surroundings: what links two sets to it and to each other is nearer than that.
LINKED = 4
AROUND = 3
# The sample of frequent shingles is one document in SAMPLED, of small tables about SAMPLE documents; it names at most so many
# shingles, those that stand in so many of its documents: 4 in one of 16 are about as many as a bucket may hold.
SAMPLE = 2000
SAMPLED = 16
FREQUENT = 4
MOST_FREQUENT = 1 << 18
# Shingles with more sets than this are compared with their first sets only, round by round, and so many times more each round.
BUCKET_LIMIT = 64
PIVOTS = 4
PIVOT_GROWTH = 8
# Most rows (node, block) that are broadcast to find the texts to verify; beyond, they are joined by a shuffle.
BROADCAST_NODES = 1 << 20
# Bytes of text that a task cuts into shingles at one time (their hashes and order take some fifty times as much), and of a batch on its way to Python.
SLICE = 1 << 19
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = str(4 << 20)
# Shingles of the sets in a block of the verification (about; 4 MB).
BLOCK_SHINGLES = 1 << 19
MOST_SEEN = 1 << 20
# Bits of a sketch for each shingle of its set (at least), and the most words of 64 bits.
SKETCH_BITS = 1.25
SKETCH_WORDS = 64


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes of each row, ascending, and where each row's begin; fewer words than five are one shingle."""
    text, starts, ends, before = _spaced(data, offsets)
    words = np.diff(before)
    counts = np.where(words == 0, 0, np.maximum(words - SHINGLE + 1, 1))
    rows = np.repeat(np.arange(len(counts)), counts)
    begin = before[rows] + np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows]
    hashes = xxh64(text, starts[begin], ends[np.minimum(begin + SHINGLE, before[rows + 1]) - 1]).astype(np.uint64)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.r_[True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])] if len(rows) else np.zeros(0, bool)
    return hashes[new], np.searchsorted(rows[new], np.arange(len(counts) + 1))


def node_ids(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One id for each set, the same for equal sets; 0 for the empty set."""
    sums = np.append(np.uint64(0), np.cumsum(mixed(hashes)))
    sizes = np.diff(first)
    return np.where(sizes > 0, mixed(sums[first[1:]] - sums[first[:-1]] + sizes.astype(np.uint64)), 0).astype(np.uint64).view(np.int64)


def sketches(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of 64 bits that say of how many shingles with one remainder each set has an odd number, and where each row's begin.

    Two sets differ in at least as many shingles as their sketches of one length differ in bits, so a pair whose sketches are
    too far apart can't be similar. Lengths are powers of two: the halves of a sketch, combined by xor, are the next shorter one.
    """
    sizes = np.diff(first)
    least = np.ceil(np.maximum(sizes, 1) * (SKETCH_BITS / 64))
    words = np.minimum(1 << np.ceil(np.log2(np.maximum(least, 1))).astype(np.int64), SKETCH_WORDS)
    starts = np.append(0, np.cumsum(words))
    row = np.repeat(np.arange(len(sizes)), sizes)
    bit = (hashes & (words[row] * 64 - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(starts[row] * 64 + bit, minlength=int(starts[-1]) * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8"), starts


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(first), pa.array(values)).cast(pa.list_(pa.int64()))


def _marker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=SLICE):
        data, offsets = utf8(batch.column("text"))
        sets = shingle_sets(data, offsets)
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("same"), pa.array(fingerprints(data, offsets).view(np.int64)), pa.array(node_ids(*sets)), _lists(*sketches(*sets))],
            names=["key", "same", "fp", "node", "sketch"])


# Names a text: equal for equal texts, and made without Python.
SAME_TEXT = "xxhash64(coalesce(text, ''))"


def marks(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, same, fp, node, sketch) of every row: a hash of the text, op8's fingerprint, the id of the shingle set and its sketch. No shuffle.

    Null and empty texts, and those without words, have node 0; repeated rows and null keys stay; other columns are not
    read, whatever their names; an empty table gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")).withColumn("same", F.expr(SAME_TEXT))
    return rows.mapInArrow(_marker, f"key {kind}, same long, fp long, node long, sketch array<bigint>").withColumnRenamed("key", key)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the texts, each at most once for a task (once more where it has met very many)."""
    seen: set[int] = set()
    for batch in slices(batches, limit=SLICE):
        same = batch.column("same").to_pylist()
        fresh = [i for i, h in enumerate(same) if h not in seen and not seen.add(h)]
        if len(seen) > MOST_SEEN:
            seen.clear()
        if not fresh:
            continue
        hashes, first = shingle_sets(*utf8(batch.column("text").take(pa.array(fresh))))
        yield pa.RecordBatch.from_arrays([pa.array(node_ids(hashes, first)), _lists(hashes.view(np.int64), first)], names=["node", "shingles"])


def _prefixes(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        seen: set[int] = set()
        for batch in slices(batches, limit=SLICE):
            hashes, first = shingle_sets(*utf8(batch.column("text")))
            size = np.diff(first)
            row = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            count = np.where(known[at] == hashes, often[at], 0) if len(known) else np.zeros(len(hashes), np.int64)
            order = np.lexsort((hashes, count, row))
            place = np.arange(len(hashes)) - first[row]
            nodes = node_ids(hashes, first)
            # Copies inside a task come once; a set that grows too large is begun anew, what comes twice goes in the distinct.
            fresh = np.zeros(len(nodes), bool)
            for i, node in enumerate(nodes.tolist()):
                if node not in seen:
                    seen.add(node)
                    fresh[i] = True
            if len(seen) > MOST_SEEN:
                seen.clear()
            keep = fresh[row] & (place < (size - (4 * size + 4) // 5 + 1)[row])
            own = nodes[row[keep]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[order][keep].view(np.int64)), pa.array(own), pa.array(size[row[keep]].astype(np.int32)), pa.array(place[keep].astype(np.int32)),
                 pa.array(np.where(count[order][keep] > 0, own & 63, -1).astype(np.int32))], names=["token", "node", "size", "place", "salt"])

    return run


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their nodes, each node at most once for a task (once more where it has met very many)."""
    seen: set[int] = set()
    for batch in batches:
        fresh = [i for i, node in enumerate(batch.column("node").to_pylist()) if node not in seen and not seen.add(node)]
        if len(seen) > MOST_SEEN:
            seen.clear()
        if fresh:
            yield batch.take(pa.array(fresh)).select(["node", "text"])


def _overlaps(fifths: int) -> Callable:
    """Of each block, the texts of its sets first and then its pairs: the pairs whose sets are at so many fifths or more, and how near they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sets = None, {}
        for batch in slices(batches, limit=SLICE):
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("cell", "i", "j")), strict=True))
            values, offsets = shingle_sets(*utf8(batch.column("text")))  # ascending as unsigned
            found = []
            for at, (key, a, b) in enumerate(zip(keys, batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                if key != block:
                    block, sets = key, {}
                if b is None:
                    sets[a] = values[offsets[at] : offsets[at + 1]].copy()
                else:
                    x, y = sorted((sets[a], sets[b]), key=len)
                    place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    both = int(np.count_nonzero(y[place] == x))
                    either = len(x) + len(y) - both
                    if 5 * both >= fifths * either:
                        found.append((a, b, both / either))
            if found:
                a, b, near = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(near, pa.float64())], names=["a", "b", "near"])

    return run


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows here are whole texts; small batches keep two copies of one, in the JVM and in Python, small."""
    usual = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, usual)


def _verified(texts: DataFrame, marked: DataFrame, pairs: DataFrame, fifths: int = LINKED) -> DataFrame:
    """(a, b, near): those of the pairs (a, b, sa, sb: a < b and the sizes of their sets) whose sets are at so many fifths or more, with their Jaccard.

    A set is sent once to each block that has a pair of it, never once for each pair, and as its text, which is shorter than its
    shingles' hashes and can be compressed; the block cuts it. Pairs whose end with more partners
    has the same smallest neighbour make a cell, so a group of copies is one cell. A cell is cut into rows by the sets on that
    side and into columns by those on the other, as many as blocks of bounded size need: sets compared with a few go to one. Of all texts with the same set one is read, and only those of
    sets that stand in a pair are cut into shingles at all.
    """
    pairs = stored(pairs)
    ways = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hubs = stored(ways.groupBy("a").agg(F.min("b").alias("cell"), F.count("*").alias("degree")).selectExpr("a as node", "least(a, cell) as cell", "degree"))
    met = pairs.join(hubs.selectExpr("node as a", "cell as cell_a", "degree as degree_a"), "a").join(hubs.selectExpr("node as b", "cell as cell_b", "degree as degree_b"), "b")
    # x is the end with more partners: the few sets that many are compared with stand on one side.
    first = "degree_a >= degree_b"
    placed = stored(met.selectExpr("a", "b", f"if({first}, a, b) as x", f"if({first}, b, a) as y", f"if({first}, sa, sb) as sx", f"if({first}, sb, sa) as sy", f"if({first}, cell_a, cell_b) as cell"))

    def cuts(end: str, name: str) -> DataFrame:
        sides = placed.selectExpr("cell", f"{end} as node", f"s{end} as size").distinct()
        return sides.groupBy("cell").agg(F.expr(f"ceil(sum(size) / {BLOCK_SHINGLES})").alias(name))

    sized = placed.join(cuts("x", "rows"), "cell").join(cuts("y", "columns"), "cell")
    dealt = stored(sized.selectExpr("cell", "pmod(xxhash64(x), rows) as i", "pmod(xxhash64(y), columns) as j", "a", "b"))
    needs = stored(dealt.selectExpr("cell", "i", "j", "explode(array(a, b)) as node").distinct())
    few = needs.count() <= BROADCAST_NODES
    one = marked.join(needs.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("same").alias("same"))
    read = texts.withColumn("same", F.expr(SAME_TEXT)).join(F.broadcast(one) if few else one, "same").select("node", "text")
    sets = read.mapInArrow(_firsts, "node long, text string").join(F.broadcast(needs) if few else needs, "node")
    sent = sets.selectExpr("cell", "i", "j", "0 as kind", "node as a", "cast(null as bigint) as b", "text")
    asked = dealt.selectExpr("cell", "i", "j", "1 as kind", "a", "b", "cast(null as string) as text")
    block = ["cell", "i", "j"]
    checked = sent.unionByName(asked).repartition(*block).sortWithinPartitions(*block, "kind").mapInArrow(_overlaps(fifths), "a long, b long, near double")
    with _small_batches(texts.sparkSession):
        return stored(checked)


def _halved(sketch: str) -> str:
    """SQL: the next shorter sketch; one word stays."""
    half = f"(size({sketch}) div 2)"
    return f"if(size({sketch}) > 1, transform(slice({sketch}, 1, {half}), (w, i) -> w ^ {sketch}[i + {half}]), {sketch})"


def _reach(fifths: int) -> str:
    """SQL: sizes and sketches of x and y that can reach so many fifths, wherever the common shingle stands.

    Sets at f/5 differ in at most (5 - f)/(5 + f) of the sum of their sizes. Such sizes differ less than twofold, so their
    sketches have one length or one of them is halved.
    """
    x, y = (f"if(size({a}.sketch) > size({b}.sketch), {_halved(f'{a}.sketch')}, {a}.sketch)" for a, b in ("xy", "yx"))
    apart = f"aggregate(zip_with({x}, {y}, (v, w) -> bit_count(v ^ w)), 0, (n, b) -> n + b)"
    return f"""5 * least(x.size, y.size) >= {fifths} * greatest(x.size, y.size)
        and if(5 * least(x.size, y.size) >= {fifths} * greatest(x.size, y.size), {5 + fifths} * {apart} <= {5 - fifths} * (x.size + y.size), false)"""


# Enough shingles from the first common one on to reach 4/5.
_PLACED = "9 * least(x.size - x.place, y.size - y.place) >= 4 * (x.size + y.size)"


def similar(docs: DataFrame, marked: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b): edges between nodes with a five-word Jaccard of 4/5 or more, by `marked` (doc_id, node, sketch) of the same rows.

    They connect exactly what all such pairs connect. Shingles with up to `bucket_limit` sets compare all pairs. In fuller
    ones the sets with the smallest ids, the pivots, are compared with all others, and they and what they link leave the shingle; so a
    large group of near copies costs a few rows a member. What leaves can still link to sets around its pivot that the pivot
    doesn't link: Jaccard distances obey the triangle inequality, so these are at 3/5 or more of the pivot and no others count. They are
    compared in the end, as far as they are not connected by then (`_borders`); a pivot that links nothing needs none of them. Each
    round takes PIVOT_GROWTH times as many pivots, so there are few rounds even where nothing links. Of the pairs that meet, those
    whose sketches are too far apart can't link; all others are verified. Documents without words are one node and are not looked at; null ids come last among a node's;
    repeated rows and copies are one node; an empty table gives no edges.
    """
    spark = docs.sparkSession
    texts = docs.select("text").where("text is not null")
    every = min(SAMPLED, max(1, texts.count() // SAMPLE))
    sample = texts.where(f"pmod(xxhash64(text, 7), {every}) = 0").withColumn("same", F.expr(SAME_TEXT)).mapInArrow(_sets, "node long, shingles array<bigint>").dropDuplicates(["node"])
    top = _most(stored(sample.select(F.explode("shingles").alias("token")).groupBy("token").agg(F.count("*").alias("often")).where(f"often >= {FREQUENT}")))
    known = np.array([r[0] for r in top], np.int64).view(np.uint64)
    order = np.argsort(known)
    shared = spark.sparkContext.broadcast((known[order], np.array([r[1] for r in top], np.int64)[order]))
    # One shuffle: shingles of one set go at once; frequent ones (salt 0 to 63, else -1) are dealt by node and stay.
    rows = texts.mapInArrow(_prefixes(shared), "token long, node long, size int, place int, salt int").repartition("token", "salt").distinct()
    rows = stored(rows.withColumn("n", F.expr("count(*) over (partition by token, salt)")).where("n > 1 or salt >= 0").drop("n", "salt"))
    sizes = rows.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    rows = stored(rows.join(sizes, "token"))
    found = []

    def compare(left: DataFrame, right: DataFrame, on: str, possible: str) -> DataFrame:
        return left.alias("x").join(right.alias("y"), "token").where(on).where(possible).selectExpr(
            "least(x.node, y.node) as a", "greatest(x.node, y.node) as b", "if(x.node < y.node, x.size, y.size) as sa", "if(x.node < y.node, y.size, x.size) as sb").distinct()

    def placed(met: DataFrame, pivots: DataFrame, others: DataFrame) -> DataFrame:
        """(token, pivot, node, near, size, place) of the pairs that stand in one shingle as a pivot and another set."""
        ways = met.unionByName(met.selectExpr("b as a", "a as b", "near"))
        both = pivots.selectExpr("token", "node as a").join(ways, "a").selectExpr("token", "a as pivot", "b as node", "near")
        return both.join(others.select("token", "node", "size", "place"), ["token", "node"]).select("token", "pivot", "node", "near", "size", "place")

    ids = stored(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.any_value("sketch").alias("sketch")))
    inside = f"{_PLACED} and {_reach(LINKED)}"
    few, many = rows.where(F.col("n") <= bucket_limit), rows.where(F.col("n") > bucket_limit)
    # These rows are many, and half a sketch tells enough of 4/5.
    few = few.drop("n").join(ids.selectExpr("node", f"{_halved('sketch')} as sketch"), "node")
    found.append(stored(compare(few, few, "x.node < y.node", inside)))
    many = stored(many.drop("n").join(ids, "node"))
    verified, left, beside = [], [], []
    taken = PIVOTS
    while not many.isEmpty():
        ordered = stored(many.withColumn("rank", F.expr("row_number() over (partition by token order by least nulls last, node)")))
        pivots, others = ordered.where(f"rank <= {taken}"), ordered.where(f"rank > {taken}")
        met = _verified(texts, marked, compare(pivots, many, "x.node <> y.node", _reach(LINKED)))
        verified.append(met.select("a", "b"))
        # A set leaves with the nearest of the pivots that link it, and only with that one it is compared with more.
        gone = placed(met, pivots, others).groupBy("token", "node").agg(F.expr("max_by(struct(pivot, near, size, place), struct(near, -pivot)) as one"))
        gone = stored(gone.select("token", "node", "one.*"))
        if not gone.isEmpty():
            left.append(gone)
            hubs = gone.selectExpr("token", "pivot as node").distinct()
            hubs = stored(pivots.join(hubs, ["token", "node"], "left_semi"))
            wide = compare(hubs, others, "x.node <> y.node", _reach(AROUND)).join(met.select("a", "b"), ["a", "b"], "left_anti")
            beside.append(stored(placed(_verified(texts, marked, wide, AROUND), hubs, others)))
        rest = others.drop("rank").join(gone, ["token", "node"], "left_anti")
        n = rest.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
        rest = stored(rest.join(n, "token"))
        small, many = rest.where(F.col("n") <= bucket_limit), stored(rest.where(F.col("n") > bucket_limit).drop("n"))
        found.append(compare(small, small, "x.node < y.node", inside))
        taken *= PIVOT_GROWTH
    verified.append(_verified(texts, marked, _together(found).distinct()).select("a", "b"))
    if left:
        verified.append(_verified(texts, marked, _borders(_together(left), _together(beside), _together(verified))).select("a", "b"))
    return _together(verified)


def _most(counts: DataFrame) -> list:
    """(token, often) of the most frequent tokens: all that occur so often or more, for the least number that leaves at most MOST_FREQUENT."""
    least, room = None, MOST_FREQUENT
    for often, n in counts.groupBy("often").count().orderBy(F.desc("often")).collect():
        if n > room:
            break
        least, room = often, room - n
    return counts.where(F.col("often") >= least).collect() if least is not None else []


def _together(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def _borders(left: DataFrame, beside: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs to verify of sets that left a shingle with a pivot and sets beside that pivot, where `edges` don't connect them yet.

    All that left with a pivot is connected to it, so what is beside is looked up once, not once for each pair. Sets at distances
    from the pivot that differ by more than 1/5 are further than that from each other.
    """
    beside = stored(beside)
    if beside.isEmpty():
        return beside.selectExpr("node as a", "node as b", "size as sa", "size as sb")
    roots = stored(components(edges))
    apart = beside.join(roots.selectExpr("node", "root"), "node", "left").join(roots.selectExpr("node as pivot", "root as met"), "pivot").where("root is null or root <> met")
    return left.alias("x").join(apart.alias("y"), ["token", "pivot"]).where("x.node <> y.node and x.near - y.near <= 0.2D + 1e-9D").where(f"5 * least(x.size, y.size) >= 4 * greatest(x.size, y.size) and {_PLACED}").selectExpr(
        "least(x.node, y.node) as a", "greatest(x.node, y.node) as b", "if(x.node < y.node, x.size, y.size) as sa", "if(x.node < y.node, y.size, x.size) as sb").distinct()


def groups(docs: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, same, fp, node) of every row and (node, root): rows are linked as op8 links them, and by `similar`.

    Rows without words are one node; null ids, repeated rows, empty tables and other columns are as for `marks`.
    """
    with _small_batches(docs.sparkSession):
        marked = stored(marks(docs))
        alike = similar(docs, marked)
    owners = stored(marked.groupBy("fp").agg(F.min("node").alias("own")))
    near = links(owners.select("fp"), radius)
    edges = near.join(owners.selectExpr("fp as a", "own as x"), "a").join(owners.selectExpr("fp as b", "own as y"), "b").selectExpr("x as a", "y as b")
    equal = marked.join(owners, "fp").selectExpr("node as a", "own as b").distinct()
    roots = components(edges.unionByName(equal).unionByName(alike))
    nodes = marked.select("node").distinct()
    return marked, stored(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
