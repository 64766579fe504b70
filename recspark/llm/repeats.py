"""Suffix-array dedup: remove every byte of a long string that occurs anywhere else, exactly, over all documents.

Windows of WINDOW bytes that are equal hold the same smallest k-gram hash (their anchor), so all windows of a document that
follow each other with one anchor form a run, and only runs with the same anchor can repeat one another. Runs of anchors that
occur once need no further look. Equal runs become one with a weight. The texts of the others meet by anchor, in shards that
build a suffix array each (`suffix_array`) and mark windows that share all bytes with a neighbour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.llm.common import mixed, prefix_hash, slices, span_hash, stored, table, utf8
from recspark.llm.suffix_array import common_prefixes, suffix_array

WINDOW = 400
GRAM = 64
# Window starts that are looked at together, and at most in one run: bounds of memory that don't change a result.
STRETCH = 1 << 20
RUN = 4096
# Bytes of run texts and windows in one suffix array, about: it ends with the anchor that reaches one of them.
SHARD_BYTES = 1 << 20
SHARD_WINDOWS = 1 << 16
# Anchors with more different runs, or more windows in them, are split: their runs are cut into pieces, which meet by
# what all windows of a piece have in common.
HOT_RUNS = 512
HOT_WINDOWS = 1 << 17
# Window starts of such a piece.
PIECE = 16


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    out, size = h, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (width - size)], out[width - size :]) if width > size else out


def _seen_twice(h: np.ndarray, starts: np.ndarray, counts: np.ndarray, anchors: np.ndarray, width: int) -> np.ndarray:
    """Does the anchor's k-gram occur more than once in a run's text? Only then can the run repeat itself."""
    bits = np.zeros(1 << 20, bool)
    low = np.uint64((1 << 20) - 1)
    bits[(anchors & low).astype(np.int64)] = True
    at = np.flatnonzero(bits[(h & low).astype(np.int64)])
    values = np.unique(anchors)
    number = np.minimum(np.searchsorted(values, h[at]), len(values) - 1)
    real = values[number] == h[at]
    places = np.sort((number[real] << 32) + at[real])
    own = np.searchsorted(values, anchors) << 32
    return np.searchsorted(places, own + starts + counts + width - 1) - np.searchsorted(places, own + starts) > 1


def runs(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM, stretch: int = STRETCH) -> list[np.ndarray]:
    """(row, start in the row, number of windows, anchor, hash of the run's text, may repeat itself) of all runs of all rows."""
    width = window - gram + 1
    found = []
    for base in range(0, max(0, len(data) - window + 1), stretch):
        part = data[base : base + stretch + window - 1]
        prefix = prefix_hash(part)
        at = np.arange(len(part) - gram + 1)
        h = mixed(span_hash(prefix, at, at + gram))
        least = _sliding_min(h, width)
        row = np.searchsorted(offsets, np.arange(base, base + len(least)), "right") - 1
        whole = np.flatnonzero(np.arange(base, base + len(least)) + window <= offsets[row + 1])
        if not len(whole):
            continue
        value = least[whole]
        new = np.r_[True, (value[1:] != value[:-1]) | (np.diff(whole) != 1) | (row[whole[1:]] != row[whole[:-1]])]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(whole)))
        if size.max() > RUN:  # cut long runs into pieces
            pieces = -(-size // RUN)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(np.repeat(size, pieces) - nth * RUN, RUN)
            first = np.repeat(first, pieces) + nth * RUN
        start, anchor = whole[first], value[first]
        text = mixed(span_hash(prefix, start, start + size + window - 1))
        found.append((row[start], start + base - offsets[row[start]], size, anchor, text, _seen_twice(h, start, size, anchor, width)))
    if not found:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, bool)]
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _run_finder(window: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, start, size, anchor, text, twice = runs(*utf8(batch.column("text")), window, gram)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("h1").take(at), batch.column("h2").take(at), pa.array(start), pa.array(size.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(text.view(np.int64)), pa.array(twice)],
                names=["h1", "h2", "start", "size", "anchor", "body", "twice"])

    return run


def _cutter(window: int) -> Callable:
    """Texts of the runs asked for in each document, once for each text that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in slices(batches):
            keys = list(zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True))
            batch = batch.take(pa.array([i for i, k in enumerate(keys) if k not in seen and not seen.add(k)], pa.int64()))
            data, offsets = utf8(batch.column("text"))
            asked = batch.column("asked")
            rows = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            flat = asked.flatten()
            start = flat.field("start").to_numpy() + offsets[rows]
            size = flat.field("size").to_numpy() + window - 1
            for at in range(0, len(rows), 4096):
                some = slice(at, at + 4096)
                texts = [data[a : a + n].tobytes() for a, n in zip(start[some].tolist(), size[some].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [flat.field(x)[some] for x in ("anchor", "body", "weight", "hot")] + [pa.array(texts, pa.binary())], names=["anchor", "body", "weight", "hot", "run_text"])

    return run


def _spans(marked: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> list[list[dict]]:
    """Stretches of marked window starts in each run, counted from the run's start."""
    out = []
    for a, n in zip(starts.tolist(), counts.tolist(), strict=True):
        edges = np.flatnonzero(np.diff(marked[a : a + n].astype(np.int8), prepend=0, append=0))
        out.append([{"from": int(x), "to": int(y)} for x, y in edges.reshape(-1, 2)])
    return out


SPANS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
SPANS_SQL = "array<struct<`from`: int, `to`: int>>"


def repeated_windows(texts: list[bytes], weights: np.ndarray, window: int = WINDOW) -> list[list[dict]]:
    """Window starts of each text that occur again in these texts; a text of weight 2 or more stands for so many equal ones."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    counts = sizes - window + 1
    order = suffix_array(data, starts, ends, counts, window)
    shared = common_prefixes(data, order, ends, window) >= window
    marked = np.zeros(len(data), bool)
    marked[order[shared]] = True
    marked[order[np.flatnonzero(shared) - 1]] = True
    for a, n, w in zip(starts.tolist(), counts.tolist(), weights.tolist(), strict=True):
        if w > 1:  # its copies share all of it
            marked[a : a + n] = True
    return _spans(marked, starts, counts)


def _sharded(window: int, shard_bytes: int) -> Callable:
    """Suffix arrays over batches of whole anchors; rows come sorted, and no anchor has more than HOT_RUNS different runs
    and HOT_WINDOWS windows, so a shard has at most SHARD_WINDOWS + HOT_WINDOWS of them."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        spans = repeated_windows([x[3] for x in held], np.array([x[2] for x in held]), window)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()), pa.array(spans, SPANS)], names=["anchor", "body", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, windows = [], 0, 0
        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("anchor", "body", "weight", "run_text")), strict=True):
                if held and row[:2] == held[-1][:2]:  # cut in two tasks
                    continue
                if (size >= shard_bytes or windows >= SHARD_WINDOWS) and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size, windows = [], 0, 0
                held.append(row)
                size += len(row[3])
                windows += len(row[3]) - window + 1
        if held:
            yield solve(held)

    return run


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _pieces(window: int, gram: int, piece: int) -> Callable:
    """Pieces of the runs of hot anchors; rows come sorted.

    A window's distance is that of the first anchor in it from its start, and equal windows have equal distances. A
    piece is the windows before one anchor with distances from k * piece to less than (k + 1) * piece. What such
    windows have in common, the core, depends on the anchor's place and k alone, so pieces that share a window have
    equal anchors, k and cores, whichever windows their runs hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out: list[tuple] = []
            for anchor, body, weight, text in zip(*(batch.column(x).to_pylist() for x in ("anchor", "body", "weight", "run_text")), strict=True):
                if (anchor, body) == last:
                    continue
                last = anchor, body
                data = np.frombuffer(text, np.uint8)
                at = np.arange(len(data) - gram + 1)
                places = np.flatnonzero(mixed(span_hash(prefix_hash(data), at, at + gram)) == np.array([anchor], np.int64).view(np.uint64)[0])
                start = np.arange(len(data) - window + 1)
                place = places[np.searchsorted(places, start)]
                k = (place - start) // piece
                first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (k[1:] != k[:-1])])
                for a, b in zip(first.tolist(), np.append(first[1:], len(start)).tolist(), strict=True):
                    begin = int(place[a] - k[a] * piece)
                    out.append((anchor, body, weight, a, b - a, int(k[a]), int(place[a] - a), _digest(text[begin : begin - piece + 1 + window]) + _digest(text[a : b + window - 1])))
            if out:
                *columns, digests = zip(*out, strict=True)
                words = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns] + [pa.array(words[:, i]) for i in range(4)],
                                                 names=["anchor", "body", "weight", "at", "n", "k", "distance", "c1", "c2", "t1", "t2"])

    return run


def _piece_cutter(window: int) -> Callable:
    """Texts of the pieces asked for in each run: (anchor, body) are the group and the piece from here on; rows come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for anchor, body, text, asked in zip(*(batch.column(x).to_pylist() for x in ("anchor", "body", "run_text", "asked")), strict=True):
                if (anchor, body) != last:
                    out += [(a["grp"], a["piece"], a["weight"], a["hot"], text[a["at"] : a["at"] + a["n"] + window - 1]) for a in asked]
                last = anchor, body
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["anchor", "body", "weight", "hot", "run_text"])

    return run


def _windows(window: int) -> Callable:
    """128-bit hashes of all windows of the texts; rows come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for anchor, body, weight, text in zip(*(batch.column(x).to_pylist() for x in ("anchor", "body", "weight", "run_text")), strict=True):
                if (anchor, body) == last:
                    continue
                last = anchor, body
                n = len(text) - window + 1
                digests = [_digest(text[i : i + window]) for i in range(n)]
                w = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, anchor)), pa.array(np.full(n, body)), pa.array(np.full(n, weight)), pa.array(np.arange(n, dtype=np.int32)), pa.array(w[:, 0]), pa.array(w[:, 1])],
                                                 names=["anchor", "body", "weight", "at", "w1", "w2"])

    return run


def _keyed(df: DataFrame, text: str) -> DataFrame:
    """The text as `text` with a 96-bit key of it, so that equal texts share their work and any row finds its result."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.withColumn("_text", body).withColumn("_h1", F.xxhash64("_text")).withColumn("_h2", F.hash("_text"))


def _split_spans(runs_of_hot: DataFrame, window: int, gram: int, shard_bytes: int, hot_runs: int, piece: int) -> DataFrame:
    """(anchor, body, spans) of runs (anchor, body, weight, run_text) whose anchors have too many different ones for one shard.

    Pieces meet by anchor, k and core; a piece alone with its core repeats as a whole, by its copies, or not at all. The
    different pieces of one core go to a suffix array like the runs of other anchors. What is left are cores with more
    different pieces than that: mostly the edges of a passage in very many documents, which differ in the few bytes that
    lie outside of it. Of these pieces (at most two an edge) the single windows are compared.
    """
    hot_runs_sorted = stored(runs_of_hot.select("anchor", "body", "weight", "run_text"))
    ordered = hot_runs_sorted.repartition("anchor", "body").sortWithinPartitions("anchor", "body")
    kinds = ", ".join(f"{c} long" for c in ("anchor", "body", "weight", "at", "n", "k", "distance", "c1", "c2", "t1", "t2"))
    pieces = stored(ordered.mapInArrow(_pieces(window, gram, piece), kinds).selectExpr(
        "anchor", "body", "weight", "at", "n", "xxhash64(anchor, k, c1, c2) as grp", "xxhash64(distance, n, t1, t2) as piece"))
    folded = pieces.groupBy("grp", "piece").agg(F.sum("weight").alias("weight"), F.min(F.struct("anchor", "body", "at", "n")).alias("one"))
    folded = stored(folded.select("grp", "piece", "weight", "one.*"))
    sized = stored(folded.join(folded.groupBy("grp").agg(F.count("*").alias("different")), "grp"))
    alone = sized.where("different = 1 and weight > 1").selectExpr("grp", "piece", f"cast(array(struct(0 as `from`, n as `to`)) as {SPANS_SQL}) as spans")
    asked = sized.where("different > 1").groupBy("anchor", "body").agg(F.collect_list(F.struct("grp", "piece", "weight", (F.col("different") > hot_runs).alias("hot"), "at", "n")).alias("asked"))
    texts = hot_runs_sorted.select("anchor", "body", "run_text").join(asked, ["anchor", "body"]).repartition("anchor", "body").sortWithinPartitions("anchor", "body").mapInArrow(
        _piece_cutter(window), "anchor long, body long, weight long, hot boolean, run_text binary")
    texts = stored(texts)
    few = texts.where("not hot").repartition("anchor").sortWithinPartitions("anchor", "body").mapInArrow(_sharded(window, shard_bytes), f"anchor long, body long, spans {SPANS_SQL}")
    single = stored(texts.where("hot").repartition("anchor", "body").sortWithinPartitions("anchor", "body").mapInArrow(
        _windows(window), "anchor long, body long, weight long, at int, w1 long, w2 long"))
    # Stored, so that adaptive execution can split a window of very many pieces in the join.
    again = stored(single.groupBy("w1", "w2").agg(F.sum("weight").alias("n")).where("n > 1").select("w1", "w2"))
    many = single.join(again, ["w1", "w2"]).groupBy("anchor", "body").agg(
        F.expr(f"cast(transform(array_sort(collect_list(at)), x -> struct(x as `from`, x + 1 as `to`)) as {SPANS_SQL})").alias("spans"))
    marked = stored(alone.unionByName(few.unionByName(many).withColumnsRenamed({"anchor": "grp", "body": "piece"}).where("size(spans) > 0")))
    met = pieces.select("anchor", "body", "at", "grp", "piece").join(marked, ["grp", "piece"])
    return met.groupBy("anchor", "body").agg(F.expr(
        f"cast(flatten(collect_list(transform(spans, s -> struct(int(at + s.`from`) as `from`, int(at + s.`to`) as `to`)))) as {SPANS_SQL})").alias("spans"))


def repeat_spans(df: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_runs: int = HOT_RUNS,
                 piece: int = PIECE) -> DataFrame:
    """(h1, h2, spans): for each different text with repeats, the stretches of window starts (from, to) that occur again.

    h1 and h2 are xxhash64 and hash of the text (null as empty). Counts are over all rows, the same text in two rows included.
    """
    docs = _keyed(df, text).select(F.col("_h1").alias("h1"), F.col("_h2").alias("h2"), F.col("_text").alias("text"))
    found = stored(docs.where(F.octet_length("text") >= window).mapInArrow(
        _run_finder(window, gram), "h1 long, h2 int, start long, size int, anchor long, body long, twice boolean"))
    shared = found.groupBy("anchor").agg(F.count("*").alias("n"), F.max("twice").alias("any_twice")).where("n > 1 or any_twice").select("anchor")
    # Equal texts have equal runs: one row with the number of copies.
    places = stored(found.join(shared, "anchor").groupBy("h1", "h2", "start", "size", "anchor", "body", "twice").agg(F.count("*").alias("copies")))
    bodies = places.groupBy("anchor", "body").agg(
        F.sum("copies").alias("weight"), F.max("twice").alias("twice"), F.min(F.struct("h1", "h2", "start", "size")).alias("one"))
    sizes = bodies.groupBy("anchor").agg(F.count("*").alias("different"), F.sum("one.size").alias("windows"))
    bodies = stored(bodies.join(sizes, "anchor").select("anchor", "body", "weight", "twice", "different", "windows", "one.*"))
    # The only run of its anchor repeats as a whole, or not at all.
    whole = bodies.where("different = 1 and not twice and weight > 1").select("anchor", "body", F.expr(f"cast(array(struct(0 as `from`, size as `to`)) as {SPANS_SQL})").alias("spans"))
    asked = bodies.where("different > 1 or twice").groupBy("h1", "h2").agg(
        F.collect_list(F.struct("start", "size", "anchor", "body", "weight", ((F.col("different") > hot_runs) | (F.col("windows") > HOT_WINDOWS)).alias("hot"))).alias("asked"))
    texts = stored(docs.join(asked, ["h1", "h2"]).mapInArrow(_cutter(window), "anchor long, body long, weight long, hot boolean, run_text binary"))
    mild = texts.where("not hot").repartition("anchor").sortWithinPartitions("anchor", "body").mapInArrow(_sharded(window, shard_bytes), f"anchor long, body long, spans {SPANS_SQL}")
    hot = _split_spans(texts.where("hot"), window, gram, shard_bytes, hot_runs, piece)
    marked = whole.unionByName(mild).unionByName(hot).where("size(spans) > 0")
    starts = places.select("h1", "h2", "start", "anchor", "body").join(marked, ["anchor", "body"])
    return starts.select("h1", "h2", F.expr("transform(spans, s -> struct(start + s.`from` as `from`, start + s.`to` as `to`))").alias("spans")).groupBy("h1", "h2").agg(
        F.flatten(F.collect_list("spans")).alias("spans"))


def covered(spans: list[dict], window: int) -> list[tuple[int, int]]:
    """Bytes under the windows that start in the spans, as maximal stretches."""
    out: list[list[int]] = []
    for a, b in sorted((s["from"], s["to"] + window - 1) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _remover(window: int, decode: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            data, offsets = utf8(batch.column("_text"))
            kept, removed, counts = [], [], []
            for a, b, spans in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("_spans").to_pylist(), strict=True):
                stretches = covered(spans or [], window)
                at, parts = a, []
                for x, y in stretches:
                    parts.append(data[at : a + x].tobytes())
                    at = a + y
                parts.append(data[at:b].tobytes())
                kept.append(b"".join(parts))
                removed.append(sum(y - x for x, y in stretches))
                counts.append(len(stretches))
            body = [k.decode("utf-8", "ignore") for k in kept] if decode else [hashlib.sha256(k).hexdigest() for k in kept]
            own = [i for i, n in enumerate(batch.schema.names) if n not in ("_text", "_spans")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in own] + [pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(body, pa.string())],
                names=[batch.schema.names[i] for i in own] + ["n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(df: DataFrame, text: str = "text", window: int = WINDOW, digest: bool = False, **how) -> DataFrame:
    """The columns of `df` but the text, with n_bytes, n_removed, n_spans and kept, which replace columns of these names.

    Each byte under a string of `window` bytes that starts anywhere else too, in the same row or another, goes; all
    occurrences go, judged on the input. Null texts count as empty; texts shorter than the window stay whole; repeated
    rows are copies of each other, so all their windows repeat. kept is the rest as text (broken characters at a cut are
    left out) or, with `digest`, the SHA-256 of the remaining bytes. An empty table gives no rows.
    """
    spans = stored(repeat_spans(df, text, window, **how).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("spans").alias("_spans")))
    rest = [c for c in df.columns if c not in (text, "n_bytes", "n_removed", "n_spans", "kept")]
    met = _keyed(df, text).join(spans, ["_h1", "_h2"], "left").select(*[f"`{c}`" for c in rest], "_text", "_spans")
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return met.mapInArrow(_remover(window, not digest), f"{kinds + ', ' if kinds else ''}n_bytes long, n_removed long, n_spans long, kept string")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256")
