"""License scans: stretches of a text against license templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from recspark.llm.common import FOLD_ASCII, WORD_BYTES, mixed, prefix_hash, slices, span_hash, table, utf8, word_spans
from recspark.llm.license_texts import TEMPLATES

LEAST = 0.8
TEMPLATE_BYTES = 16 << 20
STRIDE = np.uint64(0x9E3779B97F4A7C15)


def _bigrams(words: np.ndarray) -> np.ndarray:
    return mixed(words[:-1] * STRIDE + words[1:])


@dataclass(frozen=True)
class Templates:
    names: list[str]
    sizes: np.ndarray  # bigrams of each template
    keys: np.ndarray  # sorted different bigrams of all templates
    first: np.ndarray  # each bigram's place in the next two, and their number at the end
    template: np.ndarray
    count: np.ndarray


def index_templates(texts: tuple[tuple[str, str], ...]) -> Templates:
    """Templates of fewer than two words have no bigram and match nothing; names that come twice are variants of one license."""
    if sum(len(t.encode()) for _, t in texts) > TEMPLATE_BYTES:
        raise ValueError(f"templates exceed the bound of the broadcast, {TEMPLATE_BYTES} bytes")
    names, sizes, rows = [], [], []
    for name, text in texts:
        data, offsets = utf8(pa.array([text]))
        folded = FOLD_ASCII[data]
        starts, ends, _ = word_spans(folded, offsets, WORD_BYTES)
        grams, counts = np.unique(_bigrams(mixed(span_hash(prefix_hash(folded), starts, ends))), return_counts=True)
        if len(grams):
            rows.append(np.stack([grams, np.full(len(grams), len(names), np.uint64), counts.astype(np.uint64)], 1))
            names.append(name)
            sizes.append(int(counts.sum()))
    all_rows = np.concatenate([np.zeros((0, 3), np.uint64), *rows])
    all_rows = all_rows[np.lexsort((all_rows[:, 1], all_rows[:, 0]))]
    keys, first = np.unique(all_rows[:, 0], return_index=True)
    return Templates(names, np.array(sizes, np.int64), keys, np.append(first, len(all_rows)), all_rows[:, 1].astype(np.int64), all_rows[:, 2].astype(np.int64))


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of what is compared as a whole: lines, blocks of lines between blank ones, and texts, each once."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    # A line ends before a break, which may be where it starts, or with its text, where the next text starts.
    ends = np.concatenate([breaks, offsets[1:]])
    line_start = np.concatenate([starts[np.searchsorted(starts, breaks, "right") - 1], starts[np.searchsorted(starts, offsets[1:], "left") - 1]])
    lines = np.stack([line_start, ends], 1)
    lines = lines[lines[:, 1] > lines[:, 0]]
    lines = np.unique(lines, axis=0)
    words = np.append(0, np.cumsum(WORD_BYTES[FOLD_ASCII[data]]))
    full = lines[words[lines[:, 1]] > words[lines[:, 0]]]
    row = np.searchsorted(offsets, full[:, 0], "right") - 1
    # A block goes on as long as the next line with words follows at once in the same text.
    new = np.r_[True, (full[1:, 0] != full[:-1, 1] + 1) | (row[1:] != row[:-1])] if len(full) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(full)) - 1 if len(full) else first
    blocks = np.stack([full[first, 0], full[last, 1]], 1)
    whole = np.stack([offsets[:-1], offsets[1:]], 1)
    found = np.unique(np.concatenate([full, blocks, whole[whole[:, 1] > whole[:, 0]]]), axis=0)
    return np.searchsorted(offsets, found[:, 0], "right") - 1, found[:, 0], found[:, 1]


def matches(data: np.ndarray, offsets: np.ndarray, templates: Templates, least: float = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, template, dice) of all stretches and templates at `least` or more."""
    folded = FOLD_ASCII[data]
    starts, ends, before = word_spans(folded, offsets, WORD_BYTES)
    words = mixed(span_hash(prefix_hash(folded), starts, ends))
    row, begin, end = stretches(data, offsets)
    first, after = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    size = np.maximum(after - first - 1, 0)
    grams = _bigrams(words)
    at = np.minimum(np.searchsorted(templates.keys, grams), max(len(templates.keys) - 1, 0))
    hit = np.flatnonzero(templates.keys[at] == grams) if len(templates.keys) else np.zeros(0, np.int64)
    # Stretches with a template's bigram, of a size that can reach the coefficient with some template: 2 min / (a + b).
    low, high = np.searchsorted(hit, first), np.searchsorted(hit, np.maximum(after - 1, first))
    small, large = templates.sizes.min(initial=1 << 60), templates.sizes.max(initial=0)
    some = np.flatnonzero((high > low) & (size >= least / (2 - least) * small) & (size <= (2 - least) / least * large))
    out = []
    for i in some.tolist():
        own, counts = np.unique(at[hit[low[i] : high[i]]], return_counts=True)
        n = templates.first[own + 1] - templates.first[own]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(templates.first[own], n)
        possible = np.unique(templates.template[place])
        possible = possible[2 * np.minimum(templates.sizes[possible], size[i]) >= least * (templates.sizes[possible] + size[i])]
        if len(possible):
            shared = np.bincount(templates.template[place], np.minimum(np.repeat(counts, n), templates.count[place]), len(templates.names))
            dice = 2 * shared[possible] / (templates.sizes[possible] + size[i])
            out += [(row[i], begin[i] - offsets[row[i]], end[i] - offsets[row[i]], t, d) for t, d in zip(possible.tolist(), dice.tolist(), strict=True) if d >= least]
    cols = list(zip(*out, strict=True)) or [()] * 5
    return tuple(np.array(c, float if i == 4 else np.int64) for i, c in enumerate(cols))


def passages(data: np.ndarray, offsets: np.ndarray, templates: Templates, least: float = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `matches`, over all runs of words inside a text, whatever their lines; for each start the best run, if it is at `least` or more.

    A best run begins and ends with a bigram of its template, so no other ends are tried. A run of w bigrams that reaches
    the coefficient with a template of s shares least / 2 * (s + w) of them, and w is within the size bounds.
    """
    folded = FOLD_ASCII[data]
    starts, ends, before = word_spans(folded, offsets, WORD_BYTES)
    grams = _bigrams(mixed(span_hash(prefix_hash(folded), starts, ends)))
    out = []
    if len(grams) and len(templates.keys):
        at = np.minimum(np.searchsorted(templates.keys, grams), len(templates.keys) - 1)
        inside = templates.keys[at] == grams
        edges = before[1:-1] - 1
        inside[edges[(edges >= 0) & (edges < len(grams))]] = False
        hit = np.flatnonzero(inside)
        n = templates.first[at[hit] + 1] - templates.first[at[hit]]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(templates.first[at[hit]], n)
        where, owner = np.repeat(hit, n), templates.template[place]
        order = np.argsort(owner, kind="stable")
        where, place, owner = where[order], place[order], owner[order]
        row_of = np.searchsorted(before, where, "right") - 1
        for t, size in enumerate(templates.sizes.tolist()):
            a, b = np.searchsorted(owner, [t, t + 1])
            own, keys, rows = where[a:b], place[a:b], row_of[a:b]
            # Hits of one row up to the largest size; a hundredth is left for rounding.
            to = np.searchsorted(own, np.minimum(own + int((2 - least) / least * size + 0.01), before[rows + 1]), "left")
            short = np.ceil(least / (2 - least) * size - 0.01)
            for i in np.flatnonzero(to - np.arange(len(own)) >= least / 2 * (size + short) - 0.01).tolist():
                run = keys[i : to[i]]
                by = np.argsort(run, kind="stable")
                new = np.r_[True, run[by][1:] != run[by][:-1]]
                seen = np.empty(len(run), np.int64)
                seen[by] = np.arange(len(run)) - np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
                dice = 2 * np.cumsum(seen < templates.count[run]) / (size + own[i : to[i]] - own[i] + 1)
                j = int(np.argmax(dice))
                if dice[j] >= least:
                    r = int(rows[i])
                    out.append((r, starts[own[i]] - offsets[r], ends[own[i + j] + 1] - offsets[r], t, dice[j]))
    cols = list(zip(*out, strict=True)) or [()] * 5
    return tuple(np.array(c, float if i == 4 else np.int64) for i, c in enumerate(cols))


FOUND = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("from", pa.int64()), ("to", pa.int64())]))
FOUND_SQL = "array<struct<license: string, dice: double, `from`: bigint, `to`: bigint>>"


def _scanner(shared, text: str, least: float, inside: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = shared.value
        for batch in slices(batches, text):
            found: list[dict[str, dict]] = [{} for _ in range(batch.num_rows)]
            every = [x(*utf8(batch.column(text)), templates, least) for x in ([matches, passages] if inside else [matches])]
            for r, a, b, t, d in sorted(zip(*(np.concatenate(x).tolist() for x in zip(*every, strict=True)), strict=True), key=lambda x: (x[0], -x[4], x[1], x[2])):
                found[r].setdefault(templates.names[t], {"license": templates.names[t], "dice": d, "from": a, "to": b})
            kept = batch.drop_columns([text])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([sorted(f.values(), key=lambda x: (-x["dice"], x["license"])) for f in found], FOUND)], names=[*kept.schema.names, "licenses"])

    return run


def scan(df: DataFrame, texts: tuple[tuple[str, str], ...] = TEMPLATES, text: str = "text", least: float = LEAST, inside: bool = False) -> DataFrame:
    """The columns of `df` but the text, with licenses, which replaces a column of that name.

    licenses: for each license with a stretch (line, block of lines, or whole text) at `least` or more, the best one's
    coefficient and bytes (from, to); best first, ties by name. With `inside`, runs of words anywhere in a text count too, so
    that a notice of several paragraphs or a sentence is found in a longer text or line. Normalised means: lower-cased words of letters and digits.
    Null and empty texts, and texts of one word, match nothing; repeated rows stay; an empty table gives no rows. Templates are
    bounded by TEMPLATE_BYTES and broadcast. No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(index_templates(texts))
    rest = df.drop("licenses")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name != text)
    return rest.mapInArrow(_scanner(shared, text, least, inside), f"{kinds + ', ' if kinds else ''}licenses {FOUND_SQL}")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), inside=True)
    return found.selectExpr("doc_id", "get(licenses, 0).license as license", "get(licenses, 0).dice as dice",
                            "bigint(size(licenses)) as n_licenses", "array_join(transform(licenses, x -> x.license), ',') as licenses")
