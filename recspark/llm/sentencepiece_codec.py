"""SentencePiece encoding and decoding of BPE models: batched numpy Viterbi over a lattice of pieces.

A BPE model's segmentation isn't the one with the best sum of scores, so plain Viterbi would give other ids than the library.
It is the only path on which every two neighbours are what merging makes of their joined text: a merge across the border of
two neighbours would also happen if these two stood alone, and the other way round. So the lattice allows a step only if it
passes that test; the test of a pair runs the merges on its joined text, in batches, once for each pair met.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.llm.common import mixed, powers, slices, table

MODEL = "piece_bpe_32k.model"
BLANK = 0x2581
SLICE = 3 << 19
# Words and pairs of pieces that a worker remembers.
MEMORY = 1 << 19
BYTE = 6
NORMAL = 1
FILTER_BITS = 22


def _prefix(codes: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = BASE^i * hash(codes[i:j]), along the last axis."""
    up, _ = powers(codes.shape[-1] + 1)
    values = mixed(codes.astype(np.uint64) + np.uint64(77)) * up[: codes.shape[-1]]
    out = np.zeros((*codes.shape[:-1], codes.shape[-1] + 1), np.uint64)
    np.cumsum(values, axis=-1, out=out[..., 1:])
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Memory:
    """Sorted keys with values, in arrays; emptied when it grows over a bound."""

    def __init__(self, bound: int) -> None:
        self.bound = bound
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], -1)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New keys, sorted."""
        if not len(keys):
            return
        if len(self.keys) + len(keys) > self.bound:
            self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.values = np.insert(self.keys, at, keys), np.insert(self.values, at, values)


class Codec:
    """Pieces of a model file as sorted hash keys."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
        trainer, normal = model.trainer_spec, model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if trainer.model_type != trainer.BPE or normal.name != "identity" or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or not trainer.byte_fallback or kinds - {1, 2, 3, 6}:
            raise ValueError("only BPE models with byte fallback, identity normalization and no user-defined pieces")
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = np.array([p.type for p in model.pieces])
        self.scores = np.array([p.score for p in model.pieces])
        normal_ids = np.flatnonzero(self.kinds == NORMAL)
        codes = [_codes(self.pieces[i]) for i in normal_ids]
        self.longest = max(map(len, codes))
        hashes = np.array([_prefix(c)[-1] for c in codes], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], normal_ids[order]
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.byte_ids = np.zeros(256, np.int64)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        # No merge joins two characters that no piece has side by side.
        self.neighbours = np.unique(np.concatenate([(c[:-1].astype(np.int64) << 32) | c[1:] for c in codes if len(c) > 1]))
        self.pairs = _Memory(MEMORY)
        self.words = _Memory(MEMORY)
        self.word_ids = [np.zeros(0, np.int32)]  # flat ids of remembered words, by slice of work
        self.word_base = 0
        surface = [self._surface(i) for i in range(len(self.pieces))]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_end = np.cumsum([len(s) for s in surface])
        self.surface_size = np.array([len(s) for s in surface])

    def _surface(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return {NORMAL: self.pieces[i].replace(chr(BLANK), " "), 2: " ⁇ "}.get(int(kind), "").encode()

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        out = np.full(len(hashes), -1)
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[some]), len(self.keys) - 1)
        out[some] = np.where(self.keys[at] == hashes[some], self.ids[at], -1)
        return out

    def merged(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Borders between symbols after all merges: the best-scored piece that two neighbours make, leftmost first, again and again."""
        n, width = codes.shape
        prefix = _prefix(codes)
        _, down = powers(width + 1)
        column = np.arange(width + 1)
        border = column[None, :] <= sizes[:, None]
        live = np.arange(n)
        while len(live):
            own = border[live]
            left = np.maximum.accumulate(np.where(own, column, -1), axis=1)
            right = np.minimum.accumulate(np.where(own, column, width + 1)[:, ::-1], axis=1)[:, ::-1]
            inner = own.copy()
            inner[:, 0] = False
            inner[np.arange(len(live)), sizes[live]] = False
            row, at = np.nonzero(inner)
            a, c = left[row, at - 1], right[row, at + 1]
            found = self.probe((prefix[live[row], c] - prefix[live[row], a]) * down[a])
            score = np.full(own.shape, -np.inf)
            score[row, at] = np.where(found >= 0, self.scores[found], -np.inf)
            best = score.argmax(1)
            some = np.flatnonzero(score[np.arange(len(live)), best] > -np.inf)
            border[live[some], best[some]] = False
            live = live[some]
        return border

    def _text(self, token: int) -> np.ndarray:
        return np.zeros(0, np.uint32) if token < 0 else _codes(self.pieces[token]) if token < len(self.pieces) else np.array([token - len(self.pieces)], np.uint32)

    def compatible(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Does merging leave `before` and `after` as they are, side by side? before -1: the start of a word."""
        keys = ((before + 1).astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        distinct, which = np.unique(keys, return_inverse=True)
        known = self.pairs.find(distinct)
        fresh = np.flatnonzero(known < 0)
        for at in range(0, len(fresh), 4096):
            some = fresh[at : at + 4096]
            pairs = [(self._text(int(k >> np.uint64(32)) - 1), self._text(int(k & np.uint64(0xFFFFFFFF)))) for k in distinct[some]]
            first, sizes = np.array([len(a) for a, _ in pairs]), np.array([len(a) + len(b) for a, b in pairs])
            codes = np.zeros((len(pairs), sizes.max()), np.uint32)
            for row, (a, b) in enumerate(pairs):
                codes[row, : len(a)], codes[row, len(a) : len(a) + len(b)] = a, b
            border = self.merged(codes, sizes)
            known[some] = border[np.arange(len(pairs)), first] & (border.sum(1) == 2 + (first > 0))
        self.pairs.add(distinct[fresh], known[fresh])
        return known[which] > 0

    def viterbi(self, codes: np.ndarray) -> list[np.ndarray]:
        """Tokens of words of one length (word x character), all words a character at a time. Ids from the number of pieces
        on stand for single characters that are no piece."""
        n, size = codes.shape
        prefix = _prefix(codes)
        _, down = powers(size + 1)
        last = np.full((n, size + 1), -1)
        back = np.zeros((n, size + 1), np.int64)
        rows = np.arange(n)
        for j in range(1, size + 1):
            row, length, token = [], [], []
            for step in range(1, min(j, self.longest) + 1):
                found = self.probe((prefix[:, j] - prefix[:, j - step]) * down[j - step])
                if step == 1:
                    found = np.where(found < 0, codes[:, j - 1].astype(np.int64) + len(self.pieces), found)
                hit = np.flatnonzero(found >= 0)
                row.append(hit)
                length.append(np.full(len(hit), step))
                token.append(found[hit])
            row, length, token = np.concatenate(row), np.concatenate(length), np.concatenate(token)
            fits = self.compatible(last[row, j - length], token)
            # The one admissible step is the maximum.
            value = np.full((n, min(j, self.longest) + 1), -np.inf)
            value[row[fits], length[fits]] = 0.0
            back[:, j] = value.argmax(1)
            chosen = np.full((n, value.shape[1]), -1)
            chosen[row, length] = token
            last[:, j] = chosen[rows, back[:, j]]
        at, steps = np.full(n, size), []
        while (at > 0).any():
            steps.append(np.where(at > 0, last[rows, at], -1))
            at = at - back[rows, at] * (at > 0)
        tokens = np.stack(steps[::-1], 1) if steps else np.zeros((n, 0), np.int64)
        return [t[t >= 0] for t in tokens]

    def _expanded(self, tokens: np.ndarray) -> np.ndarray:
        """Characters that are no piece become their bytes."""
        if not (tokens >= len(self.pieces)).any():
            return tokens.astype(np.int32)
        return np.concatenate([self.byte_ids[np.frombuffer(chr(t - len(self.pieces)).encode("utf-8", "surrogatepass"), np.uint8)] if t >= len(self.pieces) else [t] for t in tokens.tolist()]).astype(np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and where each text's begin and end."""
        joined = "".join(" " + t if t else "" for t in texts)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        text_end = np.cumsum(sizes)
        codes = _codes(joined).copy()
        codes[codes == 0x20] = BLANK
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        pair = (codes[:-1].astype(np.int64) << 32) | codes[1:]
        at = np.minimum(np.searchsorted(self.neighbours, pair), len(self.neighbours) - 1)
        begins = np.append(True, self.neighbours[at] != pair)
        begins[text_end[text_end < len(codes)]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(codes))
        prefix = _prefix(codes)
        _, down = powers(len(codes) + 1)
        hashes = mixed((prefix[ends] - prefix[starts]) * down[starts]) ^ (ends - starts).astype(np.uint64)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        lengths = (ends - starts)[first]
        found: list[np.ndarray] = [None] * len(distinct)
        known = self.words.find(distinct)
        fresh = np.flatnonzero(known < 0)
        for size in np.unique(lengths[fresh]).tolist():
            some = fresh[lengths[fresh] == size]
            for i in range(0, len(some), max(1, (1 << 20) // size)):
                part = some[i : i + max(1, (1 << 20) // size)]
                for word, tokens in zip(part.tolist(), self.viterbi(codes[starts[first[part]][:, None] + np.arange(size)]), strict=True):
                    found[word] = self._expanded(tokens)
        # Remembered words: offset and number of ids in one number.
        flat = np.concatenate(self.word_ids)
        old = np.flatnonzero(known >= 0)
        fresh_ids = [found[i] for i in fresh.tolist()]
        counts = np.zeros(len(distinct), np.int64)
        offset = np.zeros(len(distinct), np.int64)
        counts[old], offset[old] = known[old] & 0xFFFFF, known[old] >> 20
        counts[fresh] = [len(x) for x in fresh_ids]
        offset[fresh] = len(flat) + np.cumsum(counts[fresh]) - counts[fresh]
        flat = np.concatenate([flat, *fresh_ids]) if len(fresh_ids) else flat
        self._remember(flat, distinct, offset, counts, fresh)
        n = counts[which]
        total = np.cumsum(n)
        ids = flat[np.arange(total[-1]) - np.repeat(total - n, n) + np.repeat(offset[which], n)]
        return ids, np.append(0, total)[np.searchsorted(starts, np.append(0, text_end))]

    def _remember(self, flat: np.ndarray, keys: np.ndarray, offset: np.ndarray, counts: np.ndarray, fresh: np.ndarray) -> None:
        keep = fresh[counts[fresh] < 64]
        if len(self.words.keys) + len(keep) > MEMORY:
            self.words, self.word_ids = _Memory(MEMORY), [np.zeros(0, np.int32)]
            return
        self.word_ids = [flat]
        self.words.add(keys[keep], (offset[keep] << 20) | counts[keep])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of runs of ids: byte pieces join to characters, broken ones become U+FFFD, the blank before the text goes."""
        n = self.surface_size[ids]
        total = np.cumsum(n)
        whole = self.surface[np.arange(total[-1] if len(total) else 0) - np.repeat(total - n, n) + np.repeat(self.surface_end[ids] - n, n)].tobytes()
        edges = np.append(0, total)[offsets].tolist()
        return [whole[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(edges[:-1], edges[1:], strict=True)]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _coder(path: str, text: str, back: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in slices(batches, text, SLICE):
            ids, offsets = coder.encode([t or "" for t in batch.column(text).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            decoded = [pa.array(coder.decode(ids, offsets), pa.string())] if back else []
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, *decoded], names=[*batch.schema.names, "token_ids", *["decoded"] * back])

    return run


def encode(df: DataFrame, model_path: str, text: str = "text", back: bool = False) -> DataFrame:
    """The columns of `df` with token_ids, which replaces a column of that name: the ids the library gives for the whole text.

    With `back`, also `decoded`, the text of these ids, made in the same pass.

    Null and empty texts have no ids; repeated rows stay; an empty table gives no rows. The model file lies at the same path
    on every worker. No shuffle.
    """
    rest = df.drop("token_ids", *["decoded"] * back)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(_coder(model_path, text, back), f"{kinds}, token_ids array<int>{', decoded string' * back}")


def _decoder(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            lists = batch.column("token_ids")
            lists = lists.fill_null([]) if lists.null_count else lists
            offsets = lists.offsets.to_numpy()
            texts = coder.decode(lists.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0])
            kept = batch.drop_columns(["token_ids"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(texts, pa.string()), lists], names=[*kept.schema.names, "decoded", "token_ids"])

    return run


def decode(df: DataFrame, model_path: str) -> DataFrame:
    """The columns of `df` with `decoded`, the text of token_ids; null ids count as none. Replaces a column of that name."""
    rest = df.drop("decoded")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name != "token_ids")
    return rest.mapInArrow(_decoder(model_path), f"{kinds + ', ' if kinds else ''}decoded string, token_ids array<int>")


def _digested(path: str) -> Callable:
    """Encode, decode again and compare, a slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in slices(batches, "text", SLICE):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, offsets = coder.encode(texts)
            back = coder.decode(ids, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
                 pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]), pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_())],
                names=["doc_id", "n_tokens", "token_ids", "decoded_sha256", "round_trip"])

    return run


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(_digested(public_tokenizers.path(MODEL)), "doc_id long, n_tokens long, token_ids array<int>, decoded_sha256 string, round_trip boolean")
