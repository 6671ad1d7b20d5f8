"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Pieces and their scores are read from a model file. The trie is two integer arrays (base and check)
over UTF-8 bytes; all distinct words of a batch are walked through it together, one byte at a time,
and the best segmentation of each is the one with the highest sum of log scores. A character that
no piece covers falls back to the byte pieces. White space is written as the marker U+2581, one
before the text too; no piece holds a marker behind another character, so a text's best
segmentation is that of its words put together, and each distinct word is segmented once a batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.llm.tokens import slices

MARK = "\u2581"
#: Stands for a cut between words while a batch is taken apart.
CUT = "\ue000"
#: Kinds of pieces as the model file numbers them.
NORMAL, UNKNOWN_KIND, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: How far below the lowest score an unknown character is scored, as in the published encoder.
UNKNOWN_PENALTY = np.float32(10.0)


def rank_scores(count: int) -> np.ndarray:
    """Log scores by rank under a Zipf law, for vocabularies whose file only ranks the pieces."""
    weights = 1.0 / (np.arange(count) + 2.7)
    return np.log(weights / weights.sum()).astype(np.float32)


class DoubleArray:
    """A trie in two arrays: from state s, byte c leads to t = base[s] + c + 1 if check[t] == s."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.base, self.check = np.zeros(1 << 10, np.int32), np.full(1 << 10, -1, np.int32)
        self.value = np.full(1 << 10, -1, np.int32)
        self.check[0] = 0
        self.free = 258  # every code leaves a base of at least 1 from here on
        self._fill([keys[i] for i in order], order)

    def _room(self, size: int) -> None:
        while size > len(self.base):
            self.base = np.concatenate([self.base, np.zeros_like(self.base)])
            self.check = np.concatenate([self.check, np.full_like(self.check, -1)])
            self.value = np.concatenate([self.value, np.full_like(self.value, -1)])

    def _fill(self, keys: list[bytes], values: list[int]) -> None:
        top = self.free
        waiting = [(0, 0, 0, len(keys))]  # state, depth, first and last key
        while waiting:
            state, depth, first, last = waiting.pop()
            if first < last and len(keys[first]) == depth:
                self.value[state] = values[first]
                first += 1
            if first == last:
                continue
            cuts, codes = [first], [keys[first][depth]]
            for i in range(first + 1, last):
                if keys[i][depth] != codes[-1]:
                    cuts.append(i)
                    codes.append(keys[i][depth])
            cuts.append(last)
            offsets = np.array(codes) + 1
            # an only child takes the first free place that its code allows, families the open end
            base = max(1, (self.free if len(codes) == 1 else top + 1) - int(offsets[0]))
            while True:
                self._room(base + 258)
                if (self.check[base + offsets] < 0).all():
                    break
                base += 1
            top = max(top, base + int(offsets[-1]))
            self.base[state] = base
            self.check[base + offsets] = state
            while self.free < len(self.check) and self.check[self.free] >= 0:
                self.free += 1
            waiting += [(base + int(o), depth + 1, a, b) for o, a, b in zip(offsets, cuts, cuts[1:])]
        self._room(int(self.base.max()) + 258)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """Encodes and decodes with the pieces of a model file."""

    def __init__(self, path: str, ranked: bool = True):
        with open(path, "rb") as f:
            messages = [dict(_fields(m)) for number, m in _fields(f.read()) if number == 1]
        self.pieces = [m[1].decode() for m in messages]
        kinds = np.array([m.get(3, NORMAL) for m in messages])
        stored = np.array([np.frombuffer(m.get(2, b"\0\0\0\0"), "<f4")[0] for m in messages], np.float32)
        self.scores = stored
        usable = np.flatnonzero((kinds == NORMAL) | (kinds == USER))
        if ranked:
            self.scores = np.zeros(len(kinds), np.float32)
            self.scores[usable] = rank_scores(len(usable))[np.argsort(np.argsort(-stored[usable], kind="stable"))]
        self.unknown = int(np.flatnonzero(kinds == UNKNOWN_KIND)[0])
        self.unknown_score = np.float32(self.scores[usable].min() - UNKNOWN_PENALTY)
        self.bytes = np.full(256, self.unknown, np.int32)
        for i in np.flatnonzero(kinds == BYTE):
            self.bytes[int(self.pieces[i][3:5], 16)] = i
        self.shown = [b"" if k in (CONTROL, UNUSED) else bytes([int(p[3:5], 16)]) if k == BYTE else p.encode() for p, k in zip(self.pieces, kinds)]
        self.trie = DoubleArray([self.pieces[i].encode() for i in usable])
        self.ids = usable.astype(np.int32)
        self.longest = max(len(self.pieces[i].encode()) for i in usable)

    def segment(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best segmentation of each word, all in a row, and where each word's begin."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out: list[np.ndarray | None] = [None] * len(words)
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):  # words of about the same length together, a bounded grid at a time
            to = at + 1
            while to < len(order) and (to + 1 - at) * (int(sizes[order[to]]) + 1) <= 1 << 20:
                to += 1
            some = order[at:to]
            for i, ids in zip(some.tolist(), self._segment([words[i] for i in some.tolist()], sizes[some])):
                out[i] = ids
            at = to
        counts = np.fromiter(map(len, out), np.int64, len(out))
        return (np.concatenate(out) if out else np.empty(0, np.int32)), np.concatenate([[0], np.cumsum(counts)])

    def _segment(self, words: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
        n, most = len(words), int(sizes.max())
        grid = np.zeros((most + 1, n), np.uint8)
        for k, w in enumerate(words):
            grid[: len(w), k] = np.frombuffer(w, np.uint8)
        best = np.full((most + 1, n), -np.inf, np.float32)
        best[0] = 0
        from_, piece = np.zeros((most + 1, n), np.int32), np.full((most + 1, n), self.unknown, np.int32)
        lane = np.arange(n)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for start in range(most):
            open_ = lane[(sizes > start) & np.isfinite(best[start]) & (grid[start] & 0xC0 != 0x80)]
            if not len(open_):
                continue
            first = grid[start, open_]
            width = np.minimum(np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4))), sizes[open_] - start)
            single, state, live = np.zeros(n, bool), np.zeros(len(open_), np.int32), open_
            for step in range(start, min(most, start + self.longest)):
                to = base[state] + grid[step, live].astype(np.int32) + 1
                good = (check[to] == state) & (sizes[live] > step)
                live, state = live[good], to[good]
                if not len(live):
                    break
                hit = value[state] >= 0
                if hit.any():
                    ends, ids = live[hit], self.ids[value[state[hit]]]
                    score = best[start, ends] + self.scores[ids]
                    better = score > best[step + 1, ends]
                    ends, ids, score = ends[better], ids[better], score[better]
                    best[step + 1, ends], from_[step + 1, ends], piece[step + 1, ends] = score, start, ids
                    one = live[hit]
                    single[one[step + 1 - start == np.where(grid[start, one] < 0x80, 1, np.where(grid[start, one] < 0xE0, 2, np.where(grid[start, one] < 0xF0, 3, 4)))]] = True
            missing = ~single[open_]
            lanes, end = open_[missing], start + width[missing]
            score = best[start, lanes] + self.unknown_score
            better = score > best[end, lanes]
            lanes, end = lanes[better], end[better]
            best[end, lanes], from_[end, lanes], piece[end, lanes] = score[better], start, self.unknown
        found = []
        for k, w in enumerate(words):
            at, back = len(w), []
            while at > 0:
                before, p = int(from_[at, k]), int(piece[at, k])
                back += [p] if p != self.unknown else self.bytes[np.frombuffer(w[before:at], np.uint8)][::-1].tolist()
                at = before
            found.append(np.array(back[::-1], np.int32))
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and where each text's begin; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = pc.replace_substring(texts, " ", MARK)
        plain = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), plain, pa.scalar("", pa.large_string())))
        # a cut before each run of markers: "x▁▁y" is the words "x" and "▁▁y"; texts that hold the cut sign stay whole
        odd = pc.match_substring(texts, CUT)
        cut = pc.replace_substring_regex(pc.if_else(odd, pa.scalar("", pa.large_string()), plain), f"([^{MARK}]){MARK}", f"\\1{CUT}{MARK}")
        lists = pc.split_pattern(cut, CUT)
        offsets, coded = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        names = coded.dictionary.to_pylist()
        ids, begins = self.segment([w.encode() for w in names + plain.take(pa.array(whole)).to_pylist()])
        words = coded.indices.to_numpy().copy()
        words[offsets[whole]] = len(names) + np.arange(len(whole))  # in place of the empty text that stood in
        counts = np.diff(begins)[words]
        total = np.concatenate([[0], np.cumsum(counts)])
        source = np.repeat(begins[words] - total[:-1], counts) + np.arange(total[-1])
        return ids[source], total[offsets]

    def decode(self, ids: np.ndarray) -> str:
        """Text of a sequence: bytes joined, markers to blanks, without the one before the text."""
        text = b"".join([self.shown[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def piece_model(path: str, ranked: bool = True) -> PieceModel:
    return PieceModel(path, ranked)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and `pieces` (array of ids). A null or empty text has none; rows are independent
    of each other, so repeated rows and ids change nothing. Only id and text are read."""
    schema = T.StructType([docs.schema[id_col], T.StructField("pieces", T.ArrayType(T.IntegerType(), False))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1):
                ids, begins = piece_model(model).encode(some.column(1))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(encode, schema)


def decode_pieces(rows: DataFrame, model: str, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """Per row: id, `n_pieces`, `ids_crc32` and the decoded `text`; a null list decodes to an empty text."""
    schema = T.StructType([rows.schema[id_col], T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("text", T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offsets = batch.column(1).values.to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
            lists = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            texts = [piece_model(model).decode(x) for x in lists]
            crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, lists), pa.int64()), pa.array(crcs, pa.int64()), pa.array(texts)], names=schema.names)

    return rows.select(id_col, pieces_col).mapInArrow(decode, schema)


def piece_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, `n_pieces`, `ids_crc32`, and `text_sha256` of the text decoded from the pieces."""
    found = decode_pieces(encode_pieces(docs, model, id_col, text_col), model, id_col)
    return found.select(id_col, "n_pieces", "ids_crc32", F.sha2("text", 256).alias("text_sha256"))
