"""Alignment of two tokenizers' tokens over whole texts, and how often their ids are linked.

Interval coalescing: the tokens of both sides are byte intervals. All are sorted by their start, a
running maximum of the ends is kept, and a group begins wherever a start has reached that maximum;
there tokens of both sides end. Within a group every A token is expanded to the B tokens whose
intervals it overlaps.

A blank that follows no white space begins a new word for both vocabularies, so texts are cut at
their blanks, each distinct word of a batch is encoded and aligned once (many words side by side in
one sort), and texts are put together from their words. Texts where blanks touch white space are
encoded and aligned whole.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from colonnade.llm.common import left_join_groups, small_batches, small_enough, staged, uncollected
from colonnade.llm.tokens import BYTES_SHOWN, Encoder, slices

#: Words that a worker remembers before it starts afresh.
CACHE_WORDS = 250_000
#: Linked id pairs that are broadcast; a longer table is joined by shuffle.
BROADCAST_PAIRS = 2_000_000
#: An id pair is one number: the A id times this, plus the B id.
SPAN = 1 << 24
#: White space of any kind; a blank next to it may be part of a longer token.
WHITE = r"[\t-\r\x1C-\x20\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
UNSAFE = rf"^ | $|  |{WHITE} {WHITE}"


def coalesce(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of intervals by start, and which of them, in that order, begin a group.

    A group begins where a start reaches the greatest end so far.
    """
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    begins = np.ones(len(order), bool)
    begins[1:] = starts[order][1:] >= reach[:-1]
    return order, begins


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (A token, B token) whose intervals overlap; tokens of one side do not overlap each other."""
    low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    count = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(a_start)), count)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)


def _summed(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


class Aligner:
    """Aligns batches of texts under a byte-level vocabulary (A) and a SentencePiece model (B)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from sentencepiece import SentencePieceProcessor

        self.a = Encoder(a_path)
        self.a.tokenizer.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        shown = {chr(s): b for b, s in BYTES_SHOWN.items()}
        names = self.a.tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, at in names.items():
            self.a_bytes[at] = bytes(shown.get(c, ord(c)) for c in name) if all(ord(c) < 256 or c in shown for c in name) else name.encode()
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.get_piece_size())]
        self.reset()

    def reset(self) -> None:
        self.a.reset()
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        #: Per word: tokens of A, tokens of B, groups, and 1 where the bytes of both sides are the word's.
        self.counts = np.zeros((0, 4), np.int64)
        self.pairs, self.pair_begin, self.pair_size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def keep(self, words: list[str]) -> None:
        """Forget all words but these."""
        slots = np.array([self.known[w] for w in words], np.int64)
        sizes = self.pair_size[slots]
        begin = np.cumsum(sizes) - sizes
        self.pairs = self.pairs[np.arange(int(sizes.sum())) + np.repeat(self.pair_begin[slots] - begin, sizes)]
        self.pair_begin, self.pair_size, self.counts = begin, sizes, self.counts[slots]
        self.groups = [self.groups[i] for i in slots.tolist()]
        self.known = dict(zip(words, range(len(words))))

    def _a_ids(self, words: list[str]) -> list[list[int]]:
        self.a.reset()
        self.a._learn(pa.array([" " + w for w in words], pa.large_string()))
        flat, begin, size = self.a.flat.tolist(), self.a.begin.tolist(), self.a.size.tolist()
        return [flat[begin[i] : begin[i] + size[i]] for i in range(len(words))]

    def learn(self, words: list[str]) -> np.ndarray:
        """Encode and align words, each behind a blank; returns their places in the store."""
        a_ids, b_ids = self._a_ids(words), self.b.encode(words, num_threads=1) if words else []
        a_bytes, b_bytes, fits = self.a_bytes, self.b_bytes, []
        for i, word in enumerate(words):
            raw = b" " + word.encode()
            same = b"".join([a_bytes[t] for t in a_ids[i]]) == raw == b"".join([b_bytes[t] for t in b_ids[i]])
            fits.append(same)
            if not same:
                a_ids[i] = b_ids[i] = []
        a, b = (np.array([t for ids in side for t in ids], np.int64) for side in (a_ids, b_ids))
        # all words lie side by side, so one sort aligns them all
        a_sizes, b_sizes = np.array([len(x) for x in a_bytes]), np.array([len(x) for x in b_bytes])
        a_edge, b_edge = _summed(a_sizes[a]), _summed(b_sizes[b])
        order, begins = coalesce(np.concatenate([a_edge[:-1], b_edge[:-1]]), np.concatenate([a_edge[1:], b_edge[1:]]))
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(begins) - 1
        in_a, in_b = group[: len(a)], group[len(a) :]
        left, right = overlaps(a_edge[:-1], a_edge[1:], b_edge[:-1], b_edge[1:])
        n_a, n_b = np.array([len(x) for x in a_ids], np.int64), np.array([len(x) for x in b_ids], np.int64)
        a_at = _summed(n_a)
        total = int(begins.sum())
        first = np.append(in_a, total)[np.minimum(a_at[:-1], len(a))]
        n_groups = np.diff(np.append(first, total))
        shown_a, shown_b = a.astype(str).tolist(), b.astype(str).tolist()
        cut_a, cut_b = np.searchsorted(in_a, np.arange(total + 1)).tolist(), np.searchsorted(in_b, np.arange(total + 1)).tolist()
        texts = [",".join(shown_a[i:j]) + "|" + ",".join(shown_b[k:m]) for i, j, k, m in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])]
        places = np.arange(len(self.groups), len(self.groups) + len(words))
        ends = _summed(n_groups).tolist()
        self.groups += [";".join(texts[i:j]) for i, j in zip(ends, ends[1:])]
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, np.array(fits, np.int64)], 1)]) if words else self.counts
        links = np.bincount(np.searchsorted(a_at, left, "right") - 1, minlength=len(words)) if words else np.zeros(0, np.int64)
        self.pair_begin = np.concatenate([self.pair_begin, len(self.pairs) + _summed(links)[:-1]])
        self.pair_size = np.concatenate([self.pair_size, links])
        self.pairs = np.concatenate([self.pairs, a[left] * SPAN + b[right]])
        return places

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Counts per text (A tokens, B tokens, groups, links), groups as text, and id pairs per text:
        where each text's begin, the distinct pairs, and how often each occurs."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        offsets, coded = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.groups) + len(names) > CACHE_WORDS:  # words that came again are worth keeping
            self.keep([w for w in names if w in self.known])
        new = [w for w in names if w not in self.known]
        self.known.update(zip(new, self.learn(new).tolist()))
        slots = np.array([self.known[w] for w in names], np.int64)[coded.indices.to_numpy()]
        whole_at = np.flatnonzero(whole)
        apart = self.learn(texts.take(pa.array(whole_at)).to_pylist())
        slots[offsets[whole_at]] = apart  # such a text stands as one word
        words = np.diff(offsets)
        of_text = np.repeat(np.arange(len(texts)), words)
        wrong = np.bincount(of_text, self.counts[slots, 3] == 0, len(texts)).astype(bool) | empty
        sums = _summed_rows(self.counts[slots, :3], offsets)
        links = self.pair_size[slots]
        out = np.concatenate([sums, _summed_rows(links[:, None], offsets)], 1)
        out[wrong] = 0
        place = slots.tolist()
        groups = ["" if no else ";".join([self.groups[s] for s in place[i:j]]) for no, i, j in zip(wrong.tolist(), offsets.tolist(), offsets[1:].tolist())]
        links[wrong[of_text]] = 0
        at = np.arange(int(links.sum())) - np.repeat(np.cumsum(links) - links - self.pair_begin[slots], links)
        held, which = np.unique(self.pairs[at], return_inverse=True)
        key, times = np.unique(np.repeat(of_text, links) * max(len(held), 1) + which, return_counts=True)
        begin = np.searchsorted(key, np.arange(len(texts) + 1) * max(len(held), 1))
        pairs = held[key % max(len(held), 1)] if len(held) else held
        if len(apart):  # whole texts are not worth remembering
            self.known, keep = {}, self.known
            self.reset() if len(self.groups) > CACHE_WORDS else self.known.update(keep)
        return out, groups, begin, pairs, times


def _summed_rows(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, values.shape[1]), np.int64), np.cumsum(values, 0, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """One row per row of `docs`: id, `row` (its own number), `n_a`, `n_b`, `n_groups`, `n_links`,
    `groups_sha256`, with `groups` also the groups themselves, and the distinct linked id pairs
    (`pairs`, `times`).

    A encodes a blank and the text, B the text (before which it puts a blank itself); neither adds
    special tokens and their strings in a text are plain text. A text that is null or empty, or
    whose tokens' bytes on either side are not the blank and the text, has zeros, an empty
    groups column and no pairs. Other columns are not read; a table without rows gives none.
    """
    long, text = T.LongType(), T.StringType()
    fields = [docs.schema[id_col], *[T.StructField(c, long) for c in ("row", "n_a", "n_b", "n_groups", "n_links")], T.StructField("groups_sha256", text)]
    fields += [T.StructField("groups", text)] * groups + [T.StructField("pairs", T.ArrayType(long, False)), T.StructField("times", T.ArrayType(long, False))]
    schema = T.StructType(fields)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for some in slices(batch, 1, size=4 << 20):
                with uncollected():
                    counts, held, begin, pairs, times = aligner(a_path, b_path).align(some.column(1))
                    hashes = pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in held])
                lists = [pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(v.astype(np.int64))) for v in (pairs, times)]
                columns = [some.column(0), pa.array(np.arange(row, row + some.num_rows)), *(pa.array(c) for c in counts.T), hashes, *([pa.array(held, pa.string())] if groups else []), *lists]
                row += some.num_rows
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        aligner(a_path, b_path).reset()  # a worker that is used again starts small
        pa.default_memory_pool().release_unused()

    return docs.select(id_col, text_col).mapInArrow(align, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """Per linked id pair (`pair`): `n_docs` that hold it, and is that its A id's `best` (ties included)?"""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    # an A id has at most as many partners as B has ids
    highest = F.max("n_docs").over(Window.partitionBy(F.shiftright("pair", 24)))
    return counts.withColumn("best", F.col("n_docs") == highest)


def link_sums(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """`rows` of `aligned` with `n_best` (links whose pair is its A id's best) and `count_sum` (over links).

    Rows and counts should be written tables, as both are read more than once.
    """
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("_p")).select("row", F.col("_p.pairs").alias("pair"), F.col("_p.times").alias("times"))
    if small_enough(counts, BROADCAST_PAIRS):
        known = each.join(F.broadcast(counts), "pair", "left")
    else:
        total = counts.agg(F.sum("n_docs")).first()[0]
        known = left_join_groups(each, counts.withColumn("_n", F.col("n_docs")), "pair", "_n", total)
    sums = known.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    joined = rows.drop("pairs", "times").join(sums, "row", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})


def alignment_digests(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Alignment counts of every row with the corpus-wide counts of its links."""
    with small_batches(docs.sparkSession):
        rows = staged(aligned(docs, a_path, b_path, id_col, text_col), "aligned")
    counts = staged(pair_counts(rows), "pairs")
    return link_sums(rows, counts).select(id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
