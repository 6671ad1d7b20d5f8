"""Language-model scoring of whole texts, beside a word-unigram base.

Texts are encoded once and written as subword ids with their distinct words. Word and id counts are
taken over all training rows. The attention model learns from every window of every training row by
averaged local steps: the windows are dealt over `ROUNDS` rounds, each once; in a round every task goes on
from the same weights over its own windows, and the tasks' weights are averaged, weighted by the ids they saw.

For the base score, words above a share of the corpus (so a bounded number of them) are looked up
by hash in the task; only the others meet their counts by a join, where no key can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.llm import attention
from colonnade.llm.common import small_batches, staged, uncollected
from colonnade.llm.tokens import Words, slices

#: Rounds between which weights are averaged; every training window is learnt from in one of them.
ROUNDS = 2
#: Words with at least one in this many of all words (so at most this many) are looked up in the task.
FREQUENT_WORDS = 3_000_000
#: Words whose ids a worker remembers before it starts afresh.
CACHE_WORDS = 300_000
#: Entries of a batch's lists that are worked on together.
PIECE = 1 << 20
LOG10 = float(np.log(10))


def held_out(id_col: str, folds: int = 7, fold: int = 2) -> Column:
    """Not learnt from: the CRC of the id as text leaves this remainder. Null ids are learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each text's words begin, and the words: A-Z lower-cased, cut at white space."""
    spaced = pc.fill_null(texts.cast(pa.large_string()), "")
    for c in "\n\t\r\x0b\x0c":
        spaced = pc.replace_substring(spaced, c, " ")
    # now a copy of its own: on a slice of a longer array this kernel reads the wrong bytes
    lists = pc.split_pattern(pc.ascii_lower(spaced), " ")
    held = pc.not_equal(lists.values, "")
    kept = np.concatenate([[0], np.cumsum(held.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return kept[lists.offsets.to_numpy()], lists.values.filter(held)


@lru_cache(maxsize=2)
def subwords(path: str) -> Subwords:
    return Subwords(path)


class Subwords:
    """Ids of words by a SentencePiece vocabulary, each distinct word once."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size, self.end = self.model.get_piece_size(), self.model.eos_id()
        self.reset()

    def reset(self) -> None:
        self.known = Words()
        self.begin, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def keep(self, slots: np.ndarray) -> None:
        """Forget all words but those in these slots, which came again."""
        sizes = np.diff(self.begin)[slots]
        begin = np.concatenate([[0], np.cumsum(sizes)])
        held = self.flat[np.arange(int(begin[-1])) + np.repeat(self.begin[slots] - begin[:-1], sizes)]
        self.known.keep(slots)
        self.begin, self.flat = begin, held

    def learn(self, words: pa.Array) -> None:
        if len(words):
            ids = self.model.encode(words.to_pylist(), num_threads=1)
            self.known.add(words)
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(i) for i in ids])])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32)])

    def encode(self, begins: np.ndarray, words: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin, and the ids, with an end id behind each text."""
        names = words.dictionary
        slots = self.known.find(names)
        if len(self.known) + len(names) > CACHE_WORDS:  # words that came again are worth keeping
            self.keep(slots[slots >= 0])
            slots[slots >= 0] = np.arange(len(self.known))
        missing, first = np.flatnonzero(slots < 0), len(self.known)
        slots[missing] = np.arange(first, first + len(missing))
        self.learn(names.take(pa.array(missing)))
        of_word = words.indices.to_numpy()
        sizes = np.diff(self.begin)[slots][of_word]
        summed = np.concatenate([[0], np.cumsum(sizes)])
        starts = summed[begins] + np.arange(len(begins))
        source = np.arange(int(summed[-1]))
        source += np.repeat(self.begin[slots][of_word] - summed[:-1], sizes)
        out, is_id = np.empty(int(starts[-1]), np.int32), np.ones(int(starts[-1]), bool)
        is_id[starts[1:] - 1] = False
        out[is_id] = self.flat[source]
        out[starts[1:] - 1] = self.end
        return starts, out


def id_kind(size: int) -> np.dtype:
    """How ids of a vocabulary of `size` lie in packed lists."""
    return np.dtype("<u2" if size <= 1 << 16 else "<i4")


def packed_lists(begins: np.ndarray, ids: np.ndarray, size: int) -> pa.Array:
    """Lists of ids as bytes: a list is one value to Spark, not one for each id."""
    kind = id_kind(size)
    return pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer((begins * kind.itemsize).astype(np.int32)), pa.py_buffer(ids.astype(kind))])


def unpacked(batch: pa.RecordBatch, column: int, size: int) -> pa.RecordBatch:
    """Rows whose `column` holds lists of ids, whether they came as lists or as `packed_lists`."""
    lists, kind = batch.column(column), id_kind(size)
    if not pa.types.is_binary(lists.type):
        return batch
    _, offsets, data = lists.buffers()
    ends = np.frombuffer(offsets, np.int32)[lists.offset : lists.offset + len(lists) + 1] if len(lists) else np.zeros(1, np.int32)
    ids = np.frombuffer(data, kind, (int(ends[-1]) - int(ends[0])) // kind.itemsize, int(ends[0])) if data else np.zeros(0, kind)
    found = pa.ListArray.from_arrays(pa.array((ends - ends[0]) // kind.itemsize), pa.array(ids))
    return batch.set_column(column, batch.schema.names[column], found)


def in_pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """Rows of a batch whose lists in `column` hold about `PIECE` entries: the rows, where each
    list begins, and the entries. A single longer list stays whole."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
        some = batch.slice(at, to - at)
        start = ends[at - 1] if at else 0
        yield some, np.concatenate([[0], ends[at:to] - start]), some.column(column).flatten()
        at = to


def encoded(docs: DataFrame, pieces: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """One row per row of `docs`: id, `row` (its own number), `held_out`, `n_tokens` (words and one
    end), `ids` (as bytes if `packed`), and the distinct `words` with their `times`. Null texts count as empty."""
    fields = [T.StructField("row", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False)), T.StructField("words", T.ArrayType(T.StringType(), False)), T.StructField("times", T.ArrayType(T.LongType(), False))]
    schema = T.StructType([docs.schema[id_col], T.StructField("held_out", T.BooleanType()), *fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for some in slices(batch, 2, size=4 << 20):
                with uncollected():
                    begins, words = words_of(some.column(2))
                    coded = words.dictionary_encode()
                    starts, ids = subwords(pieces).encode(begins, coded)
                n = max(len(coded.dictionary), 1)
                key, times = np.unique(np.repeat(np.arange(some.num_rows), np.diff(begins)) * n + coded.indices.to_numpy(), return_counts=True)
                cut = pa.array(np.searchsorted(key, np.arange(some.num_rows + 1) * n), pa.int32())
                held = coded.dictionary.cast(pa.string()).take(pa.array(key % n)) if len(key) else pa.array([], pa.string())
                coded_ids = packed_lists(starts, ids, subwords(pieces).size) if packed else pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids))
                lists = [coded_ids, pa.ListArray.from_arrays(cut, held), pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int64)))]
                numbers = [pa.array(np.arange(row, row + some.num_rows)), pa.array(np.diff(begins) + 1)]
                row += some.num_rows
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *numbers, *lists], names=schema.names)
        subwords(pieces).reset()  # a worker that is used again starts small
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col)).mapInArrow(encode, schema)


def word_counts(rows: DataFrame) -> DataFrame:
    """`word`, `n` (in all rows), `c` (in rows that are learnt from). The words of a batch are added up
    before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, begins, words in in_pieces(batch, 1):
                coded = words.dictionary_encode()
                index, times = coded.indices.to_numpy(), some.column(2).flatten().to_numpy()
                learnt = np.repeat(~some.column(0).to_numpy(zero_copy_only=False), np.diff(begins))
                sums = [np.bincount(index, t, len(coded.dictionary)).astype(np.int64) for t in (times, times * learnt)]
                yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), *map(pa.array, sums)], names=["word", "n", "c"])

    each = rows.select("held_out", "words", "times").mapInArrow(count, "word string, n long, c long")
    return each.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def _factors(n: int) -> np.ndarray:
    """A number of 64 random bits for each position of a word (splitmix64 of the position)."""
    z = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) | np.uint64(1)


def word_keys(words: pa.Array, size: int = 1 << 17) -> np.ndarray:
    """A 64-bit hash of each word, computed over the bytes of many words together (about `size` at a time)."""
    if not len(words):
        return np.zeros(0, np.int64)
    words = words.cast(pa.large_string())
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    codes, keys, at = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.empty(len(words), np.uint64), 0
    factors = _factors(int(np.diff(ends).max()))
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        cut = ends[at : to + 1] - ends[at]
        terms = factors[np.arange(cut[-1]) - np.repeat(cut[:-1], np.diff(cut))]
        terms *= codes[ends[at] : ends[to]].astype(np.uint64) + np.uint64(1)
        terms ^= terms >> np.uint64(32)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        keys[at:to] = sums[cut[1:]] - sums[cut[:-1]]
        at = to
    return keys.view(np.int64)


def base_scores(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Per `row` the sum over its words and its end of log10((c + 1) / (N + V + 1)), `n_known`
    (those with c > 0) and N as `train_tokens`. Rows and counts should be written tables."""
    ends = rows.agg(F.count_if(~F.col("held_out"))).first()[0]
    n_all, n_train, distinct = counts.agg(F.sum("n"), F.sum("c"), F.count_if(F.col("c") > 0)).first()
    learnt = (n_train or 0) + ends
    below = float(np.log10(learnt + (distinct or 0) + (ends > 0) + 1))
    frequent = F.col("n") * FREQUENT_WORDS >= F.lit(n_all or 0)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(word_keys(batch.column(0))), batch.column(1)], names=["key", "c"])

    words = counts.where(frequent).select("word", "c").mapInArrow(keyed, "key long, c long").toArrow()  # at most FREQUENT_WORDS
    keys, known_c = words.column(0).to_numpy(), words.column(1).to_numpy()
    order = np.argsort(keys)
    table = rows.sparkSession.sparkContext.broadcast((keys[order], known_c[order]))
    schema = "row long, word string, times long, score double, known long"
    of_end = (float(np.log10(ends + 1)) - below, int(ends > 0))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, c = table.value
        names = ["row", "word", "times", "score", "known"]
        for batch in batches:
            for some, begins, words in in_pieces(batch, 1):
                times, row = some.column(2).flatten().to_numpy(), some.column(0).to_numpy()
                of_row = np.repeat(np.arange(some.num_rows), np.diff(begins))
                keys = word_keys(words)
                at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                found = known[at] == keys if len(known) else np.zeros(len(keys), bool)
                count = np.where(found, c[at], 0) if len(known) else np.zeros(len(keys), np.int64)
                score = np.bincount(of_row, np.where(found, times * (np.log10(count + 1.0) - below), 0.0), some.num_rows) + of_end[0]
                n_known = np.bincount(of_row, np.where(found & (count > 0), times, 0), some.num_rows).astype(np.int64) + of_end[1]
                rest = np.flatnonzero(~found)
                none = lambda kind, n: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays([pa.array(row), none(pa.string(), len(row)), none(pa.int64(), len(row)), pa.array(score), pa.array(n_known)], names=names)
                for i in range(0, len(rest), 50_000):
                    part = rest[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(row[of_row[part]]), words.take(pa.array(part)).cast(pa.string()), pa.array(times[part]), none(pa.float64(), len(part)), none(pa.int64(), len(part))], names=names)

    with small_batches(rows.sparkSession):
        looked = staged(rows.select("row", "words", "times").mapInArrow(look_up, schema), "looked_up")
    rare = looked.where("word is not null").select("row", "word", "times")
    # rare words: neither side has a hot key, and counts are hashed rather than both sides sorted
    joined = rare.join(counts.where(~frequent & (F.col("c") > 0)).select("word", "c").hint("shuffle_hash"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    parts = joined.select("row", (F.col("times") * (F.log10(c + 1.0) - below)).alias("score"), F.when(c > 0, F.col("times")).otherwise(0).alias("known"))
    sums = looked.where("word is null").select("row", "score", "known").unionByName(parts).groupBy("row")
    return sums.agg(F.sum("score").alias("base_score"), F.sum("known").alias("n_known")).withColumn("train_tokens", F.lit(learnt).cast("long"))


def id_counts(rows: DataFrame, size: int) -> np.ndarray:
    """Counts of the ids of rows that are learnt from; as many numbers as the vocabulary has ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, ids in in_pieces(unpacked(batch, 0, size), 0):
                total += np.bincount(ids.to_numpy(), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    with small_batches(rows.sparkSession):
        each = rows.where(~F.col("held_out")).select("ids").mapInArrow(count, "id long, n long")
        for r in each.groupBy("id").agg(F.sum("n").alias("n")).collect():
            counts[r["id"]] = r["n"]
    return counts


def _added(weights: DataFrame, tasks: int = 16) -> tuple[np.ndarray | None, int]:
    """The sum of all tasks' weighted weights, added up in `tasks` tasks before the driver sees them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = None, 0
        for batch in batches:
            for numbers, n in zip(batch.column(0), batch.column(1).to_pylist()):
                values = numbers.values.to_numpy()
                total = values.copy() if total is None else total + values
                seen += n
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([seen])], names=["numbers", "seen"])

    found = weights.repartition(tasks).mapInArrow(add, weights.schema).collect()
    if not found:
        return None, 0
    return np.sum([np.array(r["numbers"]) for r in found], 0), sum(r["seen"] for r in found)


def learn(rows: DataFrame, size: int) -> tuple[attention.Vocabulary, np.ndarray]:
    """The vocabulary's classes and the attention weights, learnt from rows of `encoded`."""
    v = attention.vocabulary(id_counts(rows, size))
    weights = attention.flat(attention.untrained(v))
    texts = rows.where(~F.col("held_out")).select("row", "ids")
    for turn in range(ROUNDS):

        def steps(batches: Iterator[pa.RecordBatch], start=weights, turn=turn) -> Iterator[pa.RecordBatch]:
            learner = attention.Learner(v, start)
            for batch in batches:
                for some, begins, ids in in_pieces(unpacked(batch, 1, size), 1):
                    first, end, number = attention.windows(begins)
                    of_text = np.searchsorted(begins, first, "right") - 1
                    dealt = (some.column(0).to_numpy()[of_text] + number) % ROUNDS == turn
                    learner.add(ids.to_numpy(), begins, first[dealt], end[dealt], number[dealt])
            learner.learn(True)
            if learner.seen:
                numbers = attention.flat(learner.w).astype(np.float64) * learner.seen
                yield pa.RecordBatch.from_arrays([pa.array([numbers]), pa.array([learner.seen])], names=["numbers", "seen"])

        with small_batches(rows.sparkSession):
            found = staged(texts.mapInArrow(steps, "numbers array<double>, seen long"), "weights")
        total, seen = _added(found)
        if seen:
            weights = (total / seen).astype(np.float32)
    return v, weights


def model_scores(rows: DataFrame, v: attention.Vocabulary, weights: np.ndarray) -> DataFrame:
    """Rows of `encoded` without lists, with `score`: the model's log10 probability of the text's ids."""
    shared = rows.sparkSession.sparkContext.broadcast((v, weights))
    kept = [c for c in rows.columns if c not in ("ids", "words", "times")]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, numbers = shared.value
        w = attention.shaped(vocabulary, numbers)
        for batch in batches:
            for some, begins, ids in in_pieces(unpacked(batch, len(kept), len(vocabulary.slot)), len(kept)):
                found = attention.score(vocabulary, w, ids.to_numpy(), begins) / LOG10
                yield pa.RecordBatch.from_arrays([*some.columns[: len(kept)], pa.array(found)], names=schema.names)

    return rows.select(*kept, "ids").mapInArrow(score, schema)


def scored(docs: DataFrame, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, `held_out`, `n_tokens`, `n_known`, `train_tokens`,
    `base_score`, `score`.

    Tokens are the words and one end per text; null texts are empty and hold the end alone. Rows that
    repeat an id are scored each on its own; null ids are learnt from. Without any row to
    learn from the base score is 0 (one outcome) and the model knows all ids as equally likely. Other columns are not
    read; an empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        rows = staged(encoded(docs, pieces, id_col, text_col, packed=True), "encoded")
        counts = staged(word_counts(rows), "word_counts")
    model = learn(rows, subwords(pieces).size)
    with small_batches(docs.sparkSession):
        found = staged(model_scores(rows, *model), "scores")
    joined = found.join(base_scores(rows, counts), "row", "left")
    return joined.select(id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
