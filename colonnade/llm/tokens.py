"""Token ids of whole texts, by way of the distinct words of a batch.

A word between two single spaces is encoded on its own by both vocabularies used here: the
byte-level one starts a new pre-token at a space that follows a non-space, the word-end one drops
white space. So a batch of texts is cut at its spaces (Arrow kernels), each distinct word is
encoded once with `tokenizers`, and the ids are put together by position. A line end between two words is
a word of its own. Texts where white space touches white space or an end are encoded whole, because
there the cut would not be safe for the byte-level vocabulary. Words already seen by a worker stay in a dictionary of bounded size.
"""

from __future__ import annotations

import gc
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers between batches; when there are more, those that came again stay.
CACHE_WORDS = 400_000
#: Words of Latin letters with at most one mark behind them: their pre-tokens are known, so the
#: vocabulary's merges are asked for directly. All other words go through the whole tokenizer.
PLAIN = r"^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?\z"
#: How byte-level vocabularies show bytes: printable Latin-1 as itself, the others from U+0100 on.
BYTES_SHOWN = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}
LINES_SHOWN = {b: s for b, s in BYTES_SHOWN.items() if b != ord("\n")}
ID = attrgetter("id")
#: Stands before a word that has no space before it.
JOINED = "\ue000"
EMPTY, SPACE, JOIN = (pa.scalar(s, pa.large_string()) for s in ("", " ", JOINED))
#: White space beyond blanks, tabs and line ends, special tokens' brackets, and the stand-in itself.
ODD = r"[\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}\x{000C}\x{001C}-\x{001F}\x{E000}]|<\|"
#: Those, and white space beside white space or at an end of the text.
UNSAFE = rf"{ODD}|^[ \t\r\n]|[ \t\r\n]$|[ \t\r\n][ \t\r\n]|[\t\r]"


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def joined_lines(texts: pa.Array) -> str:
    """Texts without line ends in one string, quicker than value by value."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
    return pc.binary_join(whole, pa.scalar("\n", texts.type))[0].as_py()


class Words:
    """Distinct words in the order they were learnt; many are looked up at a time, by one Arrow kernel."""

    def __init__(self):
        self.held = pa.array([], pa.large_string())

    def __len__(self) -> int:
        return len(self.held)

    def __iter__(self) -> Iterator[str]:
        return iter(self.held.to_pylist())

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word, -1 if it is not held."""
        return pc.fill_null(pc.index_in(words.cast(pa.large_string()), self.held), -1).to_numpy().copy()

    def add(self, words: pa.Array) -> None:
        """Words that are not held yet, each once."""
        self.held = pa.concat_arrays([self.held, words.cast(pa.large_string())])

    def keep(self, places: np.ndarray) -> None:
        """Forget all words but these, whose places become 0, 1, ..."""
        self.held = self.held.take(pa.array(places))


class Encoder:
    """Encodes batches of texts with one vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: Does a space belong to the word behind it? Else words are lower-cased and spaces dropped.
        self.spaced = self.tokenizer.encode(" A", add_special_tokens=False).ids != self.tokenizer.encode("a", add_special_tokens=False).ids
        self.marks = [[t.id for t in self.model.tokenize(mark)] for mark in ".,"]
        self.reset()

    def reset(self) -> None:
        self.known = Words()
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def keep(self, slots: np.ndarray) -> None:
        """Forget all words but those in these slots, which came again."""
        known, sizes = self.known, self.size[slots]
        begin = np.cumsum(sizes, dtype=np.int64) - sizes
        held = self.flat[np.arange(int(sizes.sum())) + np.repeat(self.begin[slots] - begin, sizes)]
        known.keep(slots)
        self.reset()
        self._room(len(slots), len(held))
        self.flat[: len(held)], self.used = held, len(held)
        self.begin[: len(slots)], self.size[: len(slots)] = begin, sizes
        self.known = known

    def _room(self, words: int, ids: int) -> None:
        while self.used + ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.known) + words > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])

    def _learn(self, words: pa.Array) -> None:
        """Encode words that are not known yet and file their ids. Plain ones are put together from their
        letters (of which many are known already) and their mark."""
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
        plain_at, rest_at = np.flatnonzero(plain), np.flatnonzero(~plain)
        own = words.take(pa.array(plain_at))
        stems = pc.utf8_rtrim(own, ".,").dictionary_encode()
        slots = self.known.find(stems.dictionary)
        new = np.flatnonzero(slots < 0)
        sizes, ids, of_new = self._pieces(stems.dictionary.take(pa.array(new)))
        rest, others = words.take(pa.array(rest_at)).to_pylist(), []
        for at in range(0, len(rest), 20_000):
            others += [e.ids for e in self.tokenizer.encode_batch_fast(rest[at : at + 20_000], add_special_tokens=False)]
        others += self.marks
        sizes = np.concatenate([sizes, np.fromiter(map(len, others), np.int64, len(others))])
        begins = self.used + np.cumsum(sizes) - sizes
        source = np.concatenate([self.flat[: self.used], ids, np.fromiter(chain.from_iterable(others), np.int32)])
        # of each word two parts: its letters, or the whole of a word that is not plain, and its mark
        begin, size = np.zeros((2, len(words), 2), np.int64)
        stem_begin, stem_size = self.begin[slots], self.size[slots]
        stem_begin[new], stem_size[new] = begins[of_new], sizes[of_new]
        of_word = stems.indices.to_numpy()
        begin[plain_at, 0], size[plain_at, 0] = stem_begin[of_word], stem_size[of_word]
        whole = slice(len(sizes) - len(others), len(sizes) - len(self.marks))
        begin[rest_at, 0], size[rest_at, 0] = begins[whole], sizes[whole]
        for k, mark in enumerate(".,"):
            marked = plain_at[pc.ends_with(own, mark).to_numpy(zero_copy_only=False)]
            begin[marked, 1], size[marked, 1] = begins[k - 2], sizes[k - 2]
        begin, size = begin.ravel(), size.ravel()
        total, first = int(size.sum()), len(self.known)
        found = source[np.arange(total) + np.repeat(begin - np.cumsum(size) + size, size)]
        size = size.reshape(-1, 2).sum(1)
        self._room(len(words), total)
        self.flat[self.used : self.used + total] = found
        self.begin[first : first + len(words)] = self.used + np.cumsum(size) - size
        self.size[first : first + len(words)] = size
        self.used += total
        self.known.add(words)

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens (letters with the space before them) as the vocabulary shows them: how many ids each
        distinct one has, all their ids, and which of them each text is."""
        texts = texts if self.spaced else pc.utf8_lower(pc.utf8_ltrim(texts, " "))
        coded = texts.dictionary_encode()
        plain = pc.string_is_ascii(coded.dictionary).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        lines = lambda held: joined_lines(coded.dictionary.filter(pa.array(held)))
        shown = lines(plain).replace(" ", "Ġ").split("\n") if plain.any() else []
        if not plain.all():
            shown += lines(~plain).encode().decode("latin-1").translate(LINES_SHOWN).split("\n")
        sizes, ids = np.zeros(len(shown), np.int64), []
        for at in range(0, len(shown), 10_000):
            found = [*map(self.model.tokenize, shown[at : at + 10_000])]
            sizes[at : at + len(found)] = [*map(len, found)]
            ids.append(np.fromiter(map(ID, chain.from_iterable(found)), np.int32))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return sizes, np.concatenate([np.empty(0, np.int32), *ids]), place[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and where each begins (one more entry than texts).

        A null text counts as empty; `end` is put after each text's ids.
        """
        collecting = gc.isenabled()
        gc.disable()  # many small lists and no cycles
        try:
            return self._encode(texts, end)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.spaced:
            # white space within a word is dropped with the word's own encoding
            safe, whole = pc.replace_substring(texts, "\n", " "), pc.match_substring(texts, JOINED)
        else:
            safe, whole = texts, pc.match_substring_regex(texts, UNSAFE)
        whole = whole.to_numpy(zero_copy_only=False) | pc.equal(texts, "").to_numpy(zero_copy_only=False)
        safe = pc.if_else(pa.array(whole), EMPTY, safe)
        if self.spaced:
            safe = pc.replace_substring(safe, "\n", f" {JOINED}\n {JOINED}")
        lists = pc.split_pattern(pc.binary_join_element_wise(JOIN, safe, EMPTY), " ")
        offsets, coded = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        joined = pc.starts_with(coded.dictionary, JOINED)
        names = pc.if_else(joined, pc.utf8_slice_codeunits(coded.dictionary, 1), pc.binary_join_element_wise(SPACE, coded.dictionary, EMPTY))
        slot = self.known.find(names)
        if len(self.known) + len(names) > CACHE_WORDS:
            self.keep(slot[slot >= 0])
            slot[slot >= 0] = np.arange(len(self.known))
        missing, first = np.flatnonzero(slot < 0), len(self.known)
        slot[missing] = np.arange(first, first + len(missing))
        self._learn(names.take(pa.array(missing)))
        slots = slot[coded.indices.to_numpy()]
        sizes = self.size[slots]
        summed = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        counts = summed[offsets[1:]] - summed[offsets[:-1]]
        whole_at = np.flatnonzero(whole)
        apart = [e.ids for at in range(0, len(whole_at), 200) for e in self.tokenizer.encode_batch_fast(texts.take(pa.array(whole_at[at : at + 200])).to_pylist(), add_special_tokens=False)]
        from_words = counts.copy()
        counts[whole_at] = [len(x) for x in apart]
        begins = np.concatenate([[0], np.cumsum(counts + (end is not None))])
        out = np.empty(int(begins[-1]), np.int32)
        to = summed[:-1] + np.repeat(begins[:-1] - summed[offsets[:-1]], np.diff(offsets))
        if from_words[whole_at].any():  # the empty stand-in of such a text has no ids in either vocabulary
            raise AssertionError("an empty word has ids")
        self._copy(out, to, slots, sizes)
        for i, ids in zip(whole_at, apart):
            out[begins[i] : begins[i] + len(ids)] = ids
        if end is not None:
            out[begins[1:] - 1] = end
        return out, begins

    def _copy(self, out: np.ndarray, to: np.ndarray, slots: np.ndarray, sizes: np.ndarray) -> None:
        """Copy the ids of words to their places, one position within the word at a time."""
        source, k = self.begin[slots], 0
        while len(to):
            live = sizes > k
            if not live.all():
                to, source, sizes = to[live], source[live], sizes[live]
            if len(to):
                out[to + k] = self.flat[source + k]
            k += 1


def slices(batch: pa.RecordBatch, column: int, rows: int = 5_000, size: int = 8 << 20):
    """Cut a batch so that the texts of `column` in each piece stay below `size` bytes where rows allow."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + size, "right"))
        to = min(max(to, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def crc32(ids: np.ndarray) -> int:
    """CRC of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
