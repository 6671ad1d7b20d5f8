"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed against it from
left to right into the longest phrases that occur in the labelled text; the fewer phrases, the
better that language explains the text. Phrase counts are normalised to bits per byte (a phrase
costs the logarithm of the labelled text's length) and the language with the fewest wins.

Texts are folded first: lower case, everything but letters one blank. Parsing is over UTF-8 bytes,
many pieces of texts at once, and starts afresh every `PIECE` bytes, so long texts are parsed whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.llm.tokens import slices

#: Bytes of a text that are parsed in one go.
PIECE = 1_024
#: Undetermined: no letters, or nothing was learned.
UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    return NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""


def has_letter(folded: str) -> bool:
    return any(map(str.isalpha, folded))


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts all substrings of `data`; state 0 starts."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at >= 0:
            to = moves[at][c]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                copy = len(moves)
                moves.append(dict(moves[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and moves[at].get(c) == to:
                    moves[at][c] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return moves


@dataclass
class Model:
    """All languages' automata in one table: row = state, column = symbol, -1 where a phrase ends."""

    languages: list[str]
    lengths: list[int]
    symbols: np.ndarray
    table: np.ndarray
    roots: np.ndarray
    #: Most bits per byte that a text of each language may need; infinite where none was learned.
    bounds: np.ndarray | None = None

    @classmethod
    def build(cls, samples: dict[str, bytes]) -> Model:
        languages = sorted(k for k, v in samples.items() if v)
        used = sorted(set(b"".join(samples[k] for k in languages)))
        symbols = np.zeros(256, np.uint8 if len(used) < 255 else np.uint16)
        symbols[used] = np.arange(1, len(used) + 1)
        automata = [suffix_automaton(samples[k]) for k in languages]
        roots = np.cumsum([0, *map(len, automata)])
        table = np.full((int(roots[-1]) + 1, len(used) + 1), -1, np.int32)  # the last state leads nowhere
        for root, moves in zip(roots, automata):
            rows = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
            columns = symbols[np.fromiter((c for m in moves for c in m), np.int64, len(rows))]
            table[root + rows, columns] = root + np.fromiter((t for m in moves for t in m.values()), np.int64, len(rows))
        return cls(languages, [len(samples[k]) for k in languages], symbols, table, roots[:-1].astype(np.int32))

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (rows) under each language (columns)."""
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        data = self.symbols[np.frombuffer(b"".join(texts), np.uint8)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes) - sizes
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, size = begins[owner] + nth * PIECE, np.minimum(PIECE, sizes[owner] - nth * PIECE)
        order = np.argsort(-size, kind="stable")
        owner, begin, size = owner[order], begin[order], size[order]
        width = self.table.shape[1]
        flat = self.table.ravel()
        for group in range(0, len(owner), 4_096):
            own, at, long = (x[group : group + 4_096] for x in (owner, begin, size))
            grid = np.zeros((int(long[0]), len(own)), data.dtype)
            for k in range(len(own)):
                grid[: long[k], k] = data[at[k] : at[k] + long[k]]
            active = np.searchsorted(-long, -np.arange(len(grid)), "left")
            for k, root in enumerate(self.roots.tolist()):
                start = flat[root * width : (root + 1) * width]
                nowhere = len(self.table) - 1
                start = np.where(start < 0, nowhere, start)  # a symbol the language lacks is a phrase of its own
                state, begun = np.full(len(own), nowhere, np.int32), np.zeros(len(own), np.int64)
                for step, n in enumerate(active.tolist()):
                    symbol = grid[step, :n]
                    to = flat[state[:n] * np.int64(width) + symbol]
                    miss = to < 0
                    begun[:n] += miss
                    state[:n] = np.where(miss, start[symbol], to)
                counts[:, k] += np.bincount(own, begun, len(texts)).astype(np.int64)
        return counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score of each text, and whether it fits: the score is the runner-up's share
        of the bits that the best two need, from 0.5 (even) up to 1; 0 where the language is unknown.
        A text fits if it has letters and needs no more bits than its language's bound (every text
        with letters where nothing was learned). Its first phrase is not counted for that, as texts
        of a word or two cannot be told from noise."""
        folded = [fold(t) for t in texts]
        known = [bool(self.languages) and has_letter(t) for t in folded]
        data = [t.encode() if k else b"" for t, k in zip(folded, known)]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages or not any(known):
            return names, scores, np.array(list(map(has_letter, folded)), bool)
        phrases, each = self.phrases(data), self.costs(data)
        bits = phrases * each
        best = bits.argmin(axis=1)
        two = np.sort(bits, axis=1)[:, :2]
        for i, k in enumerate(known):
            if k:
                names[i] = self.languages[best[i]]
                scores[i] = two[i, 1] / two[i].sum() if two.shape[1] > 1 else 1.0
        rates = np.take_along_axis((phrases - 1) * each, best[:, None], 1)[:, 0]
        return names, scores, np.array(known) & (rates <= (np.inf if self.bounds is None else self.bounds[best]))

    def costs(self, texts: list[bytes]) -> np.ndarray:
        """Bits per byte that one phrase of each text costs under each language."""
        return np.log2(np.maximum(2, self.lengths)) / np.maximum(1, [len(t) for t in texts])[:, None]


def bounds(gathered: dict[str, list[bytes]], slack: float = 1.75) -> dict[str, float]:
    """Per language, `slack` times the most that labelled texts need when they
    are parsed against the others: every fifth is left out and tried. Only texts of at least 40
    bytes are tried; a language without any has no bound."""
    tried = {k: [t for t in texts[::5] if len(t) >= 40] for k, texts in gathered.items() if len(texts) > 1}
    rest = Model.build({k: b" ".join(t for i, t in enumerate(texts) if i % 5 or len(texts) < 2) for k, texts in gathered.items()})
    found = {}
    for n, lang in enumerate(rest.languages):
        if own := tried.get(lang):
            found[lang] = slack * float(((rest.phrases(own) - 1) * rest.costs(own))[:, n].max())
    return found


def held_out(id_col: str = "doc_id") -> Column:
    """Is a document kept out of training?"""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts_per_language: int = 150, bytes_per_language: int = 40_000) -> Model:
    """Automata from a bounded sample of the labelled rows that are not held out.

    The sample is documented by its parameters: about `texts_per_language` texts (those with the
    smallest hash of their id), each giving at most 1/40 of `bytes_per_language` from its middle,
    until that many bytes are gathered. Rows without label or text are left out. The bounds on bits
    per byte come from the same sample.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model.build({})
    place = (F.xxhash64("id").cast("double") / 2.0**64) + 0.5
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 2 * texts_per_language / n)))])
    each = bytes_per_language // 40
    chosen = rows.where(place <= share[F.col("lang")])
    middle = F.substring("text", F.greatest(F.lit(1), F.floor((F.length("text") - each) / 2).cast("int")), F.lit(each))
    samples: dict[str, list[tuple[float, str]]] = {}
    for r in chosen.select("lang", place.alias("place"), middle.alias("text")).collect():
        samples.setdefault(r["lang"], []).append((r["place"], r["text"]))
    gathered, apart = {}, {}
    for lang, texts in samples.items():
        parts = [fold(t) for _, t in sorted(texts)]
        gathered[lang] = " ".join(p for p in parts if has_letter(p)).encode()[:bytes_per_language]
        ends = np.cumsum([len(p.encode()) + 1 for p in parts if has_letter(p)])
        apart[lang] = [p.encode() for p, end in zip((p for p in parts if has_letter(p)), ends) if end <= bytes_per_language + each]
    model = Model.build(gathered)
    found = bounds(apart)
    model.bounds = np.array([found.get(k, np.inf) for k in model.languages])
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, `row` (hash of id and text), `lang_pred`, `score`, `fits`; only id and text are read.

    A text that is null, empty or without letters is `und` with score 0, and so is everything if
    nothing was learned. `fits` is as in Model.predict. Ties go to the language first in order. Empty tables give no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[id_col], T.StructField("row", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fits", T.BooleanType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 2, rows=20_000):
                names, scores, fits = known.value.predict(some.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(names, pa.string()), pa.array(scores), pa.array(fits)], names=schema.names)

    return docs.select(F.col(id_col), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col)).mapInArrow(predict, schema)
