"""Personal data by a semi-Markov conditional random field over candidate segments.

Regular expressions give the base spans. Words with a digit or an at sign, and those of an address
written out, form islands: neighbouring words that may belong to one entity. Over an island's words the model weighs
whole segments of up to `MAX_WORDS` words by features of the span as a whole (how many digits, which
separators, checksum, octets, shape of an address, the word before) and dynamic programming picks
boundaries and kinds together; words outside a segment score nothing. It is trained by maximum
likelihood (forward-backward) on a bounded sample of islands whose labels are the base spans, and
adds what it finds apart from them, such as phone numbers without a plus or addresses written out.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.llm.tokens import slices

KINDS = ("email", "ip", "card", "phone")
#: Words a segment may have at most, and words of an island that are learned from together.
MAX_WORDS, ISLAND_WORDS = 6, 60
IMPOSSIBLE = -1e9
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")
#: Texts without any of these hold no entity.
TRIGGER = re.compile(r"[0-9@]|\(at\)|\[at\]| at ")
WORD = re.compile(r"\S+")
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,})+")
#: An address where no run of its first characters is entered half-way, so that long runs are read once.
LONE_ADDRESS = re.compile(r"(?<![A-Za-z0-9._%+-])" + ADDRESS.pattern)
NOT_DIGITS = re.compile(r"[^0-9]+")
# Words before an entity that hint at its kind.
HINTS = {"mail": "email", "email": "email", "e-mail": "email", "contact": "email", "ip": "ip", "host": "ip", "card": "card", "visa": "card", "mastercard": "card", "tel": "phone", "phone": "phone", "call": "phone", "mobile": "phone", "fax": "phone"}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, leftmost and apart within a kind, by start then kind."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        reach = 64
        while True:  # the local part is the run before the sign, however long
            window = text[max(free, at - reach) : at]
            run = len(window) - len(window.rstrip(LOCAL))
            if run < len(window) or at - reach <= free:
                break
            reach *= 4
        domain = DOMAIN.match(text, at + 1) if run else None
        if domain:
            found.append((at - run, domain.end(), 0))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    if SIGN.search(text):
        found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = NOT_DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGITS.sub("", m[0])) <= 15]
    found.sort(key=lambda s: (s[0], s[2]))
    return found


def addresses(text: str) -> Iterator[re.Match]:
    """Matches of ADDRESS, leftmost and apart."""
    found = LONE_ADDRESS.search(text)
    while found:
        yield found
        found = ADDRESS.match(text, found.end()) or LONE_ADDRESS.search(text, found.end())


def word_at(text: str, at: int) -> tuple[int, int]:
    """Start and end of the word around a place."""
    start = at
    while start > 0 and not text[start - 1].isspace():
        start -= 1
    return start, WORD.match(text, start).end()


def islands(text: str) -> Iterator[list[tuple[int, int]]]:
    """Words (start, end) with digits or at signs, and those of addresses, in runs parted by blanks."""
    found: list[tuple[int, int]] = []
    wide = -1
    for m in SIGN.finditer(text):
        if m.start() >= wide:
            found.append(word_at(text, m.start()))
            wide = found[-1][1]
    for m in addresses(text) if TRIGGER.search(text) else ():
        found += [word_at(text, m.start() + w.start()) for w in WORD.finditer(m[0])]
    words: list[tuple[int, int]] = []
    for start, end in sorted(set(found)):
        if words and text[words[-1][1] : start].strip(" "):
            yield words
            words = []
        words.append((start, end))
    if words:
        yield words


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without the punctuation around it."""
    span = text[start:end]
    left = len(span) - len(span.lstrip("\"'<[{,.;:!?|-"))
    kept = span.rstrip("\"'>]},.;:!?|-" + ("" if "(" in span else ")"))
    return start + left, start + max(left, len(kept))


def spelled(span: str) -> bool:
    """Is an address written with a sign or a dot that prose has not, so that base labels, which
    lack it, say nothing of it? `at` alone, or a dot that may end a sentence, is not enough."""
    sign = re.search(r"@|\(at\)|\[at\]", span)
    dots = re.search(r"\(dot\)|\[dot\]| dot ", span)
    return bool((sign or dots) and not re.search(r"\. |(?<! ) \.", span.replace(" . ", "."))) and not (sign and sign[0] == "@" and " " not in span and not dots)


def features(text: str, start: int, end: int, words: int) -> tuple[list[str], list[bool]] | None:
    """Names of what holds for a whole span and the kinds that it can be; None if it can be none."""
    span = text[start:end]
    digits = NOT_DIGITS.sub("", span)
    address = ADDRESS.fullmatch(span) is not None
    if not address and not (7 <= len(digits) <= 19):
        return None
    letters = sum(map(str.isalpha, span))
    if not address and letters:
        return None
    before = text[max(0, start - 24) : start].rstrip(" :=(").rpartition(" ")[2].lower()
    parts = span.split(".")
    octets = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    n = len(digits)
    whole = address and spelled(span)
    names = ["any", f"words={1 if whole else words}", "digits=" + ("few" if n < 7 else str(n))]
    names.append("address" if address else "no address")
    names.append("octets" if octets and all(len(p) <= 3 and int(p) <= 255 for p in parts) else "large octets" if octets else "no octets")
    if n >= 12:
        names.append("checksum" if luhn(digits) else "no checksum")
    if span[0] == "+":
        names.append("plus")
    elif span[0] == "(":
        names.append("bracket")
    names += [f"has {c!r}" for c in " -.(" if c in span and not (whole and c in " (")]
    if set(span) <= set("0123456789 -"):
        names.append("digits, blanks, hyphens")
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    if groups in ([4, 4, 4, 4], [4, 6, 5]):
        names.append("card groups")
    if groups[-2:] == [3, 4] or groups[-1:] == [4] and span[0] in "+(":
        names.append("phone groups")
    if before in HINTS:
        names.append("hint " + HINTS[before])
    number = {"plus", "bracket", "phone groups", "hint phone"} & set(names)
    can_be = [address, "octets" in names, "checksum" in names and "digits, blanks, hyphens" in names, 9 <= n <= 15 and bool(number) and not address]
    return (names, can_be) if any(can_be) else None


class Crf:
    """Weights per kind and feature; scores of segments are sums of them."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros((len(KINDS), 0))

    def candidates(self, text: str, words: list[tuple[int, int]], learn: bool = False, firsts: range | None = None) -> list[tuple[int, int, int, int, list[int], np.ndarray]]:
        """Segments (first word, last word + 1, start, end, features, what rules kinds out) of an
        island, those that begin at the words `firsts` if given."""
        found = []
        for i in range(len(words)) if firsts is None else firsts:
            for j in range(i + 1, min(len(words), i + MAX_WORDS) + 1):
                start, end = trimmed(text, words[i][0], words[j - 1][1])
                seen = features(text, start, end, j - i) if end > start else None
                if seen:
                    numbers = [self.index.setdefault(n, len(self.index)) if learn else self.index.get(n, -1) for n in seen[0]]
                    found.append((i, j, start, end, [n for n in numbers if n >= 0], np.where(seen[1], 0.0, IMPOSSIBLE)))
        return found

    def scores(self, segments) -> list[list[float]]:
        return [(self.weights[:, s[4]].sum(axis=1) + s[5]).tolist() for s in segments]

    def decode(self, text: str, words: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Best spans (start, end, kind) of an island, however long: candidates are held for some words at a time."""
        n = len(words)
        best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for begin in range(0, n, ISLAND_WORDS):
            some = range(begin, min(n, begin + ISLAND_WORDS))
            segments = self.candidates(text, words, firsts=some)
            starting: dict[int, list] = {}
            for s, scores in zip(segments, self.scores(segments)):
                kind = max(range(len(KINDS)), key=scores.__getitem__)
                starting.setdefault(s[0], []).append((s[1], scores[kind], (s[2], s[3], kind)))
            for i in some:
                for last, score, span in starting.get(i, ()):
                    if best[i] + score > best[last]:
                        best[last], back[last] = best[i] + score, (i, span)
                if best[i] >= best[i + 1]:
                    best[i + 1], back[i + 1] = best[i], (i, None)
        spans, i = [], len(words)
        while i:
            i, span = back[i]
            if span:
                spans.append(span)
        return spans[::-1]

    def fit(self, rows: list[tuple[str, list[tuple[int, int]], list[tuple[int, int, int]]]], rounds: int = 30, rate: float = 0.5, decay: float = 1e-3) -> Crf:
        """Maximum likelihood by gradient steps; rows are (text, island, labelled spans)."""
        data = []
        for text, words, gold in rows:
            segments = self.candidates(text, words, learn=True)
            where = {(s[2], s[3]): k for k, s in enumerate(segments)}
            labels = {where[a, b]: kind for a, b, kind in gold if (a, b) in where}
            unsure = [k for k, s in enumerate(segments) if k not in labels and s[5][0] == 0 and spelled(text[s[2] : s[3]])]
            if unsure:
                continue
            if segments and len(labels) == len({(a, b) for a, b, _ in gold}):
                data.append((len(words), segments, labels))
        self.weights = np.zeros((len(KINDS), len(self.index)))
        squares = np.full_like(self.weights, 1e-6)
        for _ in range(rounds):
            gradient = -decay * len(data) * self.weights
            for n, segments, labels in data:
                scores = self.scores(segments)
                alpha, beta = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
                by_end: dict[int, list[int]] = {}
                by_start: dict[int, list[int]] = {}
                for k, s in enumerate(segments):
                    by_end.setdefault(s[1], []).append(k)
                    by_start.setdefault(s[0], []).append(k)
                for i in range(1, n + 1):
                    alpha[i] = _log_sum([alpha[i - 1]] + [alpha[segments[k][0]] + x for k in by_end.get(i, ()) for x in scores[k]])
                for i in range(n - 1, -1, -1):
                    beta[i] = _log_sum([beta[i + 1]] + [beta[segments[k][1]] + x for k in by_start.get(i, ()) for x in scores[k]])
                for k, s in enumerate(segments):
                    for kind in range(len(KINDS)):
                        expected = math.exp(alpha[s[0]] + scores[k][kind] + beta[s[1]] - alpha[n])
                        gradient[kind, s[4]] += (labels.get(k) == kind) - expected
            squares += gradient**2
            self.weights += rate * gradient / np.sqrt(squares)
        return self


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def learn(docs: DataFrame, text_col: str = "text", sample_rows: int = 2_000, seed: int = 7) -> Crf:
    """Fit on the islands of at most `sample_rows` texts with a base span or a long number, those
    with the smallest hash; the bound is the parameter, the labels are the base spans."""
    rows = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike("@|[0-9][0-9 ().-]{6}"))
    total = rows.count()
    place = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1_000_000))
    near = rows.where(place <= int(min(1.0, 4 * sample_rows / max(1, total)) * 1_000_000)).withColumn("place", place)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Up to 20 islands of a text, with the characters before them and their labelled spans."""
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = base_spans(text)
                for n, words in enumerate(w[i : i + ISLAND_WORDS] for w in islands(text) for i in range(0, len(w), ISLAND_WORDS)):
                    if n >= 20:
                        break
                    first = max(0, words[0][0] - 24)
                    gold = [(a, b, k) for a, b, k in base if a >= words[0][0] and b <= words[-1][1]]
                    out[0].append(at)
                    out[1].append(text[first : words[-1][1] + 1][:4_000])
                    out[2].append([x - first for w in words for x in w] + [-1] + [x for a, b, k in gold for x in (a - first, b - first, k)])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.int32()))], names=["place", "text", "marks"])

    kept = near.select("text", "place").mapInArrow(cut, "place long, text string, marks array<int>")
    sample = []
    for r in kept.orderBy("place", F.xxhash64("text")).limit(sample_rows).collect():
        split = r["marks"].index(-1)
        words, gold = r["marks"][:split], r["marks"][split + 1 :]
        if words[-1] <= len(r["text"]):
            sample.append((r["text"], list(zip(words[::2], words[1::2])), list(zip(gold[::3], gold[1::3], gold[2::3]))))
    return Crf().fit(sample)


def find(text: str, model: Crf) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: the base ones and what the model adds apart from them."""
    base = base_spans(text)
    added = []
    for words in islands(text):
        added += [s for s in model.decode(text, words) if all(s[1] <= b[0] or s[0] >= b[1] for b in base)]
    return base, sorted({*base, *added}, key=lambda s: (s[0], s[2], s[1]))


def scan_pii(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of base spans by kind, `base_sha256`, `spans` (kind:start:end of all), `n_added`.

    Starts and ends are code points of the whole text. A null or empty text has no spans; repeated
    rows give repeated results; an empty table gives no rows. Only id and text are read.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    numbers = [f"n_{k}" for k in KINDS]
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, T.LongType()) for n in numbers), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])

    def show(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1):
                counts, digests, shown, added = [], [], [], []
                for text in some.column(1).to_pylist():
                    base, spans = find(text, known.value) if text and TRIGGER.search(text) else ([], [])
                    counts.append([sum(s[2] == k for s in base) for k in range(len(KINDS))])
                    digests.append(hashlib.sha256(show(base).encode()).hexdigest())
                    shown.append(show(spans))
                    added.append(len(spans) - len(base))
                columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns, pa.array(digests, pa.string()), pa.array(shown, pa.string()), pa.array(added, pa.int64())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(scan, schema)
