"""Language-model scores: base by brute force, the attention model by its own definition."""

import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import types as T

pytest.importorskip("colonnade.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from sentencepiece import SentencePieceProcessor  # noqa: E402

from colonnade.llm import attention, common, lm_scoring  # noqa: E402
from colonnade.llm.tokens import Words  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def frame(spark, rows):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("row", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("words", T.StringType())])
    return spark.createDataFrame([(i, t, "r", None, "w") for i, t in rows], schema)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def expected(rows):
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not is_held(i) for w in words(t))
    total = sum(c.values())
    return sorted((str(i), is_held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), total, round(sum(log10((c[w] + 1) / (total + len(c) + 1)) for w in words(t)), 6)) for i, t in rows)


def found(df):
    rows = lm_scoring.scored(df, PIECES).collect()
    assert all(np.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    return sorted((str(r[0]), *r[1:5], round(r[5], 6)) for r in rows), rows


def test_base_scores_of_documents(spark):
    docs = common.read(spark, "/root/testdata/sf0.001", "documents")
    got, rows = found(docs)
    assert got == expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    # texts that were not learnt from are known better than by the classes' shares alone
    coded = common.staged(lm_scoring.encoded(docs, PIECES), "encoded")
    v = attention.vocabulary(lm_scoring.id_counts(coded, 32_000))
    plain = lm_scoring.model_scores(coded, v, attention.flat({n: x * (n == "bias") for n, x in attention.untrained(v).items()}))
    held = lambda of: sum(r["score"] for r in of if r["held_out"])
    assert held(rows) > 0.995 * held(plain.collect())


@pytest.mark.parametrize("frequent", [1, 20, 1_000_000])
def test_awkward_texts(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT_WORDS", frequent)
    texts = ["", None, "a B\tb", "É é\x0bÀ", "x\x85y\xa0z", "a" * 5_000, "w " * 9_000, "the the the", "  lead", "▁ <s> </s>", "日本 語"]
    rows = [(i, t) for i, t in enumerate(texts * 4)] + [(3, "a B"), (3, "a B"), (None, "q"), (None, None)]
    assert found(frame(spark, rows))[0] == expected(rows)


def test_nothing_to_learn_from(spark):
    assert lm_scoring.scored(frame(spark, []), PIECES).count() == 0
    out = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    got, _ = found(frame(spark, [(out, "a b")]))
    assert got == [(str(out), True, 3, 0, 0, 0.0)] == expected([(out, "a b")])


def test_ids_are_those_of_the_words(spark):
    model = SentencePieceProcessor(model_file=PIECES)
    texts = ["One two\nthree  Four", "", "É x", "one one"]
    rows = lm_scoring.encoded(frame(spark, list(enumerate(texts))), PIECES).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        assert r["ids"] == [i for w in words(t)[:-1] for i in model.encode(w)] + [model.eos_id()]


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(0)
    return attention.vocabulary(np.round(1e4 / np.arange(1, 3_001)).astype(int)), rng


def test_gradient_matches_differences(small, monkeypatch):
    v, rng = small
    w = {n: x.astype(np.float64) for n, x in attention.untrained(v).items()}
    slots, targets = rng.integers(0, v.n_slots, (3, attention.WINDOW)), rng.integers(0, len(v.prior), (3, attention.WINDOW))
    scored = rng.random((3, attention.WINDOW)) < 0.8
    _, g = attention.gradient(w, slots, targets, scored)
    for name, x in w.items():
        for at in [np.unravel_index(np.abs(g[name]).argmax(), x.shape), *(tuple(rng.integers(0, s) for s in x.shape) for _ in range(3))]:
            old, losses = x[at], []
            for step in (1e-5, -1e-5):
                x[at] = old + step
                losses.append(attention.gradient(w, slots, targets, scored)[0])
            x[at] = old
            assert abs((losses[0] - losses[1]) / 2e-5 - g[name][at]) < 1e-4 * max(1, abs(g[name][at])), name


def test_probabilities_of_all_ids_add_up_to_one(small):
    v, rng = small
    w = attention.untrained(v)
    top, _ = attention.hidden(w, rng.integers(0, v.n_slots, (2, attention.WINDOW)))
    logs, p = attention.class_log_probabilities(w, top[0], np.zeros(attention.WINDOW, int), keep=True)
    assert np.allclose(p.sum(1), 1, atol=1e-5) and np.allclose(np.bincount(v.of_class, np.exp(v.within)), 1, atol=1e-4)


@pytest.mark.parametrize("sizes", [[0], [1], [24], [25], [44], [45], [200, 0, 3, 80], []])
def test_every_id_is_scored_once_with_its_context(small, sizes):
    v, rng = small
    w = attention.shaped(v, attention.flat(attention.untrained(v)) + rng.standard_normal(attention.flat(attention.untrained(v)).size).astype(np.float32) * 0.05)
    begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    ids = rng.integers(0, 3_000, int(begins[-1])).astype(np.int32)
    got = attention.score(v, w, ids, begins)
    for n, (a, b) in enumerate(zip(begins, begins[1:])):
        total, text = 0.0, ids[a:b]
        for at in range(len(text)):
            number = 0 if at < attention.WINDOW else (at - attention.WINDOW) // attention.STRIDE + 1
            first = number * attention.STRIDE  # the window that scores this id
            seen = [v.n_slots - 1 if j == 0 else v.slot[text[j - 1]] for j in range(first, at + 1)]
            top, _ = attention.hidden(w, np.array([seen + [0] * (attention.WINDOW - len(seen))]))
            total += float(attention.class_log_probabilities(w, top[0, at - first : at - first + 1], v.of_class[text[at : at + 1]])[0][0] + v.within[text[at]])
        assert abs(got[n] - total) < 1e-3 * max(1, abs(total))


def test_learning_uses_the_context(small):
    v, rng = small
    learner = attention.Learner(v, attention.flat(attention.untrained(v)))
    ids = np.tile(np.arange(40, 60, dtype=np.int32), 2_000)  # the next id follows from the last
    begins = np.array([0, len(ids)])
    before = attention.score(v, learner.w, ids[:400], np.array([0, 400]))[0]
    learner.add(ids, begins, *attention.windows(begins))
    learner.learn(True)
    after = attention.score(v, learner.w, ids[:400], np.array([0, 400]))[0]
    assert after > 0.5 * before and learner.seen == len(ids)


def test_a_full_store_keeps_what_came_again(monkeypatch):
    import pyarrow as pa

    texts = [pa.array([f"a b c{i} d{i}", f"b a e{i % 3}"]) for i in range(40)]
    whole = lm_scoring.Subwords(PIECES)
    monkeypatch.setattr(lm_scoring, "CACHE_WORDS", 12)
    small = lm_scoring.Subwords(PIECES)
    for t in texts:
        begins, words = lm_scoring.words_of(t)
        coded = words.dictionary_encode()
        monkeypatch.setattr(lm_scoring, "CACHE_WORDS", 10**9)
        want = whole.encode(begins, coded)
        monkeypatch.setattr(lm_scoring, "CACHE_WORDS", 12)
        got = small.encode(begins, coded)
        assert all((a == b).all() for a, b in zip(got, want)) and len(small.known) <= 12
    assert {"a", "b"} <= set(small.known)


def test_every_training_window_is_learnt_from(spark, monkeypatch):
    """Over the rounds each id of a training row is a target once; ids of held-out rows never are."""
    seen, added = [], lm_scoring._added
    monkeypatch.setattr(lm_scoring, "_added", lambda found: seen.append(added(found)) or seen[-1])
    texts = ["a", "", None, "the cat sat on the mat " * 40, "one two three " * 9]
    rows = common.staged(lm_scoring.encoded(frame(spark, list(enumerate(texts * 6))).repartition(3), PIECES), "encoded")
    lm_scoring.learn(rows, 32_000)
    want = sum(len(r["ids"]) for r in rows.where("not held_out").collect())
    assert sum(n for _, n in seen) == want and all(n > 0 for _, n in seen)


def test_steps_use_their_arrays_again(small):
    """After its first step a learner takes no more fresh memory than one array of all class scores (F3 of round 3:
    fresh arrays took a large part of a step), leaves the weights it was given alone, and learns as from fresh arrays."""
    import tracemalloc

    v, rng = small
    given = attention.flat(attention.untrained(v))
    learner, kept = attention.Learner(v, given), given.copy()
    step = lambda: (rng.integers(0, v.n_slots, (attention.STEP, attention.WINDOW)).astype(np.int32), rng.integers(0, len(v.prior), (attention.STEP, attention.WINDOW)), np.ones((attention.STEP, attention.WINDOW), bool))
    learner._step(*step())
    slots, targets, scored = step()
    want = attention.gradient(learner.w, slots, targets, scored)
    tracemalloc.start()
    loss, g = attention.gradient(learner.w, slots, targets, scored, learner.room)
    assert tracemalloc.get_traced_memory()[1] < slots.size * len(v.prior) * 4
    tracemalloc.stop()
    assert loss == want[0] and all(np.array_equal(g[n], want[1][n]) for n in g)
    assert np.array_equal(given, kept)


def test_words_are_found_together():
    import pyarrow as pa

    held = Words()
    held.add(pa.array(["a", "é", "日本"]))
    assert held.find(pa.array(["日本", "b", "", "a"])).tolist() == [2, -1, -1, 0]
    held.keep(np.array([2, 0]))
    assert list(held) == ["日本", "a"] and held.find(pa.array(["a", "é", "日本"])).tolist() == [1, -1, 0]
    assert held.find(pa.array([], pa.string())).tolist() == []


def test_a_learner_lays_out_one_step_at_a_time(small):
    """Windows of a piece were all laid out before the first step (F1 of round 3, CPU); steps are the same however
    the windows come."""
    import tracemalloc

    v, rng = small
    taken = {}

    class Counted(attention.Learner):
        def _step(self, slots, targets, scored):
            taken.setdefault(id(self), []).append((slots.copy(), targets.copy(), scored.copy()))
            self.seen += int(scored.sum())

    ids, begins = rng.integers(0, 3_000, 40_000).astype(np.int32), np.array([0, 5, 5, 9_000, 40_000])
    first, end, number = attention.windows(begins)
    whole, parts = (Counted(v, attention.flat(attention.untrained(v))) for _ in range(2))
    whole.add(ids, begins, first, end, number)
    for a, b in ((0, 1), (1, 80), (80, 80), (80, 700), (700, len(first))):
        parts.add(ids, begins, first[a:b], end[a:b], number[a:b])
    for learner in (whole, parts):
        learner.learn(True)
        assert learner.seen == len(ids)
    assert all(np.array_equal(x, y) for s, t in zip(taken[id(whole)], taken[id(parts)], strict=True) for x, y in zip(s, t))
    learner = attention.Learner(v, attention.flat(attention.untrained(v)))
    learner._step = lambda *step: None
    tracemalloc.start()
    learner.add(ids, begins, first, end, number)
    assert tracemalloc.get_traced_memory()[1] < len(first) * attention.WINDOW * 16
    tracemalloc.stop()


def test_only_scored_positions_go_through_the_last_layer(small, monkeypatch):
    """Context and padding went through it too (F1 of round 3, CPU), and further windows asked from all their positions."""
    v, rng = small
    sizes, last, whole = [30, 0, 3, 500], attention.last_layer, attention.attended
    begins = np.concatenate([[0], np.cumsum(sizes)])
    rows, asked = [], []
    monkeypatch.setattr(attention, "last_layer", lambda w, h, room: rows.append(len(h)) or last(w, h, room))
    monkeypatch.setattr(attention, "attended", lambda w, slots, room, since=0: asked.append(slots.shape[0] * (attention.WINDOW - since)) or whole(w, slots, room, since))
    attention.score(v, attention.untrained(v), rng.integers(0, 3_000, int(begins[-1])), begins)
    number = attention.windows(begins)[2]
    assert sum(rows) == begins[-1] and sum(asked) == (number == 0).sum() * attention.WINDOW + (number > 0).sum() * attention.STRIDE


def test_ids_are_staged_as_bytes(spark):
    """An id was a value of its own to Spark (F1 of round 3, CPU); lists and bytes are learnt from and scored alike."""
    rows = [(i, t) for i, t in enumerate(["", None, "the cat sat on the mat " * 30, "é 日本", "x"] * 4)]
    lists, packed = (common.staged(lm_scoring.encoded(frame(spark, rows).coalesce(1), PIECES, packed=p), "encoded") for p in (False, True))
    assert isinstance(packed.schema["ids"].dataType, T.BinaryType)
    assert [np.frombuffer(r["ids"], lm_scoring.id_kind(32_000)).tolist() for r in packed.orderBy("row").collect()] == [r["ids"] for r in lists.orderBy("row").collect()]
    size = lm_scoring.subwords(PIECES).size
    assert np.array_equal(lm_scoring.id_counts(lists, size), lm_scoring.id_counts(packed, size))
    model = lm_scoring.learn(packed, size)
    scores = lambda of: sorted((r["row"], r["score"]) for r in lm_scoring.model_scores(of, *model).collect())
    assert np.array_equal(model[1], lm_scoring.learn(lists, size)[1]) and scores(lists) == scores(packed)


@pytest.mark.parametrize("size", [500, 100_000])
def test_packed_lists_and_their_slices(size):
    import pyarrow as pa

    begins, ids = np.array([0, 0, 3, 4, 9]), np.array([1, 2, size - 1, 0, 5, 6, 7, size - 1, 3])
    batch = pa.RecordBatch.from_arrays([lm_scoring.packed_lists(begins, ids, size)], names=["ids"])
    want = [ids[a:b].tolist() for a, b in zip(begins, begins[1:])]
    for a, b in ((0, 4), (1, 3), (3, 4), (2, 2)):
        assert lm_scoring.unpacked(batch.slice(a, b - a), 0, size).column(0).to_pylist() == want[a:b]


def test_keys_of_words_are_computed_together():
    """Each word was hashed on its own, as a Python string (F1 of round 3, CPU)."""
    import pyarrow as pa

    words = pa.array([f"w{i}" for i in range(5_000)] + ["a", "b", "ab", "ba", "é", "日本", "a" * 3_000, "b" * 3_000, "a\0", "\0a", "\0"])
    keys = lm_scoring.word_keys(words)
    assert len(set(keys.tolist())) == len(words) and np.array_equal(keys, lm_scoring.word_keys(words, 10))
    assert np.array_equal(lm_scoring.word_keys(words.slice(4_990, 15)), keys[4_990:5_005])
    assert np.array_equal(lm_scoring.word_keys(words.cast(pa.large_string()).take(pa.array([3, 5_004, 3]))), keys[[3, 5_004, 3]])
    assert len(lm_scoring.word_keys(words.slice(0, 0))) == 0
