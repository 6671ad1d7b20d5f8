"""Token alignment against a byte-by-byte search."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

pytest.importorskip("colonnade.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from sentencepiece import SentencePieceProcessor  # noqa: E402
from tokenizers import Tokenizer, decoders, pre_tokenizers  # noqa: E402

from colonnade.llm import alignment, common  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = ["a", " a", "a ", "  ", " ", "a  b", "a   b", "a\n b", "a \n b", "a\n\n b\n", "a\t\tb", "\n", "\na", "a  b", "a  b", "　x", "▁x", "a ▁ b", "<|endoftext|> <s> </s>", "<0x41> <unk>", "é ü é", "日本語 テスト 🙂 x", "a\r\n b", "don't won't 'tis", "1 23 456,7.8", "x\x00y z", "a  b", "ﬁ ①", "Ġ Ċ", "w" * 300, None, ""]


def tokenizers():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = {c: n for n, c in ((n, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(n))[0][0]) for n in range(128))}
    return a, b, shown


def spans(pieces):
    at, out = 0, []
    for i, raw in pieces:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out, b"".join(raw for _, raw in pieces)


def expected(texts):
    a, b, _ = tokenizers()
    decoder = decoders.ByteLevel()
    shown = {v: k for k, v in {n: (chr(n) if n not in alignment.BYTES_SHOWN else chr(alignment.BYTES_SHOWN[n])) for n in range(256)}.items()}
    assert decoder.decode(["Ġa"]) == " a"
    rows, held = [], Counter()
    for text in texts:
        if not text:
            rows.append(None)
            continue
        raw = (" " + text).encode()
        left, a_raw = spans([(i, bytes(shown[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids])
        right, b_raw = spans([(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)])
        if not a_raw == b_raw == raw:
            rows.append(None)
            continue
        cuts = sorted({e for _, _, e in left} & {e for _, _, e in right})
        groups = ";".join(",".join(str(i) for i, s, e in left if p < e <= c) + "|" + ",".join(str(i) for i, s, e in right if p < e <= c) for p, c in zip([0, *cuts], cuts))
        links = Counter((i, j) for i, s, e in left for j, t, u in right if s < u and t < e)
        held.update(links.keys())
        rows.append((len(left), len(right), len(cuts), links, groups))
    top = defaultdict(int)
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, groups = r
        out.append((n_a, n_b, n_groups, sum(links.values()), sum(n for (i, j), n in links.items() if held[i, j] == top[i]), sum(n * held[p] for p, n in links.items()), hashlib.sha256(groups.encode()).hexdigest()))
    return out


def frame(spark, texts):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("row", T.StringType()), T.StructField("pairs", T.StringType())])
    return spark.createDataFrame([(i, t, "r", None) for i, t in enumerate(texts)], schema)


def got(df):
    return [tuple(r)[1:] for r in sorted(df.collect())]


def test_intervals_coalesce():
    order, begins = alignment.coalesce(*map(__import__("numpy").array, ([0, 3, 3, 9, 0], [3, 9, 5, 10, 2])))
    assert order.tolist() == [4, 0, 2, 1, 3] and begins.tolist() == [True, False, True, False, True]


@pytest.mark.parametrize("broadcast", [True, False])
def test_alignment_of_hard_texts(spark, monkeypatch, broadcast):
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "é", "ung", "▁", "<", "|>", ".", "日", " ", "'s", "12", "\t", "Über", " x", "<0x0A>", "🙂"]
    texts = HARD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(300)] + HARD[:10]
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 2_000_000 if broadcast else 1)
    assert got(alignment.alignment_digests(frame(spark, texts), A, B)) == expected(texts)


def test_alignment_of_documents(spark):
    docs = common.read(spark, "/root/testdata/sf0.001", "documents")
    texts = [r["text"] for r in docs.orderBy("doc_id").select("text").collect()]
    assert got(alignment.alignment_digests(docs, A, B)) == expected(texts)


def test_a_full_store_starts_afresh(monkeypatch):
    own, texts = alignment.Aligner(A, B), pa.array(["one two three", "four five", "a  b", "two"])
    first = own.align(texts)[1]
    monkeypatch.setattr(alignment, "CACHE_WORDS", 4)
    for _ in range(3):
        assert own.align(texts)[1] == first


def test_empty_and_long_texts(spark):
    assert alignment.alignment_digests(frame(spark, []), A, B).count() == 0
    long = " ".join(f"w{i} the" for i in range(30_000))
    rows = got(alignment.alignment_digests(frame(spark, [long, long, None, long + "  end", "z" * 50_000]), A, B))
    assert rows[0] == rows[1] and rows[2] == (0, 0, 0, 0, 0, 0, "") and rows[3][0] > rows[0][0] and rows[4][2] >= 1
    groups = alignment.aligned(frame(spark, ["a b"]), A, B, groups=True).select(F.col("groups")).first()[0]
    assert groups.count("|") == 2


def test_a_full_store_keeps_what_came_again(monkeypatch):
    own, small = alignment.Aligner(A, B), alignment.Aligner(A, B)
    for i in range(20):
        texts = pa.array([f"a b c{i} d{i}", f"b a e{i % 3}", "x  y"])
        monkeypatch.setattr(alignment, "CACHE_WORDS", 10**9)
        want = own.align(texts)
        monkeypatch.setattr(alignment, "CACHE_WORDS", 14)
        got = small.align(texts)
        assert got[1] == want[1] and all((a == b).all() for a, b in zip((got[0], *got[2:]), (want[0], *want[2:])))
