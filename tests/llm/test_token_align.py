"""Token alignment against a brute-force version that compares every two tokens of a text."""
import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import token_align as A

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORDS = ["the", "naïve", "x", "  ", "\n", "\t\t", "don't", "日本", "12345", "<|endoftext|>", "<s>", "▁", "a▁b", "　", "\xa0", "€€", "\x00", "é", "", "𝄞", "--->", "<0x0A>", "\x1c", " "]


@pytest.fixture(scope="module")
def pair():
    with open(A_PATH, "rb") as a, open(B_PATH, "rb") as b:
        return A.Pair(a.read(), b.read())


class Whole:
    """Both tokenizers over whole texts, token by token."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
        self.a.encode_special_tokens = True
        self.chars = A.byte_level()

    def tokens(self, text):
        if not text:
            return [], []
        want = (" " + text).encode()
        ids = self.a.encode(" " + text, add_special_tokens=False).ids
        a = [(i, bytes(self.chars[c] for c in self.a.id_to_token(i))) for i in ids]
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()) for i in self.b.encode(text) for p in [self.b.id_to_piece(i)]]
        return (a, b) if all(b"".join(t for _, t in x) == want for x in (a, b)) else ([], [])


def spans(tokens):
    out, at = [], 0
    for i, t in tokens:
        out.append((at, at + len(t), i))
        at += len(t)
    return out


def brute(rows):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of every row."""
    both, tokens, corpus = Whole(), [], Counter()
    for _, t in rows:
        a, b = map(spans, both.tokens(t))
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        corpus.update(links)
        tokens.append((a, b, links))
    highest = Counter()
    for (_, y), n in corpus.items():
        highest[y] = max(highest[y], n)
    out = []
    for (i, _), (a, b, links) in zip(rows, tokens):
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups = [tuple(",".join(str(x) for s, e, x in side if lo < e <= hi) for side in (a, b)) for lo, hi in zip([0, *cuts], cuts)]
        text = ";".join("|".join(g) for g in groups)
        out.append((i, len(a), len(b), len(cuts), len(links), sum(corpus[k] == highest[k[1]] for k in links), sum(corpus[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    texts = ["".join(r.choice(WORDS) + r.choice([" ", "", "  ", " \n"]) for _ in range(r.randrange(1, 40))) for _ in range(120)]
    texts = [t for t in texts if t] + [None, "", " ", "  ", "\n", "▁", "a", " a", "a ", "word " * 400, "nospaceatall" * 200]
    out = list(enumerate(texts))
    return out + [(3, texts[3]), (3, texts[3]), (None, texts[5]), (None, None)]


@pytest.mark.parametrize("block_bytes", [300, 8 << 20])
def test_aligned_equals_brute(spark, rows, block_bytes):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n_a int, row string, block int").repartition(3)
    got = A.aligned(df, A_PATH, B_PATH, block_bytes=block_bytes)
    assert got.columns == ["doc_id", "row", "block", *A.RESULTS]
    found = got.collect()
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found) == Counter(brute(rows))
    assert {(r.row, r.block) for r in found} == {("x", 2)}


def test_empty_table(spark):
    assert A.aligned(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH).count() == 0


def test_whole_texts_where_cuts_do_not_hold(pair, rows):
    """Without cuts every text is one piece, with the same result."""
    texts = pa.array([t for _, t in rows], pa.string())
    docs, block = A.align_block(pair, texts)
    whole = pair.cuts
    assert whole
    pair.cuts = False
    try:
        docs2, block2 = A.align_block(pair, texts)
    finally:
        pair.cuts = whole
    for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256"):
        assert docs.field(c).equals(docs2.field(c))
    count = lambda b: {p: n for p, n in zip(b.field("pairs").flatten().to_pylist(), b.field("n").flatten().to_pylist()) if n}
    assert count(block) == count(block2)


def test_cuts_are_verified():
    plain = {"pre_tokenizer": {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}}
    assert A.Pair._cuts_hold(plain, ["▁a", "▁▁", "b"])
    assert not A.Pair._cuts_hold(plain, ["of▁the"])
    assert not A.Pair._cuts_hold({"pre_tokenizer": {"type": "Whitespace"}}, ["a"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é▁\n\t　日1!'s\x00", max_size=25), min_size=1, max_size=6))
def test_any_text(texts):
    with open(A_PATH, "rb") as a, open(B_PATH, "rb") as b:
        pair = A._pair(a.read(), b.read())
    docs, _ = A.align_block(pair, pa.array(texts, pa.string()))
    want = brute(list(enumerate(texts)))
    got = list(zip(*[docs.field(c).to_pylist() for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")]))
    assert got == [(w[1], w[2], w[3], w[4], w[7]) for w in want]
