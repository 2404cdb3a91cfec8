import random

import pytest
from tokenizers import Tokenizer

from pulse.llm import bpe
from pulse.llm.queries import BYTE_BPE, op1_bpe_tree

from . import data


@pytest.fixture(scope="module")
def real():
    return Tokenizer.from_file(bpe.located(BYTE_BPE))


def ids(real, text):
    return real.encode(text or "", add_special_tokens=False).ids


def tree(codec, text, leaf):
    t = bpe.Tree(codec)
    for i in range(0, len(text), leaf):
        t.add(codec.leaf(text[i:i + leaf]))
    return t.ids()


def test_tree_equals_tokenizer_at_any_cut(real, monkeypatch):
    codec, r = bpe.Codec(BYTE_BPE), random.Random(2)
    bits = ["a", "aa", " ", "  ", "\n", "'", "re", "s", "1", "23", "!", "é", "the", "x" * 9, "\u3000", "😀", " don't", "\t", "'ll", "ing"]
    for long_piece in (256, 2):
        monkeypatch.setattr(bpe, "LONG_PIECE", long_piece)
        for _ in range(400):
            some = r.sample(bits, r.randint(1, 6))
            text = "".join(r.choice(some) for _ in range(r.randint(1, 60)))
            assert tree(codec, text, r.randint(1, 9)) == ids(real, text)


def test_unsplit_text_shifts_through_the_right_half(real):
    codec = bpe.Codec(BYTE_BPE)
    for n in (1, 7, 64, 1001, 5000):
        assert tree(codec, "a" * n, 37) == ids(real, "a" * n)


def test_every_code_point_is_classed_alike(real):
    codec = bpe.Codec(BYTE_BPE)
    some = [f"a{chr(c)}1{chr(c)} {chr(c)}\n" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    assert [e.ids for e in real.encode_batch(some, add_special_tokens=False)] == [codec.encode(x) for x in some]


@pytest.mark.parametrize("leaf,spread", [(1 << 16, 1 << 16), (50, 50), (50, 1 << 16), (64, 1000)])
def test_whole_texts(llm, real, leaf, spread):
    got = [(r["row"]["doc_id"], list(r["ids"]), r["decoded"]) for r in bpe.round_trip(data.docs(llm), BYTE_BPE, leaf_chars=leaf, spread_chars=spread).collect()]
    want = [(d, ids(real, t), real.decode(ids(real, t), skip_special_tokens=False)) for d, t, *_ in data.rows()]
    key = lambda x: (str(x[0]), x[1])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_trees_of_whole_given_texts(real, monkeypatch):
    import pyarrow.parquet as pq

    codec = bpe.Codec(BYTE_BPE)
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 50)  # forgets all the time
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t]
    for leaf in (bpe.LEAF_CHARS, 301):
        assert all(codec.grown(t, leaf) == ids(real, t) for t in texts if len(t) > leaf)


def test_empty_table(llm):
    assert bpe.encode(data.empty(llm), BYTE_BPE).count() == 0


def test_query_digests(llm, real):
    import hashlib

    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in llm.read.parquet(f"{d}/documents.parquet").collect()}
    got = op1_bpe_tree(llm, d).collect()
    assert len(got) == len(texts)
    for r in got:
        want = ids(real, texts[r["doc_id"]])
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
