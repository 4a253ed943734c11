import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomline.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TK = Tokenizer.from_file(PATH)


def want(text):
    """What the library says of the whole text."""
    ids = TK.encode(text or "", add_special_tokens=False).ids
    return ids, TK.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize(("leaf", "window"), [(1, 2), (7, 3), (40, 20), (150, 64), (1024, 64)])
def test_tree_equals_whole(leaf, window, monkeypatch):
    """Cuts anywhere: in words, numbers, contractions, special tokens and composed characters."""
    monkeypatch.setattr(bpe, "LEAF", leaf)
    monkeypatch.setattr(bpe, "WINDOW", max(window, bpe.MARGIN + 1) if leaf < 40 else window)
    c, rnd = bpe.Coder(PATH), random.Random(leaf)
    bits = [list("ab"), ["a"], ["the", "in", "'", "s", "'ll"], list("abcdefghijklmnopqrstuvwxyz"), ["é", "è", "e", "\u0301", "東", "京", "🎉", "ㅎ", "\u1112", "\u1161", "\u11ab"], list("=-_!'s"), ["don't ", "<|endoftext|>", "<|", "\n", "12", "x", "\x0b", "\xa0", "\x1c"], ["Hello, ", "World's ", "42 ", "naïve "], ["東"], ["''", "'s", "!"]]
    for trial in range(150):
        n = rnd.choice([5, 60, 400, 1500])
        text = "".join(rnd.choices(bits[trial % len(bits)] + (bits[rnd.randrange(len(bits))] if trial % 3 == 0 else []), k=n))
        assert c.root(c.block(text)).tolist() == want(text)[0], text


def test_windows_stay_small(monkeypatch):
    """Unsplit text is joined by windows that don't grow with it, also where a character has several tokens."""
    c, rnd = bpe.Coder(PATH), random.Random(2)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x4E00, 0x4F00)))):
        left, right = (c.block("".join(rnd.choices(letters, k=40_000))) for _ in range(2))
        seen = []
        coded = c._coded
        monkeypatch.setattr(c, "_coded", lambda t: seen.append(len(t)) or coded(t))
        both = c.join(left, right)
        assert max(seen) < 2000
        assert both.head.ids.tolist() == want(both.head.text)[0]
        monkeypatch.undo()


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    long = "".join(rnd.choice("abcdefghij") for _ in range(30_000))
    odd = ["", None, " ", "Hello, World's 42 tests", "a<|endoftext|>b <|STARTOFTEXT|>", "x\x1cy\x85z\xa0q w é ÉÀß İI ﬁ", "́a ́b", "naïve 東京都 🎉🎉 don't", "\x00\x0b\x0c\x7f"]
    return [*odd, long, f"{long} and {long[::-1]}<|endoftext|>{long}'s " * 2, "東" * 9000 + " x", "é" * 5000 + "1" * 6000 + "!" * 6000, odd[3],
            "".join(rnd.choice("abcdefghij é'東1") for _ in range(200_000)), "".join(rnd.choice("abcdé東") for _ in range(150_000)), "x" + "the cat sat on\n" * 14_000]


def test_encode(spark, texts):
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: (r.ids, r.decoded) for r in bpe.encode(docs, PATH).collect()}
    assert got == {(i or None): want(t) for i, t in enumerate(texts)}
    d = {r.doc_id: r for r in bpe.digests(bpe.encode(docs, PATH)).collect()}
    ids, text = want(texts[10])
    assert (d[10].n_tokens, d[10].ids_sha256, d[10].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert d[None].n_tokens == 0 and d[None].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_decode_and_empty(spark, texts):
    ids = [want(t)[0] for t in texts]
    rows = spark.createDataFrame([*enumerate(ids), (99, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(rows, PATH).collect()}
    assert got == {**{i: want(t)[1] for i, t in enumerate(texts)}, 99: ""}
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b")] * 3, "doc_id long, text string")
    assert bpe.encode(docs, PATH).where(F.size("ids") == 2).count() == 3
