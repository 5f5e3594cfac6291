"""Encoder and decoder against the tokenizers library, whole and in pieces of any size; lookahead by trial."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from attesta.llm import bpe

FILE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "th", "e", " ", "  ", "\n", "\t", "'", "s", "'s", "'re", "'ll", "l", "1", "23", "!", "<|endoftext|>", "<|end", "|>", "é", "漢", " ", "　", "😀", "\U00010940", "࢏", "\x1c", "\x85", "er", "in", "ing", " the"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def known():
    return bpe.vocabulary(FILE)


def in_blocks(known, text, long, cuts):
    e, out = bpe.Encoder(known, long), b""
    for a, b in zip([0, *cuts], [*cuts, len(text)]):
        out += e.feed(text[a:b])
    return np.frombuffer(out + e.finish(), "<u4").tolist()


def test_any_blocks_give_the_ids_of_the_library(library, known):
    rng = random.Random(3)
    for _ in range(500):
        few = rng.sample(PARTS, rng.choice([1, 2, 4, len(PARTS)]))
        text = "".join(rng.choice(few) for _ in range(rng.choice([3, 12, 60, 500])))
        if rng.random() < 0.2:
            text = rng.choice(["a", " ", "\n", "!", "1", "é"]) * rng.randint(1, 3000) + text
        want = library.encode(text, add_special_tokens=False).ids
        cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.choice([0, 1, 5, 40])))
        assert in_blocks(known, text, rng.choice([4, 16, 1024]), cuts) == want, repr(text[:100])
        d, at, told = bpe.Decoder(known), 0, ""
        while at < len(want):
            step = rng.randint(1, 4)
            told += d.feed(want[at : at + step])
            at += step
        assert told + d.finish() == library.decode(want, skip_special_tokens=False)


def test_memory_of_a_long_piece_is_bounded(known):
    e = bpe.Encoder(known)
    for _ in range(15):
        e.feed("ab" * 50_000)
        assert len(e.bytes) + len(e.held) < 100_000 + 8 * known.merges.lookahead + 2 * bpe.LONG
    e.finish()
    assert (e.bytes, e.held, e.begun, e.run) == (b"", "", "", None)


def test_lookahead_is_sufficient_on_a_small_list():
    """Over all texts of an alphabet of two: tokens that end `lookahead` bytes before the end of a prefix are final."""
    from itertools import product

    pairs = [(b"a", b"b"), (b"b", b"b"), (b"b", b"ab"), (b"ab", b"bab")]
    tokens = [bytes([b]) for b in range(256)] + [a + b for a, b in pairs]
    merges = bpe.Merges(pairs, {t: i for i, t in enumerate(tokens)})
    assert 0 < merges.lookahead <= sum(len(a) for a, _ in pairs)
    for word in product(b"ab", repeat=11):
        whole = merges.encode(bytes(word))
        for n in range(1, 11):
            at = 0
            for k, t in enumerate(merges.encode(bytes(word[:n]))):
                at += len(tokens[t])
                if at > n - merges.lookahead:
                    break
                assert whole[k] == t


def test_broken_bytes_and_unknown_ids(library, known):
    by_bytes = {b: i for i, b in known.tokens.items()}
    for raw in ([0xF0, 0x9F, 0x41], [0xC3, 0x28], [0xE2, 0x82], [0xFF, 0xC0, 0x80], [0xED, 0xA0, 0x80]):
        ids = [by_bytes[bytes([b])] for b in raw]
        assert bpe.Decoder(known).feed(ids, True) == library.decode(ids, skip_special_tokens=False)
    assert bpe.Decoder(known).feed([99_999_999, by_bytes[b"a"]], True) == "a"


def test_round_trip_of_rows(spark, library):
    texts = [None, "", "it's  a\n\ntest", "x" * 300_000, "a b " * 100_000, "say <|endoftext|> now", "a b", "a b"]
    docs = spark.createDataFrame([(None if i == 6 else i // 2, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.round_trip(docs).collect()), key=repr)
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        told = library.decode(ids, skip_special_tokens=False)
        want.append((None if i == 6 else i // 2, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(told.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    back = bpe.decoded(bpe.encoded(docs).withColumnRenamed("doc_id", "id"), id_col="id")
    assert sorted(r["text"] for r in back.collect()) == sorted(t or "" for t in texts)
    assert bpe.round_trip(docs.limit(0)).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [None, 64])], "doc_id long, ids array<int>")
    assert sorted(r["text"] for r in bpe.decoded(nulls).collect()) == ["", "a"]


def test_query_on_the_given_table(spark, library):
    from attesta.llm.common import table
    from attesta.llm.queries import op11_bpe_transducer

    sf = "/root/testdata/sf0.001"
    want = {}
    for r in table(spark, sf, "documents").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in op11_bpe_transducer(spark, sf).collect()} == want
