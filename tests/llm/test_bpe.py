import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from tessera.llm import bpe, library_tokenizer

PARTS = ["\r\r", "\r", "İ", "ΑΣ", "\u0958", "\u1100\u1161", *"ab cdeé'sltrm  \n\n\t\r1234567890!?.,-_#　\xa0́Σσß日本語한국어😀\x00\x1c\x85 ", "<|endoftext|>", "<|", "the", " ing", "  ", "   ", "'ll", "aaaa"]


@pytest.fixture(scope="module")
def pair():
    return bpe.model(bpe.default_path()), Tokenizer.from_file(bpe.default_path())


def test_ids_and_text_equal_the_library(pair):
    ours, theirs = pair
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += ["", "a" * 50_000, "1" * 20_000, " " * 5_000, "日本" * 9_000, "".join(rng.choice("abcdefghij") for _ in range(30_000))]
    ids, ends = ours.encoder(texts)
    for i, t in enumerate(texts):
        mine, want = ids[ends[i] : ends[i + 1]], theirs.encode(t, add_special_tokens=False).ids
        assert mine.tolist() == want
        assert ours.decode(mine) == theirs.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_through_the_library_equal_whole_texts(name):
    """library_tokenizer's cached pieces against one call of the library per text."""
    import public_tokenizers

    path = public_tokenizers.path(name)
    ours, theirs = library_tokenizer.encoder(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(2500)]
    texts += ["a \r\r b", "\t\r\r", "a\n\r\r\tb", "x \r\r\r\ty", "\r\r", "a\n", "\na", "b ", "", "a<|endoftext|>\r\r", "a" * 30_000, "one\t\ntwo"]
    texts += [" ".join(rng.choice(("word", "Straße", "don't", "x1", "a,", "日本", "a\t", "b\nc", "\n")) for _ in range(rng.randint(1, 30))) for _ in range(500)]
    for start in range(0, len(texts), 300):
        part = texts[start : start + 300]
        ids, ends = ours(part)
        for i, t in enumerate(part):
            assert ids[ends[i] : ends[i + 1]].tolist() == theirs.encode(t, add_special_tokens=False).ids, t


def test_broken_utf8_decodes_as_the_library(pair):
    ours, theirs = pair
    rng = np.random.default_rng(2)
    for _ in range(300):
        ids = rng.integers(0, 256, rng.integers(0, 12)).tolist()
        assert ours.decode(np.array(ids, np.int64)) == theirs.decode(ids, skip_special_tokens=False)


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (1, None, 0), (None, "ab", 1), (3, "", None)], "doc_id long, text string, ids int")
    got = bpe.round_trip(docs, bpe.default_path()).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.n_tokens, r.ids_sha256 == empty, r.decoded_sha256 == empty) for r in got) == [(0, True, True)] * 3 + [(1, False, False)]
    texts = bpe.decode_documents(bpe.encode_documents(docs, bpe.default_path()), bpe.default_path()).collect()
    assert sorted(r.text for r in texts) == ["", "", "", "ab"]
    assert bpe.round_trip(docs.limit(0), bpe.default_path()).collect() == []


def test_query_equals_the_library(spark, sf_dir, pair):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in bpe.op9_bpe(spark, sf_dir).collect():
        ids = pair[1].encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_words_through_the_model_equal_the_library(pair):
    theirs = pair[1]
    words = library_tokenizer._byte_level_words(Tokenizer.from_file(bpe.default_path()))
    known = [" the", "the", " Ünïcödé", "ÀÖØöøÿ", "\nWas", "\nété", "$$$", " $$$", "'", " ''", "_", " 42", "\n7"]
    others = ["×", " a×b", " don't", "'t", " a1", "\n", "", "\n\na", " a\n", " ł", "日本", " a b", "a\tb", " aé日", "…", "a.", "<|endoftext|>"]
    ids, sizes = words([p.encode() for p in known + others])
    assert all(sizes[: len(known)]) and not any(sizes[len(known) :])
    assert ids == [i for p in known for i in theirs.encode(p, add_special_tokens=False).ids]


def test_words_are_pieces_without_marks_behind_them(pair):
    texts = ["Thé word$$$ don't, (été). a.b\nx! 日本。", "", "a  b", "\u2003<|endoftext|>x é%"]
    pieces, ends = pair[0].cut(texts)
    got = [x.decode() for x in pieces.to_pylist()]
    assert [got[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)] == [
        ["Thé", " word", "$$$", " don", "'t", ",", " (été", ").", " a", ".b", "\nx", "!", " 日本。"],
        [],
        ["a", " ", " b"],
        ["\u2003", "<|endoftext|>", "x", " é", "%"],
    ]
