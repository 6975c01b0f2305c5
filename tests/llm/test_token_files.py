import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from tessera.llm import idcoder, token_files


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 129, 5000, 70_000):
        for top in (1, 2, 300, 50_257):
            for ids in (rng.integers(0, top, n), np.minimum(rng.zipf(1.3, n) - 1, top - 1), np.full(n, top - 1), np.tile(rng.integers(0, top, 40), n // 40 + 1)[:n]):
                assert np.array_equal(idcoder.decode_block(idcoder.encode_block(ids, top)), ids)


def test_half_of_a_block_is_learned_at_most():
    for steps in range(1, 1500):
        rounds = idcoder._rounds(steps)
        assert [stop for _, stop in rounds[:-1]] == [first for first, _ in rounds[1:]] and rounds[0][0] == 0 and rounds[-1][1] == steps
        assert 2 * rounds[-1][0] <= steps  # the last round is not learned
        assert all(stop <= 2 * first + 1 for first, stop in rounds)


def test_contexts_help():
    rng = np.random.default_rng(2)
    follow = rng.integers(0, 5000, 5000)
    x, chain = 1, []
    for noise in rng.random(200_000):
        x = int(follow[x]) if noise < 0.9 else int(rng.integers(0, 5000))
        chain.append(x)
    shuffled = rng.permutation(chain)
    assert len(idcoder.encode_block(np.array(chain), 5000)) < 0.5 * len(idcoder.encode_block(shuffled, 5000))


def test_real_ids_take_less_than_their_order_0_entropy(sf_dir):
    import pyarrow.parquet as pq

    from tessera.llm.library_tokenizer import encoder

    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()
    ids, _ = encoder(token_files.default_path())([t or "" for t in texts])
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    entropy = -(share * np.log2(share)).sum()
    assert 8 * len(idcoder.encode_block(ids, 50_257)) < 0.95 * entropy * len(ids)


def test_starts_over_many_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILES_A_GROUP", 2)
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('word ', cast(id % 7 as int)) AS text")
    files = token_files.write_token_files(docs, token_files.default_path())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = token_files.read_token_files(files).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == _expected(rows)


def test_damage_is_found():
    block = token_files.pack_block([5, None], np.array([2, 1]), 7, np.array([1, 2, 3]), 9)
    assert token_files.unpack_block(block)[0] == [5, None]
    for i in range(len(block)):
        broken = bytearray(block)
        broken[i] ^= 4
        with pytest.raises(idcoder.Corrupt):
            token_files.unpack_block(bytes(broken))


def _expected(rows):
    tokenizer = Tokenizer.from_file(token_files.default_path())
    at, out = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_rows(spark):
    rows = [(3, None), (1, ""), (1, "a b"), (1, "a b"), (None, "x"), (-5, "word <|endoftext|> " * 3000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int")
    files = token_files.write_token_files(docs, token_files.default_path())
    got = token_files.read_token_files(files, with_ids=True).collect()
    got = sorted(got, key=lambda r: r.start)
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((d or 0, n, crc) for d, _, n, crc in _expected(rows))
    assert [r.doc_id for r in got] == [None, -5, 1, 1, 1, 3]  # rows of one id: in either order
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    assert all(len(r.ids) == r.n_tokens for r in got)
    none = token_files.write_token_files(docs.limit(0), token_files.default_path())
    assert token_files.read_token_files(none).collect() == []


def test_query_equals_the_library(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = token_files.op8_token_files(spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == _expected(rows)
