import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from tessera.llm import packing


def test_cuts_nearly_fill_their_class():
    for n in range(1, 9000):
        parts = packing.cut(n)
        assert sum(parts) == n
        assert all(p * (packing.CAPACITY // p) >= 0.98 * packing.CAPACITY for p in parts)


def test_packer_places_every_piece_once():
    rng, packer = random.Random(1), packing.HarmonicPacker()
    lengths = [rng.choice((1, 2, 30, 700, 1500, 2048, 5000, rng.randint(1, 20_000))) for _ in range(500)]
    placed = [x for d, n in enumerate(lengths) for x in packer.add(d, n)] + list(packer.finish())
    fills, spans = defaultdict(list), defaultdict(list)
    for p, s, o in placed:
        fills[s].append((o, p.length))
        spans[p.doc].append((p.start, p.length))
    for d, n in enumerate(lengths):
        at = 0
        for start, length in sorted(spans[d]):
            assert start == at
            at += length
        assert at == n
    padding = 0
    for parts in fills.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.02 * sum(lengths)


def _valid(rows, texts):
    tokenizer = Tokenizer.from_file(packing.default_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for d, rs in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[d], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    pad = total = 0
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        pad += 0 if at & (at - 1) == 0 else 2048 - at
        total += at
    return pad / max(1, total)


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert _valid(packing.op4_packing(spark, sf_dir).collect(), texts) < 0.02


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, "word " * 60_000, 2), (None, "x y", 3)], "doc_id long, text string, offset int")
    rows = packing.pack_documents(docs, packing.default_path()).collect()
    _valid(rows, {1: "", 2: "", 3: "word " * 60_000, None: "x y"})
    assert sum(len(r.ids) for r in rows) == 4 * sum(r.length for r in rows)
    assert packing.pack_documents(docs.limit(0), packing.default_path()).collect() == []
