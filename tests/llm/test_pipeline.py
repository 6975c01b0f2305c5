import os
import re
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as cp
from tests.llm.test_near_dedup import brute_classes, counted_idf
from tests.llm.test_packing import _valid
from tests.llm.test_pii import PLAIN

from tessera.llm import pii, quality
from tessera.llm.common import lean, written


def test_stages_one_by_one(spark, sf_dir):
    """Each stage against a plain version on its own input; the last against the tokenizer."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        out = written(stage(spark, docs, sf_dir), "test")
        assert out.columns == docs.columns
        after = {r.doc_id: r for r in out.collect()}
        assert len(after) == out.count() > 0
        if name == "quality":
            model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            scores = dict(zip(rows, model.score([r.text or "" for r in rows.values()]), strict=True))
            assert set(after) == {d for d, s in scores.items() if s >= 0.3}
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for d, r in rows.items():
                groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), d))
            assert set(after) == {min(g)[1] for g in groups.values()}
        elif name == "near_dedup":
            texts = [(d, r.text) for d, r in rows.items()]
            assert set(after) == {min(g) for g in brute_classes(texts, counted_idf(texts))}
        else:
            assert set(after) == set(rows)
            for d, r in rows.items():
                assert after[d].text == pii.redact(r.text, pii.find_pii(r.text)) and not PLAIN["email"].search(after[d].text)
                assert after[d].n_chars == len(after[d].text)
        if name != "pii":
            assert all(after[d] == rows[d] for d in after)
        docs, rows = out, after
    assert _valid(cp.STAGES[-1][1](spark, docs, sf_dir).collect(), {d: r.text for d, r in rows.items()}) < 0.02


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "The cat sat on the mat and it was the end of it.", None, "s", 48), (3, "Mail a@b.cd to the man of the house and to me.", "en", None, None)]
    for name, some in (("few", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert cp.run(spark, f"{tmp_path}/none").collect() == []
    assert {r.doc_id for r in cp.run(spark, f"{tmp_path}/few").collect()} == {1, None, 3}


def test_a_task_gives_freed_memory_back():
    """What was freed between blocks that stay in use returns to the system when the rows end."""
    kept, seen = [], []

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    def run(batches):
        blocks = [np.ones(2000) for _ in range(5000)]  # 80 MB of pieces that the C library keeps
        kept.extend(blocks[::100])
        del blocks
        yield from batches
        seen.append(resident())

    assert list(lean(run)(iter([1, 2]))) == [1, 2]
    assert seen[0] - resident() > 40
