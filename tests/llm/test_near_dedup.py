import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from tessera.llm import near_dedup as n
from tessera.llm.components import components
from tessera.llm.shingles import shingles


def representatives(rows):
    """Distinct texts that no text with a smaller hash shares a min-hash with."""
    texts = sorted({t or "" for _, t in rows}, key=lambda t: hashlib.md5(t.encode()).digest())
    seen, out = set(), []
    for t, mins in zip(texts, map(tuple, n.sketches(texts).tolist()), strict=True):
        marks = set(enumerate(mins))
        if not marks & seen:
            out.append(t)
        seen |= marks
    return out


def counted_idf(rows):
    texts = representatives(rows)
    return n.Idf(n.frequency_buckets(texts), len(texts))


def brute_classes(rows, idf):
    """Components of all pairs of distinct texts whose weighted Jaccard similarity reaches the threshold."""
    texts = sorted({t or "" for _, t in rows})
    weights, holders = [], defaultdict(list)
    for k, t in enumerate(texts):
        value, level, _ = n.weighted([t], idf)
        weights.append(dict(zip(value.tolist(), np.exp2(level / n.LEVELS).tolist(), strict=True)))
        for v in weights[-1]:
            holders[v].append(k)
    totals = [sum(w.values()) for w in weights]
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, w in enumerate(weights):
        common = Counter()
        for v, x in w.items():
            for b in holders[v]:
                if b < a:
                    common[b] += min(x, weights[b][v])
        for b, c in common.items():
            if c / (totals[a] + totals[b] - c) >= n.THRESHOLD:
                parent[find(a)] = find(b)
    at = {t: find(k) for k, t in enumerate(texts)}
    groups = defaultdict(list)
    for d, t in rows:
        groups[at[t or ""]].append(d)
    return {frozenset(g) for g in groups.values()}


def classes(found):
    groups = defaultdict(list)
    for r in found:
        groups[r.class_id].append(r.doc_id)
        assert r.kept == (r.doc_id == r.class_id)
    for c, g in groups.items():
        assert min(g) == c
    return {frozenset(g) for g in groups.values()}


def test_shingles_equal_word_tuples():
    texts = ["", "a", "A  b", "a b c d e f a b c d e f", "é è  x y z", "one two three four five"]
    value, times, start = shingles(texts)
    for k, t in enumerate(texts):
        w = t.lower().split()
        want = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
        assert sorted(want.values()) == sorted(times[start[k] : start[k + 1]].tolist())
    again = shingles(texts[::-1])[0]
    assert sorted(value.tolist()) == sorted(again.tolist())


def test_samples_agree_as_often_as_texts_are_similar():
    rng, idf = np.random.default_rng(0), n.Idf(np.zeros(n.FREQUENCY_ROWS << n.FREQUENCY_BITS, np.int64), 1)
    for changes in (2, 10, 40):
        error = []
        for _ in range(40):
            words = [f"w{x}" for x in rng.integers(0, 500, 300)]
            other = list(words)
            for k in rng.integers(0, 300, changes):
                other[k] = f"v{k}"
            pair = [" ".join(words), " ".join(other)]
            value, level, start = n.weighted(pair, idf)
            sim = n.similarity(*((value[a:b], np.exp2(level[a:b] / n.LEVELS)) for a, b in zip(start[:-1], start[1:], strict=True)))
            x, y = n.signatures(pair, idf)
            error.append((x == y).mean() - sim)
        assert abs(np.mean(error)) < 0.03


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, k) for k in range(2001, 2080)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for p in links if p[0] != p[1] for x in p}


def test_groups_chains_and_odd_rows(spark):
    rng = random.Random(2)
    base = [f"word{rng.randint(0, 400)}" for _ in range(200)]
    rows = [(100, None), (101, ""), (102, " \n"), (103, "one"), (104, "One"), (105, "two"), (106, "x " * 50_000), (106, "x " * 50_000)]
    for k in range(60):  # a large group whose members differ in a few words each
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randint(0, 199)] = f"new{k}"
        rows.append((k, " ".join(copy)))
    chain = list(base[::-1])
    for k in range(200, 220):  # neighbours are similar, ends are not
        chain[(k - 200) * 9] = f"link{k}"
        rows.append((k, " ".join(chain)))
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, h int")
    found = n.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert classes(found) == brute_classes(rows, counted_idf(rows))
    assert {frozenset(range(60)), frozenset(range(200, 220)), frozenset((103, 104))} <= classes(found)
    assert n.near_duplicates(docs.limit(0)).collect() == []
    alone = n.near_duplicates(spark.createDataFrame([(None, "a b c"), (None, "q")], "doc_id long, text string")).collect()
    assert [(r.class_id, r.class_size, r.kept) for r in alone] == [(None, 1, True)] * 2


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert classes(n.op1_near_dedup(spark, sf_dir).collect()) == brute_classes(rows, counted_idf(rows))


def test_idf_equals_exact_counts_beside_frequent_passages():
    rng = np.random.default_rng(7)
    passage = " ".join(f"hot{k}" for k in range(300))
    texts = [f"{passage} " + " ".join(f"g{k}w{x}" for x in rng.integers(0, 10**6, 30)) for k in range(400)]
    texts += [" ".join(f"h{k}w{x}" for x in rng.integers(0, 10**6, 300)) for k in range(600)]
    idf = n.Idf(n.frequency_buckets(texts), len(texts))
    value, exact = np.unique(n.shingles(texts)[0], return_counts=True)
    want = np.log(len(texts) / exact) / np.log(len(texts))
    error = np.abs(np.exp2(idf(value) / n.LEVELS) - want)
    assert set(exact) == {1, 400} and (error < 0.03).mean() > 0.999 and error[exact == 400].max() < 0.03


def test_near_copies_count_once(spark):
    """A group of a third of all texts keeps the weight of its shingles."""
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 250)]
    rows = []
    for k in range(900):
        if k < 300:
            words = list(base)
            words[rng.integers(0, 250)] = f"new{k}"
        else:
            words = [f"w{x}" for x in rng.integers(0, 10**6, 250)]
        rows.append((k, " ".join(words)))
    assert sum(t.count(" ".join(base[:3])) + t.count(" ".join(base[-3:])) > 0 for t in representatives(rows)) <= 605
    found = n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert frozenset(range(300)) in classes(found)


def test_near_copies_that_exact_weights_find_are_found(spark, sf_dir):
    """Pairs of the given documents that reach the threshold under exactly counted TF-IDF, sketches aside."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    texts = representatives(rows)
    value, count = np.unique(n.shingles(texts)[0], return_counts=True)

    class Exact:
        def __call__(self, found):
            at = np.minimum(np.searchsorted(value, found), len(value) - 1)
            df = np.where(value[at] == found, count[at], 1)
            rarity = np.log(len(texts) / df) / np.log(len(texts))
            return np.round(np.log2(np.maximum(rarity, 2.0**n.LEAST)) * n.LEVELS).astype(np.int16)

    at = {r.doc_id: r.class_id for r in n.op1_near_dedup(spark, sf_dir).collect()}
    distinct = {t or "": d for d, t in rows}
    wanted = [g for g in brute_classes([(d, t) for t, d in distinct.items()], Exact()) if len(g) > 1]
    together = sum(len({at[d] for d in g}) == 1 for g in wanted)
    assert wanted and together >= 0.9 * len(wanted)


def test_every_text_counts_for_frequencies(spark, monkeypatch):
    """All distinct texts are counted: alone with a whole weight, near copies with about one together."""
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 250)]
    near = [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(200)]
    alone = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 250)) for _ in range(100)]
    seen = {}

    def spy(texts, count=n.document_frequencies):
        seen.update((r.text, r.weight) for r in texts.select("text", "weight").collect())
        return count(texts)

    monkeypatch.setattr(n, "document_frequencies", spy)
    rows = list(enumerate([*near, *alone, *[alone[0]] * 50, ""]))
    n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert set(seen) == {t for _, t in rows}
    assert all(seen[t] == n.ONE for t in [*alone, ""])
    assert n.ONE <= sum(seen[t] for t in near) <= 3 * n.ONE
