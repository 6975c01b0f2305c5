import random
import re

from tessera.llm import license_scan as ls

SCHEMA = "doc_id long, text string, license string"


def brute(text, templates):
    """Containment, first best window and number of windows by plain loops."""

    def grams(t):
        w = [x for x in re.split(r"[\W_]+", t.lower()) if x]
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    out, s = {}, grams(text)
    for name, template in templates.items():
        t = set(grams(template))
        length, stride = ls.window_of(len(t))
        shares = [(len(set(s[a : a + length]) & t) / len(t), -a) for a in range(0, len(s), stride)]
        shares = [x for x in shares if x[0] >= ls.THRESHOLD]
        if shares:
            share, start = max(shares)
            out[name] = (round(share, 6), -start, len(shares))
    return out


def test_planted_notices_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for k in range(60):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(0, 150))]
        for name in rng.sample(sorted(ls.TEMPLATES), rng.randint(0, 3)):
            notice = ls.TEMPLATES[name].split()
            if rng.random() < 0.4:
                notice[rng.randrange(len(notice))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = notice
        rows.append((k, " ".join(words), "x"))
    rows.append((60, "Released under the MIT License. " * 3000, "x"))
    got = {(r.doc_id, r.license): (r.containment, r.word_start, r.n_windows) for r in ls.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(d, name): v for d, t, _ in rows for name, v in brute(t, ls.TEMPLATES).items()}
    assert len(got) > 40


def test_odd_rows_and_native_plan(spark):
    docs = spark.createDataFrame([(None, "released under the MIT license", "a"), (1, None, "b"), (1, "", "c"), (2, "the MIT license", "d")], SCHEMA)
    found = ls.scan_licenses(docs)
    assert [(r.doc_id, r.license, r.containment, r.word_start, r.n_windows) for r in found.collect()] == [(None, "MIT", 1.0, 0, 1)]
    plan = found._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
    assert ls.scan_licenses(docs.limit(0)).collect() == [] and ls.scan_licenses(docs, {}).collect() == []
