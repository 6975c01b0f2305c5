import hashlib
import random
import re

from tessera.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute(text):
    """The patterns as they are written, one after another."""
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    parts = ["a", ".b", "@", "x@y.z", ".", "1", "12", "255", "256", " ", "-", "+1", "(2)", "4539578763621486", "é", "\n", "%", "_", "192.168.0.1", "+1 (234) 555-0199"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 24)))
        spans = pii.find_pii(text)
        assert pii.joined([s for s in spans if s.kind in pii.BASE]) == brute(text), text


def test_checksums_and_context():
    text = "account DE89 3704 0044 0532 0130 00 or DE89 3704 0044 0532 0130 01; token = \"0a1b2c3d4e5f60718293a4b5c6d7e8f901234567\"; call (234) 555-0199"
    assert [s.kind for s in pii.find_pii(text)] == ["iban", "secret", "local_phone"]
    assert pii.find_pii("0a1b2c3d4e5f60718293a4b5c6d7e8f901234567 (234) 555-0199") == []
    assert pii.redact("x a@b.cd y", pii.find_pii("x a@b.cd y")) == "x [EMAIL] y"


def test_long_texts_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "+1" * 50_000, "1.2." * 50_000, "x@y.z " * 10_000):
        pii.find_pii(text)


def test_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (2, "mail a.b@c.de 10.0.0.1", "c"), (None, "x", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r.doc_id, r.spans): r for r in pii.span_digests(docs).collect()}
    assert len(got) == 4
    hit = got[2, "email:5:13,ip:14:22"]
    assert (hit.n_email, hit.n_ip, hit.n_card, hit.n_phone) == (1, 1, 0, 0)
    assert hit.base_sha256 == hashlib.sha256(b"email:5:13,ip:14:22").hexdigest()
    redacted = {r.redacted for r in pii.detect_pii(docs).collect()}
    assert redacted == {"", "mail [EMAIL] [IP]", "x"}
    assert pii.span_digests(docs.limit(0)).collect() == []


def test_query_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in pii.op5_pii(spark, sf_dir).collect():
        assert r.base_sha256 == hashlib.sha256(brute(texts[r.doc_id]).encode()).hexdigest()
