"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, lean, slices, whole_text, written
from tessera.llm.html_extract import STOP_WORDS

#: Labelled rows that a fit uses at most: those of the smallest hashed ids.
SAMPLE_ROWS = 20_000
#: Fourier features, ridge penalty per row, share of the sample that only calibrates, score a document is kept at.
FEATURES, RIDGE, CALIBRATION, KEEP = 256, 1e-4, 0.25, 0.3
#: Every FOLDS-th id by CRC-32 is held out: its label is never read by a fit.
FOLDS = 5

STATISTICS = (
    "log_chars", "log_words", "log_lines", "word_length", "long_words", "lower", "upper", "digits", "spaces", "marks", "other_bytes", "sentence_marks",
    "bars", "distinct_words", "top_word", "repeated_words", "stop_words", "distinct_lines", "capital_words", "marked_words", "byte_entropy",
)

_CLASSES = np.zeros((256, 7), np.int64)
for _i, _chars in enumerate((string.ascii_lowercase, string.ascii_uppercase, string.digits, string.whitespace, ".,;:?", "|")):
    _CLASSES[list(_chars.encode()), _i] = 1
_CLASSES[[ord(c) for c in string.punctuation if c not in ".,;:?|"], 6] = 1


def statistics(text: str) -> list[float]:
    """STATISTICS of one whole text; all zero for an empty one."""
    if not text or text.isspace():
        return [0.0] * len(STATISTICS)
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    n = int(raw.sum())
    lower, upper, digits, spaces, sentence, bars, marks = (raw @ _CLASSES).tolist()
    words = text.split()
    counts = Counter(words)
    k = len(words)
    lines = [x for x in text.split("\n") if x]
    share = raw[raw > 0] / n
    ends = Counter(map(str.__getitem__, words, [-1] * k))
    return [
        np.log1p(n),
        np.log1p(k),
        np.log1p(len(lines)),
        min(len(text) / k, 40.0),
        sum(map((14).__le__, map(len, words))) / k,
        lower / n,
        upper / n,
        digits / n,
        spaces / n,
        marks / n,
        (n - lower - upper - digits - spaces - sentence - bars - marks) / n,
        sentence / k,
        bars / k,
        len(counts) / k,
        max(counts.values()) / k,
        sum(map(eq, words, words[1:])) / k,
        sum(counts[w] for w in STOP_WORDS if w in counts) / k,
        len(set(lines)) / len(lines),
        sum(map(str.isupper, words)) / k,
        sum(v for c, v in ends.items() if c in "#$%&*!|~^+=<>@\\/_") / k,
        float(-(share * np.log2(share)).sum()),
    ]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass
class QualityModel:
    """Scores in [0, 1]; higher: a label of 1 is likelier. base: the score of every text, where there is no fit."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # statistics x features
    phases: np.ndarray
    ridge: np.ndarray
    knots: np.ndarray  # raw scores, ascending, and the calibrated score at each
    values: np.ndarray
    base: float | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        phi = np.cos(z @ self.weights + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([phi, np.ones((len(x), 1))])

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(x), self.base)
        return np.interp(self.features(x) @ self.ridge, self.knots, self.values)

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        return self.calibrated(np.array([statistics(t) for t in texts], np.float64))


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step fit of label on raw by pooling adjacent violators: block means at block centres.

    Equal raw scores form one block from the start. Each block counts one pseudo-label of the overall mean, so
    that no score is surer than its block is large.
    """
    order = np.argsort(raw, kind="stable")
    x, first = np.unique(raw[order], return_index=True)
    weight = np.diff(np.append(first, len(raw))).astype(np.float64)
    total = np.add.reduceat(label[order].astype(np.float64), first)
    blocks: list[list[float]] = []  # weight, sum of labels, sum of weighted raw scores
    for w, t, v in zip(weight, total, x, strict=True):
        blocks.append([w, t, w * v])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    mean = label.mean()
    return b[:, 2] / b[:, 0], np.maximum.accumulate((b[:, 1] + mean) / (b[:, 0] + 1))


def _statistics_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        x = np.array([statistics(t) for t in b.column(3).to_pylist()], np.float64).reshape(-1)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x), len(STATISTICS)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists], ["doc_id", "label", "calibrates", "x"])


def fit_quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS, seed: int = 7
) -> QualityModel:
    """Fits on at most sample_rows labelled documents that are not held out (a documented, bounded sample).

    The sample's ids are broadcast (sample_rows at most), its statistics are written once, and each partition
    adds up its own normal equations. Null labels and ids are left out, repeated labels of one id count once
    (the smallest). Without both labels in the sample every text scores the one label's share, or 0.5.
    """
    usable = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    usable = usable.filter("doc_id is not null and label in (0, 1)").filter(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    rows = own.join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "label", (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1000)) < int(1000 * CALIBRATION)).alias("calibrates"), "text"
    )
    kind = "doc_id long, label int, calibrates boolean, x array<double>"
    table = written(rows.mapInArrow(lean(_statistics_rows), kind), "quality-statistics")
    sums = (
        table.select("label", F.posexplode("x").alias("i", "v"))
        .groupBy("i")
        .agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.avg("label").alias("share"))
        .orderBy("i")
        .collect()
    )
    share = sums[0]["share"] if sums else 0.5
    rng = np.random.default_rng(seed)
    d = len(STATISTICS)
    mean = np.array([r["mean"] for r in sums] or [0.0] * d)
    scale = np.array([r["sd"] or 1.0 for r in sums] or [1.0] * d)
    model = QualityModel(mean, scale, rng.normal(0, 1 / np.sqrt(d), (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    if share in (0.0, 1.0) or not sums:
        model.base = float(share)
        return model

    def normal_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 2)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(-1, d)
                y = batch.column(0).to_numpy().astype(np.float64)
                phi = model.features(x)
                a += phi.T @ phi
                b += np.append(phi.T @ y, len(y))
        if b[-1]:
            yield pa.RecordBatch.from_arrays([pa.array([np.append(a.reshape(-1), b).tobytes()], pa.binary())], ["sums"])

    # at most 8 partitions of half a megabyte each come to the driver
    parts = table.filter("not calibrates").select("label", "x").coalesce(8).mapInArrow(lean(normal_equations), "sums binary").collect()
    if not parts:
        model.base = float(share)
        return model
    total = sum(np.frombuffer(r["sums"]) for r in parts)
    a, b = total[: (FEATURES + 1) ** 2].reshape(FEATURES + 1, -1), total[(FEATURES + 1) ** 2 :]
    penalty = RIDGE * b[-1] * np.eye(FEATURES + 1)
    penalty[-1, -1] = 0
    model.ridge = np.linalg.solve(a + penalty + 1e-9 * np.eye(FEATURES + 1), b[:-1])
    rest = table.filter("calibrates").select("label", "x").toArrow()  # a part of the bounded sample
    if not rest.num_rows:
        rest = table.select("label", "x").toArrow()
    x = pc.list_flatten(rest.column("x")).to_numpy().reshape(-1, d)
    model.knots, model.values = isotonic(model.features(x) @ model.ridge, rest.column("label").to_numpy())
    return model


def score_documents(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text; no shuffle. A null text counts as empty, null ids
    are not held out, repeated rows stay, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            score = np.clip(model.score(b.column(2).to_pylist()), 0, 1)
            arrays = [b.column(0), b.column(1), pa.array(score), pa.array((score >= KEEP).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

    given = F.col(doc_id).cast("long").alias("doc_id")
    rows = docs.select(given, held_out(F.col(doc_id)).alias("held_out"), whole_text(text).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores KEEP or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            yield b.filter(pa.array(model.score([t or "" for t in texts]) >= KEEP))

    return docs.mapInArrow(lean(run), docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_documents(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
