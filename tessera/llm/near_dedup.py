"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, banded, verified."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bucketed, documents, lean, slices, whole_text, written
from tessera.llm.components import components
from tessera.llm.shingles import mix, shingles

THRESHOLD = 0.8
#: Samples of a text are BANDS groups of ROWS. Texts at the threshold share a group with probability
#: 1 - (1 - 0.8**4)**16 > 0.9997, nearer ones with more.
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: A pair is verified if at least this share of its samples agrees: at the threshold, with 64 samples, less than one
#: in a hundred million pairs has fewer, far fewer than the bands miss.
AGREE = 30 / SAMPLES
#: Document frequencies are counted in FREQUENCY_ROWS tables of so many buckets of shingle hashes.
FREQUENCY_ROWS, FREQUENCY_BITS = 2, 17
#: Weights are powers of 2**(1 / LEVELS); the least inverse document frequency is 2**LEAST.
LEVELS, LEAST = 16, -8
#: Rows that share one of so many plain min-hashes count for document frequencies as one together.
SKETCH = 4
#: The weight of a row that shares none: weights are whole numbers, so that sums of them don't depend on their order.
ONE = 1 << 20
#: Variates are tabulated for so many hash values of a shingle.
_SLOT_BITS = 15
#: Members of a bucket are compared in blocks of so many.
BLOCK = 512


# --- document frequencies --------------------------------------------------------------------------------------


def sketches(texts: list[str]) -> np.ndarray:
    """texts x SKETCH min-hashes of the distinct shingles."""
    value, _, start = shingles(texts)
    salts = mix(np.arange(1, SKETCH + 1, dtype=np.uint64))
    return np.stack([np.minimum.reduceat(mix(value ^ s), start[:-1]) for s in salts], 1).view(np.int64)


def _buckets(value: np.ndarray) -> np.ndarray:
    """FREQUENCY_ROWS x shingles: each one's bucket in the tables, which lie one after another."""
    bits = np.uint64(FREQUENCY_BITS)
    rows = [(value >> np.uint64(64 - FREQUENCY_BITS * (k + 1))) & ((np.uint64(1) << bits) - np.uint64(1)) | np.uint64(k) << bits for k in range(FREQUENCY_ROWS)]
    return np.stack(rows).astype(np.int64)


def frequency_buckets(texts: list[str], weights: np.ndarray | None = None) -> np.ndarray:
    """How many (text, distinct shingle) fall into each bucket, or the sum of these texts' whole weights."""
    value, _, start = shingles(texts)
    each = None if weights is None else np.tile(np.repeat(weights, np.diff(start)), FREQUENCY_ROWS)
    return np.bincount(_buckets(value).reshape(-1), each, FREQUENCY_ROWS << FREQUENCY_BITS).astype(np.int64)  # exact: below 2**53


def frequencies(counts: np.ndarray) -> np.ndarray:
    """What each bucket says of its shingle's document frequency: what it holds beyond the row's median and two
    spreads, which are other shingles' chance."""
    rows = counts.reshape(FREQUENCY_ROWS, -1).astype(np.float64)
    median = np.median(rows, 1, keepdims=True)  # a few frequent shingles would raise the mean
    spread = 1.4826 * np.median(np.abs(rows - median), 1, keepdims=True)
    return np.maximum(1, rows - median - 2 * spread).reshape(-1)


class Idf:
    """Levels of log(n / df) / log(n): 0 for what is in one of n texts, LEAST * LEVELS at least."""

    def __init__(self, counts: np.ndarray, texts: float):
        n = max(2, texts)
        rarity = 1 - np.log(np.minimum(frequencies(counts), n)) / np.log(n)
        self.levels = np.round(np.log2(np.maximum(rarity, 2.0**LEAST)) * LEVELS).astype(np.int16)

    def __call__(self, value: np.ndarray) -> np.ndarray:
        return self.levels[_buckets(value)].max(0)  # the lesser frequency of the tables


def document_frequencies(texts: DataFrame) -> Idf:
    """Idf over all texts (text, weight in ONE-ths). A task sends the buckets it met, combined per bucket; the driver gets
    one row per bucket, FREQUENCY_ROWS * 2**FREQUENCY_BITS at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FREQUENCY_ROWS << FREQUENCY_BITS, np.int64), 0
        for b in slices(batches):
            weights = b.column(1).to_numpy()
            total += frequency_buckets(b.column(0).to_pylist(), weights)
            n += int(weights.sum())
        met = np.flatnonzero(total)
        bucket, count = np.append(met, -1), np.append(total[met], n)
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(count)], ["bucket", "n"])

    sums = texts.select("text", "weight").mapInArrow(lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = sums.column("bucket").to_numpy(), sums.column("n").to_numpy()
    counts = np.zeros(FREQUENCY_ROWS << FREQUENCY_BITS, np.int64)
    counts[bucket[bucket >= 0]] = n[bucket >= 0]
    return Idf(counts / ONE, n[bucket < 0].sum() / ONE)


def weighted(texts: list[str], idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, the level of each one's weight (term frequency times idf, log scale), and where texts start."""
    value, times, start = shingles(texts)
    return value, np.round(np.log2(times) * LEVELS).astype(np.int16) + idf(value), start


# --- improved consistent weighted sampling ---------------------------------------------------------------------


@lru_cache(maxsize=1)
def _variates() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    n = 1 << _SLOT_BITS
    odd = rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return rng.gamma(2, 1, n), np.log(rng.gamma(2, 1, n)), rng.uniform(0, 1, n), odd


@lru_cache(maxsize=256)
def _draws(level: int) -> np.ndarray:
    """For each slot the sampling key of a shingle of this weight: ln a (sortable, 32 bits) above a hash of t."""
    r, log_c, beta, _ = _variates()
    t = np.floor(level / LEVELS * np.log(2) / r + beta)
    log_a = (log_c - r * (t - beta + 1)).astype(np.float32).view(np.uint32).astype(np.uint64)
    sortable = np.where(log_a >> np.uint64(31), ~log_a & np.uint64(0xFFFFFFFF), log_a | np.uint64(1 << 31))
    return sortable << np.uint64(32) | mix(t.astype(np.int64).view(np.uint64)) >> np.uint64(32)


def signatures(texts: list[str], idf: Idf) -> np.ndarray:
    """texts x SAMPLES of uint32: sample k names the shingle and step t whose ln a is smallest. Two texts agree
    in a sample with the probability of their weighted Jaccard similarity."""
    value, level, start = weighted(texts, idf)
    out = np.empty((len(texts), SAMPLES), np.uint32)
    known, which = np.unique(level, return_inverse=True)
    tables = np.concatenate([_draws(int(x)) for x in known])
    base = which.astype(np.int64) << _SLOT_BITS
    low = mix(value) & np.uint64(0xFFFFFFFF)
    plain = len(known) == 1
    for k, odd in enumerate(_variates()[3]):
        slot = ((value * odd) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        key = (tables[slot] if plain else tables[base + slot]) ^ low
        out[:, k] = np.minimum.reduceat(key, start[:-1]).astype(np.uint32)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (ascending shingles, weights)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - np.minimum(a[1][i], b[1][j]).sum())) if len(common) else 0.0


# --- tables ----------------------------------------------------------------------------------------------------


def _sketched(rows: DataFrame) -> DataFrame:
    """h, doc_id and the sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = sketches(b.column(2).to_pylist())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * SKETCH, pa.int32()), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat], ["h", "doc_id", "sketch"])

    return rows.select("h", "doc_id", "text").mapInArrow(lean(run), "h binary, doc_id long, sketch array<long>")


def _shares(sketched: DataFrame) -> DataFrame:
    """h and `share`, the rows of the largest group that one of the text's min-hashes has, for texts that share any (the
    salts keep the min-hashes of different numbers apart)."""
    each = sketched.select("h", F.explode("sketch").alias("value"))
    groups = each.groupBy("value").agg(F.count("*").alias("share")).filter("share > 1")
    return each.join(groups, "value").groupBy("h").agg(F.max("share").alias("share"))


def _signed(texts: DataFrame, idf: Idf) -> DataFrame:
    """h, first_id, n and signature of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sig = pa.array([x.tobytes() for x in signatures(b.column(3).to_pylist(), idf)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], sig], ["h", "first_id", "n", "sig"])

    return texts.select("h", "first_id", "n", "text").mapInArrow(lean(run), "h binary, first_id long, n long, sig binary")


def _likely(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree in AGREE of their samples."""
    sigs = texts.select("h", "sig")
    rows = pairs.join(sigs.withColumnsRenamed({"h": "a", "sig": "x"}), "a").join(sigs.withColumnsRenamed({"h": "b", "sig": "y"}), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(-1, SAMPLES) for c in (b.column(2), b.column(3)))
            yield b.select([0, 1]).filter(pa.array((x == y).mean(1) >= AGREE))

    return rows.mapInArrow(lean(run), "a binary, b binary")


def _vectors(texts: DataFrame, needed: DataFrame, idf: Idf) -> DataFrame:
    """h, shingles and weight levels of the texts (h, text) in needed (h)."""
    found = texts.select("h", "text").join(needed, "h", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            value, level, start = weighted(b.column(1).to_pylist(), idf)
            spans = list(zip(start[:-1].tolist(), start[1:].tolist(), strict=True))
            arrays = [b.column(0), pa.array([value[x:y].tobytes() for x, y in spans], pa.binary()), pa.array([level[x:y].tobytes() for x, y in spans], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["h", "value", "level"])

    return found.mapInArrow(lean(run), "h binary, value binary, level binary")


def _verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches the threshold."""
    left = vectors.withColumnsRenamed({"h": "a", "value": "av", "level": "al"})
    right = vectors.withColumnsRenamed({"h": "b", "value": "bv", "level": "bl"})
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "av", "al", "bv", "bl")

    def vector(value: pa.Scalar, level: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(value.as_py(), np.uint64), np.exp2(np.frombuffer(level.as_py(), np.int16) / LEVELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims = [similarity(vector(av, al), vector(bv, bl)) for av, al, bv, bl in zip(*(b.column(i) for i in range(2, 6)), strict=True)]
            yield b.select([0, 1]).filter(pa.array(np.array(sims) >= threshold - 1e-9, pa.bool_()))

    return rows.mapInArrow(lean(run), "a binary, b binary")


def _open_links(members: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between members of one bucket that are not yet in one class, enough of them to join all classes
    that any similar pair of the bucket joins.

    members: band, bucket, size, h, root, sig, value, level. Buckets are cut into blocks of BLOCK members and each
    pair of blocks is compared on its own, wherever the shuffle puts it; vectors travel with members, never with
    pairs. A pair is looked at in the first band that it shares only.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("h"), blocks).cast("int")
    rows = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "h", "root", "sig", "value", "level")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def compare(group: pa.Table) -> list[tuple[bytes, bytes]]:
        own_, roots = group.column("own").to_numpy(), group.column("root").to_pylist()
        number = {r: n for n, r in enumerate(dict.fromkeys(roots))}
        if len(number) < 2:
            return []
        comp = np.array([number[r] for r in roots])
        i, j, band = (group.column(c)[0].as_py() for c in ("i", "j", "band"))
        left, right = np.flatnonzero(own_ == i), np.flatnonzero(own_ == j)
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(-1, SAMPLES)
        agree, seen = _agreement(sig[left], sig[right], band)
        wanted = (agree >= AGREE * SAMPLES) & ~seen & (comp[left][:, None] != comp[right])
        if i == j:
            wanted = np.triu(wanted, 1)
        x, y = np.nonzero(wanted)
        if not len(x):
            return []
        order = np.argsort(-agree[x, y], kind="stable")
        h, value, level = (group.column(c).to_pylist() for c in ("h", "value", "level"))
        vectors: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def vector(k: int) -> tuple[np.ndarray, np.ndarray]:
            if k not in vectors:
                vectors[k] = np.frombuffer(value[k], np.uint64), np.exp2(np.frombuffer(level[k], np.int16) / LEVELS)
            return vectors[k]

        parent = list(range(len(number)))

        def find(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        out = []
        for p, q in zip(left[x[order]].tolist(), right[y[order]].tolist(), strict=True):
            u, v = find(comp[p]), find(comp[q])
            if u != v and similarity(vector(p), vector(q)) >= threshold - 1e-9:
                parent[u] = v
                out.append((h[p], h[q]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            key = [b.column(k).to_numpy() for k in range(3)]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            found: list[tuple[bytes, bytes]] = []
            for start, stop in zip([0, *change.tolist()], [*change.tolist(), b.num_rows], strict=True):
                if start == stop:
                    continue
                now = tuple(int(k[start]) for k in key)
                if held and now != last:
                    found += compare(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(start, stop - start))
                last = now
            yield _pairs(found)
        if held:
            yield _pairs(compare(pa.Table.from_batches(held)))

    return rows.mapInArrow(lean(run), "a binary, b binary").distinct()


def _pairs(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])


def _agreement(left: np.ndarray, right: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of signatures in how many samples they agree, and whether they share a band before this one."""
    if left.shape[0] * right.shape[0] <= 4096:
        same = left[:, None] == right
        bands = same.reshape(len(left), len(right), BANDS, ROWS)[:, :, :band].all(3).any(2)
        return same.sum(2), bands
    agree, seen = np.zeros((len(left), len(right)), np.uint8), np.zeros((len(left), len(right)), bool)
    for b in range(BANDS):
        count = np.zeros(agree.shape, np.uint8)
        for k in range(b * ROWS, (b + 1) * ROWS):
            count += left[:, k][:, None] == right[:, k]
        agree += count
        if b < band:
            seen |= count == ROWS
    return agree.astype(np.int64), seen


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, class_id (the smallest doc_id of its class), class_size (rows), kept.

    A class is a connected component of texts whose weighted Jaccard similarity is at least `threshold`; equal
    texts are one node. Of each class one row stays: `kept` marks class_id's (of repeated rows, each).

    1. One row of each text, copies left behind. Document frequencies of all texts' shingles (a fixed number of buckets),
       in which the rows of a group of near copies weigh as one together: a group of them must not devalue its own text. Then a signature per text.
    2. Buckets of equal bands. A bucket's members are first compared with its smallest member only.
    3. Buckets that still hold several classes are compared in blocks: signatures all with all, vectors of pairs
       that agree enough and are not yet linked. Pairs are never written or shuffled, and pairs within one class
       not even looked at, so a large group of copies costs about its size.

    Null texts count as empty; empty texts are equal. A null id is in its text's class, which it names only if
    no row has an id. Long texts are used whole; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text")).withColumn("h", F.unhex(F.md5("text")))
    sketched = written(_sketched(rows), "near-sketches")
    shares = written(_shares(sketched), "near-shares")
    whole = rows.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.first("text").alias("text"))
    weight = F.greatest(F.lit(1), F.round(F.col("n") * ONE / F.coalesce("share", F.lit(1)))).cast("long")
    with bucketed(whole.join(shares, "h", "left").withColumn("weight", weight).drop("share"), "near-wholes", "h") as whole:
        idf = document_frequencies(whole)
        texts = written(_signed(whole, idf), "near-texts")

        keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("sig", k * 4 * ROWS + 1, F.lit(4 * ROWS))))
        banded = texts.select("h", F.posexplode(keys).alias("band", "bucket"))
        buckets = banded.groupBy("bucket").agg(F.min("h").alias("leader"), F.count("*").alias("size")).filter("size > 1")
        members = written(banded.join(buckets, "bucket"), "near-members")
        stars = members.filter("h <> leader").select(F.col("leader").alias("a"), F.col("h").alias("b")).distinct()
        pairs = written(_likely(stars, texts), "near-pairs")

        # every text that may be compared later on: members of buckets of three or more, and the pairs so far
        some = members.filter("size > 2").select("h").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("h"))).distinct()
        vectors = written(_vectors(whole, written(some, "near-needed"), idf), "near-vectors")
    links = written(_verified(pairs, vectors, threshold), "near-links")
    classes = written(components(links), "near-classes")
    rooted = members.filter("size > 2").join(classes.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
    open_ = rooted.join(mixed, "bucket").join(texts.select("h", "sig"), "h").join(vectors, "h")
    found = _open_links(open_.select("band", "bucket", "size", "h", "root", "sig", "value", "level"), threshold)
    classes = written(components(links.unionByName(written(found, "near-links"))), "near-classes")

    of_text = texts.select("h", "first_id", "n").join(classes.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    named = of_text.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size"))
    labels = of_text.select("h", "root").join(named, "root").select("h", "class_id", "class_size")
    out = sketched.select("h", "doc_id").join(labels, "h")
    return out.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
