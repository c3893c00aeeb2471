"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), and the pairwise sum is scored in
linear time as half of (sum v_i x_i)^2 - sum v_i^2 x_i^2. Features: distinct words in hashed
buckets (damped counts, unit length), the statistics of features.structure, steps of these
statistics, and steps of the metadata columns that the caller names (numbers).

Fitted on the driver from a bounded sample: SAMPLE labelled documents chosen by a hash of their id,
of which only features are gathered.

Edge cases: a null or empty text has no words and the statistics of an empty text; null metadata
is a bucket of its own; a document labelled twice is good only if all its labels are 1; null
labels are left out; without labels of both classes every score is the share of good ones; rows
without an id are scored, never learned from and not held out; repeated rows give repeated rows; other columns pass
through, whatever their names, but score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm.common import held_out, slices, small_batches, spare, table
from thalweg.llm.features import N_STRUCTURE, WordIds, structure

#: Buckets of words; then come the statistics, their steps and the metadata's.
BUCKETS = 1 << 15
STEPS = 8
#: Dimensions of the factors.
RANK = 8
#: Most labelled documents that are used to fit, and passes over them.
SAMPLE, EPOCHS = 12_000, 8
RATE, DECAY = 0.05, 1e-5
THRESHOLD = 0.3


def n_features(metadata: int) -> int:
    return BUCKETS + N_STRUCTURE * (1 + STEPS + 1) + metadata * 34


def features(ids: np.ndarray, text: str | None, metadata: list[float | None]) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a document, distinct indices."""
    at, n = np.unique(ids % BUCKETS, return_counts=True)
    v = np.log1p(n)
    v = v / max(np.sqrt((v * v).sum()), 1e-9)
    stats = np.array(structure(text, ids))
    base = BUCKETS
    steps = base + N_STRUCTURE + np.arange(N_STRUCTURE) * (STEPS + 1) + np.minimum(np.ceil(np.sqrt(stats) * STEPS), STEPS).astype(int)
    base += N_STRUCTURE * (STEPS + 2)
    meta = [base + 34 * k + (33 if m is None else min(32, int(np.log2(max(m, 0) + 1)))) for k, m in enumerate(metadata)]
    idx = np.concatenate([at.astype(np.int64), BUCKETS + np.arange(N_STRUCTURE), steps, np.array(meta, np.int64)])
    return idx, np.concatenate([v, stats, np.full(len(steps), 0.5), np.full(len(meta), 0.5)]).astype(np.float32)


class Machine:
    def __init__(self, n: int, seed: int = 5):
        self.w0 = 0.0
        self.w = np.zeros(n, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (n, RANK)).astype(np.float32)

    def raw(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the sigmoid of rows laid end to end, and the parts that training reuses."""
        vx = self.v[idx] * val[:, None]
        total = np.add.reduceat(vx, starts)
        square = np.add.reduceat((vx * vx).sum(1), starts)
        return self.w0 + np.add.reduceat(self.w[idx] * val, starts) + 0.5 * ((total * total).sum(1) - square), vx, total

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 5) -> None:
        """AdaGrad over shuffled batches of the logistic loss; a fixed seed, so that reruns agree."""
        rng = np.random.default_rng(seed)
        gw, gv, g0 = np.full(len(self.w), 1e-2, np.float32), np.full(self.v.shape, 1e-2, np.float32), 1e-2
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.w0 = float(np.log(share / (1 - share)))
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 64):
                some = order[at : at + 64]
                idx, val = (np.concatenate([rows[k][j] for k in some]) for j in (0, 1))
                size = np.array([len(rows[k][0]) for k in some])
                starts = np.cumsum(size) - size
                z, vx, total = self.raw(idx, val, starts)
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]).astype(np.float32)
                e = np.repeat(err, size)
                slope_v = (np.repeat(total, size, 0) - vx) * (val * e)[:, None]
                own, place = np.unique(idx, return_inverse=True)
                dw = np.bincount(place, val * e, len(own)) / len(some) + DECAY * self.w[own]
                order_ = np.argsort(place, kind="stable")
                cuts = np.searchsorted(place[order_], np.arange(len(own)))
                dv = np.add.reduceat(slope_v[order_], cuts) / len(some) + DECAY * self.v[own]
                gw[own] += dw * dw
                gv[own] += dv * dv
                self.w[own] -= RATE * dw / np.sqrt(gw[own])
                self.v[own] -= RATE * dv / np.sqrt(gv[own])
                d0 = float(err.mean())
                g0 += d0 * d0
                self.w0 -= RATE * d0 / np.sqrt(g0)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        size = np.array([len(r[0]) for r in rows])
        z, _, _ = self.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.cumsum(size) - size)
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def fit(docs: DataFrame, label: str, metadata: tuple[str, ...] = (), key: str = "doc_id", text: str = "text") -> Machine:
    """A machine from labelled documents: key, text, label (0/1) and the metadata columns."""
    small_batches(docs.sparkSession)
    n = docs.count()
    draw = F.pmod(F.xxhash64(F.lit("quality"), F.col(key)), F.lit(1 << 30))
    some = docs.filter(draw < int((1 << 30) * min(1.0, SAMPLE / max(n, 1))))
    source = some.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"), *[F.col(m).cast("double").alias(f"m{j}") for j, m in enumerate(metadata)], F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for b in slices(batches):
            texts, meta = b.column(b.num_columns - 1).to_pylist(), list(zip(*[c.to_pylist() for c in b.columns[2:-1]], strict=True)) or [()] * b.num_rows
            got = [features(ids.of(t), t, list(m)) for t, m in zip(texts, meta, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32()))], ["k", "y", "i", "v"])

    key_type = source.schema["k"].dataType.simpleString()
    got = source.mapInArrow(run, f"k {key_type}, y int, i array<int>, v array<float>").toArrow().to_pandas().sort_values("k", kind="stable")
    machine = Machine(n_features(len(metadata)))
    y = got["y"].to_numpy(float)
    if len(got) and 0 < y.mean() < 1:
        machine.fit([(i.astype(np.int64), v) for i, v in zip(got["i"], got["v"], strict=True)], y)
    else:
        machine.v[:] = 0
        machine.w0 = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    return machine


def score(docs: DataFrame, machine: Machine, metadata: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """Columns of ``docs`` but the text, plus score (0 to 1); nothing is shuffled."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text, "score")]
    source = docs.select(*rest, *[F.col(m).cast("double").alias(spare(docs, f"m{j}")) for j, m in enumerate(metadata)], F.col(text).alias(spare(docs, "text")))
    schema = docs.select(*rest).schema.add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n = WordIds(), len(rest)
        for b in slices(batches):
            texts, meta = b.column(b.num_columns - 1).to_pylist(), list(zip(*[c.to_pylist() for c in b.columns[n:-1]], strict=True)) or [()] * b.num_rows
            got = shared.value.scores([features(ids.of(t), t, list(m)) for t, m in zip(texts, meta, strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(got, pa.float64())], [*rest, "score"])

    return source.mapInArrow(run, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labelled ones whose crc32 mod 5 is not 0; n_chars is
    the metadata."""
    docs = table(spark, sf_dir, "documents")
    marks = table(spark, sf_dir, "labels").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality is not null")
    machine = fit(docs.select("doc_id", "text", "n_chars").join(marks, "doc_id"), "quality", ("n_chars",))
    got = score(docs.select("doc_id", "text", "n_chars"), machine, ("n_chars",))
    return got.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
