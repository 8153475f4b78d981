"""Quality classifier from trusted positives and unlabelled text (positive-unlabelled learning).

A logistic model is fitted by minimising the non-negative unbiased risk

    prior * E_positive[loss(+)] + max(0, E_unlabelled[loss(-)] - prior * E_positive[loss(-)])

over *all* documents as unlabelled text and the trusted positives (Kiryo et al. 2017). Whole texts are
turned once into a short vector of counts; every pass of the fit reads these vectors where
they lie and returns sums of fixed size. A step that would make the bracket negative is cut back and is the last one:
there an unbiased risk begins to overfit. Negative labels are never used.

Positives that a model was fitted to score higher than their like. Two models are therefore fitted, each without the
positives of one fold, and the class prior and the calibration rest on positives that their model has not seen.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowplace.llm.common import drop_keys, per_chunk, text_of
from flowplace.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIMIT = 0.7  # score from which a document counts as good
RIDGE = 3e-2
FOLDS = 2  # models, each fitted without the positives of its fold
SETTLED = 1e-4  # a step that gains less ends a fit
PASSES = 200  # looks at the vectors per fit; a fit that needs more is an error
GROUPS = 128  # sums that reach the driver
BINS = 400  # bins of the score histograms, from -SPAN to SPAN
SPAN = 20.0
# Character classes: lower, upper, digit, space, line feed, stop, other ASCII, beyond ASCII.
CLASSES = np.full(256, 6, np.uint8)
CLASSES[0x61:0x7B], CLASSES[0x41:0x5B], CLASSES[0x30:0x3A], CLASSES[0x80:] = 0, 1, 2, 7
CLASSES[[0x20, 0x09, 0x0D]], CLASSES[0x0A], CLASSES[[*b".,;:?!"]] = 3, 4, 5
STATS = 20
WIDTH = 64 + STATS
BLOCK = 1 << 20  # bytes whose class pairs are counted at once
ENDS_ODD = re.compile(rb"[^\w.,;:?!)\"'\x80-\xff]$")


def vector(text: str) -> np.ndarray:
    """Shares of character class pairs, and figures on words, lines and repetition."""
    raw = text.encode()
    out = np.zeros(WIDTH, np.float32)
    pairs = np.zeros(64, np.int64)
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, len(data) - 1, BLOCK):
        kind = CLASSES[data[at : at + BLOCK + 1]]
        pairs += np.bincount(kind[:-1] * 8 + kind[1:], minlength=64)
    out[:64] = np.sqrt(pairs / max(1, len(data) - 1))
    words = raw.split()
    n = len(words)
    if not n:
        return out
    counts = Counter(words)
    top = counts.most_common(3)
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    packed = sum(len(zlib.compress(raw[i : i + BLOCK], 1)) for i in range(0, len(raw), BLOCK))
    odd = sum(c for w, c in counts.items() if ENDS_ODD.search(w))
    upper = sum(c for w, c in counts.items() if w.isupper())
    first_upper = sum(c for w, c in counts.items() if 65 <= w[0] <= 90)
    once = sum(1 for c in counts.values() if c == 1)
    out[64:] = [
        math.log1p(len(raw)),
        math.log1p(n),
        sizes.mean() / 10,
        sizes.std() / 10,
        len(counts) / n,
        math.log(len(counts)) / math.log(n + 1),
        top[0][1] / n,
        sum(c for _, c in top) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        math.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
        (sizes <= 2).mean(),
        (sizes >= 13).mean(),
        odd / n,
        upper / n,
        first_upper / n,
        once / len(counts),
        packed / len(raw),
        math.log1p(raw.count(b".") + raw.count(b"!") + raw.count(b"?")) - math.log1p(n / 10),
    ]
    return out


@dataclass
class Model:
    """One column of weights per fold over standardised vectors; score = 1 / (1 + exp(-(slope * z + offset))), z their mean."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((WIDTH + 1, FOLDS)))
    prior: float = 0.5
    slope: float = 1.0
    offset: float = 0.0

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x).mean(axis=1) + self.offset, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never looked at."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def vectors(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, held_out, text_key, fold, x): x as float32 bytes; fold is null but for trusted positives.

    An id with any label other than 1 is not trusted.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(f"`{text}`").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [vector(t).tobytes() for t in batch.column("text").to_pylist()]
        kept = [batch.column("doc_id"), batch.column("text_key"), pa.array(x, pa.binary())]
        return pa.RecordBatch.from_arrays(kept, ["doc_id", "text_key", "x"])

    made = rows.mapInArrow(per_chunk(work, "text"), rows.select("doc_id", "text_key", F.lit(b"").alias("x")).schema)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("label_id"), "quality")
    known = known.filter(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    fold = F.pmod(F.xxhash64(F.col("label_id").cast("string")), F.lit(FOLDS)).cast("int")
    good = known.filter("low = 1 and high = 1").select("label_id", fold.alias("fold"))
    joined = made.join(good, F.col("doc_id") == F.col("label_id"), "left")
    return materialise(joined.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text_key", "fold", "x"), "quality")


def _summed(table: DataFrame, size: int, work) -> np.ndarray:
    """Sum over all rows of ``work(x, fold)``, a vector of ``size`` doubles; fold is -1 for rows that are not trusted.

    Every task gives one vector; the vectors of a group of tasks are added in the order of the tasks, so at most GROUPS
    vectors come back and a table's sums are the same in every run.
    """
    as_bytes = pa.binary()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, WIDTH)
                fold = batch.column("fold").fill_null(-1).to_numpy(zero_copy_only=False)
                total += work(x.astype(np.float64), fold)
        task = TaskContext.get().partitionId()
        columns = [pa.array([task % GROUPS], pa.int32()), pa.array([task], pa.int32()), pa.array([total.tobytes()], as_bytes)]
        yield pa.RecordBatch.from_arrays(columns, ["group", "task", "part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for group, part in zip(batch.column("group").to_pylist(), batch.column("part").to_pylist(), strict=True):
                out[group] = out.get(group, 0) + np.frombuffer(part)
        columns = [pa.array(list(out), pa.int32()), pa.array([v.tobytes() for v in out.values()], as_bytes)]
        yield pa.RecordBatch.from_arrays(columns, ["group", "part"])

    parts = table.select("x", "fold").mapInArrow(each, "group int, task int, part binary")
    grouped = parts.repartition("group").sortWithinPartitions("group", "task").mapInArrow(added, "group int, part binary")
    return sum((np.frombuffer(r["part"]) for r in sorted(grouped.collect(), key=lambda r: r["group"])), np.zeros(size))


def standardised(table: DataFrame) -> Model:
    sums = _summed(table, 2 * WIDTH + 1, lambda x, fold: np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]]))
    n = max(1.0, sums[-1])
    mean = sums[:WIDTH] / n
    spread = np.sqrt(np.maximum(0, sums[WIDTH : 2 * WIDTH] / n - mean**2))
    return Model(mean, np.where(spread > 1e-6, spread, 1.0))


def risk_sums(v: np.ndarray, positive: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows, losses and their derivatives of one model: what the risk is made of, to be added over all rows."""
    z = v @ at
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    good, z_good = v[positive], z[positive]
    curve = (v * (p * (1 - p))[:, None]).T @ v
    loss = [len(z), np.logaddexp(0, z).sum(), len(good), np.logaddexp(0, z_good).sum(), np.logaddexp(0, -z_good).sum()]
    return np.concatenate([loss, v.T @ p, good.sum(0), curve.reshape(-1)])


class Descent:
    """Newton steps of one model; a step that raises the risk is halved, one that makes the bracket negative too and ends the fit."""

    def __init__(self, prior: float) -> None:
        self.prior = prior
        self.here = self.at = np.zeros(WIDTH + 1)  # where it stands, and the place to look at next
        self.risk = math.inf
        self.done = self.cut = False

    def look(self, out: np.ndarray) -> None:
        """Take in the sums at ``at`` and choose the next place."""
        d = WIDTH + 1
        n, u, m, minus, plus = out[:5]
        n, m = max(1.0, n), max(1.0, m)
        bracket = u / n - self.prior * minus / m
        risk = self.prior * plus / m + max(0.0, bracket) + RIDGE / 2 * self.at @ self.at
        if bracket < 0 or risk > self.risk:
            step = (self.at - self.here) / 2
            self.cut = self.cut or bracket < 0
            self.done = np.abs(step).max() < 1e-7
        else:
            slope = out[5 : 5 + d] / n - self.prior * out[5 + d : 5 + 2 * d] / m + RIDGE * self.at
            curve = out[5 + 2 * d :].reshape(d, d) / n + RIDGE * np.eye(d)
            self.done = self.cut or self.risk - risk < SETTLED
            self.here, self.risk, step = self.at, risk, -np.linalg.solve(curve, slope)
        self.at = self.here + step


def fit(table: DataFrame, model: Model) -> None:
    """All models side by side from zero weights, one pass over the vectors for a step of each."""
    size = 5 + 2 * (WIDTH + 1) + (WIDTH + 1) ** 2
    runs = [Descent(model.prior) for _ in range(FOLDS)]
    for _ in range(PASSES):
        open_runs = [(k, runs[k].at) for k in range(FOLDS) if not runs[k].done]
        if not open_runs:
            break

        def work(x: np.ndarray, fold: np.ndarray, looks: list = open_runs) -> np.ndarray:
            v = model.inputs(x)
            return np.concatenate([risk_sums(v, (fold >= 0) & (fold != k), at) for k, at in looks])

        out = _summed(table, size * len(open_runs), work).reshape(len(open_runs), size)
        for (k, _), sums in zip(open_runs, out, strict=True):
            runs[k].look(sums)
    else:
        raise RuntimeError(f"the fit did not settle in {PASSES} passes")
    model.weights = np.stack([r.here for r in runs], axis=1)


def histograms(table: DataFrame, model: Model) -> np.ndarray:
    """Counts per bin of the models' values: all rows, and positives that the model has not seen.

    Seen positives are left out of "all rows"; the unseen ones stand for them.
    """

    def work(x: np.ndarray, fold: np.ndarray) -> np.ndarray:
        at = np.clip((model.raw(x) + SPAN) / (2 * SPAN) * BINS, 0, BINS - 1).astype(np.int64)
        count = lambda k, rows: np.bincount(at[rows, k], minlength=BINS)
        return np.concatenate([sum(count(k, fold < 0) for k in range(FOLDS)), sum(count(k, fold == k) for k in range(FOLDS))]).astype(float)

    rest, good = _summed(table, 2 * BINS, work).reshape(2, BINS)
    return np.stack([rest + FOLDS * good, good])


def class_prior(counts: np.ndarray) -> float:
    """Share of good rows: the ratio of all to positive rows above the threshold where its upper bound is smallest.

    Above a high score there are only good rows, so the ratio is the share itself. Few rows above make it noisy; the bound
    adds the deviation of both shares (Garg et al. 2021), at one chance in ten.
    """
    total, good = counts
    if not good.sum():
        return 0.5
    deviation = sum(math.sqrt(math.log(4 / 0.1) / 2 / c.sum()) for c in counts)
    above_all, above_good = np.cumsum(total[::-1]) / total.sum(), np.cumsum(good[::-1]) / good.sum()
    above_all, above_good = above_all[above_good > 0], above_good[above_good > 0]
    at = ((above_all + deviation) / above_good).argmin()
    return float(np.clip(above_all[at] / above_good[at], 0.02, 0.98))


def calibrate(model: Model, counts: np.ndarray) -> None:
    """Slope and offset of least positive-unlabelled risk over the histograms; as they are without positives."""
    total, good = counts
    if not good.sum():
        return
    all_rows, good = total / total.sum(), model.prior * good / good.sum()
    v = np.stack([(np.arange(BINS) + 0.5) / BINS * 2 * SPAN - SPAN, np.ones(BINS)], axis=1)
    start = np.array([1.0, 0.0])
    risk = lambda at: all_rows @ np.logaddexp(0, v @ at) - good @ (v @ at) + 5e-4 * ((at - start) ** 2).sum()
    at, move, step = start, np.ones(2), 1.0
    while np.abs(move).max() * step > 1e-7:
        p = 1 / (1 + np.exp(-np.clip(v @ at, -30, 30)))
        curve = (v * (all_rows * p * (1 - p))[:, None]).T @ v + 1e-3 * np.eye(2)
        move, step = np.linalg.solve(curve, v.T @ (all_rows * p - good) + 1e-3 * (at - start)), 1.0
        while risk(at - step * move) > risk(at) and np.abs(move).max() * step > 1e-7:
            step /= 2
        at = at - step * move
    if at[0] > 0:
        model.slope, model.offset = float(at[0]), float(at[1])


def train(table: DataFrame) -> Model:
    """Fit at an even prior, estimate the prior, fit again with it, estimate it again and calibrate."""
    model = standardised(table)
    fit(table, model)
    model.prior = class_prior(histograms(table, model))
    fit(table, model)
    counts = histograms(table, model)
    model.prior = class_prior(counts)
    calibrate(model, counts)
    return model


def scores(table: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of the vectors with their score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, WIDTH)
            score = pa.array(model.score(x.astype(np.float64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), score], [*keep, "score"])

    return table.select(*keep, "x").mapInArrow(work, table.select(*keep, F.lit(0.0).alias("score")).schema)


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: float = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Only the text enters a score. Null and empty texts have the zero vector and a score like any other; rows
    without labels still get a score. Without a trusted positive nothing is known to be good and all scores are below a half. Repeated rows come
    back each; an empty table gives no rows; other columns of both tables are ignored.
    """
    table = vectors(docs, labels, doc_id, text)
    scored = scores(table, train(table), ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= limit).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: float = LIMIT) -> DataFrame:
    """The rows of ``docs`` that score at least ``limit``, with all columns; rules as in :func:`score_quality`.

    A score is a text's, so rejected texts are found again by their hash; the others are not shuffled.
    """
    table = vectors(docs, labels, doc_id, text)
    rejected = scores(table, train(table), ["text_key"]).filter(F.col("score") < limit).select("text_key").distinct()
    return drop_keys(docs, F.xxhash64(text_of(f"`{text}`")), materialise(rejected, "quality"), "text_key")
