"""Quality classifier on document statistics.

Random Fourier features approximate a Gaussian kernel over the standardised
statistics of a text. A ridge score is fitted to them: every task sums its
share of the normal equations, Spark adds the sums, and the driver solves one
small system. Isotonic calibration then turns the score into a probability,
on labelled rows that the ridge has not seen.

Empty and null texts have statistics of zero and a score like others. Rows
with a repeated id are scored one by one and learnt from one by one. Without
labels of both kinds the share of label 1 (0.5 without any) is every score.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burrow.llm.common import labels_of, remainder, scan
from burrow.session import materialise

FEATURES = 192
BANDWIDTH = 0.15  # of the kernel exp(-BANDWIDTH^2 |x - y|^2 / 2)
RIDGE = 1e-3  # times the number of rows
STEPS = 2_000  # score classes for the calibration
SEED = 7
THRESHOLD = 0.3
HELD_OUT = 5

STATISTICS = (
    "log_chars",
    "log_words",
    "word_length",
    "long_words",
    "one_letter_words",
    "distinct_words",
    "repeats_previous",
    "top_word",
    "upper_words",
    "capital_words",
    "stopped_words",
    "upper_bytes",
    "digit_bytes",
    "mark_bytes",
    "bang_bytes",
    "bar_bytes",
    "high_bytes",
    "space_bytes",
    "distinct_lines",
    "line_words",
    "byte_entropy",
)
_CLASS = np.zeros((7, 256))
for _row, _bytes in enumerate(
    (range(65, 91), range(48, 58), b"#*$%&<>{}[]\\^~_=+@", b"!?", b"|", range(128, 256), b" \t\n\x0b\x0c\r")
):
    _CLASS[_row, list(_bytes)] = 1.0


def statistics(raw: bytes) -> list[float]:
    """The statistics of one text."""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts[counts > 0] / len(raw)
    lengths = np.fromiter(map(len, words), np.int32, n)
    hashes = np.fromiter(map(hash, words), np.int64, n)
    _, times = np.unique(hashes, return_counts=True)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return [
        float(np.log1p(len(raw))),
        float(np.log1p(n)),
        float(lengths.mean()),
        float((lengths > 15).mean()),
        float((lengths == 1).mean()),
        len(times) / n,
        float((hashes[1:] == hashes[:-1]).sum()) / n,
        float(times.max()) / n,
        sum(map(bytes.isupper, words)) / n,
        sum(map(bytes.istitle, words)) / n,
        sum(w[-1] in b".,;:" for w in words) / n,
        *(_CLASS @ counts / len(raw)).tolist(),
        len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        float(-(share * np.log2(share)).sum()),
    ]


def measured(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    def prepare():
        return lambda texts: [pa.array([statistics(raw) for raw in texts], pa.list_(pa.float64()))]

    return scan(docs, list(keep), [T.StructField("stats", T.ArrayType(T.DoubleType()))], prepare)


@dataclasses.dataclass
class Model:
    """Bounded by FEATURES and STEPS, whatever the number of rows."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def projected(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        omega = rng.normal(0.0, BANDWIDTH, (len(STATISTICS), FEATURES))
        phase = rng.uniform(0.0, 2 * np.pi, FEATURES)
        scaled = np.clip((stats - self.mean) / self.spread, -20, 20)
        return np.hstack([np.cos(scaled @ omega + phase) * np.sqrt(2 / FEATURES), np.ones((len(stats), 1))])

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.projected(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.ridge(stats), self.knots, self.values), 0.0, 1.0)


def stats_matrix(batch: pa.RecordBatch, column: str = "stats") -> np.ndarray:
    return np.array(batch.column(column).to_pylist(), float).reshape(batch.num_rows, len(STATISTICS))


def isotonic(x: np.ndarray, positives: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over score classes sorted by ``x``."""
    blocks: list[list[float]] = []
    for at, good, all_rows in zip(x, positives, totals, strict=True):
        blocks.append([at * all_rows, good, all_rows])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(labelled: DataFrame) -> Model:
    """Fit on rows (stats, label, _fold): fold 0 calibrates, the others give
    the ridge score. Only sums come to the driver."""
    size = len(STATISTICS)
    row = labelled.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.avg("label"), F.lit(0.5)).alias("rate"),
        *[F.avg(F.col("stats")[k]).alias(f"m{k}") for k in range(size)],
        *[F.stddev_pop(F.col("stats")[k]).alias(f"s{k}") for k in range(size)],
    ).first()
    mean = np.array([row[f"m{k}"] or 0.0 for k in range(size)])
    spread = np.array([row[f"s{k}"] or 0.0 for k in range(size)])
    spread[spread < 1e-9] = 1.0
    model = Model(mean, spread, np.zeros(FEATURES + 1), np.array([0.0]), np.array([row["rate"]]))
    if not 0 < row["rate"] < 1:
        return model

    def summed(batches):
        gram, right, rows = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
        for batch in batches:
            z = model.projected(stats_matrix(batch))
            gram += z.T @ z
            right += z.T @ batch.column("label").to_numpy(zero_copy_only=False)
            rows += batch.num_rows
        if rows:
            whole = np.hstack([gram, right[:, None]]).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(whole)), pa.int32()), pa.array(whole)], names=["cell", "value"]
            )

    width = FEATURES + 2
    cells = np.zeros((FEATURES + 1) * width)
    sums = (
        labelled.where("_fold <> 0").select("stats", "label").mapInArrow(summed, "cell int, value double")
        .groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    )  # (FEATURES + 1) x (FEATURES + 2) cells
    cells[sums["cell"].to_numpy()] = sums["value"].to_numpy()
    cells = cells.reshape(FEATURES + 1, width)
    gram, right = cells[:, :-1], cells[:, -1]
    penalty = RIDGE * max(1.0, gram[-1, -1]) * np.eye(FEATURES + 1) / FEATURES
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(gram + penalty, right)

    def scored(batches):
        for batch in batches:
            step = np.floor((model.ridge(stats_matrix(batch)) + 1) / 3 * STEPS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.clip(step, 0, STEPS).astype(np.int32)), batch.column("label")], names=["step", "label"]
            )

    held = labelled.where("_fold = 0").select("stats", F.col("label").cast("int").alias("label"))
    classes = (
        held.mapInArrow(scored, "step int, label int")
        .groupBy("step").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).orderBy("step").toPandas()
    )  # at most STEPS + 1 rows
    if len(classes):
        model.knots, model.values = isotonic(
            (classes["step"].to_numpy() + 0.5) * 3 / STEPS - 1, classes["good"].to_numpy(), classes["n"].to_numpy()
        )
    return model


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; what is
    held out is never learnt from."""
    fold = remainder("doc_id", HELD_OUT)
    stats = materialise(measured(docs), "statistics").withColumn("_fold", fold)
    train = stats.where("_fold <> 0").join(labels_of(labels, "quality"), "doc_id")
    model = fit(materialise(train.select("stats", "label", (F.col("_fold") - 1).alias("_fold")), "labelled"))

    def scored(batches):
        for batch in batches:
            score = pa.array(model.score(stats_matrix(batch)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), score], names=["doc_id", "_fold", "score"])

    schema = T.StructType([stats.schema["doc_id"], stats.schema["_fold"], T.StructField("score", T.DoubleType())])
    return stats.select("doc_id", "_fold", "stats").mapInArrow(scored, schema).select(
        "doc_id",
        (F.col("_fold") == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
