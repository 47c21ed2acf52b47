"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary labelled texts each give a word-bigram model with absolute
discounting; its lower order counts the distinct words a word follows, and
both classes back off to the same shared counts, those of all documents. A
text is scored by the difference of its toxic and ordinary log-likelihood per
word.

A class has counts of its own only for expressions whose share of texts
differs clearly between the classes: by a factor of ``RATIO`` and with a
log-likelihood ratio of ``EVIDENCE``. Expressions are words, pairs of words,
and beginnings of longer words, which stand for inflections and compounds too
rare to be counted one by one. All others back off to the shared counts in
both classes and make no difference, so that the chance of a small sample
doesn't add up over a text.

The models are fitted on at most ``SAMPLE`` labelled texts per class, chosen by
a hash of the id, and calibrated on those and on texts they have not seen, so
the model that the tasks get is bounded. Of labelled texts of one class that
are near copies of each other, one counts. The shared counts cover every
document.

Empty and null texts have no words and get the score of a difference of zero.
Rows with a repeated id are scored one by one. Without labels of both kinds
the share of label 1 (0 without any) is every score.
"""

from __future__ import annotations

import dataclasses
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burrow.llm.common import labels_of, raw_text, remainder, scan, small_batches
from burrow.llm.quality import isotonic
from burrow.llm.tokens import KnownWords
from burrow.session import materialise

SAMPLE = 10_000
LEAST = 3  # texts with an expression
EVIDENCE = 30.0
RATIO = 4.0
DISCOUNT = 0.75
LETTERS = range(5, 11)  # of a beginning
BEGINS = "*"
MARKS = 3
KNOWN = 200_000  # words a task remembers
STEPS = 8_000  # score classes for the calibration
RANGE = 1.0  # differences per word beyond this count as this
THRESHOLD = 0.7
HELD_OUT, OUT_OF = 1, 3

_WORDS = re.compile(r"\w+").findall


def words_of(raw: bytes) -> list[str]:
    return _WORDS(raw.decode().lower())


@dataclasses.dataclass
class Model:
    """Log-likelihood differences; bounded by the sample."""

    number: dict[str, int]  # words, and beginnings with BEGINS behind them
    word: np.ndarray  # by number; 0 stands for every other word
    pairs: np.ndarray  # word before * size + word, sorted
    pair: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    known: KnownWords | None = None

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, and how many each text has."""
        split = [words_of(raw) for raw in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        self.known = self.known or KnownWords(self._number, KNOWN)
        find = self.known.__getitem__
        return np.fromiter((find(w) for s in split for w in s), np.int64, int(sizes.sum())), sizes

    def _number(self, word: str) -> int:
        """The number of a word, or of its longest known beginning."""
        names = (word, *[f"{word[:n]}{BEGINS}" for n in reversed(LETTERS) if n < len(word)])
        return next((n for n in map(self.number.get, names) if n), 0)

    def per_word(self, texts: list[bytes]) -> np.ndarray:
        """Difference of the log-likelihoods per word of each text."""
        words, sizes = self.numbers(texts)
        owner = np.repeat(np.arange(len(texts)), sizes)
        gain = self.word[words]
        if len(words) > 1:
            inner = owner[1:] == owner[:-1]
            keys = words[:-1] * len(self.word) + words[1:]
            if len(self.pairs):
                at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
                gain[1:] = np.where(inner & (self.pairs[at] == keys), self.pair[at], gain[1:])
        return np.bincount(owner, gain, len(texts)) / np.maximum(sizes, 1)

    def score(self, difference: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(difference, self.knots, self.values), 0.0, 1.0)


def _samples(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """``raw, label, role``: the texts that fit (role 0) and calibrate (1)."""
    ids = labels_of(labels, "toxic").where(remainder("doc_id", OUT_OF) != HELD_OUT).select(
        "doc_id", "label", (F.xxhash64("doc_id") % 4 == 0).cast("int").alias("role")
    )
    chosen = None
    for label in (0, 1):
        for role in (0, 1):
            some = ids.where((F.col("label") == label) & (F.col("role") == role))
            some = some.orderBy(F.xxhash64(F.lit(1), "doc_id")).limit(bound)
            chosen = some if chosen is None else chosen.unionByName(some)
    # At most 4 * bound ids of eight bytes.
    found = small_batches(docs).select("doc_id", raw_text().alias("raw")).join(F.broadcast(chosen), "doc_id")

    def marked(batches):
        for batch in batches:
            marks = [_marks(raw) for raw in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array([m[k] for m in marks], pa.int64()) for k in range(MARKS)]],
                names=["raw", "label", "role", *names],
            )

    names = [f"_mark{k}" for k in range(MARKS)]
    fields = ", ".join(f"{n} bigint" for n in names)
    some = found.select("raw", "label", "role").mapInArrow(marked, f"raw binary, label int, role int, {fields}")
    for name in names:
        some = some.dropDuplicates(["label", "role", name])
    return materialise(some.drop(*names), "labelled")


def _marks(raw: bytes) -> list[int]:
    """Min-hashes of a text's five-word shingles; near copies share most."""
    words = np.array([zlib.crc32(w) for w in raw.split()], np.uint64)
    if not len(words):
        return [0] * MARKS
    runs = words[: max(1, len(words) - 4)].copy()
    for k in range(1, 5):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + (words[k : len(runs) + k] if len(words) > 4 else np.uint64(0))
    marks = []
    for k in range(MARKS):
        mixed = (runs ^ (runs >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k * 0x1000003D)
        marks.append(int((mixed ^ (mixed >> np.uint64(29))).min() >> np.uint64(1)))
    return marks


def _counted(frame: DataFrame, schema: str, count) -> DataFrame:
    """Sums of ``count(texts, labels)``, which gives keys and two counts, over
    all batches of ``raw, label``."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                keys, toxic, other = count(part.column("raw").to_pylist(), np.array(part.column("label").to_pylist()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(toxic), pa.array(other)], names=["key", "toxic", "other"])

    return (
        frame.select("raw", "label").mapInArrow(run, f"key {schema}, toxic bigint, other bigint")
        .groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    )


def _by_key(keys: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    distinct, place = np.unique(keys, return_inverse=True)
    return (
        distinct,
        np.bincount(place, toxic, len(distinct)).astype(np.int64),
        np.bincount(place, 1 - toxic, len(distinct)).astype(np.int64),
    )


def _word_counts(texts, labels):
    """Texts with each word and each beginning of a longer word."""
    counts: dict[str, list[int]] = {}
    for raw, label in zip(texts, labels, strict=True):
        words = set(words_of(raw))
        for word in words | {f"{w[:n]}{BEGINS}" for w in words for n in LETTERS if n < len(w)}:
            counts.setdefault(word, [0, 0])[1 - label] += 1
    pairs = np.array(list(counts.values()), np.int64).reshape(-1, 2)
    return pa.array(counts, pa.string()), pairs[:, 0], pairs[:, 1]


def _telling(toxic: int, other: int):
    """Whether an expression's share of ``toxic`` and ``other`` texts differs
    clearly; expects its numbers of texts in the columns toxic and other."""
    t, o = F.col("toxic"), F.col("other")
    everywhere = (t + o) / (toxic + other)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    evidence = 2 * (
        part(t, toxic * everywhere)
        + part(o, other * everywhere)
        + part(toxic - t, toxic * (1 - everywhere))
        + part(other - o, other * (1 - everywhere))
    )
    a, b = (t + 0.5) / toxic, (o + 0.5) / other
    return (t + o >= LEAST) & (evidence >= EVIDENCE) & (F.greatest(a / b, b / a) >= RATIO)


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    samples = _samples(docs, labels, bound)
    shares = samples.agg(F.avg("label").alias("rate")).first()
    nothing = np.zeros(1)
    model = Model({}, nothing, np.zeros(0, np.int64), np.zeros(0), nothing, np.array([shares["rate"] or 0.0]))
    fitting = samples.where("role = 0")
    texts = {r["label"]: r["count"] for r in fitting.groupBy("label").count().collect()}
    if len(texts) < 2:
        return model
    telling = _telling(texts[1], texts[0])

    # The words of the sample; rarer ones are never telling.
    counted = materialise(
        _counted(fitting, "string", _word_counts).where(F.col("toxic") + F.col("other") >= LEAST).withColumn(
            "telling", telling
        ),
        "words",
    )
    whole = ~F.col("key").endswith(BEGINS)
    words = counted.where(whole).select("key", "telling").orderBy("key").toArrow()
    begins = counted.where(~whole & F.col("telling")).orderBy("key").toArrow()
    known, own_word = words.column("key").to_pylist(), words.column("telling").to_numpy(zero_copy_only=False)
    size = len(known) + 1
    every = dataclasses.replace(model, number={w: k + 1 for k, w in enumerate(known)})

    def pair_counts(texts, labels):
        """Texts with each pair of known words."""
        numbers, sizes = every.numbers(texts)
        owner = np.repeat(np.arange(len(texts)), sizes)
        inner = owner[1:] == owner[:-1]
        before, after, owner = numbers[:-1][inner], numbers[1:][inner], owner[1:][inner]
        once = np.unique(owner * size**2 + before * size + after)
        distinct, toxic, other = _by_key(once % size**2, labels[once // size**2])
        return pa.array(distinct), toxic, other

    pairs = materialise(
        _counted(fitting, "bigint", pair_counts).withColumns(
            {"before": F.expr(f"key div {size}"), "after": F.col("key") % size}
        ),
        "pairs",
    )
    own = pairs.where(telling & (F.col("before") > 0) & (F.col("after") > 0)).orderBy("key").toArrow()
    before, after = own.column("before").to_numpy(), own.column("after").to_numpy()
    sides = {}
    for side in ("before", "after"):
        got = pairs.groupBy(side).agg(
            *[F.sum(c).alias(f"{c}_n") for c in ("toxic", "other")],
            *[F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in ("toxic", "other")],
        ).toArrow()  # a row per word of the sample
        for c in got.column_names[1:]:
            sides[side, c] = filled = np.zeros(size)
            filled[got.column(side).to_numpy()] = got.column(c).to_numpy()

    # What is left of the vocabulary: telling words and those of telling pairs.
    kept = np.unique(np.concatenate([np.flatnonzero(own_word) + 1, before, after]))
    names = [*[known[k - 1] for k in kept], *begins.column("key").to_pylist()]
    model.number = {name: n + 1 for n, name in enumerate(names)}
    shared = _shared_counts(docs, model)
    shared = (shared + 0.5) / (shared + 0.5).sum()

    lower, weight = {}, {}
    for c in ("toxic", "other"):
        kinds = sides["after", f"{c}_kinds"]
        total = max(1.0, kinds.sum())
        spare = np.minimum(kinds, DISCOUNT).sum() / total
        # Of a beginning, the texts that have it are counted.
        own_kinds = np.concatenate([kinds[kept], begins.column(c).to_numpy()])
        lower[c] = np.maximum(own_kinds - DISCOUNT, 0) / total + (spare or 1.0) * shared[1:]
        n = sides["before", f"{c}_n"]
        weight[c] = np.where(n > 0, DISCOUNT * sides["before", f"{c}_kinds"] / np.maximum(n, 1), 1.0)
    telling_word = np.append(np.append(False, own_word)[kept], np.ones(len(begins), bool))
    model.word = np.append(0.0, np.where(telling_word, np.log(lower["toxic"]) - np.log(lower["other"]), 0.0))
    place = np.zeros(size, np.int64)
    place[kept] = np.arange(len(kept))
    higher = {}
    for c in ("toxic", "other"):
        seen = np.maximum(own.column(c).to_numpy() - DISCOUNT, 0) / np.maximum(sides["before", f"{c}_n"][before], 1)
        higher[c] = np.log(seen + weight[c][before] * lower[c][place[after]])
    keys = (place[before] + 1) * len(model.word) + place[after] + 1
    order = np.argsort(keys)
    model.pairs, model.pair = keys[order], (higher["toxic"] - higher["other"])[order]

    def stepped(batches):
        for batch in batches:
            difference = model.per_word(batch.column("raw").to_pylist())
            step = np.clip(np.floor((difference / RANGE + 1) / 2 * STEPS), 0, STEPS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(step.astype(np.int32)), batch.column("label").cast(pa.int32())], names=["step", "label"]
            )

    classes = (
        samples
        .select("raw", "label").mapInArrow(stepped, "step int, label int")
        .groupBy("step").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).orderBy("step").toArrow()
    )  # at most STEPS + 1 rows
    steps = ((classes.column("step").to_numpy() + 0.5) * 2 / STEPS - 1) * RANGE
    good, n = classes.column("good").to_numpy(), classes.column("n").to_numpy()
    middles, values = isotonic(steps, good, n)
    # Flat within a pooled block. Between two, the score rises over the first
    # quarter: what lies there has more telling expressions than the lower one.
    block = np.searchsorted((middles[1:] + middles[:-1]) / 2, steps)
    rises = np.flatnonzero(block[1:] != block[:-1])
    model.knots = np.insert(steps, rises + 1, steps[rises] + (steps[rises + 1] - steps[rises]) / 4)
    model.values = np.insert(values[block], rises + 1, values[block][rises + 1])
    return model


def _shared_counts(docs: DataFrame, model: Model) -> np.ndarray:
    """How often all documents have each expression of the model, and any other word."""

    def prepare():
        kind = pa.list_(pa.struct([("w", pa.int32()), ("n", pa.int64())]))

        def compute(texts):
            numbers, _ = model.numbers(texts)
            seen = np.bincount(numbers, minlength=len(model.number) + 1)
            rows = [[{"w": int(w), "n": int(seen[w])} for w in np.flatnonzero(seen)]]
            return [pa.array(rows + [None] * (len(texts) - 1), kind)]

        return compute

    made = T.ArrayType(T.StructType([T.StructField("w", T.IntegerType()), T.StructField("n", T.LongType())]))
    counts = scan(docs, [], [T.StructField("c", made)], prepare).select(F.inline("c"))
    sums = counts.groupBy("w").agg(F.sum("n").alias("n")).toArrow()  # a row per word of the model
    shared = np.zeros(len(model.number) + 1)
    shared[sums.column("w").to_numpy()] = sums.column("n").to_numpy()
    return shared


def scored(docs: DataFrame, model: Model, keep: list[str], below: float | None = None) -> DataFrame:
    """``keep`` and the ``score`` of every document. With ``below`` only the
    columns ``keep`` of those scored lower."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [] if below is not None else [T.StructField("score", T.DoubleType())]

    def prepare():
        fitted = shared.value

        def compute(texts):
            score = fitted.score(fitted.per_word(texts))
            return ([], pa.array(score < below)) if below is not None else [pa.array(score)]

        return compute

    return scan(docs, keep, fields, prepare)


def judged(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; what is held
    out is never learnt from."""
    return scored(docs, fit(docs, labels, bound), ["doc_id"]).select(
        "doc_id",
        (remainder("doc_id", OUT_OF) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
