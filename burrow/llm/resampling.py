"""Importance resampling of documents towards a target distribution.

A document's features are its runs of one to three words, hashed into
``BUCKETS`` buckets. The gain of a bucket is the log ratio of its smoothed share
in the target texts to that in all documents; a document's weight is the sum of
its features' gains, and documents are drawn without replacement by the Gumbel
trick: weight plus a draw that depends on the seed and the id alone, the highest
first.

The work on texts is done by Arrow kernels on whole batches: ``ascii_lower``,
``split_pattern_regex``, ``list_flatten`` and ``dictionary_encode`` turn the
texts into one array of word numbers; shifted against itself it gives the pairs
and triples, whose numbers are dictionary-encoded again, so that the CRC is
computed once for every distinct pair and triple of a batch, continuing the CRC
of what stands before; ``take`` deals the gains back to all places, and a
segment sum over the documents' bounds gives the weights. Spark adds the bucket
counts of the tasks, ``BUCKETS`` rows each at most, and ranks by a range
partition; only the gains and the number of documents that may be drawn reach
the driver.

Null and empty texts have no words: no features, weight 0, never drawn.
Repeated rows are documents of their own; those of one id have the same draw,
and equal ones are ranked in any order. A null id is drawn as ''. An empty
table of documents gives no rows, an empty target the gains of smoothing alone.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burrow.llm.common import SLICE
from burrow.operators.chunks import with_ordinal
from burrow.session import materialise

BUCKETS = 10_000
LEAST_WORDS = 20
PER_CENT = 5
SEED = 42
#: Bytes of the texts that the kernels get at once, unless one text has more.
BATCH_BYTES = 16 << 20

#: What stands between words once A-Z are lowered.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TEXT = "_burrow_text"


def crc_of_byte(byte: int) -> int:
    """The CRC-32 table entry of a byte, by its polynomial."""
    for _ in range(8):
        byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
    return byte


def slices(batch: pa.RecordBatch, column: int):
    """The batch in runs of ``SLICE`` rows at most and about ``BATCH_BYTES``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for k, n in enumerate(sizes.tolist()):
        if k > start and (size + n > BATCH_BYTES or k - start == SLICE):
            yield batch.slice(start, k - start)
            start, size = k, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


class Features:
    """Buckets of all features of some texts.

    ``first`` has the place of each text's first word and, at the end, the number
    of words. ``orders`` holds, for runs of one, two and three words, the buckets
    of the distinct runs, the run's number for each place, and at which places a
    run of that length begins.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern_regex(pc.ascii_lower(texts), _BETWEEN)
        words, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
        there = pc.greater(pc.binary_length(words), 0)
        coded = words.filter(there).dictionary_encode()
        owner = owner.filter(there).to_numpy()
        self.first = np.searchsorted(owner, np.arange(len(texts) + 1))
        spoken = [w.encode() for w in coded.dictionary.to_pylist()]
        behind = [b" " + w for w in spoken]
        numbers = coded.indices.to_numpy().astype(np.int64)
        checks = np.fromiter(map(crc32, spoken), np.uint32, len(spoken))
        self.orders = [(checks % BUCKETS, numbers, np.ones(len(numbers), bool))]
        before = numbers
        for shift in (1, 2):
            n = max(0, len(numbers) - shift)
            inside = owner[:n] == owner[shift:]
            keys = before[:n] * len(spoken) + numbers[shift:]
            runs = pa.array(keys[inside]).dictionary_encode()
            left, right = np.divmod(runs.dictionary.to_numpy(), max(1, len(spoken)))
            pairs = zip(map(behind.__getitem__, right.tolist()), checks[left].tolist(), strict=True)
            checks = np.fromiter((crc32(w, c) for w, c in pairs), np.uint32, len(left))
            before, begins = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), bool)
            begins[:n] = inside
            before[begins] = runs.indices.to_numpy()
            self.orders.append((checks % BUCKETS, before, begins))

    def counts(self) -> np.ndarray:
        total = np.zeros(BUCKETS, np.int64)
        for buckets, number, begins in self.orders:
            times = np.bincount(number[begins], minlength=len(buckets))
            np.add.at(total, buckets, times)
        return total

    def sums(self, gains: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, features and summed gains of each text."""
        places = np.zeros(self.first[-1] + 1, np.int64)
        n_features = np.zeros(self.first[-1] + 1, np.int64)
        for buckets, number, begins in self.orders:
            of_run = gains.take(pa.array(buckets.astype(np.int64))).to_numpy()
            places[1:][begins] += of_run[number[begins]]
            n_features[1:] += begins
        ends = [np.cumsum(x)[self.first] for x in (places, n_features)]
        return np.diff(self.first), np.diff(ends[1]), np.diff(ends[0])


def bucket_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """``bucket, n``: the features of all texts in every bucket."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                total += Features(part.column(0)).counts()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    whole = texts.select(F.coalesce(F.col(column), F.lit("")).alias(_TEXT))
    return whole.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(source: DataFrame, target: DataFrame) -> list[int]:
    """The gain of every bucket in thousandths, from two tables of counts."""
    both = source.withColumn("t", F.lit(0)).union(target.select("bucket", F.lit(0), "n"))
    rows = both.groupBy("bucket").agg(F.sum("n").alias("s"), F.sum("t").alias("t")).collect()  # BUCKETS rows at most
    s, t = np.zeros((2, BUCKETS))
    for row in rows:
        s[row.bucket], t[row.bucket] = row.s, row.t
    all_s, all_t = s.sum(), t.sum()
    ratios = (t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS))
    return [math.floor(1000 * math.log(r)) for r in ratios.tolist()]


def weighted(docs: DataFrame, gains: list[int], keep=("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, ``n_words``, ``n_features`` and ``weight`` of every document."""
    names = [*keep, "n_words", "n_features", "weight"]

    def run(batches):
        of_bucket = pa.array(gains, pa.int64())
        for batch in batches:
            for part in slices(batch, len(keep)):
                sums = Features(part.column(len(keep))).sums(of_bucket)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *map(pa.array, sums)], names=names)

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias(_TEXT))
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return source.mapInArrow(run, ", ".join([*kinds, *[f"{c} bigint" for c in names[len(keep) :]]]))


def drawn(weights: DataFrame, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``score`` of every row of ``weights`` (doc_id, n_words, n_features,
    weight), and ``rank`` of the drawn ones."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = materialise(weights.withColumn("score", F.col("weight") + luck), "scores")
    may, number = F.col("n_words") >= least_words, 0
    number = scored.where(may).count() * per_cent // 100
    # Equal rows are told apart by their place, so that many of them are spread too.
    order = [-F.col("score"), "doc_id", "weight", "n_features", F.monotonically_increasing_id()]
    ranked = with_ordinal(scored.where(may), [], order, "_place")
    rank = F.when(F.col("_place") < number, F.col("_place") + 1).cast("bigint").alias("rank")
    rest = scored.where(~may).select(*scored.columns, F.lit(None).cast("bigint").alias("rank"))
    return ranked.select(*scored.columns, rank).unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of all ``docs`` (doc_id,
    text), drawn towards the texts of ``target``."""
    gains = gains_of(bucket_counts(docs), bucket_counts(target))
    found = drawn(weighted(docs, gains), per_cent, seed=seed)
    return found.select("doc_id", "n_features", "weight", "score", "rank")
