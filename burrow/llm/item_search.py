"""Reversed ranked search: documents stream through an index of the items.

The few items (queries) are indexed, not the many documents. The index holds
the items of each term and the term's weight; it is broadcast, and its size is
checked first: items are dealt into blocks of ``POSTINGS`` postings and
``ITEMS`` items at most on average, and each block has a pass of its own over
all documents. A task counts the indexed terms of some documents at once, adds
up the terms' gains over the postings and keeps, for every item, a heap of the
``k`` best documents it has met; what falls under a full heap's least entry is
left out at once. The heaps of all tasks are merged in two steps. Document
frequencies, the number of documents and their length come from a pass over all
documents before.

Scores are whole numbers, see ``gain``. Ties go to the smaller id. Null and
empty texts are documents without terms and don't count. Every row is a
document of its own; rows with a null id count but can't be found. Rows that
repeat an item's id are one item with the terms of all of them; items with a
null id, and items without terms, have no results.
"""

from __future__ import annotations

import heapq
import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from burrow.llm.common import SLICE, raw_text
from burrow.session import materialise

K = 10
#: Bounds of one broadcast index: postings, and items (each has a heap in every task).
POSTINGS, ITEMS = 2_000_000, 20_000
#: Scores a task holds at once, documents times items.
CELLS = 4_000_000
#: First-step merges per item; each gets the heaps of many tasks.
MERGES = 64

_TERMS = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall


def terms_of(raw: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all that is beyond ASCII; only A-Z are lowered."""
    return _TERMS(raw.lower())


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def length_mark(n: int, documents: int, length: int) -> int:
    """A document's length against the mean one."""
    return 100 - 90 + (90 * n * documents) // length


def gain(weight_, times, mark):
    """What a term adds that a document of length mark ``mark`` holds ``times`` times."""
    return weight_ * ((1_000_000_000 * times) // (1000 * times + 8 * mark))


class Index:
    """The terms of a block of items: their numbers and postings."""

    def __init__(self, ids: list[int], rows: list[tuple[bytes, list[int]]]):
        """``rows``: each term with the places of its items in ``ids``."""
        self.ids = ids
        self.number = {term: k for k, (term, _) in enumerate(rows)}
        self.first = np.cumsum([0, *[len(p) for _, p in rows]])
        self.items = np.array([i for _, p in rows for i in p], np.int64)
        self.weights = np.zeros(len(rows), np.int64)


def counted(texts: list[bytes], number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; then text, term and times of all indexed terms in them."""
    n_terms = np.zeros(len(texts), np.int64)
    hits = []
    for k, raw in enumerate(texts):
        words = terms_of(raw)
        n_terms[k] = len(words)
        found = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
        hits.append(found[found >= 0] + k * len(number))
    keys, times = np.unique(np.concatenate(hits) if hits else np.zeros(0, np.int64), return_counts=True)
    text, term = np.divmod(keys, max(1, len(number)))
    return n_terms, text, term, times


def corpus_counts(docs: DataFrame, index, text: str = "text") -> DataFrame:
    """``term, n``: documents with each indexed term; under the numbers -1 and
    -2 the documents that hold any term, and all their terms."""

    def run(batches):
        number = index.value.number
        frequency = np.zeros(len(number), np.int64)
        documents = length = 0
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                n_terms, _, term, _ = counted(batch.column(0).slice(start, SLICE).to_pylist(), number)
                documents, length = documents + int((n_terms > 0).sum()), length + int(n_terms.sum())
                frequency += np.bincount(term, minlength=len(number))
        used = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, -2, *used.tolist()]), pa.array([documents, length, *frequency[used].tolist()])], names=["term", "n"]
        )

    return docs.select(raw_text(text)).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def heaps(docs: DataFrame, index, documents: int, length: int, k: int, text: str = "text") -> DataFrame:
    """``item_id, doc_id, score``: the best of each task for every item."""

    def run(batches):
        block: Index = index.value
        n_items = len(block.ids)
        best: list[list] = [[] for _ in range(n_items)]
        least = np.ones(n_items, np.int64)  # a score under it can't come in
        step = max(1, min(SLICE, CELLS // max(1, n_items)))
        sizes = np.diff(block.first)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                ids = batch.column(0).slice(start, step).to_pylist()
                n_terms, doc, term, times = counted(batch.column(1).slice(start, step).to_pylist(), block.number)
                marks = np.array([length_mark(n, documents, length) if length else 0 for n in n_terms.tolist()], np.int64)
                gains = gain(block.weights[term], times, marks[doc])
                many = sizes[term]
                before = np.cumsum(many) - many
                postings = np.arange(int(many.sum())) + np.repeat(block.first[term] - before, many)
                scores = np.zeros(len(ids) * n_items, np.int64)
                np.add.at(scores, np.repeat(doc, many) * n_items + block.items[postings], np.repeat(gains, many))
                scores = scores.reshape(len(ids), n_items)
                for place, item in zip(*map(np.ndarray.tolist, np.nonzero(scores >= least)), strict=True):
                    heap, entry = best[item], (int(scores[place, item]), -ids[place])
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        least[item] = max(1, heap[0][0])
        rows = [(block.ids[i], -d, s) for i, heap in enumerate(best) for s, d in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))],
            names=["item_id", "doc_id", "score"],
        )

    named = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint"), raw_text(text))
    return named.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def item_terms(items: DataFrame, text: str = "text") -> DataFrame:
    """``item_id, term``: the distinct terms of every item."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                terms = [list(set(terms_of(raw))) for raw in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "terms"])

    named = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint"), raw_text(text))
    return named.mapInArrow(run, "item_id bigint, terms array<binary>").select("item_id", F.explode("terms").alias("term")).distinct()


def _index(spark: SparkSession, postings: DataFrame) -> Index:
    """The index of one block; its size has been checked."""
    found: dict[bytes, list[int]] = {}
    ids: dict[int, int] = {}
    for row in postings.collect():
        found.setdefault(bytes(row.term), []).append(ids.setdefault(row.item_id, len(ids)))
    return Index(list(ids), sorted(found.items()))


def best_documents(
    docs: DataFrame, items: DataFrame, k: int = K, postings: int = POSTINGS, most_items: int = ITEMS
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best of ``docs`` (doc_id,
    text) for every row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    terms = materialise(item_terms(items), "item_terms")
    size = terms.agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("items")).first()
    blocks = max(1, -(-size.n // postings), -(-size["items"] // most_items))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = []
    for b in range(blocks):
        index = _index(spark, terms.where(block == b))
        bare = spark.sparkContext.broadcast(index)
        counts = {r.term: r.n for r in corpus_counts(docs, bare).collect()}  # a row per indexed term
        documents, length = counts.get(-1, 0), counts.get(-2, 0)
        for t in range(len(index.weights)):
            index.weights[t] = weight(documents, counts.get(t, 0))
        weighted = spark.sparkContext.broadcast(index)
        part = heaps(docs, weighted, documents, length, k)
        found.append(part if blocks == 1 else materialise(part, "heaps"))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    order = [F.col("score").desc(), F.col("doc_id")]
    merge = F.pmod(F.spark_partition_id(), F.lit(MERGES))
    some = Window.partitionBy("item_id", "_merge").orderBy(*order)
    whole = Window.partitionBy("item_id").orderBy(*order)
    return (
        every.withColumn("_merge", merge)
        .withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )
