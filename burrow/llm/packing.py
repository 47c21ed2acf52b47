"""Best-fit packing of documents into sequences of fixed length.

Large-item matching: pieces above a third of the capacity go at most two to a
sequence, so the largest is matched with the largest partner that still fits;
smaller pieces then fill the remaining gaps, each in the tightest one.

The number of pieces of each length is all that the plan depends on, and there
are at most ``capacity`` lengths. So the plan is made from the histogram, as
runs "the n next pieces of length l go into n sequences from number s at place
o"; its size is bounded by the capacity, not by the data. Pieces then find
their run by their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from burrow.llm.common import scan
from burrow.llm.tokens import library_words
from burrow.session import materialise

CAPACITY = 4096
#: Pieces ranked by one task.
RANKED_ROWS = 1_000_000

_PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )
)


def pieces(
    docs: DataFrame, words: Callable[[], dict], end_id: int, capacity: int = CAPACITY, id_column: str = "doc_id"
) -> DataFrame:
    """One row per piece of each document's ids with ``end_id`` behind them.

    Only documents longer than ``capacity`` are cut. An empty or null text is
    the end id alone. Rows with a repeated id are documents of their own.
    """
    end = end_id.to_bytes(4, "little")

    def prepare():
        known = words()
        step = 4 * capacity
        arrow = pa.list_(
            pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        )

        def compute(texts):
            rows = []
            for raw in texts:
                ids = b"".join(map(known.__getitem__, raw.split())) + end
                rows.append(
                    [
                        {
                            "piece": k,
                            "start": at // 4,
                            "length": len(part) // 4,
                            "ids_crc32": zlib.crc32(part),
                        }
                        for k, at in enumerate(range(0, len(ids), step))
                        for part in (ids[at : at + step],)
                    ]
                )
            return [pa.array(rows, arrow)]

        return compute

    found = scan(docs, [id_column], [T.StructField("_pieces", _PIECES)], prepare)
    return found.select(id_column, F.inline("_pieces"))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, number, first sequence, place), and the
    number of sequences, for so many pieces of each length."""
    left = {n: c for n, c in histogram.items() if c > 0}
    ranks = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[list[int]]] = {}  # gap -> [first sequence, number]
    order: list[int] = []  # the gaps, sorted
    made = 0

    def put(length: int, count: int, sequence: int, place: int) -> None:
        runs.append((length, ranks[length], count, sequence, place))
        ranks[length] += count
        left[length] -= count

    def leave(gap: int, sequence: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append([sequence, count])

    # Large pieces, largest first; the partner is the largest that fits.
    third = capacity // 3
    large = sorted(n for n in left if n > third)
    open_large = list(large)  # lengths with pieces left
    for length in reversed(large):
        while left[length]:
            while open_large and not left[open_large[-1]]:
                open_large.pop()
            at = bisect.bisect_right(open_large, capacity - length) - 1
            while at >= 0 and not left[open_large[at]]:
                open_large.pop(at)
                at -= 1
            if at < 0:
                count = left[length]
                leave(capacity - length, made, count)
                put(length, count, made, 0)
            else:
                other = open_large[at]
                count = min(left[length], left[other]) if other != length else left[length] // 2
                if not count:  # a single piece of this length: the next smaller partner
                    open_large.pop(at)
                    continue
                put(length, count, made, 0)
                put(other, count, made, length)
                leave(capacity - length - other, made, count)
            made += count

    # Smaller pieces, largest first, each into the tightest gap.
    for length in sorted((n for n in left if n <= third), reverse=True):
        while left[length]:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                fit = capacity // length
                full, rest = divmod(left[length], fit)
                for count, times in ((full, fit), (1 if rest else 0, rest)):
                    for k in range(times if count else 0):
                        put(length, count, made, k * length)
                    leave(capacity - times * length, made, count)
                    made += count
                continue
            gap = order[at]
            group = gaps[gap][-1]
            count = min(group[1], left[length])
            place = capacity - gap
            put(length, count, group[0], place)
            sequence = group[0]
            group[0] += count
            group[1] -= count
            if not group[1]:
                gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            leave(gap - length, sequence, count)
    return runs, made


def pack(found: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id", ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """Give every piece a ``sequence_id`` and an ``offset`` in it.

    Pieces are ranked within (length, salt), so that many pieces of one length
    are ranked by many tasks; counts per salt give the ranks their starts.
    """
    spark = found.sparkSession
    rows = materialise(found, "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    runs, _ = plan(counts, capacity)
    salts = max(1, -(-sum(counts.values()) // ranked_rows))
    keys = [F.col(c) for c in (id_column, "piece", "ids_crc32")]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    local = salted.withColumn("_local", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*keys)) - 1)
    starts = (
        salted.groupBy("length", "_salt")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_first", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"))
        .drop("_n")
    )
    slots = spark.createDataFrame(
        runs or [(0, 0, 0, 0, 0)], "length bigint, _from bigint, _count bigint, _sequence bigint, _place bigint"
    )
    rank = F.col("_local") + F.col("_first")
    return (
        local.join(starts, ["length", "_salt"])
        .withColumn("_rank", rank)
        .join(F.broadcast(slots), "length")  # the plan's runs: bounded by the capacity
        .where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_count")))
        .select(
            id_column,
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"),
            F.col("_place").alias("offset"),
        )
    )


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pack the documents' ids by the tokenizer in file ``tokenizer``."""
    return pack(pieces(docs, lambda: library_words(tokenizer), end_id, capacity), capacity)
