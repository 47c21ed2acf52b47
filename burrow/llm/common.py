"""Helpers shared by the corpus operators.

Texts travel to Python once, as UTF-8 bytes in Arrow batches, and only the
columns asked for come back. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

RAW = "_burrow_raw"
#: Documents handled at once inside a task.
SLICE = 512
#: Rows of a batch on its way to Python and back: two slices of documents.
BATCH = 2 * SLICE
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def raw_text(column: str = "text") -> Column:
    """The whole text as UTF-8 bytes; a null text is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def small_batches(frame: DataFrame) -> DataFrame:
    """Lets the session send at most ``BATCH`` rows at once, because rows hold
    whole texts; neither the JVM nor a worker has to hold more of them. A
    smaller setting stays."""
    conf = frame.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_SETTING)) <= BATCH:
        conf.set(_BATCH_SETTING, str(BATCH))
    return frame


def scan(
    docs: DataFrame,
    keep: list[str],
    fields: list[StructField],
    prepare: Callable[[], Callable[[list[bytes]], list[pa.Array]]],
    text: str = "text",
) -> DataFrame:
    """The columns ``keep`` of every row and ``fields`` computed from its text.

    ``prepare`` runs once per task and gives the function from a list of texts
    to one array per field, or to (arrays, mask) where the mask drops rows.
    Rows stay in their partition.
    """
    source = small_batches(docs).select(*[F.col(f"`{c}`") for c in keep], raw_text(text).alias(RAW))
    kept = [docs.schema[c] for c in keep]
    names = [*keep, *[f.name for f in fields]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = None
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                compute = compute or prepare()
                made = compute(part.column(len(keep)).to_pylist())
                mask = None
                if isinstance(made, tuple):
                    made, mask = made
                out = pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=names)
                yield out if mask is None else out.filter(mask)

    return source.mapInArrow(run, StructType([*kept, *fields]))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """One 0/1 label per id. Rows without id or label are left out; if the
    rows of an id disagree, the larger label holds."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(column).cast("int")).alias("label"))
    )
