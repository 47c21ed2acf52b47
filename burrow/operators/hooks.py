"""User data sources: functions that add columns to the frame table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from burrow.operators.chunks import CHUNK, CHUNK_FRAMES, keep_home, with_chunk, with_halo

KEYS = ("session_id",)
FRAME = "frame_number"

DATA_SOURCES: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {}


def data_source(name: str, adds: Sequence[str]):
    """Register ``f(frames, **args) -> frames`` that adds the columns ``adds``."""

    def register(fn):
        DATA_SOURCES[name] = (fn, tuple(adds))
        return fn

    return register


def with_sources(frames: DataFrame, wanted: Sequence[tuple[str, Mapping]]) -> DataFrame:
    """Apply the named sources in order.

    What a source returns is checked before it is used: all columns that were
    there, with their types, and the ones it has declared.
    """
    for name, args in wanted:
        if name not in DATA_SOURCES:
            raise ValueError(f"unknown data source {name!r}, known: {sorted(DATA_SOURCES)}")
        fn, adds = DATA_SOURCES[name]
        made = fn(frames, **args)
        types = dict(made.dtypes)
        lost = [c for c, kind in frames.dtypes if types.get(c) != kind]
        missing = [c for c in adds if c not in types]
        if lost or missing:
            raise ValueError(f"data source {name} lost or changed {lost} and did not add {missing}")
        frames = made
    return frames


def per_chunk(
    frames: DataFrame,
    function: Callable,
    schema: StructType | str,
    *,
    halo: int = 0,
    keys: Sequence[str] = KEYS,
    chunk_frames: int = CHUNK_FRAMES,
) -> DataFrame:
    """Run ``function(pandas.DataFrame) -> pandas.DataFrame`` on the frames of a
    session, a bounded chunk at a time.

    With a halo of n the function also sees the n rows before and after its
    chunk, and has to hand on the boolean column ``_home``, which is false for
    them; those rows are dropped afterwards.
    """
    if halo:
        rows = with_halo(frames, keys, FRAME, halo, halo, chunk_frames)
        return keep_home(rows.groupBy(*keys, CHUNK).applyInPandas(_without_chunk(function), schema), drop_chunk=False)
    return with_chunk(frames, FRAME, chunk_frames).groupBy(*keys, CHUNK).applyInPandas(_without_chunk(function), schema)


def _without_chunk(function: Callable) -> Callable:
    def run(rows):
        return function(rows.drop(columns=CHUNK).sort_values(FRAME, ignore_index=True))

    return run
