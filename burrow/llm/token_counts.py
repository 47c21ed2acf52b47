"""Token counts of whole texts by a public sentencepiece vocabulary.

A text is cut into pre-tokens at places no piece of the vocabulary reaches
over: before a run of spaces and on both sides of a line feed. The counts of
the pre-tokens then add up to the library's count of the whole text; a
vocabulary with a piece over such a place is refused.

The lookup has two tiers and stays on the map side. A first pass finds the
pre-tokens that are frequent in all documents: every task hands on a summary of
``SUMMARY`` pre-tokens at most, and the ``FREQUENT`` commonest of the summed
summaries are measured once and broadcast, as one string of bytes with their
token counts. In the second pass a pre-token is looked up there; what is not
found is encoded by the library and remembered in a cache of the Python worker,
which is bounded too. No pre-token of a text is shuffled, and which pre-tokens
are frequent changes the time a count takes, never the count.

Null and empty texts have no bytes and no tokens. Repeated rows and rows with
a null id are counted one by one. Bytes that aren't UTF-8 count as the
replacement character. Other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burrow.llm.common import SLICE, raw_text, scan
from burrow.llm.tokens import KnownWords, kept

LIMIT = 4096
#: Entries of the broadcast table, and of one task's summary.
FREQUENT, SUMMARY = 50_000, 5_000
#: Distinct pre-tokens a summarising task holds before it forgets the rarer half.
COUNTED = 200_000
#: Bytes of the longest pre-token that is remembered: bounds both tiers.
LONGEST = 48

_MARK = "▁".encode()


def pre_tokens(raw: bytes) -> list[bytes]:
    """The pre-tokens of a text. One starts with a line feed, or has a space
    before it that isn't written; one that is only spaces ends in a space."""
    if not raw:
        return []
    found = raw.replace(_MARK, b" ").replace(b"\n", b" \n").split(b" ")
    return found if b"" not in found else _with_blanks(found)


def _with_blanks(parts: list[bytes]) -> list[bytes]:
    """Give runs of spaces to the pre-token behind them, or make them one."""
    found, blanks = [], 0
    for empty, group in groupby(parts, lambda p: not p):
        group = list(group)
        if empty:
            blanks = len(group)
            continue
        if blanks and group[0].startswith(b"\n"):
            found.append(b" " * blanks)
        elif blanks:
            group[0] = b" " * blanks + group[0]
        found += group
        blanks = 0
    if blanks:
        found.append(b" " * blanks)
    return found


def measure_of(model: str):
    """The function from a pre-token to its number of tokens."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    for k in range(len(library)):
        piece = library.id_to_piece(k)
        if "\n" in piece or "▁" in piece.lstrip("▁"):
            raise ValueError(f"piece {piece!r} reaches over a space or line feed")

    def measure(word: bytes) -> int:
        text = word.decode(errors="replace")
        if text.startswith("\n"):  # the library puts a space before it
            return len(library.encode(text)) - 1
        if text.endswith(" "):
            text = text[1:]
            return len(library.encode(text)) if text else 1
        return len(library.encode(text))

    return measure


def summaries(docs: DataFrame, text: str = "text", size: int = SUMMARY) -> DataFrame:
    """``word, n``: the commonest pre-tokens of all documents."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                for raw in batch.column(0).slice(start, SLICE).to_pylist():
                    counts.update(pre_tokens(raw))
                    if len(counts) > COUNTED:
                        counts = Counter(dict(counts.most_common(COUNTED // 2)))
        top = Counter({w: n for w, n in counts.items() if len(w) <= LONGEST and b"\0" not in w}).most_common(size)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"]
        )

    told = docs.select(raw_text(text)).mapInArrow(run, "word binary, n bigint")
    return told.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_lengths(docs: DataFrame, model: str, text: str = "text", entries: int = FREQUENT) -> tuple[bytes, bytes]:
    """The table to broadcast: pre-tokens between zero bytes, and one byte with
    the token count of each. Bounded by ``entries`` times ``LONGEST``."""

    def run(batches):
        measure = measure_of(model)
        for batch in batches:
            counts = [measure(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], names=["word", "tokens"])

    common = summaries(docs, text).orderBy(F.desc("n"), "word").limit(entries)
    rows = common.select("word").mapInArrow(run, "word binary, tokens int").collect()
    return b"\0".join(bytes(r.word) for r in rows), bytes(r.tokens for r in rows)


class Lengths(dict):
    """Token counts of pre-tokens: the broadcast table, then the cache."""

    def __init__(self, table: tuple[bytes, bytes], measure):
        words, tokens = table
        super().__init__(zip(words.split(b"\0"), tokens, strict=True) if tokens else ())
        self.cache, self.measure = KnownWords(measure), measure

    def __missing__(self, word: bytes) -> int:
        return self.cache[word] if len(word) <= LONGEST else self.measure(word)


def counted(
    docs: DataFrame, model: str, limit: int = LIMIT, keep=("doc_id",), text: str = "text", entries: int = FREQUENT
) -> DataFrame:
    """``keep``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every text, by
    the sentencepiece file ``model``."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model, text, entries))

    def prepare():
        lengths = kept(("token counts", model, table.value), lambda: Lengths(table.value, measure_of(model)))

        def compute(texts):
            tokens = [sum(map(lengths.__getitem__, pre_tokens(raw))) for raw in texts]
            return [
                pa.array(list(map(len, texts)), pa.int64()),
                pa.array(tokens, pa.int64()),
                pa.array([n > limit for n in tokens], pa.bool_()),
            ]

        return compute

    fields = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ]
    return scan(docs, list(keep), fields, prepare, text)
