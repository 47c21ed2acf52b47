"""Quality rules with tokeniser fertility.

Base rules count words, symbols, repeated lines and repeated 5-word windows.
Fertility measures each text with two public vocabularies: characters per
token of a byte-level one, and the byte-fallback share and token entropy of
one with byte fallback. Tokens are those of the single words. A text is
rejected if a measure leaves the band of its language and of its length class,
the binary logarithm of its number of tokens. Where the language is null, its
script takes its place. A band is the median of all documents of that
group plus or minus ``WIDTH`` times the distance to the near quartile, and at
least the ``LEAST`` distance. A length class with fewer than ``ENOUGH``
documents takes the language's band; for entropy, which grows with length by
one bit per class at most, that of the nearest class with enough, widened by a
bit per class towards the missing length. A language with fewer takes the
bands of its script, and these those of all documents, however few.

Quartiles are exact for measures rounded to ``DIGITS`` decimals: their counts add
up in any order, and a group has a bounded number of values.

A batch of texts is measured at once: every distinct word of it gets a number
and is encoded by both vocabularies when it is new to the worker; tokens,
entropy and repeated windows then come from arrays over the whole batch.

``WIDTH`` is taken from the labelled rows of the given tables at sf0.1: of 301
low-quality texts that pass the base rules four quartile distances reject 276
and of 3,330 clean ones 52 (a trial of three gave 284 and 109, of five 262 and 29).

Empty and null texts have no words, fail the base rules and are not kept.
Repeated rows are measured one by one. Columns that are not used don't matter.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burrow.llm.common import scan
from burrow.llm.tokens import kept
from burrow.session import materialise

ENOUGH = 30
WIDTH = 4.0
#: Least half width of a band: chars per token (as a share of the median),
#: byte-fallback share, entropy in bits (as a share of the median).
LEAST = {"chars_per_token": 0.05, "fallback_share": 0.02, "token_entropy": 0.05}

#: Decimals of a measure that its quartiles are taken of.
DIGITS = 3
#: Rows of the band table that are broadcast at most.
BROADCAST_ROWS = 200_000
#: Words a worker remembers before it starts anew, between two batches.
KNOWN = 150_000
#: The band of a whole group, beside those of its length classes 0 to 63.
WHOLE, CLASSES = -1, 64
MIN_WORDS = 10
MAX_REPEATED = 20  # per cent of the words
WINDOW = 5

_BLANKS = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
_SYMBOLS = tuple(bytes([c]) for c in b"#*$%&|<>")
#: Scripts by the first byte of a character in UTF-8: (name, from, below).
_SCRIPTS = (
    ("latin", 0x41, 0xCE),
    ("greek", 0xCE, 0xD0),
    ("cyrillic", 0xD0, 0xD5),
    ("semitic", 0xD6, 0xDD),
    ("indic", 0xE0, 0xE2),
    ("east_asian", 0xE3, 0xEE),
)
#: Odd multipliers that mix the five word hashes of a window.
_OWNER = 0xA0761D6478BD642F
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("chars_per_token", T.DoubleType()),
    T.StructField("fallback_share", T.DoubleType()),
    T.StructField("token_entropy", T.DoubleType()),
    T.StructField("script", T.StringType()),
]
_ARROW = [pa.int64()] * 6 + [pa.float64()] * 3 + [pa.string()]
#: The key of the bands of all documents.
ALL = "all"
BANDED = ("chars_per_token", "fallback_share", "token_entropy")


def repeated_words(numbers: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Words of each text in windows of five that it holds twice or more, from
    the numbers of all words in a row and the text of each."""
    n = len(numbers) - WINDOW + 1
    if n < 2:
        return np.zeros(texts, np.int64)
    inside = owner[:n] == owner[WINDOW - 1 :]
    windows = owner[:n].astype(np.uint64) * np.uint64(_OWNER)
    for k, mix in enumerate(_MIX):
        windows += numbers[k : n + k].astype(np.uint64) * np.uint64(mix)
    at = np.flatnonzero(inside)
    order = at[np.argsort(windows[at], kind="stable")]
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(numbers) + 1, np.int64)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    twice[WINDOW:] -= twice[: -WINDOW].copy()
    return np.bincount(owner[np.cumsum(twice)[:-1] > 0], minlength=texts)


def script_of(counts: np.ndarray) -> str:
    """By the number of times that each byte occurs."""
    upto = np.cumsum(counts)
    shares = [upto[below - 1] - upto[start - 1] for _, start, below in _SCRIPTS]
    # UTF-8 continuation bytes lie between the Latin first bytes.
    shares[0] -= upto[0xBF] - upto[0x7F]
    best = int(np.argmax(shares))
    return _SCRIPTS[best][0] if shares[best] else "none"


def repeated_lines(raw: bytes) -> int:
    if b"\n" not in raw:
        return 0
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def measured(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str, keep=("doc_id", "lang")) -> DataFrame:
    """``keep`` and the measures of every text. ``byte_vocabulary`` is a file
    of the tokenizers library, ``piece_vocabulary`` one of sentencepiece."""

    def prepare():
        key = ("fertility", byte_vocabulary, piece_vocabulary)
        words = kept(key, lambda: Words(byte_vocabulary, piece_vocabulary))
        return lambda texts: [pa.array(c, t) for c, t in zip(measures_of(texts, words), _ARROW, strict=True)]

    return scan(docs, list(keep), FIELDS, prepare)


def byte_lengths(vocabulary: str):
    """The function from words to their numbers of byte-level tokens, each with
    a space before it. A file of ranks is read by tiktoken, another by tokenizers."""
    if vocabulary.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        ranked = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda words: [len(ranked.encode_ordinary(" " + w)) for w in words]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    whole.encode_special_tokens = True
    return lambda words: [len(e) for e in whole.encode_batch([" " + w for w in words], add_special_tokens=False)]


class Words:
    """Numbers of words, with their token counts and pieces as arrays."""

    def __init__(self, byte_vocabulary: str, piece_vocabulary: str):
        import sentencepiece

        self.lengths_of = byte_lengths(byte_vocabulary)
        self.library = sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary)
        self.fallback = np.array([self.library.is_byte(i) for i in range(len(self.library))])
        self.forget()

    def forget(self):
        self.number: dict[bytes, int] = {}
        self.lengths, self.pieces, self.ends = array("q"), array("H"), array("q", [0])

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word; new words are encoded."""
        if len(self.number) > KNOWN:
            self.forget()
        known = self.number
        new = [w for w in dict.fromkeys(words) if w not in known]
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        texts = [w.decode(errors="replace") for w in new]
        self.lengths.extend(self.lengths_of(texts))
        for ids in self.library.encode(texts, num_threads=1) if texts else ():
            self.pieces.extend(ids)
            self.ends.append(len(self.pieces))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def measures_of(texts: list[bytes], words: Words) -> list:
    """The columns of ``FIELDS`` for a batch of texts."""
    split = [raw.split() for raw in texts]
    n_words = np.fromiter(map(len, split), np.int64, len(texts))
    numbers = words.numbers([w for found in split for w in found])
    owner = np.repeat(np.arange(len(texts)), n_words)
    # How often each text holds each byte: its characters, blanks, symbols, script.
    held = np.array([np.bincount(np.frombuffer(raw, np.uint8), minlength=256) for raw in texts]).reshape(len(texts), 256)
    chars = held[:, :0x80].sum(axis=1) + held[:, 0xC0:].sum(axis=1) - held[:, [b[0] for b in _BLANKS]].sum(axis=1)
    symbols = held[:, [b[0] for b in _SYMBOLS]].sum(axis=1)
    tokens = np.bincount(owner, np.frombuffer(words.lengths, np.int64)[numbers], len(texts)).astype(np.int64)
    # All pieces of all words in a row, counted for each text.
    ends, pieces = np.frombuffer(words.ends, np.int64), np.frombuffer(words.pieces, np.uint16)
    sizes = (ends[1:] - ends[:-1])[numbers]
    before = np.cumsum(sizes) - sizes
    places = np.arange(int(sizes.sum())) + np.repeat(ends[numbers] - before, sizes)
    kinds = len(words.fallback)
    found, times = np.unique(np.repeat(owner, sizes) * kinds + pieces[places], return_counts=True)
    text, piece = np.divmod(found, kinds)
    total = np.maximum(np.bincount(text, times, len(texts)), 1)
    share = times / total[text]
    entropy = np.bincount(text, -share * np.log2(share), len(texts)) + 0.0
    fallback = np.bincount(text, times * words.fallback[piece], len(texts)) / total
    scripts = [script_of(row) if n else "none" for row, n in zip(held, n_words.tolist(), strict=True)]
    return [
        n_words, chars, symbols, np.fromiter(map(repeated_lines, texts), np.int64, len(texts)),
        repeated_words(numbers, owner, len(texts)), tokens, chars / np.maximum(tokens, 1), fallback, entropy, scripts,
    ]


def bands(measures: DataFrame) -> DataFrame:
    """``_key, _size`` and low and high bound of every measure for each key of
    the array ``_keys`` and length class, from all documents that pass the base
    rules. Keys other than ``ALL`` need enough documents."""
    dealt = measures.where(~F.col("base_failed")).select(
        F.explode("_keys").alias("_key"), F.explode(F.array(F.lit(WHOLE), "_size")).alias("_size"), *BANDED
    )
    quartiles = dealt.groupBy("_key", "_size").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.percentile(F.round(c, DIGITS), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in BANDED],
    )
    bounds = []
    for c in BANDED:
        low, mid, high = (F.col(c)[k] for k in range(3))
        least = F.lit(LEAST[c]) * (F.lit(1.0) if c == "fallback_share" else mid)
        bounds.append((mid - F.greatest(WIDTH * (mid - low), least)).alias(f"_low_{c}"))
        bounds.append((mid + F.greatest(WIDTH * (high - mid), least)).alias(f"_high_{c}"))
    known = quartiles.select("_key", "_size", "_n", F.struct(*bounds).alias("_band"))
    # One row per key from here on, at most one per language, script and all.
    enough = F.when(F.col("_n") >= ENOUGH, F.struct("_size", "_band"))
    keys = known.groupBy("_key").agg(
        F.max(F.when(F.col("_size") == WHOLE, F.struct("_n", "_band"))).alias("_whole"),
        F.collect_list(F.when(F.col("_size") != WHOLE, enough)).alias("_classes"),
    ).where((F.col("_whole._n") >= ENOUGH) | (F.col("_key") == ALL))
    sizes = keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(CLASSES - 1))).alias("_size"))
    far = sizes.withColumn(
        "_near",
        F.array_min(F.transform("_classes", lambda k: F.struct(F.abs(k["_size"] - F.col("_size")).alias("far"), k["_size"].alias("_size"), k["_band"].alias("_band")))),
    )
    own = F.when(F.col("_near.far") == 0, F.col("_near._band"))
    found = []
    for c in BANDED[:2]:
        for end in (f"_low_{c}", f"_high_{c}"):
            found.append(F.coalesce(own[end], F.col("_whole._band")[end]).alias(end))
    step, last = F.col("_size") - F.col("_near._size"), BANDED[2]
    low, high = (F.col("_near._band")[f"_{end}_{last}"] for end in ("low", "high"))
    # Without any class of enough documents, all documents bound the entropy.
    whole = [F.when(F.col("_key") == ALL, F.col("_whole._band")[f"_{end}_{last}"]) for end in ("low", "high")]
    found.append(F.coalesce(low + F.least(step, F.lit(0)), whole[0]).alias(f"_low_{last}"))
    found.append(F.coalesce(high + F.greatest(step, F.lit(0)), whole[1]).alias(f"_high_{last}"))
    return far.select("_key", "_size", *found)


def judged(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str, keep=("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every document, its base counts, whether they
    fail, its fertility and whether it is kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    named = docs.select(*keep, F.col("lang").alias("_lang"), "text")
    measures = materialise(
        measured(named, byte_vocabulary, piece_vocabulary, [*keep, "_lang"]).withColumns(
            {"base_failed": failed, "_size": F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int")}
        ),
        "fertility",
    )
    script = F.concat(F.lit("script "), "script")
    own = F.coalesce(F.concat(F.lit("language "), "_lang"), script)
    banded = measures.withColumn("_keys", F.array_distinct(F.array(own, script, F.lit(ALL))))
    found, inside = materialise(bands(banded), "bands"), F.lit(True)
    few = found.count() <= BROADCAST_ROWS  # 64 rows for each key with enough documents
    for k, mark in enumerate(("_own", "_script", "_every")):
        at = F.get("_keys", F.lit(k))
        named = found.select(F.col("_key").alias(f"{mark}_key"), F.col("_size").alias(f"{mark}_size"), F.struct(found.columns[2:]).alias(mark))
        banded = banded.join(F.broadcast(named) if few else named, (at == F.col(f"{mark}_key")) & (F.col("_size") == F.col(f"{mark}_size")), "left")
    for c in BANDED:
        tests = [F.col(c).between(F.col(f"{m}._low_{c}"), F.col(f"{m}._high_{c}")) for m in ("_own", "_script", "_every")]
        inside = inside & F.coalesce(*tests, F.lit(True))
    return banded.select(
        *keep,
        *[f.name for f in FIELDS[:5]],
        "base_failed",
        (~F.col("base_failed") & inside).alias("kept"),
        *[f.name for f in FIELDS[5:]],
    )
