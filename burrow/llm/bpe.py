"""Byte-pair encoding by speculation and verification, and decoding.

Greedy longest match proposes tokens for a word. The proposal is the encoding
exactly if every token is what merging its own bytes gives, and merging every
adjacent pair of tokens keeps the border between them. All pairs of a batch
are tested together in numpy; only words with a failing pair are merged
step by step.

Inside this module token t is a byte (t < 256) or the result of merge t - 256,
so that a smaller number is an earlier merge.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from burrow.llm.common import scan
from burrow.llm.tokens import byte_letters, kept

#: Fixed value: the public pattern that splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KNOWN_CHUNKS = 400_000
KNOWN_WORDS = 400_000
_NONE = 1 << 40
_NEVER = np.int64(_NONE)


class ByteBpe:
    """The vocabulary in the tokenizers file ``path``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parsed = json.load(file)
        letters = byte_letters()
        vocabulary = {bytes(letters[c] for c in t): i for t, i in parsed["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in parsed["model"]["merges"]]
        self.bytes_of = [bytes([b]) for b in range(256)]
        self.left, self.right = list(range(256)), list(range(256))
        number = {b: t for t, b in enumerate(self.bytes_of)}
        self.merge: dict[tuple[int, int], int] = {}
        for a, b in merges:
            a, b = (number[bytes(letters[c] for c in x)] for x in (a, b))
            made = len(self.bytes_of)
            whole = self.bytes_of[a] + self.bytes_of[b]
            self.bytes_of.append(whole)
            self.left.append(a)
            self.right.append(b)
            self.merge[a, b] = made
            number.setdefault(whole, made)
        self.number = number
        # The longest token by its first four bytes; others have three at most.
        self.longest: dict[bytes, int] = {}
        for whole in number:
            if len(whole) > 3:
                self.longest[whole[:4]] = max(len(whole), self.longest.get(whole[:4], 0))
        self.known: dict[bytes, bytes] = {}
        self.ids = np.array([vocabulary[b] for b in self.bytes_of], np.uint32)
        self._ids = self.ids.tolist()
        self.specials = {t["content"]: t["id"] for t in parsed["added_tokens"] if t["special"]}
        self.text_of = {int(i): b for i, b in zip(self.ids, self.bytes_of, strict=True)} | {
            i: s.encode() for s, i in self.specials.items()
        }
        self.split = regex.compile(PATTERN).findall
        n = len(self.bytes_of)
        self._left, self._right = np.array(self.left, np.int64), np.array(self.right, np.int64)
        keys = np.array([a * n + b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self._keys, self._made, self._n = keys[order], np.array(list(self.merge.values()), np.int64)[order], n

    # -- exact merging ------------------------------------------------------

    def merged(self, word: bytes) -> list[int]:
        """Merge a word's bytes, the earliest merge first, leftmost on ties."""
        tokens = list(word)
        n = len(tokens)
        return self._merged_long(tokens, n) if n > 100 else self._merged_short(tokens, n)

    def _merged_short(self, tokens: list[int], n: int) -> list[int]:
        merge = self.merge.get
        offers = [merge(pair, _NONE) for pair in zip(tokens, tokens[1:], strict=False)]
        while offers and (made := min(offers)) < _NONE:
            i = offers.index(made)
            tokens[i] = made
            del tokens[i + 1], offers[i]
            if i:
                offers[i - 1] = merge((tokens[i - 1], made), _NONE)
            if i < len(offers):
                offers[i] = merge((made, tokens[i + 1]), _NONE)
        return tokens

    def _merged_long(self, tokens: list[int], n: int) -> list[int]:
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := self.merge.get((tokens[i], tokens[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            made, i = heapq.heappop(heap)
            j = after[i] if tokens[i] >= 0 else n
            if j >= n or self.merge.get((tokens[i], tokens[j])) != made:
                continue
            tokens[i], tokens[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (m := self.merge.get((made, tokens[after[i]]))) is not None:
                    heapq.heappush(heap, (m, i))
            if (h := before[i]) >= 0 and (m := self.merge.get((tokens[h], made))) is not None:
                heapq.heappush(heap, (m, h))
        return [t for t in tokens if t >= 0]

    # -- speculation and verification --------------------------------------

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        number, longest, out, at, n = self.number, self.longest.get, [], 0, len(word)
        if (whole := number.get(word)) is not None:
            return [whole]
        while at < n:
            end = min(n, at + longest(word[at : at + 4], 3))
            while (token := number.get(word[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def pair_merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge of each pair, or a number above all merges."""
        keys = a * self._n + b
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._made[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a and b, side by side, keeps the border.

        The merges inside both tokens are undone, the latest first. What then
        touches the border existed together until the merge just undone; had
        the two a merge that comes earlier, it would have crossed the border.
        On a tie of place, the merge further left goes first.
        """
        good = np.ones(len(a), bool)
        rows = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        until = np.full(len(a), _NEVER)
        while len(rows):
            crossed = self.pair_merge(a, b) < until
            good[rows[crossed]] = False
            alive = ~crossed & ((a > 255) | (b > 255))
            rows, a, b = rows[alive], a[alive], b[alive]
            undo_left = a > b
            # A merge in the left token is done before an equal one at the
            # border; one in the right token is done after it.
            until = np.where(undo_left, a, b + 1)
            a, b = np.where(undo_left, self._right[a], a), np.where(undo_left, b, self._left[b])
        return good

    @cached_property
    def reachable(self) -> np.ndarray:
        """Whether merging a token's own bytes gives the token."""
        n = np.arange(self._n)
        good = np.ones(self._n, bool)
        made = n > 255
        good[made] = self.compatible(self._left[made], self._right[made]) | (
            self.pair_merge(self._left[made], self._right[made]) == n[made]
        )
        return good

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Tokens of each word: proposed, tested together, merged if wrong."""
        found = [self.proposed(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for f in found for t in f), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(found)), sizes)
        inner = owner[1:] == owner[:-1]
        wrong = np.zeros(len(found), bool)
        wrong[owner[:-1][inner][~self.compatible(flat[:-1][inner], flat[1:][inner])]] = True
        for k in np.flatnonzero(wrong):
            found[k] = self.merged(words[k])
        return found

    # -- whole texts ----------------------------------------------------------

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk as little-endian unsigned 32-bit integers."""
        split = [[w.encode() for w in self.split(c)] for c in chunks]
        wanted = {w for s in split for w in s}
        missing = wanted - self.known.keys()
        if len(self.known) + len(missing) > KNOWN_WORDS:
            self.known.clear()
            missing = wanted
        missing = list(missing)
        self.known.update(zip(missing, map(self._packed, self.encode_words(missing)), strict=True))
        return [b"".join(map(self.known.__getitem__, s)) for s in split]

    def _packed(self, tokens: list[int]) -> bytes:
        return array("I", map(self._ids.__getitem__, tokens)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(BatchEncoder(self).encode([text])[0], np.uint32)

    def decode(self, ids) -> str:
        return b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")


#: A single space between two characters that are not white space. No token
#: reaches over the place before it, so texts are cut there into chunks.
_CUT = regex.compile(r"(?<=\S) (?=\S)")
_BESIDE_SPACE = regex.compile(r"\s | \s|^ | $")


class BatchEncoder:
    """Encodes batches of texts and remembers chunks; bounded by ``limit``."""

    def __init__(self, bpe: ByteBpe, limit: int = KNOWN_CHUNKS):
        self.bpe, self.limit = bpe, limit
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        special = sorted(bpe.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def parts(self, text: str) -> list[str]:
        return self.special.split(text) if self.special and self.special.search(text) else [text]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = []
        for text in texts:
            split.append([])
            for part in self.parts(text):
                if part in self.bpe.specials:
                    split[-1].append(part)
                elif part:
                    split[-1].append(_CUT.split(part) if _BESIDE_SPACE.search(part) else part.split(" "))
        for known, wanted, prefix in (
            (self.first, {p[0] for s in split for p in s if isinstance(p, list)}, ""),
            (self.later, {c for s in split for p in s if isinstance(p, list) for c in p[1:]}, " "),
        ):
            missing = wanted - known.keys()
            if len(known) + len(missing) > self.limit:
                known.clear()
                missing = wanted
            missing = list(missing)
            known.update(zip(missing, self.bpe.encode_chunks([prefix + c for c in missing]), strict=True))
        out = []
        for parts in split:
            ids = []
            for p in parts:
                if isinstance(p, str):
                    ids.append(array("I", [self.bpe.specials[p]]).tobytes())
                else:
                    ids.append(self.first[p[0]])
                    ids.extend(map(self.later.__getitem__, p[1:]))
            out.append(b"".join(ids))
        return out


def encoder_of(tokenizer: str) -> BatchEncoder:
    """A worker keeps what it knows from task to task."""
    return kept(("bytes", tokenizer), lambda: BatchEncoder(ByteBpe(tokenizer)))


FIELDS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The ids of every whole text: ``doc_id, ids``. Null texts have none."""

    def prepare():
        encoder = encoder_of(tokenizer)

        def compute(texts):
            ids = encoder.encode([raw.decode() for raw in texts])
            return [pa.array([np.frombuffer(i, np.uint32).astype(np.int32) for i in ids], pa.list_(pa.int32()))]

        return compute

    return scan(docs, ["doc_id"], [T.StructField("ids", T.ArrayType(T.IntegerType()))], prepare)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode and decode every whole text and give digests of both.

    Null and empty texts have no tokens and the digests of nothing. Rows with
    repeated ids are encoded one by one.
    """

    def prepare():
        encoder = encoder_of(tokenizer)
        bpe = encoder.bpe

        def compute(texts):
            ids = encoder.encode([raw.decode() for raw in texts])
            decoded = [bpe.decode(np.frombuffer(i, np.uint32).tolist()) for i in ids]
            return [
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
            ]

        return compute

    return scan(docs, ["doc_id"], FIELDS, prepare)
