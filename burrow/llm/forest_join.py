"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Every distinct set of five-word shingles gets a signature for each of
``TREES`` sorted prefix tries. Sets that share a prefix of a trie are compared
inside their trie node by all values of their signatures, in blocks of bounded
size; those that agree too little for the threshold (a chance of ``LOST`` at
the threshold itself) are no candidates, so texts that merely share a passage
don't hang together. The prefix starts at the longest length whose expected
recall at the threshold itself is ``START`` and is shortened until the
estimated recall reaches ``TARGET``: a link found by a shared prefix stands for
one over the expected recall at its similarity, so that links whose texts never
became candidates are counted too. Candidates that hang together are
compared exactly, in blocks of bounded size: a group too large for one task is
cut into blocks, and every pair of its blocks is a task. Tasks hand on sums of
links and spanning ties, not pairs.

Exact copies (equal shingle sets) are one set with a number of copies. Words
are what ASCII white space separates; a text of one to four words has one
shingle, all its words. Texts without words (empty, null) and rows with a null
id link to nothing. Rows that repeat an id are documents of their own.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from burrow.llm.common import RAW, raw_text, scan
from burrow.operators.stars import linked_components as components
from burrow.session import materialise

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
TREES, LEVELS = 16, 8  # a level is two bytes of a path
START, TARGET = 0.9999, 0.999
#: Chance that two signatures of texts at the threshold agree too little.
LOST = 1e-9
#: Sets of one block of a trie node.
NODE_ROWS = 4_000
#: Shingles of one block of a candidate group.
BLOCK_SHINGLES = 400_000
#: Texts of one block of a candidate group: short ones have few shingles.
BLOCK_ROWS = 2_000
#: Cells of a dense slice when sets are compared.
CELLS = 4_000_000

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_WORD_MIX = np.random.default_rng(5).integers(0, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_TREE_MIX = np.random.default_rng(6).integers(0, 2**31, TREES * LEVELS, np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(raw: bytes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    import xxhash

    words = raw.split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(words) - SHINGLE + 1, min(1, len(words)))
    runs = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        runs += hashes[k : k + n] * _WORD_MIX[k]
    runs = (runs ^ (runs >> np.uint64(33))) * _M1
    runs = (runs ^ (runs >> np.uint64(33))) * _M2
    return np.unique(runs ^ (runs >> np.uint64(33)))


def paths(hashes: np.ndarray) -> list[bytes]:
    """The path of a shingle set in every trie."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(TREES * LEVELS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 8192):
        np.minimum(least, (short[at : at + 8192, None] * _TREE_MIX).min(axis=0), out=least)
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    levels = ((least ^ (least >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(16)
    whole = levels.astype(">u2").tobytes()
    return [whole[k : k + 2 * LEVELS] for k in range(0, len(whole), 2 * LEVELS)]


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id, _text`` (hash of the text), ``_node`` (digest of the shingle
    set, null without words), ``_size`` of the set and its ``_paths``."""

    def prepare():
        def compute(texts):
            sets = [shingles(raw) for raw in texts]
            return [
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([paths(s) if len(s) else None for s in sets], pa.list_(pa.binary())),
            ]

        return compute

    fields = [
        T.StructField("_node", T.BinaryType()),
        T.StructField("_size", T.LongType()),
        T.StructField("_paths", T.ArrayType(T.BinaryType())),
    ]
    keyed = docs.select("doc_id", F.xxhash64(raw_text()).alias("_text"), F.col("text").alias("text"))
    return scan(keyed, ["doc_id", "_text"], fields, prepare)


def expected_recall(depth: int, similarity: float, trees: int = TREES) -> float:
    """Chance that two sets share a prefix of ``depth`` in some trie."""
    return 1 - (1 - similarity**depth) ** trees


def first_depth(threshold: Fraction = THRESHOLD) -> int:
    """The longest prefix with an expected recall of START at the threshold."""
    return next((d for d in range(LEVELS, 1, -1) if expected_recall(d, float(threshold)) >= START), 1)


def least_agreement(threshold: Fraction = THRESHOLD) -> int:
    """The most equal values that two signatures at the threshold have, but for
    a chance of LOST: each value agrees with the chance of the similarity."""
    t, n = float(threshold), TREES * LEVELS
    below = itertools.accumulate(math.comb(n, k) * t**k * (1 - t) ** (n - k) for k in range(n + 1))
    return sum(1 for chance in below if chance <= LOST)


def _shared(batches, depth: int):
    """Rows sorted by (tree, path): trie node and set, where a trie node has
    several sets or may go on in a neighbouring partition."""
    last = lone = None
    for batch in batches:
        at, nodes = [], []
        keys = (b"%c%b" % (t, p[: 2 * depth]) for t, p in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True))
        for row in zip(keys, batch.column(2).to_pylist(), strict=True):
            if row[0] != last and last is not None:
                last, lone = row[0], row
                continue
            for key, node in filter(None, (lone, row)):
                at.append(key)
                nodes.append(node)
            last, lone = row[0], None
        yield _binary_rows(at=at, _node=nodes)
    if lone:
        yield _binary_rows(at=[lone[0]], _node=[lone[1]])


def _binary_rows(**columns):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns.values()], names=list(columns))


def _runs(batches, keys: int):
    """The rows of each run of equal first ``keys`` columns, as lists of the
    other columns."""
    held, now = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now and held:
                yield held
                held = []
            now = row[:keys]
            held.append(row[keys:])
    if held:
        yield held


def _tied(rows: list[tuple[bytes, bytes]], least: int) -> list[tuple[bytes, bytes]]:
    """(set, first set of those it hangs together with) over pairs whose
    signatures have ``least`` equal values. What has been reached is not
    compared again, so many near copies take one comparison each."""
    values = np.frombuffer(b"".join(s for _, s in rows), np.uint16).reshape(len(rows), -1)
    rest, left, ties = np.arange(len(rows)), values, []
    while len(rest) > 1:
        head, todo = rest[0], [rest[0]]
        rest, left = rest[1:], left[1:]
        while todo and len(rest):
            near = np.count_nonzero(left == values[todo.pop()], axis=1) >= least
            if near.any():
                found = rest[near]
                todo.extend(found)
                ties += [(rows[k][0], rows[head][0]) for k in found]
                rest, left = rest[~near], left[~near]
    return ties


def candidates(sets: DataFrame, depth: int, threshold: Fraction = THRESHOLD, node_rows: int = NODE_ROWS) -> DataFrame:
    """``u, v``: ties between sets that share a trie node of ``depth`` and whose
    signatures agree. A trie node of more than ``node_rows`` sets is cut into
    blocks, and every pair of its blocks is compared by itself."""
    least = least_agreement(threshold)
    rows = sets.select(F.posexplode("_paths").alias("tree", "path"), "_node")
    shared = materialise(
        rows.repartitionByRange("tree", "path", "_node")
        .sortWithinPartitions("tree", "path", "_node")
        .mapInArrow(lambda b: _shared(b, depth), "at binary, _node binary"),
        "shared",
    )
    several = (
        shared.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("at", F.ceil(F.col("n") / node_rows).cast("int").alias("blocks"))
    )
    signatures = sets.select("_node", F.concat(*[F.col("_paths")[k] for k in range(TREES)]).alias("signature"))
    block = F.pmod(F.xxhash64("_node"), "blocks").cast("int")
    dealt = (
        shared.join(several, "at").join(signatures, "_node")
        .select("*", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("at", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "_node", "signature")
    )

    def compare(batches):
        for run in _runs(batches, 3):
            ties = _tied(run, least)
            if ties:
                yield _binary_rows(u=[t[0] for t in ties], v=[t[1] for t in ties])

    return (
        dealt.repartition("at", "i", "j").sortWithinPartitions("at", "i", "j").mapInArrow(compare, "u binary, v binary").distinct()
    )


def _verified(batches, depth: int, threshold: Fraction):
    """Rows sorted by (group, i, j), one run of rows per pair of blocks."""
    held, key = [], None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            at = (row["group"], row["i"], row["j"])
            if at != key and held:
                out += _compared(held, key[1] == key[2], depth, threshold)
                held = []
            key = at
            held.append(row)
        yield _link_rows(out)
    if held:
        yield _link_rows(_compared(held, key[1] == key[2], depth, threshold))


def _link_rows(rows):
    columns = list(zip(*rows, strict=True)) or [[], [], [], [], []]
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64())
    names = ["u", "v", "links", "met", "pairs"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _compared(rows: list[dict], same: bool, depth: int, threshold: Fraction):
    """(node, the first node of its tie, links to copies, pairs that share a
    trie node, pairs that these stand for) of every node with a link in this
    pair of blocks."""
    rows = list({(r["_node"], r["block"]): r for r in rows}.values())  # a set's text may come twice
    rows.sort(key=lambda r: (r["block"], r["_node"]))
    n = len(rows)
    sets = [np.frombuffer(r["set"], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = counts > 1
    width = int(several.sum())
    number = np.cumsum(several) - 1
    keep = several[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common, linked = np.zeros((n, n), np.int32), np.zeros((n, n), bool)
    step = max(64, CELLS // n)
    # Whatever needs wider cells than these is made for a stripe of rows.
    stripe = max(1, CELLS // 4 // n)
    stripes = [slice(top, min(n, top + stripe)) for top in range(0, n, stripe)]
    for start in range(0, width, step):
        a, b = np.searchsorted(column, (start, start + step))
        part = np.zeros((n, min(step, width - start)), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        for at in stripes:
            common[at] += (part[at] @ part.T).astype(np.int32)
    for at in stripes:
        here = common[at].astype(np.int64)
        linked[at] = threshold.denominator * here >= threshold.numerator * (sizes[at, None] + sizes[None, :] - here)
    np.fill_diagonal(linked, False)
    if not same:
        block = np.array([r["block"] for r in rows])
        linked &= block[:, None] != block[None, :]
    if not linked.any():
        return []
    places = [np.unique([r["_paths"][t][: 2 * depth] for r in rows], return_inverse=True)[1] for t in range(TREES)]
    copies = np.array([r["copies"] for r in rows], np.int64)
    links, found, pairs = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    for at in stripes:
        links[at] = np.where(linked[at], copies[None, :], 0).sum(axis=1)
        met = np.zeros((at.stop - at.start, n), bool)
        for place in places:
            met |= place[at, None] == place[None, :]
        one, two = np.nonzero(linked[at] & met)
        one += at.start
        shared = common[one, two]
        stand_for = 1 / expected_recall(depth, shared / (sizes[one] + sizes[two] - shared))
        found += np.bincount(one, minlength=n)
        pairs += np.bincount(one, stand_for, n)
    root = np.arange(n)
    while True:
        near = [np.where(linked[at], root[None, :], n).min(axis=1) for at in stripes]
        lower = np.minimum(root, np.concatenate(near))
        lower = lower[lower]
        if (lower == root).all():
            break
        root = lower
    return [
        (rows[k]["_node"], rows[root[k]]["_node"], int(links[k]), int(found[k]), float(pairs[k])) for k in np.flatnonzero(links)
    ]


def block_counts(members: DataFrame, block_shingles: int = BLOCK_SHINGLES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``group, blocks``: so many that a block is bounded in shingles and rows."""
    parts = F.greatest(F.sum("_size") / block_shingles, F.count(F.lit(1)) / block_rows)
    return members.groupBy("group").agg(F.ceil(parts).cast("int").alias("blocks"))


def _links(docs: DataFrame, sets: DataFrame, depth: int, threshold: Fraction, block_shingles: int) -> DataFrame:
    """Verified links of every set, as sums and spanning ties."""
    groups = materialise(components(candidates(sets, depth, threshold)).withColumnsRenamed({"u": "_node", "component": "group"}), "groups")
    members = sets.join(groups, "_node")
    blocks = block_counts(members, block_shingles)
    wanted = members.join(blocks, "group").select("doc_id", "_text", "_node", "_paths", "copies", "group", "blocks")
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", raw_text().alias(RAW))
    texts = texts.withColumn("_text", F.xxhash64(RAW)).join(wanted, ["doc_id", "_text"])

    def prepare():
        return lambda raws: [pa.array([shingles(r).tobytes() for r in raws], pa.binary())]

    kept = ["_node", "_paths", "copies", "group", "blocks"]
    found = scan(texts.select(*kept, F.col(RAW).alias("text")), kept, [T.StructField("set", T.BinaryType())], prepare)
    found = found.withColumn("block", F.pmod(F.xxhash64("_node"), "blocks").cast("int"))
    dealt = found.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    keys = ["group", "i", "j"]
    return materialise(
        dealt.select(*keys, "block", "_node", "_paths", "copies", "set")
        .repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(
            lambda b: _verified(b, depth, threshold), "u binary, v binary, links bigint, met bigint, pairs double"
        ),
        "links",
    )


def classes(docs: DataFrame, threshold: Fraction = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) by ``doc_id, _text``: its
    ``class_id``, the smallest id that links reach, and ``n_links``, the other
    documents with a similarity of ``threshold`` or more. ``_first`` is the
    (doc_id, _text) that stands for its class."""
    marks = materialise(signed(docs), "signed")
    able = F.col("_node").isNotNull() & F.col("doc_id").isNotNull()
    sets = materialise(
        marks.where(able)
        .groupBy("_node")
        .agg(
            F.min(F.struct("doc_id", "_text")).alias("_one"),
            F.count(F.lit(1)).alias("copies"),
            F.first("_size").alias("_size"),
            F.first("_paths").alias("_paths"),
        )
        .select("_node", "_one.doc_id", "_one._text", "copies", "_size", "_paths"),
        "sets",
    )
    depth = first_depth(threshold)
    while True:
        links = _links(docs, sets, depth, threshold, block_shingles)
        pairs, met = links.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("met"), F.lit(0))).first()
        if met >= TARGET * pairs or depth == 1:
            break
        depth -= 1

    members = components(links).withColumnsRenamed({"u": "_node", "component": "_class"})
    counted = links.groupBy(F.col("u").alias("_node")).agg(F.sum("links").alias("_links"))
    nodes = (
        sets.select("_node", "copies", F.struct("doc_id", "_text").alias("_one"))
        .join(members, "_node", "left")
        .join(counted, "_node", "left")
        .withColumn("_class", F.coalesce("_class", "_node"))
    )
    firsts = nodes.groupBy("_class").agg(F.min("_one").alias("_first"))
    named = nodes.join(firsts, "_class").select(
        "_node", "_first", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return (
        marks.select("doc_id", "_text", F.when(F.col("doc_id").isNotNull(), F.col("_node")).alias("_node"))
        .join(named, "_node", "left")
        .select(
            "doc_id",
            "_text",
            F.coalesce(F.col("_first"), F.struct("doc_id", "_text")).alias("_first"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
        .withColumn("class_id", F.col("_first.doc_id"))
    )


def linked(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links`` of every document."""
    return classes(docs.select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def representatives(docs: DataFrame) -> DataFrame:
    """The documents with one of each class, that of the smallest id; of rows
    that repeat it with the same text, one. Texts without words and rows with
    a null id all stay."""
    firsts = classes(docs.select("doc_id", "text")).select(
        F.col("_first.doc_id").alias("_id"), F.col("_first._text").alias("_text")
    ).where("_id IS NOT NULL").distinct()
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]") & F.col("doc_id").isNotNull()
    rest = docs.where(~has_words)
    one = docs.where(has_words).withColumn("_burrow_text", F.xxhash64(raw_text()))
    kept = one.join(firsts, (F.col("doc_id") == F.col("_id")) & (F.col("_burrow_text") == firsts["_text"]))
    again = Window.partitionBy("_id", firsts["_text"]).orderBy(F.lit(1))
    return (
        kept.withColumn("_burrow_nth", F.row_number().over(again))
        .where("_burrow_nth = 1")
        .select(*[F.col(f"`{c}`") for c in docs.columns])
        .unionByName(rest)
    )
