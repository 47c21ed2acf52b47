"""Token counts, importance resampling and reversed search against plain Python."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from burrow.llm import item_search, queries, resampling, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


# Token counts


def test_pre_tokens_add_up_to_the_library(library):
    measure, draw = token_counts.measure_of(MODEL), random.Random(4)
    alphabet = [" ", " ", "\n", "▁", "a", "b", "the", "é", "日", "\r", "\t", "\x00", "<s>", "<0x0A>", "👍", "​", ".", "1", " "]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(14))) for _ in range(6_000)]
    for text in texts:
        assert sum(map(measure, token_counts.pre_tokens(text.encode()))) == len(library.encode(text)), repr(text)


@pytest.mark.parametrize("entries", [0, 3, token_counts.FREQUENT])
def test_counts_equal_the_library_whatever_the_table(spark, odd, library, entries):
    got = token_counts.counted(odd, MODEL, keep=["doc_id", "text"], entries=entries).collect()
    assert len(got) == odd.count()
    for row in got:
        text = row.text or ""
        n = len(library.encode(text))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 4096)


def test_counts_of_given_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: len(library.encode(r.text or "")) for r in docs.collect()}
    got = queries.QUERIES["op13_token_counts"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert {r.doc_id: r.n_tokens for r in got.collect()} == want


def test_tables_stay_within_their_bounds(documents, monkeypatch):
    docs = documents([(k, " ".join(f"w{k}x{j}" for j in range(200)) + " often" * 9 + " " + "y" * 100) for k in range(40)])
    words, tokens = token_counts.frequent_lengths(docs, MODEL, entries=7)
    assert len(tokens) == 7 and b"often" in words.split(b"\0") and b"y" * 100 not in words
    assert token_counts.summaries(docs.coalesce(1), size=50).count() == 50
    monkeypatch.setattr(token_counts, "COUNTED", 300)  # forgetting rare pre-tokens keeps the common ones
    assert b"often" in {bytes(r.word) for r in token_counts.summaries(docs.coalesce(1), size=50).collect()}
    lengths = token_counts.Lengths((words, tokens), token_counts.measure_of(MODEL))
    assert lengths[b"z" * 100] > 0 and b"z" * 100 not in lengths.cache


def test_counts_of_nothing(none_at_all):
    assert token_counts.counted(none_at_all, MODEL).collect() == []


# Importance resampling


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resampling(docs, target):
    def buckets(text):
        return [zlib.crc32(f.encode()) % 10_000 for f in plain_features(text)[1]]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text))
    for text in target:
        t.update(buckets(text))
    all_s, all_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log(float(t[b] + 1) * (all_s + 10_000) / (float(s[b] + 1) * (all_t + 10_000))))

    rows = []
    for doc_id, text in docs:
        found = buckets(text)
        weight = sum(map(gain, found))
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, len(plain_features(text)[0]) >= 20])
    may = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(may[: 5 * len(may) // 100])}
    return Counter((*r[:4], ranks.get(id(r))) for r in rows)


def test_resampling_equals_plain_python(spark):
    docs, target = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_resampling([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    got = queries.QUERIES["op12_importance_resampling"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and set(dict(got.dtypes).values()) == {"bigint"}
    assert Counter(map(tuple, got.collect())) == want
    assert sum(n for row, n in want.items() if row[4] is not None) > 5


def test_resampling_of_odd_rows(odd, spark):
    target = spark.createDataFrame([(1, "same text of"), (2, None), (3, "")], "item_id bigint, text string")
    want = plain_resampling([(r.doc_id, r.text) for r in odd.collect()], ["same text of"])
    got = resampling.resampled(odd, target)
    assert Counter(map(tuple, got.drop("rank").collect())) == Counter(x[:4] for x in want.elements())
    assert got.where("rank IS NOT NULL").count() == 0  # five of a hundred of the two long ones


def test_ranks_are_dense_with_many_equal_rows(spark):
    rows = [(7, 30, 90, 5)] * 300 + [(k, 30, 90, k % 50) for k in range(700)] + [(9, 3, 3, 10_000)] * 50
    weights = spark.createDataFrame(rows, "doc_id bigint, n_words bigint, n_features bigint, weight bigint").repartition(5)
    got = resampling.drawn(weights, per_cent=40)
    ranked = got.where("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 401)) and got.count() == 1_050
    keys = [(-r.score, r.doc_id) for r in ranked]
    assert keys == sorted(keys) and all(r.n_words == 30 for r in ranked)
    left = got.where("rank IS NULL AND n_words >= 20").agg(F.max("score")).first()[0]
    assert left <= ranked[-1].score


def test_resampling_of_nothing(none_at_all, documents, spark):
    target = spark.createDataFrame([], "item_id bigint, text string")
    assert resampling.resampled(none_at_all, target).collect() == []
    docs = [(k, "some words " * 15) for k in range(40)]
    got = resampling.resampled(documents(docs), target)
    assert Counter(map(tuple, got.collect())) == plain_resampling(docs, [])


def test_kernels_take_slices_of_bounded_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(resampling, "BATCH_BYTES", 100)
    texts = ["a" * 60, None, "b" * 60, "c" * 300, "", "d", "e"]
    parts = list(resampling.slices(pa.record_batch([pa.array(texts)], names=["t"]), 0))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts
    assert [p.num_rows for p in parts] == [2, 1, 1, 3]
    sums = resampling.Features(parts[0].column(0).fill_null("")).sums(pa.array([1] * 10_000))
    assert [x.tolist() for x in sums] == [[1, 0], [1, 0], [1, 0]]


# Reversed search


def plain_search(docs, items, k=10):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    asked: dict = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    found = []
    for item, words in asked.items():
        scores = []
        for d, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * n_docs) // length
            score = 0
            for w in words & b.keys():
                idf = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                score += idf * ((1_000_000_000 * b[w]) // (1000 * b[w] + 8 * m))
            if score > 0 and d is not None:
                scores.append((-score, d))
        found += [(item, r + 1, d, -s) for r, (s, d) in enumerate(heapq.nsmallest(k, scores))]
    return sorted(found)


def test_search_equals_plain_python_in_one_block_and_many(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted(map(tuple, queries.QUERIES["op11_reversed_search"](spark, "/root/testdata/sf0.001").collect())) == want
    monkeypatch.setattr(item_search, "CELLS", 30)
    spread = docs.repartition(7)
    assert sorted(map(tuple, item_search.best_documents(spread, items, postings=400).collect())) == want
    assert sorted(map(tuple, item_search.best_documents(spread, items, most_items=9).collect())) == want


def test_search_of_odd_rows(odd, spark):
    items = [(1, "SAME text, same words! É́ 日本語"), (1, "long"), (2, None), (3, ""), (4, "nowhere"), (None, "word"), (5, "word")]
    table = spark.createDataFrame([(*r, 0) for r in items], "item_id bigint, text string, score int")
    want = plain_search([(r.doc_id, r.text) for r in odd.collect()], items)
    got = sorted(map(tuple, item_search.best_documents(odd, table).collect()))
    assert got == want and {r[0] for r in got} == {1, 5}


def test_ties_and_repeated_documents(documents, spark):
    rows = [(k % 12, "alpha beta") for k in range(40)] + [(100, "gamma")] * 70
    items = [(1, "alpha"), (2, "beta alpha gone")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(map(tuple, item_search.best_documents(documents(rows).repartition(6), table).collect()))
    assert got == plain_search(rows, items) and [r[2] for r in got[:5]] == [0, 0, 0, 0, 1]


def test_search_without_documents_or_items(none_at_all, odd, spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "word")], "item_id bigint, text string")
    assert item_search.best_documents(none_at_all, some).collect() == []
    assert item_search.best_documents(odd, none).collect() == []
    assert item_search.best_documents(odd.where("text IS NULL"), some).collect() == []
