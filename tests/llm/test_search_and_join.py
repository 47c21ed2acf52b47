import math
import random
import tracemalloc
from collections import Counter
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from burrow.llm import bm25, forest_join
from burrow.operators.stars import linked_components as components
from tests.llm.conftest import ODD

WORDS = [f"w{i}" for i in range(60)]


def brute_top(rows, queries, k):
    docs = sorted((i, t or "") for i, t in rows if i is not None)
    bags = [(i, Counter(w.decode() for w in bm25.words_of(t.encode()))) for i, t in docs]
    whole = [Counter(bm25.words_of((t or "").encode())) for _, t in rows]
    n, mean = len(rows), sum(map(lambda c: sum(c.values()), whole)) / max(1, len(rows))
    df = Counter(w.decode() for c in whole for w in c)
    out = Counter()
    for qid, text in set(queries):
        terms = {w.decode() for w in bm25.words_of((text or "").encode())}
        scored = []
        for i, bag in bags:
            norm = bm25.K1 * (1 - bm25.B + bm25.B * sum(bag.values()) / mean)
            units = 0
            for t in terms & bag.keys():
                idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1)
                units += round(idf * (bag[t] * (bm25.K1 + 1) / (bag[t] + norm)) * bm25.UNIT)
            if units:
                scored.append((-units, i))
        out.update((qid, r + 1, i, -u) for r, (u, i) in enumerate(sorted(scored)[:k]))
    return out


@pytest.mark.parametrize("shard_words", (200, 10**6))
def test_top_k_equals_brute_force(spark, documents, shard_words):
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choices(WORDS, weights=range(1, 61), k=draw.randint(1, 40)))) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(5)] + [(500, None), (501, "")]
    docs = documents(rows)
    queries = [r for r in rows if r[0] % 20 == 0 or r[0] > 399]
    got = bm25.top_k(docs, docs.where("doc_id % 20 = 0 or doc_id > 399"), 4, shard_words).collect()
    assert Counter((r.query_id, r["rank"], r.doc_id, round(r.score * bm25.UNIT)) for r in got) == brute_top(rows, queries, 4)


def ranking(found):
    return Counter((r.query_id, r["rank"], r.doc_id, round(r.score * bm25.UNIT)) for r in found.collect())


def test_search_of_odd_rows(spark, odd, none_at_all):
    rows = [r[:2] for r in ODD]
    asked = [r for r in rows if r[0] is not None]
    assert ranking(bm25.top_k(odd, odd.where("doc_id IS NOT NULL"), 3)) == brute_top(rows, asked, 3)
    assert len(rows) == odd.count()
    assert bm25.top_k(none_at_all, none_at_all, 3).count() == 0


def test_repeated_rows_are_documents_of_their_own(spark, documents):
    rows = [(1, "alpha beta"), (2, "beta gamma gamma"), (3, "beta beta delta"), (4, "delta"), (5, "gamma")]
    for many in ([], [rows[1]] * 3, [rows[2]] * 5):
        docs = documents([*rows, *many])
        for shard_words in (4, 10**6):
            got = ranking(bm25.top_k(docs, docs.where("doc_id <= 2"), 4, shard_words))
            assert got == brute_top([*rows, *many], [*rows[:2], *many[:1]] if many[:1] == rows[1:2] else rows[:2], 4)


def test_pruning_keeps_the_best(spark):
    draw = random.Random(2)
    texts = [" ".join(draw.choices(WORDS, weights=[1 / (k + 1) for k in range(60)], k=30)).encode() for _ in range(1000)]
    shard = bm25.Shard(list(range(1000)), texts, 30.0)
    for query in texts[::50]:
        words = sorted(set(bm25.words_of(query)))
        idf = [1.0 + (len(w) % 3) for w in words]
        ids, units = shard.best(words, idf, 5)
        every, all_units = shard.best(words, idf, 1000)
        best = sorted(zip(-all_units, every, strict=True))[:5]
        assert sorted(zip(-units, ids, strict=True)) == best


def test_queries_are_sent_in_blocks_and_a_task_hands_on_k_a_query(spark, documents, monkeypatch):
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choices(WORDS, k=draw.randint(1, 30)))) for i in range(200)]
    docs = documents(rows)
    sent = []
    made = bm25.Asked.__init__
    monkeypatch.setattr(bm25.Asked, "__init__", lambda self, table: made(self, table) or sent.append(len(self.numbers)))
    asked = [r for r in rows if r[0] % 10 == 0]
    got = ranking(bm25.top_k(docs, docs.where("doc_id % 10 = 0"), 3, 300, postings=60))
    assert got == brute_top(rows, asked, 3) and len(sent) > 3 and max(sent) < sum(sent)
    monkeypatch.setattr(bm25, "QUERIES", 12)
    assert ranking(bm25.top_k(docs, docs.where("doc_id % 10 = 0"), 3, 300, postings=60)) == got
    words = sorted({w for _, t in asked for w in bm25.words_of(t.encode())})
    terms = [[{"word": w, "idf": 1.0 + words.index(w) % 3} for w in sorted(set(bm25.words_of(t.encode())))] for _, t in asked]
    kind = pa.list_(pa.struct([("word", pa.binary()), ("idf", pa.float64())]))
    table = pa.table({"doc_id": [i for i, _ in asked], "query_text": [0] * len(asked), "terms": pa.array(terms, kind)})
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "raw": [t.encode() for _, t in rows]})
    found = [
        Counter(zip(*[c.to_pylist() for c in part.columns], strict=True))
        for words in (100, 10**6)
        for part in bm25._searched(iter([batch]), [SimpleNamespace(value=bm25.Asked(table))], 3, 15.0, words)
    ]
    assert len(found) == 2 and found[0] == found[1] and sum(found[0].values()) == 3 * len(asked)


def brute_links(rows, threshold=Fraction(4, 5)):
    sets = []
    for i, text in rows:
        words = (text or "").encode().split()
        few = {tuple(words)} if words else set()
        sets.append((i, {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or few))
    links, root = Counter(), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            one, two = sets[a][1], sets[b][1]
            if one and two and None not in (sets[a][0], sets[b][0]) and len(one & two) >= threshold * len(one | two):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        least[r] = i if least.get(r) is None else min(least[r], i) if i is not None else least[r]
    return Counter((i, least[find(k)], links[k]) for k, (i, _) in enumerate(sets))


def copies(seed, base_words=80, groups=12, many=25):
    """Groups of exact and near copies, one of them large, and lone texts."""
    draw = random.Random(seed)
    rows, doc = [], 0
    for g in range(groups):
        base = [f"{draw.randint(0, 10**6):x}" for _ in range(base_words)]
        for k in range(many * 4 if g == 0 else draw.randint(1, 6)):
            words = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 5])):
                words[draw.randrange(len(words))] = f"z{draw.randint(0, 10**6)}"
            rows.append((doc, " ".join(words)))
            doc += 1
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", (400, 400_000))
def test_links_equal_brute_force(spark, documents, block):
    rows = copies(3)
    got = forest_join.classes(documents(rows).select("doc_id", "text"), block_shingles=block)
    assert Counter(map(tuple, got.select("doc_id", "class_id", "n_links").collect())) == brute_links(rows)


def test_links_of_odd_rows(spark, odd, none_at_all):
    got = Counter(map(tuple, forest_join.linked(odd).collect()))
    want = brute_links([r[:2] for r in ODD])
    assert got == want
    assert forest_join.linked(none_at_all).count() == 0
    kept = forest_join.representatives(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[9] == 1 and ids[10] == 1 and ids[None] == 1 and ids[1] == ids[2] == ids[3] == 1
    assert forest_join.representatives(none_at_all).count() == 0


def test_recall_grows_as_the_prefix_shrinks():
    recalls = [forest_join.expected_recall(d, 0.8) for d in range(forest_join.LEVELS, 0, -1)]
    assert recalls == sorted(recalls) and recalls[-1] > forest_join.START


def pair_at_the_threshold(draw):
    """Two sets of 90 shingles with 80 in common, so that 80 of 100 agree."""
    every = np.array([draw.getrandbits(64) for _ in range(100)], np.uint64)
    return np.sort(every[:90]), np.sort(every[10:])


def test_no_isolated_link_at_the_threshold_is_lost():
    draw = random.Random(7)
    depth = forest_join.first_depth()
    for _ in range(4000):
        one, two = map(forest_join.paths, pair_at_the_threshold(draw))
        assert any(a[: 2 * depth] == b[: 2 * depth] for a, b in zip(one, two, strict=True))


def test_links_that_share_no_prefix_are_estimated():
    draw = random.Random(8)
    while True:
        sets = pair_at_the_threshold(draw)
        ways = list(map(forest_join.paths, sets))
        if any(a == b for a, b in zip(*ways, strict=True)):
            break
    rows = [{"_node": b"%d" % k, "block": 0, "set": s.tobytes(), "copies": 1, "_paths": w} for k, (s, w) in enumerate(zip(sets, ways, strict=True))]
    found = forest_join._compared(rows, True, 8, forest_join.THRESHOLD)
    assert [r[2:4] for r in found] == [(1, 1)] * 2
    assert [r[4] for r in found] == pytest.approx([1 / forest_join.expected_recall(8, 0.8)] * 2)


def test_blocks_of_short_texts_are_bounded(spark):
    members = spark.range(5000).select(F.lit("one").alias("group"), F.lit(10).cast("long").alias("_size"))
    assert [tuple(r) for r in forest_join.block_counts(members).collect()] == [("one", 3)]
    # All pairs of 3,000 near copies, without wide n x n matrices.
    many = np.arange(10, dtype=np.uint64)
    way = forest_join.paths(many)
    rows = [{"_node": b"%06d" % k, "block": 0, "set": np.append(many, np.uint64(100 + k)).tobytes(), "copies": 1, "_paths": way} for k in range(3000)]
    tracemalloc.start()
    found = forest_join._compared(rows, True, 3, forest_join.THRESHOLD)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r[:4] for r in found] == [(b"%06d" % k, b"000000", 2999, 2999) for k in range(3000)]
    print("peak MB", peak >> 20)
    assert peak < 150 << 20


def test_trie_nodes_over_partition_borders(spark, documents):
    rows = [(i, "one and the same long text for all of them " + ("x " if i % 2 else "y ")) for i in range(60)]
    marks = forest_join.signed(documents(rows)).where("_node IS NOT NULL").withColumnRenamed("_text", "t")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ties = forest_join.candidates(marks.dropDuplicates(["_node"]), 1)
        assert ties.where("u = v").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # One trie node in three partitions, a lone set at either end of one.
    parts = [[(b"aa", 1), (b"ab", 2)], [(b"ab", 3)], [(b"ab", 4), (b"ac", 5), (b"ad", 6), (b"ad", 7), (b"ae", 8)]]
    got = []
    for part in parts:
        table = pa.RecordBatch.from_arrays(
            [pa.array([0] * len(part)), pa.array([p for p, _ in part], pa.binary()), pa.array([b"%d" % n for _, n in part], pa.binary())],
            names=["tree", "path", "_node"],
        )
        # Every row a batch of its own.
        batches = (table.slice(k, 1) for k in range(table.num_rows))
        got += [r["_node"] for out in forest_join._shared(batches, 1) for r in out.to_pylist()]
    assert sorted(got) == [b"1", b"2", b"3", b"4", b"6", b"7", b"8"]


def test_signatures_at_the_threshold_agree():
    least = forest_join.least_agreement()
    assert 60 < least < 80
    assert forest_join.least_agreement(Fraction(9, 10)) > least > forest_join.least_agreement(Fraction(1, 2))
    draw = random.Random(9)
    for _ in range(3000):
        one, two = (np.frombuffer(b"".join(forest_join.paths(s)), np.uint16) for s in pair_at_the_threshold(draw))
        assert (one == two).sum() >= least


def sharing_a_passage(many, words, common, seed):
    draw = random.Random(seed)
    passage = [f"p{k}" for k in range(common)]
    return [(i, " ".join(passage + [f"{draw.getrandbits(40):x}" for _ in range(words - common)])) for i in range(many)]


def test_texts_that_share_a_passage_make_no_group(documents):
    # A third of 300 words in common: a similarity of about 0.2 everywhere.
    rows = sharing_a_passage(1000, 300, 100, 11)
    sets = forest_join.signed(documents(rows)).withColumn("copies", F.lit(1)).persist()
    depth = forest_join.first_depth()
    trie_nodes = sets.select(F.posexplode("_paths").alias("tree", "path"), "_node").groupBy(
        "tree", F.substring("path", 1, 2 * depth)
    ).count()
    assert trie_nodes.agg(F.max("count")).first()[0] > 5
    assert forest_join.candidates(sets, depth).count() == 0
    # A low threshold asks for such pairs, and cut trie nodes find the same groups.
    low = Fraction(1, 10)
    whole, cut = (
        Counter(map(tuple, components(forest_join.candidates(sets, depth, low, n)).collect())) for n in (4000, 7)
    )
    assert whole == cut and whole


def test_recall_of_near_copies(documents):
    # Pairs of 0.80 to 0.85 in a crowd that shares a passage.
    rows, pairs = sharing_a_passage(300, 200, 60, 12), []
    draw = random.Random(13)
    for k in range(300):
        words = rows[k][1].split()
        # A word in the middle changed costs five shingles of 196 on each side.
        for at in draw.choice([(70, 80, 90, 100), (70, 90, 110), (120, 150, 180)]):
            words[at] = f"n{draw.getrandbits(40):x}"
        rows.append((1000 + k, " ".join(words)))
        pairs.append((k, 1000 + k))
    got = {r.doc_id: r.class_id for r in forest_join.linked(documents(rows)).collect()}
    want = {i: (c, n) for i, c, n in brute_links(rows)}
    close = [(a, b) for a, b in pairs if want[b][0] == a]
    assert len(close) == 300
    assert sum(got[b] == a for a, b in close) >= 0.99 * len(close)
    assert all(got[i] == i for i, (c, n) in want.items() if not n)


def test_components(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(120), draw.randrange(120)) for _ in range(90)] + [(None, 3), (5, 5), (7, 8), (8, 7)]
    edges += [(1000 - k, 999 - k) for k in range(200)]
    got = {r.u: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for n in near[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        assert got[node] == min(seen)
    assert got.keys() == near.keys()
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0
