import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from burrow.llm import bpe, common, fertility, packing
from burrow.llm.tokens import library_words
from tests.llm.conftest import ODD

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PARTS = [
    "a", "b", "S", "'s", "'", " ", "  ", "\n", "\t", "!", ".", "?", ",", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "é", "É",
    "ñ", "1", "½", "　", "日", "x́", "\x1f", "\x85", "٣", "ß", "İ", "K", "Å", "Σ", "ς", "ﬁ", "́", "’", "the", "tion",
]


def texts(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 25))) for _ in range(n)]


def test_word_ids_equal_the_library():
    library, known = Tokenizer.from_file(WORD), library_words(WORD, 200)
    for text in texts(4000, 1):
        ids = b"".join(map(known.__getitem__, text.encode().split()))
        assert np.frombuffer(ids, np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_byte_pair_encoding_equals_the_library():
    library, own = Tokenizer.from_file(BYTE), bpe.ByteBpe(BYTE)
    encoder = bpe.BatchEncoder(own, limit=100)
    found = texts(4000, 2)
    for at in range(0, len(found), 100):
        part = found[at : at + 100]
        for text, ids in zip(part, encoder.encode(part), strict=True):
            ids = np.frombuffer(ids, np.uint32).tolist()
            assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
            assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_compatibility_is_that_of_merging():
    own, draw = bpe.ByteBpe(BYTE), random.Random(3)
    assert own.reachable.all()
    pairs = np.array([(draw.randrange(20_000), draw.randrange(20_000)) for _ in range(4000)])
    want = [own.merged(own.bytes_of[a] + own.bytes_of[b]) == [a, b] for a, b in pairs]
    assert own.compatible(pairs[:, 0], pairs[:, 1]).tolist() == want
    words = [bytes(draw.choice(b"abcdeinrst ") for _ in range(draw.randint(1, 150))) for _ in range(300)]
    assert own.encode_words(words) == [own.merged(w) for w in words]


def test_round_trip_of_odd_rows(spark, odd, none_at_all):
    library = Tokenizer.from_file(BYTE)
    got = Counter(map(tuple, bpe.round_trip(odd, BYTE).collect()))
    want = Counter()
    for doc_id, text in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), back.encode())]
        want[doc_id, len(ids), *digests] += 1
    assert got == want
    assert bpe.round_trip(none_at_all, BYTE).count() == 0
    assert {r.doc_id: len(r.ids) for r in bpe.encoded(odd, BYTE).collect()}[4] == 1


def check_bins(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_plan_places_every_piece():
    draw = random.Random(4)
    for _ in range(200):
        capacity = draw.choice([3, 10, 30, 97])
        counts = Counter(draw.randint(1, capacity) for _ in range(draw.randint(0, 200)))
        runs, made = packing.plan(dict(counts), capacity)
        bins, seen = defaultdict(list), Counter()
        for length, rank, n, sequence, place in runs:
            assert rank == seen[length]
            seen[length] += n
            for k in range(n):
                bins[sequence + k].append((place, length))
        assert seen == counts and sorted(bins) == list(range(made))
        for places in bins.values():
            ends = [p + n for p, n in sorted(places)]
            assert [p for p, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= capacity


def test_large_pieces_are_matched():
    runs, made = packing.plan({60: 2, 40: 2, 35: 1, 20: 1}, 100)
    assert made == 3  # 60+40, 60+40, 35+20


def test_packing_of_odd_rows(spark, odd, none_at_all):
    library = Tokenizer.from_file(WORD)
    rows = packing.packed_documents(odd, WORD).collect()
    want = Counter()
    for doc_id, text in ODD:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_bins(rows, 4096)
    assert packing.packed_documents(none_at_all, WORD).count() == 0


def test_packing_is_tight_and_ranks_in_parts(spark, sample):
    found = packing.pieces(sample("documents"), lambda: library_words(WORD), 1)
    one, many = (packing.pack(found, ranked_rows=n).collect() for n in (10**6, 20))
    assert check_bins(one, 4096) == check_bins(many, 4096) <= 1.02 * sum(r.length for r in one) / 4096 + 1


def brute_base(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def test_base_rules_equal_brute_force(spark, odd, none_at_all, sample):
    for docs, rows in ((odd, ODD), (sample("documents"), [(r.doc_id, r.text) for r in sample("documents").collect()])):
        judged = fertility.judged(docs, BYTE, PIECE).collect()
        base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
        assert Counter(tuple(r[c] for c in base) for r in judged) == Counter((i, *brute_base(t)) for i, t in rows)
        assert not any(r.kept and r.base_failed for r in judged)
    assert fertility.judged(none_at_all, BYTE, PIECE).count() == 0


def test_fertility_bands_reject_outliers(spark, documents):
    draw = random.Random(5)
    plain = [(i, " ".join(draw.choice(["apple", "river", "stone", "walk", "green", "window"]) + str(draw.randint(0, 99)) for _ in range(60))) for i in range(80)]
    odd = (900, " ".join("ᚠᚡᚢ" + chr(0x16A0 + draw.randint(0, 60)) for _ in range(60)))
    got = {r.doc_id: r for r in fertility.judged(documents([*plain, odd]), BYTE, PIECE).collect()}
    assert all(got[i].kept for i, _ in plain)
    assert not got[900].base_failed and not got[900].kept and got[900].fallback_share > 0.3


def test_fertility_bands_reject_junk_of_common_and_rare_languages(spark, documents):
    draw = random.Random(6)

    def text(top, n=60):
        words = ["apple", "river", "stone", "walk", "green", "window", "table", "house"]
        return " ".join(draw.choice(words) + str(draw.randint(0, top)) for _ in range(n))

    # Junk has shorter tokens than the rest, by an eighth.
    rows = [(i, text(99)) for i in range(300)]
    junk = [(900, text(9)), (901, text(9), "xx"), (902, text(9), None)]
    rare = [(910, rows[0][1] + "a", "xx"), (911, rows[1][1] + "a", None)]
    got = {r.doc_id: r for r in fertility.judged(documents([*rows, *junk, *rare]), BYTE, PIECE).collect()}
    assert sum(got[i].kept for i, _ in rows) >= 294 and got[910].kept and got[911].kept
    for i in (900, 901, 902):
        assert not got[i].base_failed and not got[i].kept, got[i]


@pytest.mark.parametrize("raw, script", [("plain", "latin"), ("слово", "cyrillic"), ("日本語", "east_asian"), ("λόγος", "greek"), ("..", "none")])
def test_scripts(raw, script):
    assert fertility.script_of(np.bincount(np.frombuffer(raw.encode(), np.uint8), minlength=256)) == script


def brute_measures(text):
    """Characters per token, byte-fallback share and entropy of one text's words."""
    import sentencepiece

    library, pieces = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    library.encode_special_tokens = True
    words = (text or "").encode().split()
    tokens = sum(len(library.encode(" " + w.decode(), add_special_tokens=False).ids) for w in words)
    ids = Counter(i for w in words for i in pieces.encode(w.decode()))
    total = sum(ids.values())
    entropy = -sum(n / total * np.log2(n / total) for n in ids.values())
    chars = sum(len(w.decode()) for w in words)
    return tokens, chars / max(tokens, 1), sum(n for i, n in ids.items() if pieces.is_byte(i)) / max(total, 1), entropy


@pytest.mark.parametrize("vocabulary", [BYTE, public_tokenizers.path("byte_bpe_50k.tiktoken")])
def test_measures_equal_brute_force_in_batches(spark, odd, sample, vocabulary, monkeypatch):
    rows = [(r.doc_id, r.text) for r in sample("documents").collect()][:60] + ODD
    monkeypatch.setattr(fertility, "KNOWN", 500)  # the worker forgets between batches
    words = fertility.Words(vocabulary, PIECE)
    for size in (1, 7, 200):
        got = []
        for at in range(0, len(rows), size):
            texts = [(t or "").encode() for _, t in rows[at : at + size]]
            got += list(zip(*fertility.measures_of(texts, words), strict=True))
        for (_, text), row in zip(rows, got, strict=True):
            assert tuple(row[:5]) == brute_base(text)[:5]
            assert tuple(row[5:9]) == pytest.approx(brute_measures(text))


def test_kept_equals_brute_force(spark, sample):
    """Bands of the commonest language from all of its documents' quartiles."""
    docs = sample("documents").where("lang = 'en'")
    judged = [r for r in fertility.judged(docs, BYTE, PIECE).collect()]
    good = [r for r in judged if not r.base_failed]
    sizes = {r.doc_id: int(np.log2(max(r.n_tokens, 1))) for r in good}
    number = Counter(sizes.values())
    checked = 0
    for r in good:
        if number[sizes[r.doc_id]] < fertility.ENOUGH:
            continue
        inside = True
        for c in fertility.BANDED:
            values = [round(x[c], fertility.DIGITS) for x in good if sizes[x.doc_id] == sizes[r.doc_id]]
            low, mid, high = np.percentile(values, [25, 50, 75])
            least = fertility.LEAST[c] * (1 if c == "fallback_share" else mid)
            inside &= mid - max(4 * (mid - low), least) <= r[c] <= mid + max(4 * (high - mid), least)
        assert r.kept == inside
        checked += 1
    assert checked > 30


def test_a_language_has_bands_of_its_own_among_many(spark, documents):
    rows = [(k, " ".join(f"w{(k * j) % 97}" for j in range(40)), f"l{k % 1100}") for k in range(1100)]
    rows += [(5000 + k, " ".join(f"{'ab' * (j % 5 + 3)}{k}x{j}" for j in range(40)), "rare") for k in range(fertility.ENOUGH)]
    got = fertility.judged(documents(rows), BYTE, PIECE).where("doc_id >= 5000").collect()
    assert len(got) == fertility.ENOUGH and sum(r.kept for r in got) >= fertility.ENOUGH - 3


def test_batches_are_small_and_smaller_settings_stay(spark, documents):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows = documents([(k, "a b c") for k in range(3000)]).coalesce(1)

    def largest():
        kind = T.StructField("n", T.LongType())
        seen = common.scan(rows, [], [kind], lambda: lambda texts: [pa.array([len(texts)] * len(texts))])
        return seen.agg(F.max("n"), F.count("n")).first()

    try:
        for value, after in (("10000", str(common.BATCH)), ("0", str(common.BATCH)), ("100", "100")):
            spark.conf.set(key, value)
            assert tuple(largest()) == (min(common.SLICE, int(after)), 3000)
            assert spark.conf.get(key) == after
    finally:
        spark.conf.set(key, before)
