"""Tokenizers against their libraries, packing and sharding against their rules."""

import collections
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.samples import documents, no_documents, odd_documents, odd_rows, prose
from wayfare.llm import bpe, packing, sharding, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def strange_texts(n=1500):
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "▁", "<s>", "</s>", "<|startoftext|>"]
    parts += ["<|endoftext|>", "<0x0A>", "'s", "'RE", "a", "B", "é", "é", "Σ", "ς", "İ", "ß", "日本", "한", "😀"]
    parts += ["1", "２", "½", "...", "!!", "_", "\x00", "ﬁ", " ", "　", "क्षि", "Ⅷ", "the", "tion", "Ⱥ", "K"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]
    return texts + ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0xD800)])) for _ in range(8)) for _ in range(n)]


def test_bpe_equals_the_library():
    coder, library = bpe.Coder(WORDS), Tokenizer.from_file(WORDS)
    for text in strange_texts() + [prose(1, 2000)]:
        parts = coder.encode(text)
        ids = np.frombuffer(b"".join(p[0] for p in parts), "<u4")
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
        shown = library.decode(ids.tolist(), skip_special_tokens=False)
        assert coder.decode(ids) == shown == " ".join(p[1] for p in parts)


def test_no_merge_crosses_a_forced_boundary():
    coder = bpe.Coder(WORDS)
    whole = Tokenizer.from_file(WORDS)
    for word in ["\x7fx\x7f", "ñandú", "naïveté", "日本語", "😀😀", "....,,,,"]:
        for pre in coder.pre_tokens(word):
            symbols = pre.encode().decode("latin-1").translate(coder.table)
            cuts = list(coder.cuts(symbols))
            assert "".join(c for c, _ in cuts) == symbols and [last for _, last in cuts] == [False] * (len(cuts) - 1) + [True]
            assert [i for c in cuts for i in coder.merge(*c)] == whole.encode(pre, add_special_tokens=False).ids


def test_bounded_tables_change_nothing():
    small, large = bpe.Coder(WORDS, rows=5), bpe.Coder(WORDS)
    counts = token_counts.PieceCounts(PIECES, rows=5)
    for text in strange_texts(100):
        assert [p[0] for p in small.encode(text)] == [p[0] for p in large.encode(text)]
        assert counts.counts([text]) == token_counts.PieceCounts.counts(token_counts._model(PIECES), [text])


def test_bpe_rows(spark):
    library = Tokenizer.from_file(WORDS)
    rows = bpe.digests(odd_documents(spark), WORDS).collect()
    expected = []
    for r in odd_rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        expected.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(expected, key=repr)
    assert bpe.digests(no_documents(spark), WORDS).collect() == []
    texts = bpe.decode(bpe.encode(odd_documents(spark), WORDS), WORDS)
    digests = {(r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in texts.collect()}
    assert digests == {(e[0], e[3]) for e in expected}


def test_piece_counts_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = strange_texts() + [prose(1, 2000), " ", "a ", "  a", "\n a \n"]
    assert token_counts.PieceCounts(PIECES).counts(texts) == [len(library.encode(t)) for t in texts]


def test_token_count_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.token_counts(odd_documents(spark), PIECES, limit=100)
    expected = [(r[0], len((r[1] or "").encode()), n, n > 100) for r in odd_rows() for n in [len(library.encode(r[1] or ""))]]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert token_counts.token_counts(no_documents(spark), PIECES).collect() == []


# Packing -----------------------------------------------------------------------------------------


def check_placed(pieces, lengths):
    """Pieces (length, bin, capacity, offset): no overlap, no overflow, least capacity."""
    bins = collections.defaultdict(list)
    for length, bin_, capacity, offset in pieces:
        bins[bin_].append((offset, length, capacity))
    for held in bins.values():
        held.sort()
        at = 0
        for offset, length, capacity in held:
            assert offset == at
            at += length
        assert {c for _, _, c in held} == {min(x for x in lengths if x >= at)}
    return sum(held[0][2] for held in bins.values())


@pytest.mark.parametrize("seed", range(5))
def test_packing_is_tight(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(rng.geometric(1 / 700, 3000), 8192)
    bins, capacity, offsets = packing.pack(sizes)
    used = check_placed(zip(sizes.tolist(), bins.tolist(), capacity.tolist(), offsets.tolist()), packing.LENGTHS)
    assert used <= 1.02 * sizes.sum() + max(packing.LENGTHS)


def test_packing_by_hand():
    bins, capacity, offsets = packing.pack(np.array([3, 5, 5, 3]), (4, 8), 0)
    assert bins.tolist() == [0, 0, 1, 1] and capacity.tolist() == [8] * 4 and offsets.tolist() == [5, 0, 0, 5]
    assert packing.pack(np.array([3]), (4, 8))[1].tolist() == [4]  # shrinks to what it holds
    assert [len(x) for x in packing.pack(np.zeros(0, int))] == [0, 0, 0]
    with pytest.raises(ValueError):
        packing.pack(np.array([9]), (4, 8))


def test_packed_documents(spark):
    docs = odd_documents(spark)
    rows = packing.pack_documents(docs, group=6).collect()
    check_placed([(r["length"], r["bin"], r["capacity"], r["offset"]) for r in rows], packing.LENGTHS)
    tokens = sorted(len((r[1] or "").encode()) + 1 for r in odd_rows())
    assert sum(r["length"] for r in rows) == sum(tokens)
    long = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == 6)
    assert all(a + n == b for (a, n), (b, _) in zip(long, long[1:])) and long[0][0] == 0
    assert packing.pack_documents(no_documents(spark)).collect() == []
    own = packing.pack_documents(docs, F.lit(None).cast("long"))
    assert own.collect() == []


# Sharding ----------------------------------------------------------------------------------------


def test_shards_of_odd_rows(spark):
    rows = sharding.shard_documents(odd_documents(spark)).collect()
    expected = [(r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in odd_rows()]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == sorted(expected, key=repr)
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    assert sharding.shard_documents(no_documents(spark)).collect() == []


def test_even_shards_keep_groups_together(spark):
    texts = [f"t{i}" for i in range(600)] + [f"g{i % 40}" for i in range(120)] + ["hot"] * 360
    random.Random(1).shuffle(texts)
    rows = sharding.shard_documents(documents(spark, texts), shards=6, rounds=4).collect()
    sizes = collections.Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 6
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    groups = collections.defaultdict(collections.Counter)
    for r in rows:
        groups[texts[r["doc_id"]]][r["shard"]] += 1
    whole = sum(len(groups[f"g{i}"]) == 1 for i in range(40))
    assert whole >= 30
    assert sum(sorted(groups["hot"].values())[-2:]) >= 300  # a third of all rows fills two shards


def test_quotas_exchange_evenly():
    moves, room = sharding.quotas({(0, 1): 5, (1, 0): 3, (2, 1): 4}, {0: 1, 1: 3, 2: 9})
    assert moves == {(0, 1): 5, (1, 0): 3, (2, 1): 1} and room == {(1, 0): 2, (1, 2): 1}


def test_no_group_that_fits_is_split_beside_a_hot_one(spark):
    teams = ["hot"] * 1600 + [f"g{i % 300}" for i in range(1500)] + [None] * 1700
    random.Random(2).shuffle(teams)
    rows = spark.createDataFrame(list(enumerate(teams)), "row long, name string")
    got = sharding.propagate(rows, F.col("name"), shards=24).collect()
    assert sorted(r["row"] for r in got) == list(range(4800))
    assert set(collections.Counter(r["shard"] for r in got).values()) == {200}
    places = collections.defaultdict(set)
    for r in got:
        places[teams[r["row"]]].add(r["shard"])
    assert len(places["hot"]) == 8 and all(len(places[f"g{i}"]) == 1 for i in range(300))


def test_shards_full_of_groups(spark):
    teams = [f"g{i % 160}" for i in range(800)]  # no row without links to make room
    random.Random(3).shuffle(teams)
    rows = spark.createDataFrame(list(enumerate(teams)), "row long, name string")
    got = sharding.propagate(rows, F.col("name"), shards=8).collect()
    assert set(collections.Counter(r["shard"] for r in got).values()) == {100}
    assert len({(teams[r["row"]], r["shard"]) for r in got}) == 160


@pytest.mark.parametrize("seed", range(20))
def test_split_groups_fit_nowhere(seed):
    rng = random.Random(seed)
    shards = rng.randint(2, 9)
    classes = collections.Counter((rng.choice([2, 3, 7, 20, 45, 130]), rng.randrange(shards)) for _ in range(rng.randint(1, 60)))
    total = sum(size * n for (size, _), n in classes.items()) + rng.randint(0, 40)
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    for keep in (True, False):
        plan = sharding.place(classes, capacity, keep)
        used, rows, whole = collections.Counter(), collections.Counter(), collections.Counter()
        for size, home, lower, upper, to in plan.whole:
            used[to] += size * (upper - lower)
            whole[to] += size * (upper - lower)
            for number in range(lower, upper):
                rows[size, home, number] += size
        shares = collections.Counter()
        for size, home, number, lower, upper, to in plan.parts:
            used[to] += upper - lower
            rows[size, home, number] += upper - lower
            shares[size, home, number] += 1
        assert all(used[j] + plan.room[j] == capacity[j] and plan.room[j] >= 0 for j in range(shards))
        assert rows == {(size, home, k): size for (size, home), n in classes.items() for k in range(n)}
        split = [g for g in shares if g[0] <= max(capacity)]
        assert len(split) == plan.split and all(shares[g] > 1 for g in split)
        giants = collections.Counter()
        for size, _, _, lower, upper, to in plan.parts:
            giants[to] += upper - lower if size > max(capacity) else 0
        assert all(g[0] > capacity[j] - whole[j] - giants[j] for g in split for j in range(shards))


def test_rows_without_links_move_through_any_shard():
    spans = sharding.displaced({0: 5, 2: 4}, [1, 6, 2])
    assert spans == [(0, 0, 1, 0), (2, 0, 2, 2), (0, 1, 5, 1), (2, 2, 4, 1)]


def test_a_very_long_word_is_merged_as_the_library_does():
    coder, library, rng = bpe.Coder(WORDS), Tokenizer.from_file(WORDS), random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (65, 300, 5_000, 1_000_000)] + ["a" * 200_000, "é" * 3_000]
    for word in words:
        start = time.perf_counter()
        ids = np.frombuffer(b"".join(x[0] for x in coder.encode(word)), "<u4").tolist()
        assert time.perf_counter() - start < 60
        assert ids == library.encode(word, add_special_tokens=False).ids
    assert not any(len(w) > bpe.KEPT for w in coder.known)
