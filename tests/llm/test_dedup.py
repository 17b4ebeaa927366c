"""Exact, near and line deduplication against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.samples import LONG, documents, found, lined, no_documents, odd_documents, odd_rows, prose
from wayfare.llm import components, exact_dedup, line_dedup, near_dedup


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Exact ---------------------------------------------------------------------------------------


def test_exact_groups_of_odd_rows(spark):
    rows = [(r[0], lowered(r[1])) for r in odd_rows()]
    got = exact_dedup.exact_groups(odd_documents(spark)).collect()
    assert len(got) == len(rows)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in got:
        group = [i for i, t in rows if digest(t) == r["text_sha256"]]
        assert r["group_size"] == len(group) and r["doc_id"] in group
        assert r["keep_id"] == max((i for i in group if i is not None), default=None)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert sorted(kept) == sorted({digest(t) for _, t in rows})


def test_exact_groups_of_no_rows(spark):
    assert exact_dedup.exact_groups(no_documents(spark)).collect() == []


def test_chunks_do_not_depend_on_what_stands_before():
    tail = LONG.encode()[:60_000]
    ends = [{len(x) - e for e in exact_dedup.cut_points(x)} for x in (tail, b"some other start " * 40 + tail)]
    assert len(ends[0] & ends[1]) >= len(ends[0]) - 3
    for data in (b"", b"x", b"y" * 100_000, tail):
        cuts = [0, *exact_dedup.cut_points(data)]
        assert cuts[-1] == len(data) and all(0 < b - a <= exact_dedup.MAX_CHUNK for a, b in zip(cuts, cuts[1:]))


def test_contents_of_one_hash_are_told_apart(spark):
    chunks = spark.createDataFrame([(1, b"a"), (1, b"b"), (1, b"b"), (2, b"a")], "hash long, digest binary")
    got = {(r["hash"], bytes(r["digest"])): r["variant"] for r in exact_dedup.verified_chunks(chunks).collect()}
    assert got == {(1, b"a"): 0, (1, b"b"): 1, (2, b"a"): 0}


# Near ----------------------------------------------------------------------------------------


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", lowered(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                top[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, len(sets[i]), least.get(root(i))) for i, (doc, _) in enumerate(rows)]


def test_near_groups_of_odd_rows(spark):
    expected = brute_components([(r[0], r[1]) for r in odd_rows()])
    assert found(near_dedup.near_groups(odd_documents(spark))) == sorted(
        ((d, n, c, d == c) for d, n, c in expected), key=repr
    )


def test_near_groups_of_no_rows(spark):
    assert near_dedup.near_groups(no_documents(spark)).collect() == []
    assert near_dedup.drop_near_duplicates(no_documents(spark)).collect() == []


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.random()}"
    return words


def test_chains_stars_and_near_misses(spark):
    rng = random.Random(5)
    texts = []
    step = prose(3, 150).split()
    for _ in range(40):  # a chain: neighbours are alike, its ends are not
        texts.append(" ".join(step))
        step = edited(step, rng, 2)
    base = prose(4, 200).split()
    texts += [" ".join(edited(base, rng, rng.randrange(12))) for _ in range(60)]
    shared = prose(5, 100)  # a passage that unlike documents share
    texts += [shared + " " + prose(100 + i, 100) for i in range(30)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(documents(spark, texts)).collect()}
    assert got == {d: c for d, _, c in brute_components(rows)}


def test_dropping_keeps_one_row_of_each_group_with_its_columns(spark):
    docs = odd_documents(spark)
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    # Wordless texts are groups of their own; repeated rows of one id and text are one.
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in rows) == sorted(
        [-1, 1, 2, 3, 4, 6, 8, 8, 9, 11, 12, 13]
    )


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 6000, dtype=np.uint64)
    a, b = pool[:4000], pool[1000:5000]
    x, y = near_dedup.sketch(a), near_dedup.sketch(b)
    assert (near_dedup.merge(x, y) == near_dedup.sketch(np.union1d(a, b))).all()
    estimate, near = near_dedup.similarity(x[None], y[None], np.array([4000.0]), np.array([4000.0]))
    assert abs(estimate[0] - 0.6) < 0.12
    far = near_dedup.sketch(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    assert not near_dedup.similarity(x[None], far[None], np.array([4000.0]), np.array([4000.0]))[1][0]
    assert near_dedup.similarity(x[None], x[None], np.array([4000.0]), np.array([4000.0]))[1][0]


@pytest.mark.parametrize("seed", [1, 2])
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(20)] + [(200, 200), (None, 3), (7, 7)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    top = {}

    def root(i):
        while top.setdefault(i, i) != i:
            i = top[i]
        return i

    for a, b in links:
        if a is not None:
            top[root(a)] = root(b)
    assert {r["node"] for r in got} == set(top)
    by_label = {}
    for r in got:
        by_label.setdefault(r["label"], set()).add(root(r["node"]))
    assert all(len(s) == 1 for s in by_label.values()) and len(by_label) == len({root(i) for i in top})


# Lines ---------------------------------------------------------------------------------------


def brute_lines(rows, least=5):
    """(doc_id, text, site) to (doc_id, n_lines, n_removed, left_whole, digest)."""
    sites = {}
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if site is not None and re.search("[^\x20\x09-\x0d]", line):
                sites.setdefault(line, set()).add(site)
    out = []
    for doc, text, _ in rows:
        lines = (text or "").split("\n")
        hit = [len(sites.get(line, ())) >= least for line in lines]
        few = sum(len(x) for x, h in zip(lines, hit) if h) <= 0.5 * sum(map(len, lines))
        gone = [h and few for h in hit]
        left = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((doc, len(lines), sum(gone), any(hit) and not few, hashlib.sha256(left.encode()).hexdigest()))
    return out


def test_line_report_of_odd_rows(spark):
    rows = [(r[0], r[1], r[3]) for r in odd_rows()]
    got = line_dedup.line_report(odd_documents(spark), min_sites=2)
    assert found(got) == sorted(brute_lines(rows, 2), key=repr)
    assert line_dedup.line_report(no_documents(spark)).collect() == []


def test_lines_about_the_threshold(spark):
    rng = random.Random(9)
    common = [prose(500 + i, 6) for i in range(12)]
    rows = []
    for i in range(300):
        lines = lined(i, 4).split("\n") + [common[k] for k in range(12) if i % 40 <= k]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), None if i % 17 == 0 else f"site{i % 40}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    expected = brute_lines(rows)
    assert sum(r[2] for r in expected) > 100
    assert found(line_dedup.line_report(df)) == sorted(expected, key=repr)
    clean = line_dedup.drop_boilerplate(df)
    assert clean.columns == df.columns
    digests = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in clean.collect()}
    assert digests == {r[0]: r[4] for r in expected}


def test_dropping_lines_keeps_rows_and_columns(spark):
    docs = odd_documents(spark)
    clean = line_dedup.drop_boilerplate(docs, min_sites=2)
    assert clean.dtypes == docs.dtypes and clean.count() == docs.count()
    assert clean.where("text IS NULL").count() == docs.where("text IS NULL").count()
    assert clean.where("n_chars <> length(text)").count() == 0


@pytest.mark.parametrize("shift", [0, 7919])
def test_an_ordered_chain_takes_few_rounds(spark, monkeypatch, shift):
    """Versions of a page in row order are such a chain; the numbering must not matter."""
    rounds, plain = [], components.stage
    monkeypatch.setattr(components, "stage", lambda df, label: rounds.append(label) or plain(df, label))
    n = 10_000
    name = (lambda i: i) if not shift else (lambda i: i * shift % 100_003)
    links = spark.createDataFrame([(name(i), name(i + 1)) for i in range(n)] + [(200_000, 200_001)], "a long, b long").coalesce(4)
    found = components.connected_components(links, "a", "b").groupBy("label").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in found) == [2, n + 1]
    assert rounds.count("pointers") <= 12


def test_rows_without_an_id_are_grouped_by_their_texts(spark):
    texts = [lined(i // 3, 6) + (f" end{i % 3}" if i % 3 else "") for i in range(90)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(3)
    assert near_dedup.drop_near_duplicates(docs).count() == 30
    assert [r["n"] for r in near_dedup.near_groups(docs).groupBy("component_id").agg(F.count("*").alias("n")).collect()] == [90]
