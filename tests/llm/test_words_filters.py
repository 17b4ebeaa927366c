"""Spelling variants and the filter audit against plain Python."""

import collections
import itertools
import os
import re
import zlib

import numpy as np
import pytest

from tests.llm.samples import documents, no_documents, odd_documents, odd_rows, prose
from wayfare.llm import filter_audit, queries, spelling

FOLDER = "/root/testdata/sf0.001"
CAPITALS = {k: k + 32 for k in range(65, 91)}


# -- spelling ---------------------------------------------------------------


def brute_words(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(CAPITALS)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    near = {w: [v for v in words if abs(len(w) - len(v)) < 2 and v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 2 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def shown(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("box, most", [(8192, 1 << 20), (20, 1 << 20), (20, 60)])
def test_variants_equal_brute_force(spark, monkeypatch, box, most):
    """Also with small boxes, and with boxes that are split by hash."""
    monkeypatch.setattr(spelling, "BOX", box)
    monkeypatch.setattr(spelling, "MOST", most)
    monkeypatch.setattr(spelling, "MOST_ASKED", most)
    base = ["winter", "wnter", "winte", "winters", "wintexs", "xinter", "retniw", "winetr", "école", "ecole", "École", "×××××"]
    texts = [" ".join(w for i, w in enumerate(base) for _ in range(3 + i % 4 * 3)), *[prose(i, 150) for i in range(40)], None, ""]
    texts += ["A" * 5000 + " " + "A" * 5001 + " B" + "A" * 4999] * 3  # very long words
    rows = list(enumerate(texts))
    assert shown(spelling.spelling_variants(documents(spark, texts))) == brute_variants(brute_words(rows))


def test_chains_of_forms_lead_to_their_end(spark):
    words = {"abcde": 1, "abcdx": 2, "abcyx": 4, "abzyx": 8, "awzyx": 16, "other": 3}
    forms = [("abcde", "abcdx"), ("abcdx", "abcyx"), ("abcyx", "abzyx"), ("abzyx", "awzyx")]
    ends = spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()
    assert sorted(tuple(r) for r in ends) == [(w, "awzyx") for w, _ in forms]
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    near = {r["word"]: (r["n_near"], r["best"]) for r in spelling.near_words(table).collect()}
    assert near["abcdx"] == (2, "abcyx") and near["other"] == (0, None)


def test_boxes_hold_every_word_and_reach_every_edit():
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abcde"), 7)) for _ in range(1500)})
    boxes = spelling.Boxes(spelling.vectors(words[::3]), 40)
    home = boxes.of(spelling.vectors(words))
    place = dict(zip(words, home.tolist()))
    assert len(set(place.values())) > 20
    who, found = boxes.reached(spelling.vectors(words), spelling.REPLACE)
    reached = set(zip((words[i] for i in who), found.tolist()))
    for a, b in itertools.combinations(words[:300], 2):
        if one_edit(a, b):
            assert (a, place[b]) in reached and (b, place[a]) in reached


def test_odd_texts_have_defined_words(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert shown(spelling.spelling_variants(odd_documents(spark))) == brute_variants(brute_words(rows))
    assert spelling.spelling_variants(no_documents(spark)).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
def test_registered_spelling_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert shown(queries.op12_spelling(spark, FOLDER)) == brute_variants(brute_words(rows))


# -- filter audit -----------------------------------------------------------


def brute_audit(rows, labels):
    """``rows``: doc_id, text, lang; ``labels``: doc_id, quality, toxic."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = collections.defaultdict(list)
    for doc_id, text, lang in rows:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        fails = set()
        fails |= {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        smaller = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows)
        fails |= {"E"} if smaller else set()
        parts[lang or ""].append((fails, doc_id in good, doc_id in toxic))
    out = []
    for part, docs in parts.items():
        cells, total = [], collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, letter in enumerate(order, 1):
                hit = [d for d in left if letter in d[0]]
                left = [d for d in left if letter not in d[0]]
                earlier = sum(letter in f for f, _, _ in docs) - len(hit)
                only = sum(f == {letter} for f, _, _ in docs)
                total[letter] += len(hit)
                cells.append((part, "".join(order), step, len(left), len(hit), earlier, only, sum(d[1] for d in hit), sum(d[2] for d in hit), letter))
        out += [(*c[:-1], total[c[-1]]) for c in cells]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_all_orders_in_turn(spark):
    texts = [prose(i, n) for i, n in enumerate([20, 99, 100, 101, 150, 300, 120, 130] * 4)]
    texts += [texts[3], texts[3], texts[5], texts[2] + " #", texts[4].upper(), texts[5].upper() + " 50%", "", "", None]
    rows = [(i, t, ["en", "de", None, ""][i % 4]) for i, t in enumerate(texts)] + [(None, texts[3], "en"), (3, texts[3], "en")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 40, 2)] + [(0, 1, 1), (None, 1, 1), (5, None, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, part string, mask int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit.audit(docs, marks).select(*COLUMNS).collect())
    assert got == brute_audit(rows, labels)


def test_audit_of_odd_and_empty_tables(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(r[0], r[1], r[2]) for r in odd_rows()]
    got = sorted(tuple(r) for r in filter_audit.audit(odd_documents(spark), marks).select(*COLUMNS).collect())
    assert got == brute_audit(rows, [])
    assert filter_audit.audit(no_documents(spark), marks).count() == 0


def test_ranks_follow_the_alphabet(spark):
    last = filter_audit._beginnings(spark)[-1].orderBy("start").collect()
    assert [r["spelled"] for r in last] == ["".join(p) for p in itertools.permutations("ABCDE")]
