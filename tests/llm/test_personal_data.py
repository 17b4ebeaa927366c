"""Patterns, network and reconciliation of the personal data scan."""

import hashlib
import itertools
import os
import re

import numpy as np
import pytest

from tests.llm.samples import documents, no_documents, odd_documents, odd_rows, prose
from wayfare.llm import pii, queries, tagger

FOLDER = "/root/testdata/sf0.001"

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def digits(text):
    return re.sub("[^0-9]", "", text)


def passes(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    checks = [
        (EMAIL, lambda m: True),
        (IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
        (CARD, lambda m: 13 <= len(digits(m)) <= 19 and passes(digits(m))),
        (PHONE, lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, *m.span()) for k, (p, good) in enumerate(checks) for m in re.finditer(p, text) if good(m[0])]


SAMPLES = [
    "a@b.c_d@e.f b.c@@d.e x@a@b.c @b.c@d.e .@a.b- q@r",
    "1.2.3.4.5.6.7.8 999.1.1.1.2.3.4 0001.002.3.4 1.2.3 256.1.1.1 00000000000000255.1.1.1 é1.2.3.4é",
    "4111 1111 1111 1111 4111-1111-1111-1111, 4111111111111111 4111111111111112 1 2 3  4 5",
    "7536784127813050 4845168114407329",
    "+1 (017) 555-7713 +12 +1..2 ++1 555 +49 (0)30 / 12 +123456789012345678 +1 ( 5",
    "",
    "x" * 3000 + "@" + "9" * 3000 + ".5",
    "😀 no.one@example.com 日本 255.255.255.255",
]


def test_base_spans_are_those_of_the_patterns():
    rng = np.random.default_rng(0)
    noise = ["".join(rng.choice(list("a1.@+- ()9_%"), 60)) for _ in range(400)]
    for text in [*SAMPLES, *noise, *[r[1] or "" for r in odd_rows()]]:
        assert pii.base_spans(text) == plain_spans(text), text[:80]


def test_long_runs_do_not_slow_the_patterns():
    for text in ("a" * 400_000, "9" * 400_000, "1 " * 200_000, "+1" + " " * 300_000, "a." * 200_000):
        assert pii.base_spans(text) == []


# -- the network ------------------------------------------------------------


@pytest.fixture
def small():
    rng = np.random.default_rng(1)
    network = tagger.Tagger(2, kind=np.float64)
    network.p["move"] += rng.normal(size=network.p["move"].shape)
    ids = rng.integers(0, 100, (7, 3))
    tags = np.array([[0, 1, 2, 2, 3, 0, 1], [1, 2, 0, 0, 0, 1, 2], [3, 4, 4, 1, 2, 0, 0]]).T
    return network, ids, tags


def test_gradients_are_those_of_the_loss(small):
    network, ids, tags = small
    sizes = np.full(3, 7)
    keep = []
    _, error, moves = network.loss(network.emissions(ids, sizes, keep), tags)
    found = network.gradients(keep, error) | {"move": moves}
    rng = np.random.default_rng(2)
    for name, values in network.p.items():
        places = [tuple(rng.integers(0, d) for d in values.shape) for _ in range(5)]
        if name == "embed":
            places = [(ids[0, 0], j) for j in range(5)]
        for place in places:
            if name == "move" and not network.legal[place]:
                continue
            kept, ends = values[place], []
            for change in (1e-5, -1e-5):
                values[place] = kept + change
                ends.append(network.loss(network.emissions(ids, sizes), tags)[0])
            values[place] = kept
            assert abs((ends[0] - ends[1]) / 2e-5 - found[name][place]) < 1e-6, name


def test_best_tags_equal_trying_all(small):
    network, ids, _ = small
    sizes, move = np.array([7, 5, 3]), network.p["move"]
    scores = network.emissions(ids, sizes)
    tags = network.best(scores, sizes)
    for j, n in enumerate(sizes):
        alone = network.emissions(ids[:n, j : j + 1], np.array([n]))[:, 0]
        assert np.allclose(alone, scores[:n, j])

        def total(path):
            return sum(scores[t, j, path[t]] for t in range(n)) + sum(move[a, b] for a, b in zip(path, path[1:]))

        legal = [
            p for p in itertools.product(range(5), repeat=int(n))
            if network.first[p[0]] and all(network.legal[a, b] for a, b in zip(p, p[1:]))
        ]
        best = max(legal, key=total)
        assert list(best) == tags[:n, j].tolist() and not tags[n:, j].any()


def test_sequences_without_a_find_are_told_rightly(small):
    network, _, _ = small
    rng = np.random.default_rng(3)
    ids, sizes = rng.integers(0, 133, (12, 400)), rng.integers(1, 13, 400)
    for shift in (0.0, 2.0, 4.0):
        scores = network.emissions(ids, sizes)
        scores[:, :, 0] += shift
        sure, tags = network.outside_wins(scores, sizes), network.best(scores, sizes)
        assert not tags[:, sure].any()
    assert sure.any()


def test_stretches_and_tags_agree():
    spans = [(0, 2, 6), (1, 6, 9), (1, 9, 10), (3, 15, 20)]
    assert pii.stretches(pii.tags_of(20, spans)) == spans
    assert pii.stretches(pii.tags_of(10, spans, 4)) == [(0, 0, 2), (1, 2, 5), (1, 5, 6)]


# -- finds ------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("mail me at jo at web dot org now", 0, None),
        ("jo at web dot org", 0, "jo at web dot org"),
        ("<jo [at] web [dot] org>", 0, "jo [at] web [dot] org"),
        ("jo@", 0, None),
        ("10[.]0[.]0[.]1.", 1, "10[.]0[.]0[.]1"),
        ("10.0.0.256", 1, None),
        ("2001:db8::ff00:42:8329", 1, "2001:db8::ff00:42:8329"),
        ("12:30", 1, None),
        ("4111.1111.1111.1111", 2, "4111.1111.1111.1111"),
        ("4111.1111.1111.1112", 2, None),
        ("(017) 555-7713", 3, "(017) 555-7713"),
        ("call 017) 555-7713", 3, None),
        ("0171234567", 3, None),
    ],
)
def test_finds_are_checked(text, kind, found):
    spans = pii.checked(text, (kind, 0, len(text)))
    if kind == 3 and found is None:
        assert all(text[a:b] != text for _, a, b in spans)
    else:
        assert [text[a:b] for _, a, b in spans] == ([found] if found else [])


def test_two_cards_in_one_find_are_both_kept():
    text = "x 7536784127813050 4845168114407329 y"
    assert pii.checked(text, (2, 2, 35)) == [(2, 2, 18), (2, 19, 35)]


def test_pieces_cut_by_a_window_are_joined_and_overlaps_settled():
    text = "reach jo at web dot org or 10 . 0 . 0 . 1 today"
    mail, ip = text.index("jo"), text.index("10")
    finds = [
        (mail + 8, (0, mail, mail + 8), 5.0),  # cut by the end of its window
        (60, (0, mail + 4, mail + 17), 4.0),
        (60, (1, ip, ip + 14), 6.0),
        (60, (3, ip, ip + 14), 2.0),
        (60, (2, 0, 5), 9.0),  # no card
    ]
    got = pii.reconcile(text, finds, [])
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in got] == [("email", "jo at web dot org"), ("ip", "10 . 0 . 0 . 1")]
    assert pii.reconcile(text, finds, [(1, ip + 3, ip + 6)]) == got[:1]


@pytest.fixture(scope="module")
def network(spark):
    texts = [f"{prose(i, 40)} {i}.mail{i}@host{i % 7}.com {prose(i + 500, 60)} +1 (0{i % 90:02}) 555-{1000 + i} {prose(i, 5)}" for i in range(120)]
    texts += [prose(i + 2000, 200) for i in range(60)]
    return pii.train(documents(spark, texts), made=1500)


def test_unusual_spellings_are_found_and_plain_text_left_alone(network):
    maker = pii.Inventor(99)
    found = total = 0
    for i in range(150):
        text, spans = maker.fill(prose(i + 7000, 30))
        ((base, added),) = pii.scan(network, [text])
        total += len(spans)
        found += len(set(spans) & {*base, *added})
    assert found > 0.7 * total
    clean = [prose(i + 9000, 400) + ". Look at him. They dot the map at 12:30, 4.0 or 3." for i in range(60)]
    assert sum(len(added) for _, added in pii.scan(network, clean)) <= 1


def test_finds_do_not_depend_on_where_windows_end(network):
    card = "7536784127813050 4845168114407329"
    for pad in range(380, 520, 10):
        words = prose(3, 400)
        text = words[:pad] + " " + card + " " + words[pad:]
        (_, added), = pii.scan(network, [text])
        assert (2, pad + 1, pad + 17) in added and (2, pad + 18, pad + 34) in added


def test_rows_and_digests(spark, network):
    texts = SAMPLES + [r[1] for r in odd_rows()] + ["+1 (017) 555-7713 " * 400]
    got = {r["doc_id"]: r for r in pii.find_personal_data(documents(spark, texts), network).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        spans = plain_spans(text or "")
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in range(4)]
        shown = [s for s in got[i]["spans"].split(",") if s]
        assert set(line.split(",")) - {""} <= set(shown) and len(shown) == len(spans) + got[i]["n_added"]
        order = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in shown]
        assert order == sorted(order)


def test_odd_and_empty_tables(spark):
    rows = pii.find_personal_data(odd_documents(spark)).collect()
    assert len(rows) == len(odd_rows())
    assert {r["spans"] for r in rows if r["n_added"] == 0 and not r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]} <= {""}
    assert pii.find_personal_data(no_documents(spark)).count() == 0
    assert pii.train(no_documents(spark)) is None


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
def test_registered_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op11_personal_data(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in plain_spans(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) - {""} <= set(r["spans"].split(","))
