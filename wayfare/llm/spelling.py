"""Spelling variants of the words of a corpus, by k-d trees over letter-count vectors.

A word is a vector of how often each letter occurs in it. One replaced letter moves it by two in the
sum of absolute differences (L1), one inserted or deleted letter by one. Words of each length are
dealt to the boxes of a k-d tree. For each pair of equal or neighbouring lengths a word is sent to the
boxes that its ball reaches, searched there in a finer tree, and what is found is verified letter by
letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.session import stage

#: A word is a run of these letters, lower-cased in A-Z only.
_RUN = re.compile(rb"[a-z\xc0-\xff]+")
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
MIN_LENGTH, MIN_COUNT = 5, 3
#: Every text's spelling of a word whose hash is a multiple of this loses a letter.
DAMAGE = 97
#: Distinct words that a task holds before it hands them on.
COUNTED = 300_000
#: Words that the outer trees are fitted on at most; every word is dealt by them.
SAMPLE = 50_000
#: Words that a box should hold, and the characters of points and of queries from which on it is split by
#: hash as well.
BOX, MOST, MOST_ASKED = 8192, 1 << 20, 1 << 22
#: Words in a leaf of the finer trees, and pairs compared at once.
LEAF, PAIRS = 32, 1 << 17
#: Letters that one edit adds and takes off, for a word of the same length and for one a letter longer.
REPLACE, INSERT = (1, 1), (1, 0)
#: Words that are dealt at once.
DEAL = 1 << 14
#: Lengths with a tree of their own; longer words are split by hash alone.
LONGEST = 64

_TABLE = np.zeros(256, np.int64)
_TABLE[[ord(c) for c in LETTERS]] = range(len(LETTERS))


# -- words ------------------------------------------------------------------


def _spelled_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n by some texts at a time. Letters are bytes of Latin-1, what lies beyond it parts words."""

    def counted() -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counts: dict[bytes, int] = {}
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            runs = Counter(_RUN.findall((text.as_py() or "").encode("latin-1", "replace").lower()))
            seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in runs.items():
                h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
                if h % DAMAGE == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                counts[run] = counts.get(run, 0) + n
            if len(counts) > COUNTED:
                yield counted()
                counts = {}
    yield counted()


def damaged_words(docs: DataFrame) -> DataFrame:
    """word, n: the words of all whole texts, as each text spells them, with their occurrences.

    A text's spelling of a word loses one letter where 97 divides the hash of its id and the word. A
    null id counts as empty, a null text has no words. Every task counts its words before they are
    shuffled.
    """
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return read.mapInArrow(_spelled_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of the words of five or more letters that occur three times or more."""
    return damaged_words(docs).where((F.length("word") >= MIN_LENGTH) & (F.col("n") >= MIN_COUNT))


# -- vectors and trees ------------------------------------------------------


def letters(words: list[str]) -> np.ndarray:
    """The letters of words of one length, one row each."""
    return _TABLE[np.frombuffer("".join(words).encode("latin-1"), np.uint8)].reshape(len(words), -1)


def vectors(words: list[str]) -> np.ndarray:
    """The letter counts of words of one length, one row each."""
    spelled = letters(words)
    kind = np.int16 if spelled.shape[1] < 1 << 14 else np.int32
    counts = np.zeros((len(words), len(LETTERS)), kind)
    np.add.at(counts, (np.arange(len(words))[:, None], spelled), kind(1))
    return counts


def split_plane(points: np.ndarray) -> tuple[int, int] | None:
    """Letter and count that part points most evenly: those above the count go right. None if all are
    alike."""
    middle = np.sort(points, axis=0)[len(points) // 2]
    best = None
    for shift in (0, -1):
        share = np.abs((points > middle + shift).mean(axis=0) - 0.5)
        letter = int(np.argmin(share))
        if share[letter] < 0.5 and (best is None or share[letter] < best[0]):
            best = (share[letter], letter, int(middle[letter] + shift))
    return best and best[1:]


class Boxes:
    """An outer tree for the words of one length: planes that part them into boxes.

    ``planes``: node to (letter, count, left child, right child); a node without a plane is a box.
    """

    def __init__(self, sample: np.ndarray, boxes: int):
        self.planes: dict[int, tuple[int, int, int, int]] = {}
        todo, nodes = [(0, sample, boxes)], 1
        while todo:
            node, points, n = todo.pop()
            plane = split_plane(points) if n > 1 and len(points) > 1 else None
            if plane is None:
                continue
            right = points[:, plane[0]] > plane[1]
            self.planes[node] = (*plane, nodes, nodes + 1)
            share = min(n - 1, max(1, round(n * float(right.mean()))))
            todo += [(nodes, points[~right], n - share), (nodes + 1, points[right], share)]
            nodes += 2

    def of(self, points: np.ndarray) -> np.ndarray:
        """The box each point lies in."""
        return self.reached(points, (0, 0))[1]

    def reached(self, points: np.ndarray, edit: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(point, box) for all boxes that a point can get to by adding and taking off so many letters."""
        who, boxes = [], []
        zero = np.zeros(len(points), np.int32)
        # Letters add up; for one letter the farthest plane on either side counts.
        todo = [(0, np.arange(len(points)), zero, zero, {})]
        while todo:
            node, at, add, take, bounds = todo.pop()
            if node not in self.planes or not len(at):
                who.append(at)
                boxes.append(np.full(len(at), node, np.int64))
                continue
            letter, count, left, right = self.planes[node]
            value = points[at, letter].astype(np.int32)
            low, high = bounds.get(letter, (0, None))
            more = np.maximum(low - value, 0)
            less = np.maximum(value - high, 0) if high is not None else np.zeros(len(at), np.int32)
            fewer = take - less + np.maximum(less, value - count)
            ok = fewer <= edit[1]
            todo.append((left, at[ok], add[ok], fewer[ok], bounds | {letter: (low, count)}))
            further = add - more + np.maximum(more, count + 1 - value)
            ok = further <= edit[0]
            todo.append((right, at[ok], further[ok], take[ok], bounds | {letter: (count + 1, high)}))
        found = np.concatenate(who), np.concatenate(boxes)
        order = np.argsort(found[0], kind="stable")
        return found[0][order], found[1][order]


def near_pairs(points: list[str], queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) of all words that are one edit apart: both of one length, or the points one
    letter longer.

    A k-d tree over the points is walked with all queries at once; a query leaves a branch whose
    tight box is farther away than one edit can lead.
    """
    p_vec, q_vec = vectors(points), vectors(queries)
    used = (p_vec.max(axis=0) > 0) | (q_vec.max(axis=0) > 0)
    p_vec, q_vec = p_vec[:, used], q_vec[:, used]
    p_let, q_let = letters(points), letters(queries)
    same = p_let.shape[1] == q_let.shape[1]
    edit = REPLACE if same else INSERT
    found = [], []
    todo = [(np.arange(len(points)), np.arange(len(queries)))]
    while todo:
        at, asked = todo.pop()
        here = p_vec[at]
        low, high = here.min(axis=0), here.max(axis=0)
        near = np.zeros(len(asked), bool)
        step = max(1, PAIRS // max(1, len(low)))
        for i in range(0, len(asked), step):
            some = q_vec[asked[i : i + step]]
            near[i : i + step] = (np.maximum(low - some, 0).sum(axis=1) <= edit[0]) & (
                np.maximum(some - high, 0).sum(axis=1) <= edit[1]
            )
        asked = asked[near]
        if not len(asked):
            continue
        plane = split_plane(here) if len(at) > LEAF else None
        if plane is not None:
            right = here[:, plane[0]] > plane[1]
            todo += [(at[~right], asked), (at[right], asked)]
            continue
        step = max(1, PAIRS // (len(low) * min(len(at), LEAF)))
        for j in range(0, len(at), LEAF):  # more than a leaf only where all vectors are alike
            some = p_vec[at[j : j + LEAF]]
            for i in range(0, len(asked), step):
                apart = np.abs(q_vec[asked[i : i + step], None, :] - some).sum(axis=2)
                q, p = np.nonzero(apart == sum(edit))
                q, p = asked[i + q], at[j + p]
                good = verified(q_let, p_let, q, p)
                found[0].append(q[good])
                found[1].append(p[good])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found[0]]), np.concatenate([none, *found[1]])


def verified(q_let: np.ndarray, p_let: np.ndarray, q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether letters are in such an order that exactly one edit leads from query to point."""
    out = np.zeros(len(q), bool)
    size = q_let.shape[1]
    for i in range(0, len(q), step := max(1, PAIRS * 8 // size)):
        a, b = q_let[q[i : i + step]], p_let[p[i : i + step]]
        if b.shape[1] == size:
            out[i : i + step] = (a != b).sum(axis=1) == 1
        else:
            # The letters alike from the front and from the back cover the shorter word.
            front = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
            back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            out[i : i + step] = front + back >= size
    return out


# -- the search -------------------------------------------------------------


def outer_trees(words: DataFrame) -> dict[int, Boxes]:
    """A tree for every length up to LONGEST with more words than a box should hold.

    Fitted on SAMPLE words at most, an even choice by hash; the counts by length come from all words.
    """
    short = words.where(F.length("word") <= LONGEST)
    sizes = {r["length"]: r["count"] for r in short.groupBy(F.length("word").alias("length")).count().collect()}
    total = sum(sizes.values())
    share = max(1, -(-2 * total // SAMPLE))  # half of SAMPLE is expected, so that the limit is a guard alone
    chosen = short.where(F.pmod(F.xxhash64("word", F.lit(29)), F.lit(share)) == 0).select("word").limit(SAMPLE).collect()
    by_length: dict[int, list[str]] = {}
    for row in chosen:
        by_length.setdefault(len(row["word"]), []).append(row["word"])
    return {
        length: Boxes(vectors(sorted(found)), -(-sizes[length] // BOX))
        for length, found in by_length.items()
        if sizes[length] > BOX
    }


POINT, AT_HOME, VISITING = 0, 1, 2
ROUTED = "length int, box long, role int, word string, n long"


def _route(trees: dict[int, Boxes]):
    """Every word to its own box as a point, and to the boxes it must be searched in as a query.

    A pair of one length is found in one box: in the later one of two, or, from both its words, in the
    one that they share.
    """

    def deal(length: int, words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        counts, every, none = vectors(words), np.arange(len(words)), np.zeros(len(words), np.int64)
        home = trees[length].of(counts) if length in trees else none
        yield length, every, home, none + POINT
        who, box = trees[length].reached(counts, REPLACE) if length in trees else (every, none)
        later = box >= home[who]
        who, box = who[later], box[later]
        yield length, who, box, np.where(box == home[who], AT_HOME, VISITING)
        who, box = trees[length + 1].reached(counts, INSERT) if length + 1 in trees else (every, none)
        yield length + 1, who, box, none[who] + VISITING

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[str] = []
        sizes: list[int] = []

        def dealt() -> Iterator[pa.RecordBatch]:
            spans, n = np.array([len(w) for w in words], np.int64), np.array(sizes, np.int64)
            for length in np.unique(spans).tolist():
                picked = np.flatnonzero(spans == length)
                some = pa.array([words[i] for i in picked], pa.string())
                for other, who, box, role in deal(length, some.to_pylist()):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(who), other, np.int32)),
                            pa.array(box),
                            pa.array(role.astype(np.int32)),
                            some.take(pa.array(who)),
                            pa.array(n[picked[who]]),
                        ],
                        ["length", "box", "role", "word", "n"],
                    )

        for batch in batches:
            words += batch.column("word").to_pylist()
            sizes += batch.column("n").to_pylist()
            if len(words) >= DEAL:
                yield from dealt()
                words, sizes = [], []
        yield from dealt()

    return run


FOUND = "word string, n long, n_near long, best_n long, best string"


def _search(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """One row per word with near words among the points and queries of a box: their number and the best."""
    length = key[0].as_py()
    words, n = rows.column("word").to_numpy(), rows.column("n").to_numpy()
    role, sizes = rows.column("role").to_numpy(), pc.utf8_length(rows.column("word")).to_numpy()
    points = np.flatnonzero(role == POINT)
    one, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in (length, length - 1):
        asked = np.flatnonzero((role != POINT) & (sizes == size))
        if not len(points) or not len(asked):
            continue
        q, p = near_pairs(words[points].tolist(), words[asked].tolist())
        q, p = asked[q], points[p]
        # Words that share the box find each other twice.
        once = (role[q] == VISITING) | (words[q] < words[p])
        one += [q[once], p[once]]
        other += [p[once], q[once]]
    one, other = np.concatenate(one), np.concatenate(other)
    # Rank the words, so that the best near word of each comes first; a word has one row as a point and
    # one as a query.
    names, place = np.unique(words, return_inverse=True)
    order = np.lexsort((place[other], -n[other], place[one]))
    one, other = one[order], other[order]
    which, first, near = np.unique(place[one], return_index=True, return_counts=True)
    return pa.table(
        {
            "word": pa.array(names[which], pa.string()),
            "n": n[one[first]],
            "n_near": near,
            "best_n": n[other[first]],
            "best": pa.array(words[other[first]], pa.string()),
        }
    )


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, best, best_n for all of ``words`` (word, n; each word once, of five or more
    letters): how many are one edit away, and the one of them with the largest n, the smallest word of
    equals; null where there is none.
    """
    words = stage(words, "words")
    routed = words.mapInArrow(_route(outer_trees(words)), ROUTED)
    routed = stage(routed, "routed-words")
    # Boxes that hold too much are split by hash: each part of the points meets each part of the queries.
    asks = F.col("role") != POINT
    chars = lambda these: F.sum(F.when(these, F.length("word")).otherwise(0))
    sizes = routed.groupBy("length", "box").agg(chars(~asks).alias("points"), chars(asks).alias("queries"))
    parts = [F.greatest(F.lit(1), F.ceil(F.col(c) / most)).cast("int").alias(f"{c}_parts") for c, most in (("points", MOST), ("queries", MOST_ASKED))]
    sizes = sizes.where(f"points > {MOST} OR queries > {MOST_ASKED}").select("length", "box", *parts)
    dealt = routed.join(sizes, ["length", "box"], "left").na.fill(1, ["points_parts", "queries_parts"])
    part = lambda c: F.array(F.pmod(F.xxhash64("word"), F.col(c)).cast("int"))
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    dealt = dealt.withColumn("p_part", F.explode(F.when(asks, every("points_parts")).otherwise(part("points_parts"))))
    dealt = dealt.withColumn("q_part", F.explode(F.when(asks, part("queries_parts")).otherwise(every("queries_parts"))))
    found = dealt.groupBy("length", "box", "p_part", "q_part").applyInArrow(_search, FOUND)
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), *[F.lit(None).cast(k).alias(c) for c, k in (("best_n", "long"), ("best", "string"))])
    first = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    every_word = found.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), first.alias("first"))
    return every_word.select("word", "n", "n_near", F.col("first.best").alias("best"), (-F.col("first.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms of every word that has one.

    ``forms``: word, form (not null). Pointers double in each round; since a form occurs at least twice
    as often as its word, chains are short and the rounds few.
    """
    to = stage(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stage(to.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        if longer.where("next IS NOT NULL").isEmpty():
            return to
        to = longer.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Words of all whole texts with their likely right form: word, form, root, n, n_near, form_n.

    ``form`` is the word one edit away with the largest n, the smallest one of equals, where it occurs at
    least twice as often; else null, as is form_n. ``root`` follows forms to the last; it is the word
    itself where there is none. Words are as :func:`vocabulary` gives them. Repeated rows count each; a
    null text has no words, an empty table gives no rows, and other columns are ignored.
    """
    near = stage(near_words(vocabulary(docs)), "near-words")
    has_form = F.col("best_n") >= F.col("n") * 2
    ends = roots(near.where(has_form).select("word", F.col("best").alias("form")))
    return near.join(ends, "word", "left").select(
        "word",
        F.when(has_form, F.col("best")).alias("form"),
        F.coalesce("root", "word").alias("root"),
        "n",
        "n_near",
        F.when(has_form, F.col("best_n")).alias("form_n"),
    )
