"""Near-duplicate groups by SetSketch registers.

A document is the set of its five-word shingles. Its sketch has M registers, each the exponentially
spaced, truncated minimum of one hash function over the set: equal sets have equal registers, and a
register of two sets agrees about as often as the sets overlap. Bands of registers propose pairs,
the joint likelihood of all registers discards those far from the threshold, and the rest are
confirmed on the full sets.

This is done in two rounds so that no bucket gives all its pairs: first every document meets the
first of each of its buckets; then, where buckets still hold several components, the documents
outside the largest are compared with the others in blocks, which yield only the links that join
components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.components import connected_components
from wayfare.session import stage

#: Words of a shingle and the least similarity, in percent, of linked documents.
SHINGLE, LINKED = 5, 75
#: BANDS bands of ROWS registers: a pair at the threshold is missed about twice in 100,000.
BANDS, ROWS = 40, 5
M = BANDS * ROWS
#: Base and rate of the registers, and their greatest value.
BASE, RATE, LIMIT = 1.001, 20.0, 65535
#: Pairs are discarded when their registers are exp(MARGIN) times likelier at some similarity below
#: the threshold than at any above it.
MARGIN = 14.0

#: Nodes and shingles of a block, on average.
BLOCK_NODES, BLOCK_SHINGLES = 512, 1_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Distinct 64-bit shingle hashes of a text, sorted; A-Z count as a-z.

    Fewer words than SHINGLE make one shingle; no words make none.
    """
    words = (text or "").encode().lower().split()  # bytes split at ASCII white space alone
    n, k = len(words), min(SHINGLE, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    mixed = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        mixed = (mixed ^ hashes[i : n - k + 1 + i]) * _MIX
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_101)
    odd = rng.integers(0, 2**63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 2**63, M, dtype=np.uint64)


_ODD, _ADD = _functions()
#: Shingles that meet all hash functions at once: bounds the memory for long documents.
_STEP = 2048


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The M registers of a set of shingle hashes that is not empty."""
    least = np.full(M, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _STEP):
        block = np.multiply.outer(_ODD, hashes[at : at + _STEP])
        block += _ADD[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    return _registers(least)


def _registers(least: np.ndarray) -> np.ndarray:
    # A uniform minimum becomes an exponential one of rate RATE, then its rank on a scale of BASE.
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    spaced = np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(BASE))
    return np.clip(spaced, 0, LIMIT).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


_GRID = np.linspace(0.0, 1.0, 201)


def _log_likelihood(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Log-likelihood of each similarity of the grid (columns) for pairs of sketches (rows)."""
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    only_a, only_b = chance(u - v * _GRID), chance(v - u * _GRID)
    log = lambda x: np.log(np.maximum(x, 1e-9))
    return above * log(only_a) + below * log(only_b) + same * log(1 - only_a - only_b)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Likeliest similarity of pairs of sketches, and whether the threshold is within MARGIN of it."""
    found = _log_likelihood(a, b, n_a, n_b)
    linked = found[:, _GRID >= LINKED / 100 - 1e-9].max(axis=1)
    return _GRID[found.argmax(axis=1)], found.max(axis=1) - linked <= MARGIN


# Spark steps ----------------------------------------------------------------------------------

_SKETCHED = "doc_id long, text_key string, n_shingles long, set_key string, registers binary"


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, sizes, keys, registers = [], [], [], []
        for text in batch.column("text"):
            text = text.as_py()
            found = shingles(text)
            texts.append(hashlib.md5((text or "").encode()).hexdigest())
            sizes.append(len(found))
            keys.append(xxhash.xxh3_128_hexdigest(found.tobytes()) if len(found) else None)
            registers.append(sketch(found).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(texts, pa.string()),
                pa.array(sizes, pa.int64()),
                pa.array(keys, pa.string()),
                pa.array(registers, pa.binary()),
            ],
            ["doc_id", "text_key", "n_shingles", "set_key", "registers"],
        )


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, buckets = batch.column("node").to_numpy(), []
        for value in batch.column("registers"):
            data = value.as_py()
            size = 2 * ROWS
            buckets += [
                xxhash.xxh3_64_intdigest(data[i * size : i * size + size], seed=i) - (1 << 63) for i in range(BANDS)
            ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(buckets, pa.int64()), pa.array(np.repeat(node, BANDS))], ["bucket", "node"]
        )


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            sides = [
                np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("r_a", "r_b")
            ]
            sizes = [part.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b")]
            estimate, near = similarity(*sides, *sizes)
            # Sizes alone rule out what can't reach the threshold.
            near &= 100 * np.minimum(*sizes) >= LINKED * np.maximum(*sizes)
            pick = np.flatnonzero(near)
            yield pa.RecordBatch.from_arrays(
                [part.column("a").take(pa.array(pick)), part.column("b").take(pa.array(pick)), pa.array(estimate[pick])],
                ["a", "b", "estimate"],
            )


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for a, b in zip(batch.column("t_a"), batch.column("t_b"), strict=True):
            x, y = shingles(a.as_py()), shingles(b.as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= LINKED * (len(x) + len(y) - both))
        pick = pa.array(np.flatnonzero(linked))
        yield pa.RecordBatch.from_arrays([batch.column("a").take(pick), batch.column("b").take(pick)], ["a", "b"])


def _of_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts whose shingle set is that of the node they were joined to."""
    for batch in batches:
        mine = []
        for text, key in zip(batch.column("text"), batch.column("set_key"), strict=True):
            found = shingles(text.as_py())
            mine.append(bool(len(found)) and xxhash.xxh3_128_hexdigest(found.tobytes()) == key.as_py())
        pick = pa.array(np.flatnonzero(mine))
        yield pa.RecordBatch.from_arrays([batch.column("node").take(pick), batch.column("text").take(pick)], ["node", "text"])


def _judge(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, estimate of the pairs that their sketches leave open."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("registers").alias(f"r_{s}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(_judged, "a long, b long, estimate double")


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    side = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias(f"t_{s}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "t_a", "t_b").mapInArrow(_confirmed, "a long, b long")


def _link_blocks(teams: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: links that join the components of every team of nodes, as few as do.

    A team is all nodes that share a bucket with the same first node, so every proposed pair is in
    one. Nodes outside a team's largest component are compared with all of the team, on full sets,
    in blocks of bounded size: a task holds two blocks, however large the team. Teams of a single
    component are left alone.
    """
    known = teams.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = known.join(nodes.select("node", "n_shingles"), "node")
    counts = counts.groupBy("team", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    need = lambda n, size: F.greatest(F.ceil(n / BLOCK_NODES), F.ceil(size / BLOCK_SHINGLES), F.lit(1))
    mixed = counts.groupBy("team").agg(
        F.max(F.struct("n", "label", "size")).alias("main"),
        F.sum("n").alias("n"),
        F.sum("size").alias("size"),
        F.count("*").alias("labels"),
    )
    mixed = mixed.where("labels > 1").select(
        "team",
        F.col("main.label").alias("main"),
        need(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).cast("int").alias("few"),
        need(F.col("main.n"), F.col("main.size")).cast("int").alias("many"),
    )
    still = known.join(mixed, "team")
    # Blocks 0 to few - 1 hold the nodes outside the main component, the rest those inside.
    hashed = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    still = still.withColumn(
        "block", F.when(F.col("label") == F.col("main"), F.col("few") + hashed(F.col("many"))).otherwise(hashed(F.col("few")))
    )
    last = F.when(F.col("block") < F.col("few"), F.col("few") + F.col("many")).otherwise(F.col("few")) - 1
    paired = still.join(texts, "node").withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    paired = paired.select(
        "team", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "label", "text"
    )
    return paired.groupBy("team", "low", "high").applyInPandas(_linked_block, "a long, b long")


def _linked_block(part: pd.DataFrame) -> pd.DataFrame:
    """Links between different components of two blocks (or within one), a spanning set of them."""
    low, high = int(part["low"].iloc[0]), int(part["high"].iloc[0])
    part = part.sort_values(["block", "node"], kind="stable")
    sides = [part[part["block"] == low], part[part["block"] == high]]
    if low < high and (sides[0].empty or sides[1].empty):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    sets = [[shingles(t) for t in side["text"]] for side in sides]
    sizes = [np.array([len(x) for x in s], np.int64) for s in sets]
    both = overlaps(*sets)
    linked = 100 * both >= LINKED * (sizes[0][:, None] + sizes[1][None, :] - both)
    names = [side["label"].to_numpy() for side in sides]
    ids = [side["node"].to_numpy() for side in sides]
    linked &= names[0][:, None] != names[1][None, :]
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    found = []
    for i, j in np.argwhere(linked).tolist():
        x, y = root(int(names[0][i])), root(int(names[1][j]))
        if x != y:
            top[x] = y
            found.append((int(ids[0][i]), int(ids[1][j])))
    return pd.DataFrame(found, columns=["a", "b"]).astype(np.int64)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one side with all of the other."""
    sides = [np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (left, right)]
    shared = np.intersect1d(*sides)
    places = []
    for sets, stacked in zip((left, right), sides, strict=True):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(shared, stacked)
        at[at == len(shared)] = 0
        hit = shared[at] == stacked if len(shared) else np.zeros(len(stacked), bool)
        order = np.argsort(at[hit], kind="stable")
        places.append((owner[hit][order], at[hit][order]))
    total = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(shared), _STEP):
        held = []
        for sets, (owner, at) in zip((left, right), places, strict=True):
            low, high = np.searchsorted(at, [start, start + _STEP])
            block = np.zeros((len(sets), min(_STEP, len(shared) - start)), np.float32)
            block[owner[low:high], at[low:high] - start] = 1
            held.append(block)
        total += held[0] @ held[1].T
    return total.astype(np.int64)


def _grouped(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_key, n_shingles, node, component of every document; nodes stand for sets,
    and documents without shingles have neither node nor component."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    read = narrow.mapInArrow(_sketched, _SKETCHED).withColumn("row", F.monotonically_increasing_id())
    # Row numbers hold only for rows that are not computed again.
    rows = stage(read, "sketches")

    sets = rows.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("row").alias("node"))
    nodes = stage(
        rows.join(sets.select(F.col("node").alias("row")), "row").select(
            F.col("row").alias("node"), "set_key", "doc_id", "text_key", "n_shingles", "registers"
        ),
        "sketch-nodes",
    )

    bands = nodes.select("node", "registers").mapInArrow(_banded, "bucket long, node long")
    shared = bands.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    members = stage(bands.join(shared, "bucket").select("bucket", "node", "first"), "buckets")

    # First round: each node and the first of each of its buckets. Of those that may be linked, the
    # likeliest is confirmed.
    meet = members.where("node > first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    open_pairs = _judge(meet, nodes)
    best = open_pairs.groupBy("a").agg(F.max(F.struct("estimate", "b")).alias("x")).select("a", F.col("x.b").alias("b"))

    # By id and text: rows without an id share none of their texts' keys.
    wanted = members.select("node").distinct().join(nodes.select("node", "set_key", F.col("doc_id").alias("of"), "text_key"), "node")
    keyed = narrow.withColumn("key", F.md5(F.coalesce("text", F.lit(""))))
    named = keyed.join(wanted, (F.col("key") == F.col("text_key")) & F.col("doc_id").eqNullSafe(F.col("of")))
    texts = named.select("node", "set_key", "text").mapInArrow(_of_candidates, "node long, text string")
    texts = stage(texts.groupBy("node").agg(F.first("text").alias("text")), "candidate-texts")

    links = stage(_confirm(best, texts), "links")
    labels = connected_components(links, "a", "b")

    # Second round: groups that still hold several components.
    more = _link_blocks(members.select(F.col("first").alias("team"), "node").distinct(), labels, nodes, texts)
    labels = connected_components(links.unionByName(stage(more, "more-links")), "a", "b")

    of_sets = sets.join(labels, "node", "left").select("set_key", "node", F.coalesce("label", "node").alias("component"))
    # Joined on one more key, so that adaptive execution can split the rows of a frequent set.
    of_sets = of_sets.withColumn("deal", F.xxhash64("set_key"))
    rows = rows.drop("registers").withColumn("deal", F.xxhash64("set_key"))
    return rows.join(of_sets, ["set_key", "deal"], "left").drop("deal")


def near_groups(docs: DataFrame) -> DataFrame:
    """The group of near-duplicates of every document of ``docs`` (doc_id, text).

    Documents are linked whose five-word shingle sets are similar to 75 percent or more. Returns
    one row per input row: doc_id, n_shingles, component_id, kept. ``component_id`` is the smallest
    doc_id that can be reached over links, the row's own included; ``kept`` marks rows that have
    it. A null or wordless text has no shingles and is linked with nothing. A null doc_id counts
    for no component; a row with it has the component of the others, is kept where it has none, and
    repeated rows are linked like any equal texts. Columns besides doc_id and text are ignored.
    """
    rows = _grouped(docs)
    least = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
    # Dealt by one more key than grouped by, so that the rows of a large group can be split.
    least = least.withColumn("salt", F.xxhash64("component"))
    found = rows.withColumn("salt", F.xxhash64("component")).join(least, ["component", "salt"], "left")
    component = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the smallest
    doc_id; of repeated rows with that doc_id and text one stays. All columns are kept."""
    rows = _grouped(docs.select("doc_id", "text"))
    group = F.coalesce(F.col("component"), F.col("row"))
    alone = F.col("component").isNull()
    first = rows.groupBy(group.alias("g"), alone.alias("alone")).agg(
        F.min_by(F.struct("doc_id", "text_key"), F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("keep")
    )
    keep = first.select(F.col("keep.doc_id").alias("k_id"), F.col("keep.text_key").alias("k_text")).distinct()
    keep = keep.select(F.coalesce("k_id", F.lit(0)).alias("__near_id"), F.col("k_id").isNull().alias("__near_none"), F.col("k_text").alias("__near_key"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.withColumns(
        {"__near_id": F.coalesce(doc_id, F.lit(0).cast("long")), "__near_none": doc_id.isNull(), "__near_key": F.md5(text)}
    )
    keys = ["__near_id", "__near_none", "__near_key"]
    return keyed.join(keep, keys, "left_semi").dropDuplicates(keys).drop(*keys)
