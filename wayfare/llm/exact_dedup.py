"""Exact deduplication by content-defined chunk recipes.

Each text is read once. A rolling hash cuts it into chunks at places that depend on the bytes
around them, so equal passages give equal chunks wherever they stand. From then on only chunk
hashes move: chunks are reduced to distinct ones, each gets a verified identifier, a text becomes
the ordered list of its chunks' identifiers, and texts are equal when those lists are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.session import stage

#: Rolling window in bytes; a power of two.
WINDOW = 16
#: A cut falls after a byte whose rolling hash has this many leading zero bits: 1 KiB on average.
CUT_BITS = 10
MIN_CHUNK, MAX_CHUNK = 256, 8192

RECIPE = "doc_id long, text_sha256 string, chunks array<struct<hash: bigint, digest: binary>>"


def _gear() -> np.ndarray:
    """One mixed 32-bit value per byte value."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def cut_points(data: bytes) -> list[int]:
    """End offsets of the chunks of ``data``; empty for empty data.

    The rolling hash at a byte sums the gear values of the last ``WINDOW`` bytes, each shifted by
    its distance; doubling the window builds it in a few array passes.
    """
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    rolled = GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:
        wider = rolled.copy()
        wider[width:] += rolled[:-width] << np.uint32(width)
        rolled, width = wider, 2 * width
    cuts, start = [], 0
    for at in (np.flatnonzero(rolled >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist() + [n]:
        while at - start > MAX_CHUNK:
            start += MAX_CHUNK
            cuts.append(start)
        if at - start >= MIN_CHUNK or at == n:
            if at > start:
                cuts.append(at)
            start = at
    return cuts


def recipe(data: bytes) -> list[dict]:
    """The chunks of ``data`` in order: a 64-bit hash and a SHA-256 digest each."""
    found, start = [], 0
    for end in cut_points(data):
        chunk = data[start:end]
        signed = xxhash.xxh3_64_intdigest(chunk) - (1 << 63)
        found.append({"hash": signed, "digest": hashlib.sha256(chunk).digest()})
        start = end
    return found


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("digest", pa.binary())]))
    for batch in batches:
        digests, chunks = [], []
        for text in batch.column("text"):
            data = (text.as_py() or "").encode().lower()  # bytes.lower() changes A-Z alone
            digests.append(hashlib.sha256(data).hexdigest())
            chunks.append(recipe(data))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(digests, pa.string()), pa.array(chunks, kind)],
            ["doc_id", "text_sha256", "chunks"],
        )


def verified_chunks(chunks: DataFrame) -> DataFrame:
    """hash, digest, variant of every distinct chunk: (hash, variant) identifies its content.

    ``variant`` tells apart contents that share a 64-bit hash, and is 0 but for such a collision.
    """
    distinct = chunks.groupBy("hash", "digest").agg(F.count("*").alias("uses"))
    alike = distinct.groupBy("hash").agg(F.array_sort(F.collect_set("digest")).alias("digests"))
    return alike.select("hash", F.posexplode("digests").alias("variant", "digest"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """Group ``docs`` (doc_id, text) by equal text and mark the row that stays.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Returns one
    row per input row: doc_id, keep_id, group_size, kept, text_sha256. The row with the largest
    doc_id stays; a null doc_id counts as smaller than any other, and of repeated rows with that
    doc_id exactly one stays. Empty texts form a group like any other. Other columns are ignored.
    """
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    read = read.mapInArrow(_recipes, RECIPE).withColumn("row", F.monotonically_increasing_id())
    # Row numbers hold only for rows that are not computed again.
    rows = stage(read, "chunk-recipes")

    chunks = rows.select("row", F.posexplode("chunks").alias("at", "chunk")).select(
        "row", "at", "chunk.hash", "chunk.digest"
    )
    named = chunks.join(verified_chunks(chunks), ["hash", "digest"])
    lists = named.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "hash", "variant"))).alias("ids"))
    # A text without chunks has no list and is equal to the other empty ones.
    ids = F.coalesce(F.expr("transform(ids, x -> struct(x.hash, x.variant))"), F.expr("array()"))
    named_rows = rows.drop("chunks").join(lists, "row", "left").withColumn("ids", ids)
    named_rows = named_rows.withColumn("list_hash", F.xxhash64("ids"))
    groups = named_rows.groupBy("ids").agg(
        F.max(F.struct("doc_id", "row")).alias("keeper"), F.count("*").alias("group_size")
    )
    # Joined on one more key than grouped by, both sides are dealt anew, and adaptive execution can
    # then split the rows of a large group over several tasks.
    groups = groups.withColumn("list_hash", F.xxhash64("ids"))
    return named_rows.join(groups, ["list_hash", "ids"]).select(
        "doc_id",
        F.col("keeper.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keeper.row")).alias("kept"),
        "text_sha256",
    )
