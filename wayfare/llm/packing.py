"""Best-fit packing into sequences of several permitted lengths.

Documents, cut into pieces no longer than the longest sequence, are dealt evenly into groups of a
bounded number of pieces, and each group is packed on its own. Pieces are placed longest first into
the open sequence that they fill best. Where none has room, a new one is opened at the length that
costs least for what is left to place. In the end every sequence shrinks to the shortest permitted
length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.session import stage

#: Permitted sequence lengths.
LENGTHS = (1024, 2048, 4096, 8192)
#: Cost of a sequence beyond its length, in tokens.
OVERHEAD = 64
#: Pieces of a group, on average.
GROUP = 20_000

PLACED = "doc_id long, piece int, start long, length int, bin long, capacity int, offset int"


def pack(sizes: np.ndarray, lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, capacity and offset of each piece.

    Ties go to the piece that comes first and to the bin opened first. A piece of size 0 takes no
    room; a piece longer than every length is an error.
    """
    lengths = sorted(lengths)
    if len(sizes) and sizes.max() > lengths[-1]:
        raise ValueError("a piece is longer than every permitted length")
    n = len(sizes)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    filled: list[int] = []
    # Open bins by the room that they have left.
    room: list[int] = []
    by_room: dict[int, list[int]] = {}
    left = int(sizes.sum())

    def put_back(bin_: int, space: int) -> None:
        if space:
            if space not in by_room:
                insort(room, space)
                by_room[space] = []
            insort(by_room[space], bin_)

    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(room, size)
        if at < len(room):
            space = room[at]
            bin_ = by_room[space].pop(0)
            if not by_room[space]:
                del by_room[space]
                del room[at]
        else:
            # What is left fills a bin up to its length, at best; the least cost per token wins.
            space = min((c for c in lengths if c >= size), key=lambda c: ((c + overhead) / max(1, min(c, left)), c))
            bin_ = len(filled)
            filled.append(0)
        bins[i], offsets[i] = bin_, filled[bin_]
        filled[bin_] += size
        left -= size
        put_back(bin_, space - size)
    capacity = np.array([lengths[bisect_left(lengths, f)] for f in filled], np.int64)
    return bins, capacity[bins] if n else np.zeros(0, np.int64), offsets


def pack_documents(
    docs: DataFrame,
    length: Column | None = None,
    lengths: Sequence[int] = LENGTHS,
    overhead: int = OVERHEAD,
    group: int = GROUP,
) -> DataFrame:
    """Place every document of ``docs`` in sequences of the permitted lengths.

    ``length`` gives a document's tokens; without it they are the UTF-8 bytes of ``text`` and one
    end mark. Returns one row per piece: doc_id, piece (from 0), start and length within the
    document, bin, its capacity, and the piece's offset in it. All tokens of all rows are placed,
    each once. A null length or text counts as 0 tokens, or an end mark alone; a document of 0
    tokens has no piece. Repeated rows are placed each on its own, null ids stay null.
    """
    tokens = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 1 if length is None else length
    narrow = docs.select(F.col("doc_id").cast("long"), F.coalesce(tokens.cast("long"), F.lit(0)).alias("tokens"))
    # Row numbers hold only for rows that are not computed again.
    rows = stage(narrow.withColumn("row", F.monotonically_increasing_id()), "lengths").where("tokens > 0")
    longest = max(lengths)
    starts = F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(longest).cast("long"))
    pieces = rows.select("doc_id", "row", "tokens", F.posexplode(starts).alias("piece", "start")).withColumn(
        "length", F.least(F.lit(longest), F.col("tokens") - F.col("start")).cast("int")
    )
    total = pieces.count()
    groups = max(1, -(-total // group))

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["row", "piece"], kind="stable")
        bins, capacity, offsets = pack(part["length"].to_numpy(np.int64), lengths, overhead)
        part = part.assign(bin=bins + (part["group"].to_numpy(np.int64) << 32), capacity=capacity, offset=offsets)
        return part[["doc_id", "piece", "start", "length", "bin", "capacity", "offset"]]

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    return dealt.drop("tokens").groupBy("group").applyInPandas(place, PLACED)
