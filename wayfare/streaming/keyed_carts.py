"""Carts kept as keyed state, for consumers that want each change as it happens.

The state of a customer is dealt over shards by flight and class, so an addition or removal touches one pair
in one shard. Clears go to all shards, and there to the pairs that have entries. Removals and clears leave
marks, since an older addition may still arrive; a timer drops a mark when the watermark has passed it and
such an addition would be dropped as late. What is left of a customer is the entries in the cart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "customer_id bigint, seq bigint, flight_id bigint, class_id int, in_cart boolean"

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Timers fall on whole minutes, so that marks set close together share one.
TIMER_MS = 60_000


def _newest(events: list) -> int:
    return int(max(s for s, _ in events if not pd.isna(s)))


class CartShard(StatefulProcessor):
    """State of one shard of one customer's cart: the newest clear, and per pair the newest removal and the
    numbers of its entries. Only sequence numbers are compared, so late and repeated events lead to
    the same state."""

    def __init__(self, timed: bool):
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cleared = handle.getValueState("cleared", "seq bigint, due bigint")
        # A pair without a mark has -1 for it.
        self.pairs = handle.getMapState(
            "pairs", "flight_id bigint, class_id int", "removed bigint, due bigint, seqs array<bigint>"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Groups are small and many, and every call on the state is a message to the JVM: events are
        # dealt in plain lists, and a pair is read and written once at most.
        customer, out, dues = key[0], [], []
        ends, of_pairs = self._dealt(pd.concat(list(rows)))

        def left(pair: tuple[int, int], seqs: list[int], change: bool) -> None:
            out.extend((customer, seq, *pair, change) for seq in seqs)

        state = self.cleared.get()
        cleared = state[0] if state else -1
        known = None
        if ends and _newest(ends) > cleared:
            cleared, due = _newest(ends), self._due(ends)
            dues.append(due)
            self.cleared.update((cleared, due))
            known = {tuple(pair): value for pair, value in self.pairs.iterator()}
            for pair, (removed, due, seqs) in known.items():
                gone = [s for s in seqs if s <= cleared]
                if gone and pair not in of_pairs:
                    left(pair, gone, False)
                    self._put(pair, removed, due, [s for s in seqs if s > cleared])

        for pair, (adds, removals) in of_pairs.items():
            before = self.pairs.getValue(pair) if known is None else known.get(pair)
            removed, due, held = before or (-1, 0, [])
            if removals and _newest(removals) > removed:
                removed, due = _newest(removals), max(due, self._due(removals))
                dues.append(due)
            bar = max(cleared, removed)
            new = sorted({int(s) for s, _ in adds} - set(held))
            left(pair, [s for s in held if s <= bar], False)
            left(pair, [s for s in new if s > bar], True)
            after = (removed, due, [s for s in [*held, *new] if s > bar])
            if before and after != (before[0], before[1], list(before[2])) or not before and (after[2] or removed >= 0):
                self._put(pair, *after)
        self._wake(dues)
        if out:
            yield pd.DataFrame(out, columns=["customer_id", "seq", "flight_id", "class_id", "in_cart"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, later = timerValues.getCurrentWatermarkInMs(), []
        state = self.cleared.get()
        if state and state[1] <= now:
            self.cleared.clear()
        elif state:
            later.append(state[1])
        for pair, (removed, due, seqs) in list(self.pairs.iterator()):
            if removed >= 0 and due <= now:
                self._put(tuple(pair), -1, 0, list(seqs))
            elif removed >= 0:
                later.append(due)
        self._wake(later)
        yield from ()

    def _dealt(self, events: pd.DataFrame) -> tuple[list, dict]:
        """The (number, time) of clears and checkouts, and of the additions and removals of each pair."""
        times = events["ts"].tolist() if self.timed else [None] * len(events)
        ends, of_pairs = [], {}
        columns = (events[c].tolist() for c in ("action", "seq", "flight_id", "class_id"))
        for action, seq, flight, cabin, time in zip(*columns, times):
            if action in ("clear", "checkout"):
                ends.append((seq, time))
            elif action in ("add", "remove") and not (pd.isna(flight) or pd.isna(cabin)):
                of_pairs.setdefault((int(flight), int(cabin)), ([], []))[action == "remove"].append((seq, time))
        return ends, of_pairs

    def _due(self, events: list) -> int:
        """When the marks of some events can go."""
        if not self.timed:
            return 0
        last = int(max(t for _, t in events if not pd.isna(t)).timestamp() * 1000)
        return -(-last // TIMER_MS) * TIMER_MS

    def _wake(self, dues: list[int]) -> None:
        """A timer for the first mark that can go, which sets the next one when it has fired."""
        if self.timed and dues:
            self.handle.registerTimer(min(dues))

    def _put(self, pair: tuple[int, int], removed: int, due: int, seqs: list[int]) -> None:
        if seqs or removed >= 0:
            self.pairs.updateValue(pair, (int(removed), int(due), [int(s) for s in seqs]))
        else:
            self.pairs.removeKey(pair)

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store, which keeps it off the heap and spills to disk."""
    spark.conf.set(_PROVIDER, _ROCKSDB)


def cart_changes(events: DataFrame, shards: int = 8, late: str | None = None) -> DataFrame:
    """Stream of cart changes: an entry appears with ``in_cart`` true and may leave with false.

    A customer is split into ``shards`` keys by flight and class, so even a customer with a large part of
    all events is spread over several tasks. With ``late`` (such as "1 hour") the stream needs a ``ts``
    column that grows with ``seq`` for a customer; events later than that are dropped, and marks that
    only those could meet go. Without it marks stay.
    """
    timed = late is not None
    columns = ["seq", "customer_id", "action", "flight_id", "class_id"]
    if timed:
        events = events.withWatermark("ts", late)
        columns.append("ts")
    own = f"array(cast(pmod(xxhash64(flight_id, class_id), {shards}) as int))"
    shard = f"explode(if(action in ('add', 'remove'), {own}, sequence(0, {shards - 1})))"
    keyed = events.select(*columns, F.expr(shard).alias("shard"))
    return keyed.groupBy("customer_id", "shard").transformWithStateInPandas(
        CartShard(timed), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime" if timed else "None"
    )


def current_carts(changes: DataFrame) -> DataFrame:
    """Entries still in the carts according to the landed changes."""
    entry = ["customer_id", "seq", "flight_id", "class_id"]
    return changes.groupBy(*entry).agg(F.bool_and("in_cart").alias("_in")).filter("_in").select(*entry)
