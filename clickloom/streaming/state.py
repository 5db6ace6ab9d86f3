"""Evolving-session state as a streaming operator, and its batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "session_key string, request_id long, items array<bigint>"


def session_key(session_id: F.Column) -> F.Column:
    return F.md5(session_id.cast("string").cast("binary"))


def step(items: list[int], last_time: int | None, item: int, time: int, idle: int, most: int) -> list[int]:
    """The session after a click: forgotten if idle for longer, appended unless it repeats the last item, one oldest item dropped if too long."""
    if last_time is not None and time - last_time > idle:
        items = []
    if items and items[-1] == item:
        return items
    items = [*items, item]
    return items[1:] if len(items) > most else items


class EvolvingSessions(StatefulProcessor):
    """State of one session: its items and the time of its last click; expiry is judged by the clicks' own times."""

    def __init__(self, idle: int = 1200, most: int = 2, ttl_ms: int | None = None) -> None:
        self.idle, self.most, self.ttl_ms = idle, most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "items array<bigint>, time bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        items, last = (list(held[0]), held[1]) if held else ([], None)
        clicks = pd.concat(list(rows)).sort_values(["time", "request_id"])
        out = []
        for request, item, time in zip(clicks["request_id"], clicks["item_id"], clicks["time"], strict=True):
            items, last = step(items, last, int(item), int(time), self.idle, self.most), int(time)
            out.append((key[0], int(request), items))
        self.state.update((items, last))
        yield pd.DataFrame(out, columns=["session_key", "request_id", "items"])

    def close(self) -> None:
        pass


def evolve(requests: DataFrame, idle: int = 1200, most: int = 2, ttl_ms: int | None = None) -> DataFrame:
    """(session_key, request_id, items) for streaming requests(request_id, session_id, item_id, time, user_consent).

    Without consent a request is a session of its one item and leaves no state. ttl_ms: the store drops a session's state so long after
    its last click, by the cluster's clock; such a stream runs on, since its time never ends.
    """
    keyed = requests.withColumn("session_key", session_key(F.col("session_id")))
    own = keyed.filter("user_consent").groupBy("session_key").transformWithStateInPandas(EvolvingSessions(idle, most, ttl_ms), OUTPUT, "append", "ProcessingTime" if ttl_ms else "None")
    return own.union(stateless(keyed))


def stateless(keyed: DataFrame) -> DataFrame:
    return keyed.filter("NOT user_consent").select("session_key", "request_id", F.array("item_id").alias("items"))


def evolve_batch(requests: DataFrame, idle: int = 1200, most: int = 2) -> DataFrame:
    """The same over a table: sessions are folded by an aggregate over their clicks in order, without Python."""
    keyed = requests.withColumn("session_key", session_key(F.col("session_id")))
    clicks = keyed.filter("user_consent").groupBy("session_key").agg(F.array_sort(F.collect_list(F.struct("time", "request_id", "item_id"))).alias("clicks"))
    start = "named_struct('items', CAST(array() AS array<bigint>), 'time', CAST(NULL AS bigint), 'out', CAST(array() AS array<struct<request_id: bigint, items: array<bigint>>>))"
    live = f"IF(a.time IS NOT NULL AND c.time - a.time > {idle}, CAST(array() AS array<bigint>), a.items)"
    grown = f"IF(element_at(reverse({live}), 1) <=> c.item_id, {live}, IF(size({live}) + 1 > {most}, slice(concat({live}, array(c.item_id)), 2, {most}), concat({live}, array(c.item_id))))".replace("element_at(reverse", "try_element_at(reverse")
    fold = f"aggregate(clicks, {start}, (a, c) -> named_struct('items', {grown}, 'time', c.time, 'out', concat(a.out, array(named_struct('request_id', c.request_id, 'items', {grown})))), a -> a.out)"
    rows = clicks.select("session_key", F.explode(F.expr(fold)).alias("o")).select("session_key", "o.request_id", "o.items")
    return rows.union(stateless(keyed))
