"""Admission of requests: a sliding log per client that denials do not extend, and verdicts reused for a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The limits of one client.
WINDOW_MS, MAX_REQUESTS = 600_000, 10
CACHE_MS = 600_000


def _admit(kept: list[int], at: int, window: int, most: int) -> tuple[list[int], bool]:
    kept = [t for t in kept if at - t < window]
    return (kept, False) if len(kept) >= most else ([*kept, at], True)


def admitted(requests: DataFrame, window_ms: int = WINDOW_MS, most: int = MAX_REQUESTS) -> DataFrame:
    """requests: client, at (ms), seq. Adds allowed: fewer than `most` allowed requests of the client in the window before.

    A denial depends on earlier denials, so a client's requests are taken in order, by one task that holds at most `most`
    times for it; they are streamed, never gathered.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, kept = object(), []
        for b in batches:
            out = []
            for c, at in zip(b.column("client").to_pylist(), b.column("at").to_pylist(), strict=True):
                if c != client:
                    client, kept = c, []
                kept, ok = _admit(kept, at, window_ms, most)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([b.column("client"), b.column("at"), b.column("seq"), pa.array(out, pa.bool_())], ["client", "at", "seq", "allowed"])

    rows = requests.select("client", F.col("at").cast("long").alias("at"), F.col("seq").cast("long").alias("seq"))
    kind = next(t for c, t in rows.dtypes if c == "client")
    return rows.repartition("client").sortWithinPartitions("client", "at", "seq").mapInArrow(run, f"client {kind}, at long, seq long, allowed boolean")


def admitted_stream(requests: DataFrame, window_ms: int = WINDOW_MS, most: int = MAX_REQUESTS, expire: bool = True) -> DataFrame:
    """The same over a stream of (client string, at long, seq long), with the client's log as keyed state.

    expire: a log goes when its client was silent for the window. Spark then also runs batches without data, so a query
    that is to end by itself takes expire=False.
    """

    def run(key: tuple, pdfs: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(pdfs).sort_values(["at", "seq"])
        allowed = []
        for at in rows["at"]:
            kept, ok = _admit(kept, int(at), window_ms, most)
            allowed.append(ok)
        state.update((kept,))
        if expire:
            state.setTimeoutDuration(window_ms)
        yield pd.DataFrame({"client": key[0], "at": rows["at"], "seq": rows["seq"], "allowed": allowed})

    return requests.groupBy("client").applyInPandasWithState(run, "client string, at long, seq long, allowed boolean", "kept array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def served(requests: DataFrame, ttl_ms: int = CACHE_MS) -> DataFrame:
    """requests: key, at (ms), seq. Adds cached: an earlier scan of the key that is not older than ttl_ms, or a new scan."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, landed = object(), None
        for b in batches:
            out = []
            for k, at in zip(b.column("key").to_pylist(), b.column("at").to_pylist(), strict=True):
                if k != key:
                    key, landed = k, None
                hit = landed is not None and at - landed < ttl_ms
                landed = landed if hit else at
                out.append(hit)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("at"), b.column("seq"), pa.array(out, pa.bool_())], ["key", "at", "seq", "cached"])

    rows = requests.select("key", F.col("at").cast("long").alias("at"), F.col("seq").cast("long").alias("seq"))
    kind = next(t for c, t in rows.dtypes if c == "key")
    return rows.repartition("key").sortWithinPartitions("key", "at", "seq").mapInArrow(run, f"key {kind}, at long, seq long, cached boolean")


def client_key(platform, forwarded, real, trusted_hops: int = 1):
    """The client's name: the platform's header, else the hop before the trusted ones, else the proxy's, else one shared name."""
    hops = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    hop = F.when(F.size(hops) >= trusted_hops, F.try_element_at(hops, F.lit(-trusted_hops)))
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(filled(platform), hop, filled(real), F.lit("unknown"))
