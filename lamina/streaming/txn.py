"""Transactions: timestamps, watermarks and leases, on the driver; and the same watermarks over a log of them."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LeaseExpired(RuntimeError):
    """The transaction took longer than its lease; it is rolled back."""


@dataclass
class Transaction:
    id: int
    ts: int
    read_only: bool
    expires: float


class Transactions:
    """Write transactions run at their own number as timestamp; read-only ones one below the high watermark. The high
    watermark is the least timestamp of a running write, or else one above the greatest that ended; the low one is the
    same for read-only ones."""

    def __init__(self, lease_s: float = 600, clock: Callable[[], float] = time.monotonic):
        self.lease_s, self.clock, self.next = lease_s, clock, 1
        self.running: dict[int, Transaction] = {}
        self.ended = {False: 0, True: 0}

    @property
    def high_watermark(self) -> int:
        return min([t.ts for t in self.running.values() if not t.read_only], default=self.ended[False] + 1)

    @property
    def low_watermark(self) -> int:
        return min([t.ts for t in self.running.values() if t.read_only], default=self.ended[True] + 1)

    @property
    def safe_fold(self) -> int:
        """Up to where garbage may be collected: no running reader is older, and no writer is."""
        top = self.high_watermark - 1
        return min(self.low_watermark, top) if any(t.read_only for t in self.running.values()) else top

    def begin(self, read_only: bool = False) -> Transaction:
        number, self.next = self.next, self.next + 1
        t = Transaction(number, self.high_watermark - 1 if read_only else number, read_only, self.clock() + self.lease_s)
        self.running[number] = t
        return t

    def _end(self, t: Transaction) -> None:
        self.running.pop(t.id, None)
        self.ended[t.read_only] = max(self.ended[t.read_only], t.ts)

    def commit(self, t: Transaction) -> None:
        if t.id not in self.running:
            raise LeaseExpired(f"transaction {t.id} has ended")
        if self.clock() > t.expires:
            self._end(t)
            raise LeaseExpired(f"the lease of transaction {t.id} has run out")
        self._end(t)

    def rollback(self, t: Transaction) -> None:
        self._end(t)

    def extend(self, t: Transaction) -> None:
        if self.clock() > t.expires:
            raise LeaseExpired(f"the lease of transaction {t.id} has run out")
        t.expires = self.clock() + self.lease_s

    def expire(self) -> list[int]:
        """Rolls back what has run out."""
        out = [t for t in self.running.values() if self.clock() > t.expires]
        for t in out:
            self._end(t)
        return [t.id for t in out]


def watermarks(log: DataFrame) -> DataFrame:
    """high_watermark, low_watermark, safe_fold after a log of transactions: txn_id, ts, read_only, ended (whether it
    has committed or was rolled back)."""
    write, ended = ~F.col("read_only"), F.col("ended")
    figures = log.agg(
        F.coalesce(F.min(F.when(write & ~ended, F.col("ts"))), F.coalesce(F.max(F.when(write & ended, F.col("ts"))), F.lit(0)) + 1).cast("long").alias("high_watermark"),
        F.coalesce(F.min(F.when(~write & ~ended, F.col("ts"))), F.coalesce(F.max(F.when(~write & ended, F.col("ts"))), F.lit(0)) + 1).cast("long").alias("low_watermark"),
        F.count_if(~write & ~ended).alias("_readers"),
    )
    top = F.col("high_watermark") - 1
    return figures.select("high_watermark", "low_watermark", F.when(F.col("_readers") > 0, F.least("low_watermark", top)).otherwise(top).alias("safe_fold"))
