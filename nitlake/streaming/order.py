"""Rows of a stream in the order of their event time, key by key.

Rows that come out of order wait in state until the watermark has passed them; what is late beyond the
watermark never enters. Then they go on in order, together with what the last row before them left.
State and timers belong to a bucket of keys: asking for them costs a call to the JVM each time, and keys
are as many as the input makes them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of keys. A task holds the waiting rows of one of them.
BUCKETS = 4096

#: (key as strings, what the last row left or None, rows in order) to (columns of rows to give, what the last row leaves)
Advance = Callable[[tuple, tuple | None, list[tuple]], tuple[dict[str, list], tuple]]


class InOrder(StatefulProcessor):
    """Holds back rows ``(key, micros, *rest)`` until the watermark has passed ``micros``."""

    def __init__(self, rest: Sequence[str], order: int, made: Sequence[str], advance: Advance, quiet_ms: int | None):
        self.rest, self.order, self.made, self.advance, self.quiet_ms = list(rest), order, list(made), advance, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "held binary")
        self.carried = handle.getValueState("carried", "held binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            held = [map(tuple, batch["who"]), batch["at_micros"].tolist(), *(_packed(batch[name].tolist()) for name in self.rest)]
            self.waiting.appendValue((pickle.dumps(list(zip(*held, strict=True))),))
            first = min(held[1]) if first is None else min(first, *held[1])
        if first is not None:  # a timer at the present watermark would be taken for one that has fired
            self.handle.registerTimer(max(_millis(first), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = [row for held in self.waiting.get() for row in pickle.loads(held[0])]
        ready = [row for row in rows if row[1] <= passed * 1000]
        later = [row for row in rows if row[1] > passed * 1000]
        if not ready and self.quiet_ms is None:
            return
        carried = pickle.loads(self.carried.get()[0]) if self.carried.exists() else {}
        found = {name: [] for name in ("who", *self.made)}
        if ready:
            self.waiting.clear()
            if later:
                self.waiting.put([(pickle.dumps(later),)])
                self.handle.registerTimer(_millis(min(row[1] for row in later)))
            ready.sort(key=lambda row: ([(part is not None, part) for part in row[0]], *row[1 : 2 + self.order]))
            for who, some in groupby(ready, key=lambda row: row[0]):
                mine = list(some)
                made, left = self.advance(who, carried[who][1] if who in carried else None, [row[2:] for row in mine])
                carried[who] = mine[-1][1], tuple(_packed(left))
                found["who"] += [list(who)] * len(mine)
                for name, values in made.items():
                    found[name] += values
        if self.quiet_ms is not None:
            self._forget(carried, passed, {row[0] for row in later})
        if carried:
            self.carried.update((pickle.dumps(carried),))
        elif self.carried.exists():
            self.carried.clear()
        if ready:
            yield pd.DataFrame(found)

    def _forget(self, carried: dict, passed: int, waiting: set) -> None:
        """Drop keys of which nothing has come for ``quiet_ms`` of event time."""
        for who in [who for who, (last, _) in carried.items() if _millis(last) + self.quiet_ms <= passed and who not in waiting]:
            del carried[who]
        ends = [end for end in (_millis(last) + self.quiet_ms for last, _ in carried.values()) if end > passed]
        if ends:
            self.handle.registerTimer(min(ends))

    def close(self) -> None:
        pass


def _packed(values: Sequence) -> list:
    """Arrays of numbers travel to the state as bytes, not number by number."""
    return [np.asarray(v, float).tobytes() if isinstance(v, np.ndarray) else v for v in values]


def _millis(micros: int) -> int:
    return -(-int(micros) // 1000)


def in_order(
    rows: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    advance: Advance,
    made: str,
    late: str,
    quiet_ms: int | None = None,
) -> DataFrame:
    """(keys, made): ``advance`` over the rows of each key in the order of ``ts``, then of the columns in ``order``.

    A row waits until the watermark, which is ``late`` behind the newest row of all, has passed its time;
    one that comes when it has passed is left out, as Spark counts in ``numRowsDroppedByWatermark``. So
    state holds the rows of the last ``late`` of the stream, and what ``advance`` left of each key. That
    goes too once a key has been quiet for ``quiet_ms`` of event time; rows that come
    later start afresh. The last rows of a stream that ends need a newer row of any key behind them.
    Times lie after 1970, where Spark's watermark begins. Keys are of types that a string can hold;
    ``advance`` gets them as strings, and gives a row for each row it gets.
    Columns of type ``array<double>`` reach ``advance`` as bytes, and what it leaves may be NumPy arrays.
    """
    keys, kinds = list(keys), dict(rows.dtypes)
    rest = [*order, *(name for name in rows.columns if name not in {*keys, ts, *order})]
    fields = [field.split()[0] for field in made.split(", ")]
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    who = F.array(*(F.col(k).cast("string") for k in keys)).alias("who")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket")
    timed = rows.withWatermark(ts, late).select(bucket, who, ts, F.unix_micros(ts).alias("at_micros"), *rest)
    processor = InOrder(rest, len(order), fields, advance, quiet_ms)
    found = timed.groupBy("bucket").transformWithStateInPandas(processor, f"who array<string>, {made}", "append", "EventTime")
    return found.select(*(F.get("who", F.lit(i)).cast(kinds[k]).alias(k) for i, k in enumerate(keys)), *fields)
