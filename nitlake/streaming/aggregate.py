"""A user's aggregate on a stream: states of a micro-batch are merged into one state per key."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.aggregate import Aggregate, partials
from .order import ROCKS

#: Groups of keys by hash. Spark calls Python once for each that a micro-batch touches, not once a key.
BUCKETS = 4096


def aggregated_stream(rows: DataFrame, keys: Sequence[str], aggregate: Aggregate) -> DataFrame:
    """(keys, updates, made): what ``aggregate`` gives for a key, each time that a micro-batch had rows of it.

    Of a key, the row with the most ``updates`` tells of all rows so far. Tasks fold their rows first, so
    a key that all rows have sends one state a task. State is one state per key, for as long as the stream,
    kept with those of the same bucket. Keys are of types that a string can hold.
    """
    keys, kinds = list(keys), dict(rows.select(*keys).dtypes)
    fields = [field.split()[0] for field in aggregate.made.split(",")]

    def met(bucket: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(kept.get[0]) if kept.exists else {}
        touched = {}
        for batch in batches:
            batch = batch.sort_values("partial_of", kind="stable")
            for who, state in zip(map(tuple, batch["who"]), batch["partial"], strict=True):
                if who not in touched:
                    updates, packed = held.get(who, (0, None))
                    touched[who] = updates + 1, aggregate.zero() if packed is None else np.frombuffer(packed, float)
                updates, whole = touched[who]
                touched[who] = updates, aggregate.merge(whole, np.asarray(state, float))
        held |= {who: (updates, np.asarray(whole, float).tobytes()) for who, (updates, whole) in touched.items()}
        kept.update((pickle.dumps(held),))
        values = zip(*(aggregate.finish(whole) for _, whole in touched.values()), strict=True)
        made = {"who": list(map(list, touched)), "updates": [updates for updates, _ in touched.values()]}
        yield pd.DataFrame(made | dict(zip(fields, map(list, values), strict=True)))

    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    bucket = F.pmod(F.xxhash64(F.lit(0), *keys), F.lit(BUCKETS))
    who = F.array(*(F.col(k).cast("string") for k in keys)).cast("array<string>")
    # Names that begin with an underscore do not reach a stateful function.
    states = partials(rows, keys, aggregate).select(
        bucket.alias("bucket"), who.alias("who"), F.col("_part").alias("partial_of"), F.col("_state").alias("partial")
    )
    made = f"who array<string>, updates bigint, {aggregate.made}"
    found = states.groupBy("bucket").applyInPandasWithState(met, made, "held binary", "append", GroupStateTimeout.NoTimeout)
    return found.select(*(F.get("who", F.lit(i)).cast(kinds[k]).alias(k) for i, k in enumerate(keys)), "updates", *fields)
