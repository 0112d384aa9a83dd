"""Aggregates of a user's own, with a merge: partial states by task, merged in a tree by key.

Spark combines its own aggregates before the shuffle; a function over whole groups would move every
row of a key to one task. Here a task folds its rows into one state per key, and only states move. They
are merged as sorted rows that pass by, not group by group: a group has a cost of its own, and a table
with many keys has many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: States of one key that are merged by one task at a time.
FAN = 64
#: Keys a task holds before it gives their states away and starts afresh.
HELD = 10_000
#: Rows that a task puts together by key at a time, and sums it holds.
ROWS = 1 << 18


@dataclass(frozen=True)
class Aggregate:
    """A state is an array of doubles of any length.

    ``update(state, columns)`` folds rows of one key in, given as arrays in the order of ``columns``
    (null numbers are NaN); ``merge`` joins two states and must not depend on their order beyond
    rounding; ``finish`` gives the values of the fields in ``made``. Where a state is a sum over rows,
    ``each`` may give the summands of all rows as a matrix; then rows and states of many keys are added
    up at a time, and ``update`` and ``merge`` are not called.
    """

    columns: tuple[str, ...]
    zero: Callable[[], np.ndarray]
    update: Callable[[np.ndarray, list[np.ndarray]], np.ndarray]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], Sequence]
    made: str
    each: Callable[[list[np.ndarray]], np.ndarray] | None = None

    def merged(self, states: Sequence) -> np.ndarray:
        whole = self.zero()
        for state in states:
            whole = self.merge(whole, np.asarray(state, float))
        return whole


def summed(
    columns: Sequence[str], size: int, of: Callable[[list[np.ndarray]], np.ndarray], finish: Callable, made: str, each: Callable | None = None
) -> Aggregate:
    """An aggregate whose state is ``size`` sums: ``of`` gives those of some rows, ``each`` (if given) row by row."""
    add = lambda state, other: state + other
    return Aggregate(tuple(columns), lambda: np.zeros(size), lambda state, rows: state + of(rows), add, finish, made, each)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ROWS; never an empty one."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            yield from _joined(held)
            held, rows = [], 0
    if rows:
        yield from _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()


def _codes(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """A number per row, the same where the keys are; null is a key like any other."""
    code = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        found = batch.column(k).dictionary_encode()
        at = found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        code = np.unique(code * (len(found.dictionary) + 1) + at, return_inverse=True)[1].ravel()
    return code


def _starts(code: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))


def _groups(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, its rows) of a batch that is not empty."""
    code = _codes(batch, keys)
    order = np.argsort(code, kind="stable")
    for rows in np.split(order, _starts(code[order])[1:]):
        yield tuple(batch.column(k)[int(rows[0])].as_py() for k in keys), rows


def _matrix(states: pa.Array) -> np.ndarray:
    return states.flatten().to_numpy(zero_copy_only=False).reshape(len(states), -1)


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix, float).ravel()))


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*names).schema)


def _plain(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Minus zero is no key beside zero."""
    kinds = dict(df.select(*keys).dtypes)
    return df.withColumns({k: (F.col(k) + F.lit(0.0)).cast(kinds[k]) for k in keys if kinds[k] in ("float", "double")})


def _state_schema(df: DataFrame, keys: Sequence[str]) -> pa.Schema:
    return pa.schema([*to_arrow_schema(df.select(*keys).schema), ("_part", pa.int32()), ("_state", pa.list_(pa.float64()))])


def partials(df: DataFrame, keys: Sequence[str], aggregate: Aggregate) -> DataFrame:
    """(keys, _part, _state): a state per key and task, or a few where a task meets very many keys."""
    keys, used = list(keys), list(dict.fromkeys([*keys, *aggregate.columns]))
    # A key may be a column of the aggregate, too, and that stays as it is.
    named = {k: f"_key{i}" for i, k in enumerate(keys)}
    rows = _plain(df.select(*used, *(F.col(k).alias(n) for k, n in named.items()), F.spark_partition_id().alias("_part")), list(named.values()))
    schema, inner = _state_schema(df, keys), list(named.values())

    def given(held: dict, part: int) -> pa.RecordBatch:
        columns = [pa.array([key[i] for key in held], schema.field(i).type) for i in range(len(keys))]
        states = pa.array([np.asarray(s, float) for s in held.values()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(held), pa.int32()), states], schema=schema)

    def values(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(c).to_numpy(zero_copy_only=False) for c in aggregate.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = {}, 0
        for batch in _chunks(batches):
            part, columns = batch.column("_part")[0].as_py(), values(batch)
            for key, some in _groups(batch, inner):
                state = held[key] if key in held else aggregate.zero()
                held[key] = aggregate.update(state, [v[some] for v in columns])
                if len(held) >= HELD:
                    yield given(held, part)
                    held = {}
        if held:
            yield given(held, part)

    def added(batch: pa.RecordBatch, names: Sequence[str], summands: np.ndarray) -> pa.RecordBatch:
        code = _codes(batch, names)
        order = np.argsort(code, kind="stable")
        starts = _starts(code[order])
        firsts = batch.take(pa.array(order[starts]))
        sums = np.add.reduceat(summands[order], starts, axis=0)
        return pa.RecordBatch.from_arrays([*(firsts.column(n) for n in [*names, "_part"]), _lists(sums)], schema=schema)

    def run_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in _chunks(batches):
            held.append(added(batch, inner, np.asarray(aggregate.each(values(batch)), float)))
            if sum(h.num_rows for h in held) >= ROWS:
                held = [added(h, keys, _matrix(h.column("_state"))) for h in _joined(held)]
                if sum(h.num_rows for h in held) > ROWS // 2:  # hardly a key comes again
                    yield from held
                    held = []
        for h in _joined(held) if held else []:
            yield added(h, keys, _matrix(h.column("_state")))

    return rows.mapInArrow(run if aggregate.each is None else run_sums, f"{_fields(df, keys)}_part int, _state array<double>")


def aggregated(df: DataFrame, keys: Sequence[str], aggregate: Aggregate) -> DataFrame:
    """(keys, made) for every key of ``df``.

    States of one key are merged FAN at a time, in as many rounds as the number of tasks asks for, so
    that a key that all tasks have is no more work for one of them than any other. An empty table has
    no rows, also without keys.
    """
    keys = list(keys)
    states, parts = partials(df, keys, aggregate), df.rdd.getNumPartitions()
    shape, schema = f"{_fields(df, keys)}_part int, _state array<double>", _state_schema(df, keys)
    made = StructType.fromDDL(aggregate.made)
    whole = pa.schema([*to_arrow_schema(df.select(*keys).schema), *to_arrow_schema(made)])

    def merged(by: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One state for each run of rows with the same ``by``; the last run may go on in the next batch."""
            last = []
            for batch in _chunks(batches):
                for joined in _joined([*last, batch]):
                    starts, states = _starts(_codes(joined, by)), joined.column("_state")
                    if aggregate.each is not None:
                        sums = _lists(np.add.reduceat(_matrix(states), starts, axis=0))
                    else:
                        cuts = zip(starts, [*starts[1:], joined.num_rows], strict=True)
                        of = lambda a, b: [s.values.to_numpy(zero_copy_only=False) for s in states[int(a) : int(b)]]
                        sums = pa.array([aggregate.merged(of(a, b)) for a, b in cuts], pa.list_(pa.float64()))
                    firsts = joined.take(pa.array(starts))
                    one = pa.RecordBatch.from_arrays([*(firsts.column(n) for n in [*keys, "_part"]), sums], schema=schema)
                    yield one.slice(0, one.num_rows - 1)
                    last = [one.slice(one.num_rows - 1)]
            yield from last

        return run

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(keys)(batches):
            if batch.num_rows:
                values = [aggregate.finish(s.values.to_numpy(zero_copy_only=False)) for s in batch.column("_state")]
                columns = [pa.Array.from_pandas(pd.Series(c), type=whole.field(n).type) for n, c in zip(made.names, zip(*values, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *columns], schema=whole)

    while parts > FAN:
        states = states.withColumn("_part", F.floor(F.col("_part") / FAN).cast("int"))
        by = [*keys, "_part"]
        states, parts = states.repartition(*by).sortWithinPartitions(*by).mapInArrow(merged(by), shape), -(-parts // FAN)

    met = states.repartition(*keys) if keys else states.repartition(1)
    return met.sortWithinPartitions(*keys, "_part").mapInArrow(finished, f"{_fields(df, keys)}{aggregate.made}")
