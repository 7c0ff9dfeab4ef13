"""One pass over sorted rows: row numbers, previous rows, running sums and flags within a key of any size.

Rows are range-partitioned and sorted by key and order. A task walks its sorted rows once, Arrow batch by
Arrow batch, and adds what it knows on its own: everything is right but for the key that a partition
continues from the one before. What is missing there is one row per partition, put together on the driver
and broadcast; the rows are not shuffled a second time and their layout is read once.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.runtime import stage

# Ship these functions inside the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Opens = Callable[[dict[str, pa.Array], dict[str, pa.Array]], np.ndarray]


@dataclass
class Walk:
    """What to add to each row. ``previous`` columns of the row before, ``sums`` of columns (NULL as 0; integers
    exactly), ``opens`` tells from (columns of the row before, columns of the row) where a new group begins."""

    keys: list[str]
    previous: list[str] = field(default_factory=list)
    sums: list[str] = field(default_factory=list)
    opens: Opens | None = None
    opens_on: list[str] = field(default_factory=list)
    totals: bool = False  # without keys: the sums over the whole table, too

    def seen(self) -> list[str]:
        return list(dict.fromkeys([*self.keys, *self.previous, *self.opens_on]))


def _same(before: dict[str, pa.Array], now: dict[str, pa.Array], keys: list[str], n: int) -> np.ndarray:
    """Whether the key of each row is that of the row before; NULLs are equal."""
    same = np.ones(n, dtype=bool)
    for k in keys:
        both = pc.and_(pc.is_null(before[k]), pc.is_null(now[k]))
        same &= pc.if_else(pc.is_valid(eq := pc.equal(before[k], now[k])), eq, both).to_numpy(zero_copy_only=False)
    return same


def _numbers(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False)


def _array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class _Walker:
    """State of one task between batches: the last row and the totals of its key so far."""

    def __init__(self, walk: Walk) -> None:
        self.walk, self.last, self.head = walk, None, True
        self.n, self.groups, self.totals = 0, 0, [0] * len(walk.sums)

    def step(self, batch: pa.RecordBatch) -> list[pa.Array]:
        walk, n = self.walk, batch.num_rows
        now = {c: _array(batch.column(c)) for c in walk.seen()}
        first = {c: a.slice(0, 1) if self.last is None else self.last[c] for c, a in now.items()}
        before = {c: pa.concat_arrays([first[c], a.slice(0, n - 1)]) for c, a in now.items()}
        same = _same(before, now, walk.keys, n)
        alone = self.last is None  # the row before the first is in another task
        start = ~same
        start[0] |= alone
        at = np.arange(n)
        run = np.maximum.accumulate(np.where(start, at, -1))  # -1: the key of the batch before goes on
        goes_on = run < 0
        head = goes_on & self.head if not alone else run == 0
        out = [pa.array(at - np.maximum(run, 0) + 1 + np.where(goes_on, self.n, 0)), pa.array(head), pa.array((at == 0) & alone)]
        for c in walk.previous:
            out.append(pc.if_else(pa.array(~start), before[c], pa.scalar(None, before[c].type)))
        for k, c in enumerate(walk.sums):
            upto = np.cumsum(_numbers(_array(batch.column(c))))
            base = np.where(run > 0, upto[np.maximum(run, 1) - 1], 0)
            total = upto - base + np.where(goes_on, self.totals[k], 0)
            self.totals[k] = total[-1]
            out.append(pa.array(total))
        if walk.opens:
            flag = start | walk.opens(before, now)
            flag[0] &= not alone  # to be told by the row before
            upto = np.cumsum(flag)
            base = np.where(run > 0, upto[np.maximum(run, 1) - 1], 0)
            groups = upto - base + np.where(goes_on, self.groups, 0)
            self.groups = groups[-1]
            out += [pa.array(flag.astype(np.int32)), pa.array(groups)]
        self.n, self.head = out[0][-1].as_py(), bool(head[-1])
        self.last = {c: a.slice(n - 1, 1) for c, a in now.items()}
        return out


def _walked(df: DataFrame, walk: Walk, order: list[Column]) -> DataFrame:
    """Stage table of the sorted rows with what each task knows on its own."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    added = [("_n", T.LongType()), ("_head", T.BooleanType()), ("_lone", T.BooleanType())]
    added += [(f"_p_{c}", kinds[c]) for c in walk.previous]
    added += [(f"_s_{c}", T.DoubleType() if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else T.LongType()) for c in walk.sums]
    if walk.opens:
        added += [("_flag", T.IntegerType()), ("_groups", T.LongType())]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in added], T.StructField("_part", T.IntegerType()), T.StructField("_pos", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, part, seen = _Walker(walk), TaskContext.get().partitionId(), 0
        for batch in batches:
            if n := batch.num_rows:
                tail = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen + 1, seen + n + 1))]
                arrays = [*batch.columns, *walker.step(batch), *tail]
                seen += n
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    by = [*[F.col(k) for k in walk.keys], *order]
    return stage(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema))


def _borders(walked: DataFrame, walk: Walk) -> DataFrame:
    """What each partition takes over from those before: one row per partition, so the driver can put it together."""
    totals = [*[f"_s_{c}" for c in walk.sums], *(["_groups"] if walk.opens else [])]
    ends = walked.groupBy("_part").agg(
        F.min_by(F.struct(*walk.seen()), "_pos").alias("first"),
        F.max_by(F.struct(*walk.seen(), "_head", "_n", *totals), "_pos").alias("last"),
    )
    flat = [F.col(f"first.{c}").alias(f"f_{c}") for c in walk.seen()] + [F.col(f"last.{c}").alias(f"l_{c}") for c in [*walk.seen(), "_head", "_n", *totals]]
    table = ends.orderBy("_part").select("_part", *flat).toArrow()
    n = table.num_rows
    column = lambda name: _array(table.column(name))
    shifted = lambda name: pa.concat_arrays([pa.nulls(min(n, 1), column(name).type), column(name).slice(0, max(n - 1, 0))])
    before, now = {c: shifted(f"l_{c}") for c in walk.seen()}, {c: column(f"f_{c}") for c in walk.seen()}
    same = _same(before, now, walk.keys, n) & (np.arange(n) > 0)
    opened = ~same | walk.opens(before, now) if walk.opens else ~same
    whole = column("l__head").to_numpy(zero_copy_only=False)  # one key from the first row to the last
    carried, reached = {}, {}
    for name in ["_n", *totals]:
        ends_at, carry, upto = column(f"l_{name}").to_pylist(), [], 0
        for p in range(n):
            flag = int(opened[p]) if name == "_groups" else 0
            carry.append((upto if same[p] else 0) + flag)
            upto = ends_at[p] + (carry[p] if whole[p] else 0)
        carried[name] = pa.array(carry, type=column(f"l_{name}").type)
        reached[name] = pa.array([upto] * n, type=carried[name].type)  # without keys: the total
    prior = {f"_b_{c}": pc.if_else(pa.array(same), before[c], pa.scalar(None, before[c].type)) for c in walk.previous}
    made = pa.table({"_part": column("_part"), "_opened": pa.array(opened.astype(np.int32)), **{f"_c{k}": v for k, v in carried.items()}, **prior, **({f"_t{k}": v for k, v in reached.items()} if walk.totals else {})})
    return walked.sparkSession.createDataFrame(made)


def ordered_pass(df: DataFrame, walk: Walk, order: list[Column]) -> DataFrame:
    """Adds ``row_number`` (from 1 within the keys), ``previous_<c>``, ``running_<c>``, ``total_<c>`` if asked and, with ``opens``, ``opened``
    (0/1; 1 on the first row of a key) and ``group_number`` (running count of ``opened`` within the key).

    ``keys`` and ``order`` together must be unique over rows. No keys: the whole table. An empty table stays empty.
    """
    walked = _walked(df, walk, order)
    head = F.col("_head")
    over = lambda name: F.when(head, F.col(f"_c{name}") + F.col(name)).otherwise(F.col(name))
    columns = [over("_n").alias("row_number")]
    columns += [F.when(F.col("_lone"), F.col(f"_b_{c}")).otherwise(F.col(f"_p_{c}")).alias(f"previous_{c}") for c in walk.previous]
    columns += [over(f"_s_{c}").alias(f"running_{c}") for c in walk.sums]
    if walk.totals:
        columns += [F.col(f"_t_s_{c}").alias(f"total_{c}") for c in walk.sums]
    if walk.opens:
        columns += [F.when(F.col("_lone"), F.col("_opened")).otherwise(F.col("_flag")).alias("opened"), over("_groups").alias("group_number")]
    return walked.join(F.broadcast(_borders(walked, walk)), "_part").select(*df.columns, *columns)
