"""Sorted scans that split hot keys.

A key may hold a third of all rows. Rows are range-partitioned by (key, order), so a
hot key spans several tasks; a task streams over its sorted Arrow batches and keeps no
more than a batch and a few numbers. What it must know of earlier tasks comes from
summaries of the first and the last key of a partition, a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import cut_lineage


def runs(key: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Run number of each row of a sorted column without nulls, and first row of each run."""
    if len(key) < 2:
        return np.zeros(len(key), np.int64), np.arange(len(key))
    new = np.r_[True, pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def sorted_batches(it: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, bool]]:
    """(batch, run of each row, first row of each run, whether the first run goes on from the batch before)."""
    last = None
    for b in it:
        if b.num_rows:
            run, first = runs(b.column(key))
            yield b, run, first, last is not None and b.column(key)[0].as_py() == last
            last = b.column(key)[b.num_rows - 1].as_py()


_SCANNED = ["k", "o", "t", "s", "e"]


def running_total(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """(key, order, out): the sum of the integer column `value` over the earlier rows of the same key.

    Only these three columns move; join the rest back by (key, order). Keys are strings
    without nulls, (key, order) is unique and `order` an integer. An empty table stays empty.
    """
    src = df.select(F.col(key).alias("k"), F.col(order).cast("long").alias("o"), F.col(value).cast("long").alias("v"))

    def scan(it):
        carry = head = 0  # total and first order value of the last key so far
        last = lead = None  # lead: the first key, which may go on from earlier partitions, while no other has come
        edge = lambda k, t, s: pa.RecordBatch.from_arrays([pa.array([k]), pa.array([0], pa.int64()), pa.array([t], pa.int64()), pa.array([s], pa.int64()), pa.array([True])], names=_SCANNED)
        for b, run, first, goes_on in sorted_batches(it, 0):
            o, v = b.column(1).to_numpy(), b.column(2).to_numpy()
            total = np.cumsum(v)
            before = total - v
            local, start = before - before[first][run], o[first]
            if goes_on:
                local[run == 0] += carry
                start[0] = head
            if last is None:
                lead = b.column(0)[0].as_py(), int(start[0])
            if lead and (run[-1] or last is not None and not goes_on):  # it ends here: its rows still ask for what came before
                yield edge(lead[0], 0, lead[1])
                lead = None
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(local), pa.array(start[run]), pa.array(np.zeros(len(v), bool))], names=_SCANNED)
            carry, head, last = int(local[-1] + v[-1]), int(start[-1]), b.column(0)[len(v) - 1].as_py()
        if last is not None:  # only the last key can go on in later partitions
            yield edge(last, carry, head)

    done = cut_lineage(src.repartitionByRange("k", "o").sortWithinPartitions("k", "o").mapInArrow(scan, "k string, o long, t long, s long, e boolean"))
    earlier = Window.partitionBy("k").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    carry = done.where("e").select("k", "s", F.sum("t").over(earlier).alias("c")).where("c IS NOT NULL")
    rows = done.where("NOT e").join(F.broadcast(carry), ["k", "s"], "left")
    return rows.select(F.col("k").alias(key), F.col("o").alias(order), (F.col("t") + F.coalesce("c", F.lit(0))).alias(out))
