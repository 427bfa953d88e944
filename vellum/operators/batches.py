"""Arrow batches of whole images, for folds over an image's rows in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType


#: Bytes of source files behind one task's share of rows, at most, on average.
SHARE = 4 << 20
#: Shares up to which the session's own number of partitions holds, and Spark may join them to fewer.
FEW = 8


def shares(rows: DataFrame) -> int:
    """How many times SHARE the files behind rows hold."""
    leaves, size = rows._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for k in range(leaves.size()):
        n = int(str(leaves.apply(k).stats().sizeInBytes()))
        size += n if n < 1 << 60 else 0  # a source that doesn't know its size gives the largest number
    return -(-size // SHARE)


def tasks(rows: DataFrame) -> int:
    """Among how many tasks to deal rows: as many as the session says, or more if the files behind them are large, so that a
    task's share doesn't grow with the tables."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), shares(rows))


def by_image(rows: DataFrame) -> DataFrame:
    """Rows dealt by image, a share a task. The session's number of partitions would be no bound for it: Spark joins such
    partitions to about as many as there are cores. The number comes from the files alone, so a second deal of the same
    rows is no exchange."""
    n = shares(rows)
    return rows.repartition(n, "image_id") if n > FEW else rows.repartition("image_id")


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Rows in ``order`` from the first partition to the last, a share a task as by_image deals them. The ranges dealt
    are those that the sort asks for, so there is one exchange."""
    n = shares(rows)
    return (rows.repartitionByRange(n, *order) if n > FEW else rows).orderBy(*order)


def over_images(rows: DataFrame, order: list[str | Column], work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str | StructType) -> DataFrame:
    """``work`` over tables of whole images (column image_id), rows of each in ``order``; it gets the places where images begin,
    and the end. One exchange; a task holds the images of a batch and one more."""

    def starts(t: pa.Table) -> np.ndarray:
        v = pc.rank(t["image_id"], tiebreaker="dense").to_numpy()  # rows without an image are one image
        return np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1, [len(v)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            same = bool(held) and held[0]["image_id"][0].equals(b["image_id"][-1])  # rows are in order: one image still
            held.append(b)
            if same:
                continue
            t = pa.Table.from_batches(held)
            at = starts(t)
            if len(at) > 2:
                yield from work(t.slice(0, at[-2]).combine_chunks(), at[:-1]).to_batches()
                held = t.slice(at[-2]).to_batches()
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from work(t, starts(t)).to_batches()

    return by_image(rows).sortWithinPartitions("image_id", *order).mapInArrow(run, schema)
