"""Feature matrices as packed blocks of rows, and sums of arrays over them.

A fit that goes over its rows again and again first packs them: a row of the packed table is a
block of rows, as two matrices. Each round every task sends one set of arrays of the model's
size, and these are added in a tree, so the driver gets a few of them however many tasks there are.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.functions.lineage import landed

#: Numbers of a block, sets of arrays that are added in one place, bytes of blocks read at once.
CELLS, FAN, GROUP = 1 << 17, 32, 16 << 20


def matrix(column):
    """An Arrow column of lists, all of one length and none null, as a numpy matrix."""
    import numpy as np

    values = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    if column.null_count or len(column) and len(values) % len(column) or np.isnan(values).any():
        raise ValueError("vectors must have one length and no nulls or NaN in them")
    return values.reshape(len(column), -1)


@dataclass
class Packed:
    """The packed table (n, x, y), its number of tasks, its rows and the widths of x and y."""

    table: DataFrame
    tasks: int
    rows: int
    p: int
    q: int


def pack(batches: Iterator) -> Iterator:
    """Rows (n, x, y, p, q) of Arrow batches of two columns of vectors."""
    import numpy as np
    import pyarrow as pa

    kinds = pa.schema([("n", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("p", pa.int32()), ("q", pa.int32())])
    for batch in batches:
        if not len(batch):
            continue
        a, b = matrix(batch.column(0)), matrix(batch.column(1))
        step = max(1, CELLS // max(1, a.shape[1] + b.shape[1]))
        raw = lambda m: np.ascontiguousarray(m).tobytes()
        parts = [(len(a[k : k + step]), raw(a[k : k + step]), raw(b[k : k + step]), a.shape[1], b.shape[1]) for k in range(0, len(a), step)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), kinds.types, strict=True)], schema=kinds)


PACKED = "n int, x binary, y binary, p int, q int"


def vectors(rows: DataFrame, x: str | Column, y: str | Column) -> DataFrame:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return rows.select(x.cast("array<double>").alias("x"), y.cast("array<double>").alias("y")).where("x is not null and y is not null")


def measured(table: DataFrame) -> Packed:
    """What ``table``, of packed rows, holds."""
    said = table.withColumn("_t", F.spark_partition_id()).agg(F.sum("n"), F.min("p"), F.max("p"), F.min("q"), F.max("q"), F.max("_t")).first()
    if said[1] != said[2] or said[3] != said[4]:
        raise ValueError("vectors must have one length")
    return Packed(table.select("n", "x", "y"), (said[5] or 0) + 1, said[0] or 0, said[1] or 0, said[3] or 0)


def packed(rows: DataFrame, x: str | Column, y: str | Column) -> Packed:
    """Blocks of ``rows`` with the vectors ``x`` and ``y`` (arrays of numbers), landed. Rows without
    either are left out. Widths must be the same in all rows."""
    return measured(landed(vectors(rows, x, y).mapInArrow(pack, PACKED), GROUP))


def unpacked(held: Packed, batches: Iterator) -> Iterator:
    """(x, y) matrices of the packed rows a task reads."""
    import numpy as np

    for batch in batches:
        for n, a, b in zip(*(batch.column(k) for k in range(3)), strict=True):
            n = n.as_py()
            yield np.frombuffer(a.as_buffer(), float).reshape(n, held.p), np.frombuffer(b.as_buffer(), float).reshape(n, held.q)


def _sum(totals: Iterator) -> list | None:
    total = None
    for made in totals:
        total = made if total is None else [a + b for a, b in zip(total, made, strict=True)]
    return total


def gathered(held: Packed, work: Callable) -> list | None:
    """The sums of the arrays that ``work(task, blocks)`` gives for the blocks (x, y) of a task."""
    shape = Packed(None, held.tasks, held.rows, held.p, held.q)

    def part(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        total = work(task, unpacked(shape, batches))
        if total is not None:
            yield pa.RecordBatch.from_pydict({"slot": pa.array([task], pa.int32()), "part": pa.array([pickle.dumps(total, 5)], pa.binary())})

    def add(table):
        import pyarrow as pa

        total = _sum(pickle.loads(x.as_buffer()) for x in table["part"])
        return pa.table({"slot": table["slot"][:1], "part": pa.array([pickle.dumps(total, 5)], pa.binary())})

    parts, tasks = held.table.mapInArrow(part, "slot int, part binary"), held.tasks
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        parts = parts.withColumn("slot", F.pmod("slot", F.lit(tasks))).groupBy("slot").applyInArrow(add, "slot int, part binary")
    return _sum(pickle.loads(row["part"]) for row in parts.select("part").collect())


def summed(held: Packed, step: Callable) -> list | None:
    """The sums of the arrays that ``step(x, y)`` gives for each block; None without rows."""
    return gathered(held, lambda _, found: _sum(step(x, y) for x, y in found))


def scaler(held: Packed):
    """(mean, deviation) of the columns of x and of y, of the population, taken as 1 under 1e-6. The
    deviations are summed about the means, in a second pass."""
    import numpy as np

    totals = summed(held, lambda x, y: [x.sum(axis=0), y.sum(axis=0)])
    means = [t / held.rows for t in totals]
    squares = summed(held, lambda x, y: [((x - means[0]) ** 2).sum(axis=0), ((y - means[1]) ** 2).sum(axis=0)])
    deviations = [np.sqrt(s / held.rows) for s in squares]
    return [(m, np.where(d < 1e-6, 1.0, d)) for m, d in zip(means, deviations, strict=True)]


def mapped(rows: DataFrame, x: str, predict: Callable, columns: str) -> DataFrame:
    """``rows`` with ``columns`` (DDL) made by ``predict(matrix of x)``, a list of Arrow-ready
    sequences; null where a row has no ``x``."""
    names = [c.strip().split(" ")[0] for c in columns.split(", ")]
    kept = [c for c in rows.columns if c not in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept), columns])
    read = rows.select(*[f"`{c}`" for c in kept], F.col(f"`{x}`").cast("array<double>").alias("_x"))

    def body(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in made.fields]
        for batch in batches:
            vectors = batch.column(len(kept))
            full = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
            out = predict(matrix(vectors.take(pa.array(full)))) if len(full) else [[] for _ in names]
            place = np.full(len(batch), -1)
            place[full] = np.arange(len(full))
            index = pa.array(place, mask=place < 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(list(o), k).take(index) for o, k in zip(out, kinds, strict=True))], names=[*kept, *names])

    from pyspark.sql.types import StructType

    made = StructType.fromDDL(columns)
    return read.mapInArrow(body, schema)
