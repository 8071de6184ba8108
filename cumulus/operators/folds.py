"""One-pass folds of a whole table into model-sized state, for the whole table or for every key.

Every iterative job here has the same shape: a block step on executors turns an Arrow batch into fixed-length vectors
of numbers, one for each key in the batch, and a task adds them up. A task hands on blocks of a vector, a row for each
key and block; these rows are dealt by key, block and a part of the tasks, so that the tasks' vectors meet in two
levels: inside each part first, then across the parts. Rows never leave the executors; only model-sized state reaches
the driver, and its size is checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulus.functions.vectors import matrix, packed_rows
from cumulus.session import MAX_STATE, check_state, materialise

_COMBINE = {"sum": (np.add, 0.0), "min": (np.minimum, np.inf), "max": (np.maximum, -np.inf)}
#: Numbers in a row of state; numbers that a task holds before it hands them on.
BLOCK, HELD = 4_096, 4_000_000
#: Rows that a step gets at once at most (more where its vector is long), so that its arrays stay small whatever the batch.
ROWS = 4_096
#: Vectors in a block of :func:`packed`.
PACK = 256
#: Parts into which the tasks' rows of one key and block are dealt before they meet.
PARTS = 64


def by_code(codes: np.ndarray, n: int) -> list[np.ndarray]:
    """The positions of each of ``n`` codes, from one sort."""
    order = np.argsort(codes, kind="stable")
    return np.split(order, np.searchsorted(codes[order], np.arange(1, n)))


def _slices(batches: Iterator[pa.RecordBatch], rows: Callable[[], int], pack: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows()`` vectors, none of them empty."""
    for batch in batches:
        at, own = 0, batch.schema.field("x").type if "x" in batch.schema.names else None
        while at < batch.num_rows:
            take = max(1, rows() // pack) if own and pa.types.is_binary(own) else rows()
            yield batch.slice(at, take)
            at += take


def packed(points: DataFrame) -> DataFrame:
    """(x): the vectors in blocks of bytes, written once, for folds that scan them many times: a block's numbers reach a
    step as they lie, while a vector of its own is built up number by number."""
    size = PACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([packed_rows(matrix(batch.column("x")), size)], names=["x"])

    return materialise(points.select("x").mapInArrow(run, "x binary"), "packed")


def fold_keys(df: DataFrame, key: str, step: Callable[[pa.RecordBatch, np.ndarray, int], np.ndarray], how: str = "sum") -> DataFrame:
    """(key, slot, value): per key and slot the sum, min or max over all batches of ``df``.

    ``step`` gets a batch without the key, the codes of its rows' keys and their number, and returns a row of numbers
    for each code. A NULL key is a key. Slots that no batch has changed are left out.
    """
    combine, neutral = _COMBINE[how]
    most, pack = ROWS, PACK
    kind = df.schema[key].dataType.simpleString()

    def rows(state: dict, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for k, vector in state.items():
            blocks = [(i, vector[at : at + BLOCK]) for i, at in enumerate(range(0, len(vector), BLOCK))]
            blocks = [(i, v) for i, v in blocks if (v != neutral).any()]
            if blocks:
                values = pa.array([v for _, v in blocks], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(blocks), kind), pa.array([i for i, _ in blocks], pa.int32()), values], names=[key, "_block", "_values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held, own, take = {}, 0, None, most
        for batch in _slices(batches, lambda: take, pack):
            own = batch.column(0).type
            coded = batch.column(0).dictionary_encode("encode")
            part = np.asarray(step(batch.select(batch.schema.names[1:]), coded.indices.to_numpy(), len(coded.dictionary)), np.float64)
            take = max(most, part.size // 16)
            for k, vector in zip(coded.dictionary.to_pylist(), part.reshape(len(coded.dictionary), -1)):
                if k in state:
                    combine(state[k], vector, out=state[k])
                else:
                    state[k] = vector.copy()
                    held += len(vector)
            if held > HELD:
                yield from rows(state, own)
                state, held = {}, 0
        yield from rows(state, own)

    others = [c for c in df.columns if c != key]
    partial = df.select(key, *others).mapInArrow(run, f"`{key}` {kind}, _block int, _values array<double>")
    dealt = partial.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(PARTS))).repartition(key, "_block", "_part")
    slots = dealt.select(key, "_block", F.posexplode("_values").alias("_at", "value")).filter(F.col("value") != F.lit(neutral))
    reduce = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    met = slots.groupBy(key, "_block", "_at").agg(reduce("value").alias("value"))
    return met.select(key, (F.col("_block").cast("long") * BLOCK + F.col("_at")).alias("slot"), "value")


def fold_slots(df: DataFrame, step: Callable[[pa.RecordBatch], np.ndarray], how: str = "sum") -> DataFrame:
    """``(slot, value)``: per-slot sum, min or max of ``step`` over all batches of ``df``."""
    whole = df.withColumn("_whole", F.lit(0))
    return fold_keys(whole, "_whole", lambda batch, codes, n: np.asarray(step(batch), np.float64).ravel()[None], how).drop("_whole")


def fold(df: DataFrame, step: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...], how: str = "sum") -> np.ndarray:
    """:func:`fold_slots` brought to the driver as an array of a checked shape."""
    size = int(np.prod(shape))
    check_state(size, "fold")
    out = np.full(size, _COMBINE[how][1])
    table = fold_slots(df, step, how).toArrow()
    out[table.column("slot").to_numpy()] = table.column("value").to_numpy()
    return out.reshape(shape)


def fold_groups(df: DataFrame, key: str, step: Callable[[pa.RecordBatch, np.ndarray, int], np.ndarray], width: int, how: str = "sum") -> tuple[np.ndarray, np.ndarray]:
    """:func:`fold_keys` brought to the driver: sorted keys and a row of ``width`` numbers for each; its size is checked."""
    table = fold_keys(df, key, step, how).limit(MAX_STATE + 1).toArrow()
    check_state(table.num_rows, f"state by {key}")
    keys, at = np.unique(table.column(0).to_numpy(), return_inverse=True)
    check_state(len(keys) * width, f"state by {key}")
    out = np.full((len(keys), width), _COMBINE[how][1])
    out[at, table.column("slot").to_numpy()] = table.column("value").to_numpy()
    return keys, out


def map_blocks(df: DataFrame, step: Callable[[pa.RecordBatch], dict[str, pa.Array]], added: str, keep: list[str], needs: tuple[str, ...] = ("x",)) -> DataFrame:
    """Narrow block step: the ``keep`` columns plus the ``added`` ones ("name type, ...").

    A Python step hides its inputs from the optimiser, so the columns it ``needs`` are named and everything
    else is pruned here; what is not kept does not travel back.
    """
    df = df.select(*[c for c in df.columns if c in keep or c in needs])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep] + ([added] if added else []))
    ordered = [f.name for f in df.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                new = step(batch)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ordered] + list(new.values()), names=ordered + list(new))

    return df.mapInArrow(run, schema)
