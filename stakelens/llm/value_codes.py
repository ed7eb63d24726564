"""Vector code compression: each vector becomes one small number for each of its parts.

Components become integers. A part's codebook starts as that part of the first vectors and
is improved by rounds of assignment (nearest entry) and replacement (mean of what was
assigned). Vectors lie in stored blocks, and a block keeps a dictionary of the distinct
integers of each dimension, with its components as codes into it. The squared differences of
a dictionary's integers to one coordinate of all entries are tabulated once for a block; the
distances of a part are then rows gathered from such tables by code, and added up. All sums
are of integers, so they do not depend on the order or the number of tasks.

A round sends a row for each part and entry from each task to a grouped sum; the driver gets
the codebooks only, whose size is that of `parts * entries` vector parts.

Defined results: rows whose vector is null, or holds a null or non-finite component, are
dropped; so are vectors that cannot be cut into equal parts or have not as many components
as the first kept one, as they lack some. Null ids come last, equal ids in the order of their
vectors; repeated rows count as often as they are there. With fewer vectors than entries a
codebook has one entry for each. Components beyond 2**14 either way are taken as 2**14.
Null labels are one group. An empty table has no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakelens.llm.scratch import stored

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LARGEST = 1 << 24  # of the integers, so that summed squares fit in 64 bits
BLOCK_VALUES = 1 << 18
_INT32 = 1 << 31


class Codebooks(NamedTuple):
    """The entries of each part, and a name for all of them."""

    entries: np.ndarray  # parts x entries x components, 64-bit integers

    @property
    def sha256(self) -> str:
        """Of the components as decimals, by part, entry and place, with commas between."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel())).encode()).hexdigest()


# -- vectors and their blocks ---------------------------------------------------------------


def usable(vector: Column, parts: int = PARTS) -> Column:
    """Whether a vector is there, has finite components only and can be cut evenly."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & (F.size(vector) > 0) & (F.size(vector) % parts == 0)


def _integers(values: np.ndarray) -> np.ndarray:
    scaled = np.floor(values.astype(np.float64) * SCALE)
    return np.clip(scaled, -LARGEST, LARGEST).astype(np.int64)


def blocks(rows: DataFrame, dims: int, label_type: str) -> DataFrame:
    """Rows (vec_id, label, vector) gathered into blocks with dictionaries of their values.

    A row has the ids and labels of its vectors; `values`, the distinct integers of each
    dimension end to end, with their numbers in `sizes`; `codes`, 16-bit, by dimension.
    """
    most = max(1, min(BLOCK_VALUES // dims, 1 << 16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                some = batch.slice(at, most)
                vectors = np.asarray(some.column("vector").flatten())
                grid = _integers(vectors).reshape(some.num_rows, dims)
                found = [np.unique(grid[:, d], return_inverse=True) for d in range(dims)]
                values = np.concatenate([v for v, _ in found]).astype("<i4")
                codes = np.concatenate([c.astype("<u2") for _, c in found])
                yield pa.RecordBatch.from_arrays(
                    [_as_list(some.column("vec_id")), _as_list(some.column("label")),
                     pa.array([values.tobytes()]), pa.array([[len(v) for v, _ in found]]),
                     pa.array([codes.tobytes()])],
                    names=["vec_id", "label", "values", "sizes", "codes"],
                )

    schema = (
        f"vec_id array<bigint>, label array<{label_type}>, "
        "values binary, sizes array<bigint>, codes binary"
    )
    return rows.mapInArrow(run, schema)


def _as_list(column: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


class Block:
    """One block as arrays: a dictionary and codes for each dimension."""

    def __init__(self, values: bytes, sizes: list[int], codes: bytes):
        flat = np.frombuffer(values, "<i4").astype(np.int64)
        self.dictionaries = np.split(flat, np.cumsum(sizes)[:-1])
        self.codes = np.frombuffer(codes, "<u2").reshape(len(sizes), -1)

    def assigned(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry, its squared distance) of each part of each vector, parts first."""
        parts, count, width = entries.shape
        reach = max(int(np.abs(d).max()) for d in self.dictionaries) + int(np.abs(entries).max())
        kind = np.int32 if width * reach * reach < _INT32 else np.int64
        n = self.codes.shape[1]
        nearest = np.empty((parts, n), np.int64)
        errors = np.empty((parts, n), np.int64)
        total, gathered = np.empty((n, count), kind), np.empty((n, count), kind)
        for p in range(parts):
            total[:] = 0
            for d in range(width):
                of = p * width + d
                table = (self.dictionaries[of][:, None] - entries[p, :, d]).astype(kind)
                table *= table
                np.take(table, self.codes[of], axis=0, out=gathered, mode="clip")
                np.add(total, gathered, out=total)
            nearest[p] = total.argmin(1)  # the first of equals
            errors[p] = total[np.arange(n), nearest[p]]
        return nearest, errors

    def sums(self, p: int, nearest: np.ndarray, count: int, width: int) -> np.ndarray:
        """How many vectors each entry of a part has, then their summed components."""
        out = np.empty((count, width + 1), np.int64)
        out[:, 0] = np.bincount(nearest, minlength=count)
        for d in range(width):
            of = p * width + d
            # Whole numbers below 2**40 in a block: exact as doubles.
            own = self.dictionaries[of][self.codes[of]]
            out[:, d + 1] = np.bincount(nearest, own, minlength=count).astype(np.int64)
        return out


def _each(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """The blocks of some batches, with more columns as they are."""
    for batch in batches:
        for k in range(batch.num_rows):
            values, sizes, codes = (batch.column(c)[k].as_py() for c in ("values", "sizes", "codes"))
            yield Block(values, sizes, codes), *[batch.column(c)[k].values for c in more]


# -- codebooks and codes --------------------------------------------------------------------


def _improved(stored_blocks: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The entries replaced by the floored means of the parts assigned to them."""
    parts, count, width = entries.shape
    names = ["part", "entry", "n", *[f"c{d}" for d in range(width)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, count, width + 1), np.int64)
        for (block,) in _each(batches):
            nearest, _ = block.assigned(entries)
            for p in range(parts):
                sums[p] += block.sums(p, nearest[p], count, width)
        part, entry = np.nonzero(sums[:, :, 0])
        used = sums[part, entry]
        columns = [part, entry, *used.T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

    found = stored_blocks.select("values", "sizes", "codes").mapInArrow(
        run, ", ".join(f"{name} bigint" for name in names)
    )
    added = found.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]])
    out = entries.copy()
    for row in added.collect():  # parts * entries rows at most
        out[row[0], row[1]] = np.array(row[3:], np.int64) // row[2]
    return out


def codebooks(
    stored_blocks: DataFrame, first: list[list[float]], parts: int = PARTS, rounds: int = ROUNDS
) -> Codebooks:
    """The codebooks that start as the parts of the vectors in `first`."""
    start = _integers(np.array(first, np.float64))
    entries = start.reshape(len(first), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        entries = _improved(stored_blocks, entries)
    return Codebooks(entries)


def _coded(stored_blocks: DataFrame, books: Codebooks, label_type: str) -> DataFrame:
    """vec_id, label, code and error of each vector."""
    entries = books.entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, labels in _each(batches, "vec_id", "label"):
            nearest, errors = block.assigned(entries)
            digits = nearest.T.astype(np.uint8).tobytes().hex()
            step = 2 * len(entries)
            codes = [digits[k : k + step] for k in range(0, len(digits), step)]
            yield pa.RecordBatch.from_arrays(
                [ids, labels, pa.array(codes), pa.array(errors.sum(0))],
                names=["vec_id", "label", "code", "error"],
            )

    return stored_blocks.mapInArrow(
        run, f"vec_id bigint, label {label_type}, code string, error bigint"
    )


def compressed(
    df: DataFrame,
    column: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of each kept vector.

    `entries` is at most 256, so that an index has two hexadecimal digits.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits for each part: 1 to 256 entries")
    kind = df.schema["label"].dataType.simpleString()
    vector = F.col(f"`{column}`")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "label", vector.alias("vector"))
    rows = rows.filter(usable(F.col("vector"), parts))
    order = [F.asc_nulls_last("vec_id"), F.asc("vector")]
    head = rows.orderBy(*order).first()
    if head is None:
        nothing = f"vec_id bigint, label {kind}, code string, error bigint, label_error bigint, "
        return df.sparkSession.createDataFrame([], nothing + "codebooks_sha256 string")
    dims = len(head["vector"])
    rows = rows.filter(F.size("vector") == dims)
    first = [r["vector"] for r in rows.orderBy(*order).limit(entries).select("vector").collect()]
    held = stored(blocks(rows, dims, kind), "blocks")
    books = codebooks(held, first, parts, rounds)
    coded = stored(_coded(held, books, kind), "coded")
    # A row for each label; Spark chooses the join by their number.
    of_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    of_label = of_label.withColumnRenamed("label", "of")
    return coded.join(of_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "label", "code", "error", "label_error",
        F.lit(books.sha256).alias("codebooks_sha256"),
    )
