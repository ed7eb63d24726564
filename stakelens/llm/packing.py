"""Bounded-space online packing of token ids into sequences of a fixed capacity.

Each partition keeps at most `open_windows` open windows. A document's ids (and the end id)
fill whole windows first; the rest goes to the open window that it fits most tightly, or to
a new one. If none fits and no more may be opened, the fullest is emitted: topped up with
the head of the rest if its gap is at least `min_cut` ids, else with that gap as padding.
What is left open at the ends of `merge` partitions is then merged in one task, at most
merge * open_windows windows, by filling windows end to end; one of them may stay short.

Defined results: a null or empty text has only the end id. Null ids are kept. Repeated rows
are packed once each. An empty table gives no pieces. A long text is cut into many pieces.
Columns other than id and text are not read. Pieces carry their ids.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakelens.llm import textops as T
from stakelens.llm.scratch import stored
from stakelens.llm.tokens import encoder

CAPACITY = 2048
OPEN_WINDOWS = 64
MIN_CUT = 32
MERGE = 32
END_ID = 1
FLUSH_BYTES = 4 << 20

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, part long, left_open boolean"
)
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.bool_()]


class _Pieces:
    """Rows on their way out, as Arrow batches of bounded size."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.bytes += len(row[3]) + 64

    def flush(self, at_least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.rows and self.bytes >= at_least:
            columns = zip(*self.rows, strict=True)
            arrays = [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]
            self.rows, self.bytes = [], 0
            yield pa.RecordBatch.from_arrays(arrays, names=_NAMES)


class _Windows:
    """The open windows of a partition: (free, number, pieces), tightest first."""

    def __init__(self, out: _Pieces, part: int, capacity: int, most: int, min_cut: int):
        self.out, self.part, self.capacity = out, part, capacity
        self.most, self.min_cut = most, min_cut
        self.number, self.open = 0, []

    def _emit(self, number: int, pieces: list[tuple], left_open: bool = False) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            length = len(ids) // 4
            name = (self.part << 32) + number
            self.out.add((doc_id, start, length, ids, total, name, at, self.part, left_open))
            at += length

    def _put(self, free: int, number: int, pieces: list[tuple]) -> None:
        if free:
            bisect.insort(self.open, (free, number, pieces))
        else:
            self._emit(number, pieces)

    def _next(self) -> int:
        self.number += 1
        return self.number - 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.capacity:
            piece = (doc_id, at, ids[4 * at : 4 * (at + self.capacity)], total)
            self._emit(self._next(), [piece])
            at += self.capacity
        while at < total:
            need = total - at
            k = bisect.bisect_left(self.open, (need, -1))
            if k < len(self.open):
                free, number, pieces = self.open.pop(k)
            elif len(self.open) < self.most:
                free, number, pieces = self.capacity, self._next(), []
            else:
                free, number, pieces = self.open.pop(0)
                if free < self.min_cut:
                    self._emit(number, pieces)
                    continue
            take = min(free, need)
            pieces.append((doc_id, at, ids[4 * at : 4 * (at + take)], total))
            self._put(free - take, number, pieces)
            at += take

    def close(self) -> None:
        for _, number, pieces in self.open:
            self._emit(number, pieces, left_open=True)
        self.open = []


def packed(
    df: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    open_windows: int = OPEN_WINDOWS,
    min_cut: int = MIN_CUT,
    merge: int = MERGE,
    end_id: int = END_ID,
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    tail = np.asarray([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = encoder(tokenizer).encode, _Pieces()
        windows = _Windows(out, TaskContext.get().partitionId(), capacity, open_windows, min_cut)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                windows.add(doc_id.as_py(), encode(text.as_py()) + tail)
                yield from out.flush(FLUSH_BYTES)
        windows.close()
        yield from out.flush()

    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stored(texts.mapInArrow(T.released(pack), SCHEMA), "pieces")
    left = pieces.filter("left_open").withColumn("bin", F.floor(F.col("part") / merge))
    columns = _NAMES[:7]
    merged = left.groupBy("bin").applyInArrow(_merger(capacity), SCHEMA)
    return pieces.filter("NOT left_open").select(columns).unionByName(merged.select(columns))


def _merger(capacity: int):
    def fill(key: tuple, table: pa.Table) -> pa.Table:
        """Pieces of windows that stayed open, cut and laid end to end."""
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        name = (1 << 62) + (key[0].as_py() << 32)
        rows, at = [], 0
        for piece in table.to_pylist():
            ids, done = piece["ids"], 0
            while done < len(ids) // 4:
                take = min(capacity - at, len(ids) // 4 - done)
                part = ids[4 * done : 4 * (done + take)]
                rows.append(
                    (
                        piece["doc_id"],
                        piece["start"] + done,
                        take,
                        part,
                        piece["doc_tokens"],
                        name,
                        at,
                        piece["part"],
                        False,
                    )
                )
                done, at = done + take, at + take
                if at == capacity:
                    name, at = name + 1, 0
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
        return pa.Table.from_arrays(arrays, names=_NAMES)

    return fill
