"""Exact removal of repeated windows of words, found level by level with doubled lengths.

A window is `window` consecutive words of one text. Levels have lengths window/4, window/2
and window, rounded up, so that each is at most twice the one before. The first level counts
only the windows that are sampled: of the short windows inside each full window, the ones
with the least hash (equal full windows sample equal short ones). What occurs once is no
candidate any more; a full window lives on if its sampled short window occurs again, and
this short window is extended to twice its length inside it and counted again. The full
windows around survivors are counted at last, by 128-bit hashes. Words that a repeated full
window covers are removed; all windows are judged on the input.

From the second level on the work is done on the distinct texts that have candidates. A row
that only one window gives is named by the count itself, so what dies need not be joined
back. A text that several rows hold has only repeated windows.

Defined results: a null or empty text has no words, and the hash of an empty text. Texts
shorter than the window lose nothing. Null ids are kept. Repeated rows are copies of each
other and lose all their words if they are long enough. An empty table gives no rows. Extra
columns are not read. Counts are merged in each task before the shuffle, so that a frequent
window is no hot key. Memory is bounded by the longest text and by a batch of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakelens.llm import textops as T
from stakelens.llm.scratch import stored

WINDOW = 35


def levels(window: int) -> tuple[int, int, int]:
    """The three lengths; each is at most twice the one before."""
    half = -(-window // 2)
    return -(-half // 2), half, window


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each `width` neighbours, by doubling."""
    pick = np.minimum if least else np.maximum
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out


class _Run:
    """A run of texts: its words, its short windows, and which of them are sampled."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        self.window, (self.short, self.half, _) = window, levels(window)
        self.words = T.words(data, offsets)
        self.full = T.within(self.words.first, window)  # whether a window fits, by first word
        self.hash = T.windows(self.words.hash, self.short)
        self.inner = window - self.short + 1  # short windows in a full one
        if len(self.full):
            self.least = _sliding(self.hash, self.inner, True)
            held = np.where(self.full, self.least, T.U(0))
            pad = np.zeros(self.inner - 1, T.U)
            reach = _sliding(np.concatenate([pad, held, pad]), self.inner, False)
            self.sampled = np.flatnonzero(reach[: len(self.hash)] == self.hash)
            self.sampled = self.sampled[reach[self.sampled] > 0]
        else:
            self.sampled = np.zeros(0, np.int64)

    def alive(self, places: np.ndarray) -> np.ndarray:
        """First words of full windows whose sampled short window is at one of `places`."""
        if not len(self.full) or not len(places):
            return np.zeros(0, np.int64)
        marked = np.full(len(self.hash), np.iinfo(np.uint64).max, T.U)
        marked[places] = self.hash[places]
        return np.flatnonzero(self.full & (_sliding(marked, self.inner, True) == self.least))

    def extended(self, start: np.ndarray, places: np.ndarray) -> np.ndarray:
        """For alive windows, where their first sampled window begins at twice its length.

        It runs on from its place, moved back where it would leave the full window.
        """
        k = np.searchsorted(places, start)
        while len(wrong := np.flatnonzero(self.hash[places[k]] != self.least[start])):
            k[wrong] += 1
        return np.minimum(places[k], start + self.window - self.half)


def _numbers(lists: pa.Array, words: T.Words) -> np.ndarray:
    """Word numbers in a run, sorted, from a list of word numbers for each text."""
    lists = lists.fill_null([])
    values = np.asarray(lists.flatten(), np.int64)
    owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths(), np.int64))
    return np.sort((values + words.first[owner])[values < words.counts[owner]])


def _mapped(df: DataFrame, schema: str, of_run: Callable, window: int) -> DataFrame:
    """`of_run` over runs of the texts of `df` and the rows that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in T.runs(batch.column("text")):
                rows = batch.slice(row, len(offsets) - 1)
                yield of_run(_Run(data, offsets, window), rows)

    return df.mapInArrow(run, schema)


def _rows(run: _Run, names: pa.Array, name: str, at: np.ndarray, *keys: np.ndarray):
    """A row for each word number in `at`: its text's name, its place there, and keys."""
    owner = np.searchsorted(run.words.first, at, "right") - 1
    columns = {name: names.take(pa.array(owner))}
    columns["place"] = pa.array((at - run.words.first[owner]).astype(np.int32))
    for k, key in enumerate(keys):
        columns[f"key{k}"] = pa.array(key.view(np.int64))
    return pa.RecordBatch.from_pydict(columns)


def _short_windows(run: _Run, rows: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each distinct text of the run and each sampled hash in it."""
    coded = rows.column("digest").dictionary_encode()
    _, opens, copies = np.unique(np.asarray(coded.indices), return_index=True, return_counts=True)
    times = np.zeros(len(rows), np.int64)
    times[opens] = copies
    owner = T.owners(run.words.first)[run.sampled]
    at, owner = run.sampled[times[owner] > 0], owner[times[owner] > 0]
    order = np.lexsort((run.hash[at], owner))
    at, owner, key = at[order], owner[order], run.hash[at][order]
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    starts = np.flatnonzero(new)
    places = pa.array((at - run.words.first[owner]).astype(np.int32))
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)).astype(np.int32)), places)
    return pa.RecordBatch.from_pydict(
        {"digest": rows.column("digest").take(pa.array(owner[starts])), "places": lists,
         "times": pa.array(times[owner[starts]]), "key0": pa.array(key[starts].view(np.int64))}
    )


def _alive_halves(run: _Run, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    places = _numbers(rows.column("places"), run.words)
    start = run.alive(places)
    return start, run.extended(start, places)


def _half_windows(run: _Run, rows: pa.RecordBatch) -> pa.RecordBatch:
    at = np.unique(_alive_halves(run, rows)[1])
    key = T.windows(run.words.hash, run.half, 1)[at] if len(at) else np.zeros(0, T.U)
    return _rows(run, rows.column("id"), "id", at, key)


def _alive_windows(run: _Run, rows: pa.RecordBatch) -> np.ndarray:
    start, half = _alive_halves(run, rows)
    return start[~np.isin(half, _numbers(rows.column("dead_halves"), run.words))]


def _full_windows(run: _Run, rows: pa.RecordBatch) -> pa.RecordBatch:
    at = _alive_windows(run, rows)
    keys = [np.zeros(0, T.U)] * 2
    if len(at):
        keys = [T.windows(run.words.hash, run.window, which)[at] for which in (0, 1)]
    return _rows(run, rows.column("id"), "id", at, *keys)


def _cut(run: _Run, rows: pa.RecordBatch) -> pa.RecordBatch:
    """What stays of each text once the words of repeated windows are taken out."""
    words, at = run.words, _alive_windows(run, rows)
    at = at[~np.isin(at, _numbers(rows.column("dead"), words))]
    gone = T.covered(len(words.hash), at, at + run.window)
    gone |= (np.asarray(rows.column("copies")) > 1)[T.owners(words.first)] & np.repeat(
        words.counts >= run.window, words.counts
    )
    texts = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        kept = np.flatnonzero(~gone[a:b]) + a
        spans = zip(words.start[kept], words.end[kept], strict=True)
        texts.append(b" ".join([words.data[s:e].tobytes() for s, e in spans]).decode())
    n_removed = T.sums_by_text(gone, words.first)
    return pa.RecordBatch.from_pydict(
        {"digest": rows.column("digest"), "n_removed": pa.array(n_removed), "kept": texts}
    )


def _whole(run: _Run, rows: pa.RecordBatch) -> pa.RecordBatch:
    """Word count and hash of the words of each text, as if nothing were removed."""
    hashes = []
    for text in rows.column("text").to_pylist():
        hashes.append(sha256(b" ".join((text or "").encode().split())).hexdigest())
    return pa.RecordBatch.from_pydict(
        {"doc_id": rows.column("doc_id"), "digest": rows.column("digest"),
         "n_words": pa.array(run.words.counts), "whole_sha256": hashes}
    )


def _single(rows: DataFrame, keys: list[str]) -> DataFrame:
    """id and places of rows whose key no other row has."""
    counted = rows.groupBy(keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("place").alias("place")
    )
    return counted.filter("n = 1").groupBy("id").agg(F.collect_list("place").alias("places"))


def cut_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """digest, n_removed and kept (text) for each distinct text that has candidates."""
    texts = _texts(docs).select("digest", "text")
    schema = "digest binary, places array<int>, times long, key0 long"
    first = stored(_mapped(texts, schema, _short_windows, window), "level1")
    n = F.sum(F.col("times") * F.size("places"))
    again = first.groupBy("key0").agg(n.alias("n")).filter("n > 1").select("key0")
    lists = first.join(again, "key0").groupBy("digest").agg(F.collect_set("places").alias("lists"))
    found = lists.select("digest", F.array_distinct(F.flatten("lists")).alias("places"))
    distinct = texts.groupBy("digest").agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")
    )
    held = distinct.join(found, "digest").withColumn("id", F.monotonically_increasing_id())
    held = stored(held, "held")

    halves = _mapped(held, "id long, place int, key0 long", _half_windows, window)
    dead_halves = _single(halves, ["key0"]).withColumnRenamed("places", "dead_halves")
    held = stored(held.join(dead_halves, "id", "left"), "halves")

    full = _mapped(held, "id long, place int, key0 long, key1 long", _full_windows, window)
    dead = _single(full, ["key0", "key1"]).withColumnRenamed("places", "dead")
    held = held.join(dead, "id", "left")
    return stored(_mapped(held, "digest binary, n_removed long, kept string", _cut, window), "cut")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.md5(text.cast("binary")))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), text.alias("text")
    )


def summary(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for each row."""
    schema = "doc_id long, digest binary, n_words long, whole_sha256 string"
    rows = stored(_mapped(_texts(docs), schema, _whole, window), "rows")
    cut = cut_texts(docs, window).select(
        "digest", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("cut_sha256")
    )
    # A text with copies has candidates if it holds a window, so that it is in `cut` too.
    return rows.join(cut, "digest", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"),
    )
