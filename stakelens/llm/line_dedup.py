"""Line deduplication that can be taken back: exact reference counts behind cuckoo filters.

The state is three stored tables. `postings` has a row for each document and distinct line
key in it; `counts` has, for each key, in how many documents it stands, the smallest id
among them and the layer of the filter that holds it; `filters` has a cuckoo filter of each shard's keys. New documents ask the filter
of the shard first: keys that it has certainly not seen are appended without a lookup in
`counts`, the others are looked up. Deleting documents lowers the counts, takes keys
that no document holds any more out of their filter, and gives lines back.

A key is a line without white space at its ends, with A-Z lower-cased, of at least
`min_chars` code points; it is held as a 128-bit hash. A key that several documents hold
stays in the document with the smallest id only.

Defined results: a null or empty text is one empty line. A null id is larger than any other;
documents with null ids keep their lines if no other document holds them. Rows with equal
ids are one document. An empty table gives an empty state. Extra columns are not read.
Rows of a hot line are merged within each task before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakelens.llm.cuckoo import Filter
from stakelens.llm.scratch import stored

MIN_CHARS = 10
KEYS_PER_SHARD = 200_000
SPACES = " \t\n\v\f\r"


_COUNTS = "key binary, refs long, owner long, layer int"


class State(NamedTuple):
    """The stored tables; `shards` is fixed when the state is built."""

    postings: DataFrame  # doc_id, key
    counts: DataFrame  # key, refs, owner, layer
    filters: DataFrame  # shard, filter
    shards: int
    min_chars: int


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    line = line.strip(SPACES)
    if len(line) < min_chars:
        return None
    return blake2b(line.encode().lower(), digest_size=16).digest()


def postings_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, th (hash of the text) and key, for each row and distinct key in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, keys = [], [], []
            for doc_id, th, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = {line_key(x, min_chars) for x in text.split("\n")} - {None}
                ids += [doc_id] * len(found)
                hashes += [th] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()),
                 pa.array(keys, pa.binary())],
                names=["doc_id", "th", "key"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, th long, key binary")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")
    )


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("key").agg(
        F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("owner")
    )


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))


def empty(like: DataFrame, shards: int, min_chars: int = MIN_CHARS) -> State:
    spark = like.sparkSession
    return State(
        spark.createDataFrame([], "doc_id long, key binary"),
        spark.createDataFrame([], _COUNTS),
        spark.createDataFrame([], "shard int, filter binary"),
        shards,
        min_chars,
    )


def build(docs: DataFrame, min_chars: int = MIN_CHARS) -> State:
    """The state of these documents."""
    postings = stored(postings_of(docs, min_chars).select("doc_id", "key").distinct(), "postings")
    shards = max(8, -(-postings.count() // KEYS_PER_SHARD))
    return _added(empty(docs, shards, min_chars), postings)._replace(postings=postings)


def insert(state: State, docs: DataFrame) -> State:
    """The state with documents added; ids that it has already must not be given."""
    new = stored(postings_of(docs, state.min_chars).select("doc_id", "key").distinct(), "new")
    postings = stored(state.postings.unionByName(new), "postings")
    return _added(state, new)._replace(postings=postings)


def _added(state: State, new: DataFrame) -> State:
    asked = stored(_asked(_sharded(_counted(new), state.shards), state.filters), "asked")
    fresh = asked.filter("NOT maybe")
    maybe = asked.filter("maybe").select("key", F.struct("refs", "owner", "shard").alias("new"))
    met = maybe.join(state.counts, "key", "left")
    mistaken = met.filter("refs IS NULL").select("key", "new.*")
    first = fresh.select("key", "refs", "owner", "shard").unionByName(mistaken)
    again = met.filter("refs IS NOT NULL").select(
        "key",
        (F.col("refs") + F.col("new.refs")).alias("refs"),
        F.least("owner", "new.owner").alias("owner"),
        "layer",
    )
    untouched = state.counts.join(again.select("key"), "key", "left_anti")
    filled = stored(_inserted(state.filters, first), "filled")
    fresh = filled.filter("key IS NOT NULL").select("key", "refs", "owner", "layer")
    return state._replace(
        counts=stored(untouched.unionByName(again).unionByName(fresh), "counts"),
        filters=filled.filter("filter IS NOT NULL").select("shard", "filter"),
    )


def delete(state: State, doc_ids: DataFrame) -> State:
    """The state without the documents whose `doc_id` is given."""
    gone = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    left = stored(state.postings.join(gone, "doc_id", "left_anti"), "postings")
    lost = state.postings.join(gone, "doc_id", "left_semi").select("key").distinct()
    lost = stored(lost, "lost")
    recounted = _counted(left.join(lost, "key", "left_semi"))
    layers = state.counts.join(lost, "key", "left_semi").select("key", "layer")
    touched = stored(layers.join(recounted, "key", "left"), "touched")
    held = touched.filter("refs IS NOT NULL").select("key", "refs", "owner", "layer")
    counts = state.counts.join(lost, "key", "left_anti").unionByName(held)
    empty_keys = _sharded(touched.filter("refs IS NULL"), state.shards)
    return state._replace(
        postings=left,
        counts=stored(counts, "counts"),
        filters=stored(_deleted(state.filters, empty_keys), "filters"),
    )


def _hashes(keys: pa.ChunkedArray) -> np.ndarray:
    data = b"".join(keys.to_pylist())
    return np.frombuffer(data, "<u8")[::2].astype(np.uint64)


def _asked(keys: DataFrame, filters: DataFrame) -> DataFrame:
    """`keys` with `maybe`: whether the filter of their shard may have them."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        held = Filter.load(right["filter"][0].as_py() if len(right) else None)
        return left.append_column("maybe", pa.array(held.contains(_hashes(left["key"]))))

    schema = "key binary, refs long, owner long, shard int, maybe boolean"
    return (
        keys.select("key", "refs", "owner", "shard")
        .groupBy("shard")
        .cogroup(filters.groupBy("shard"))
        .applyInArrow(ask, schema)
    )


def _inserted(filters: DataFrame, keys: DataFrame) -> DataFrame:
    """A row with the filter of each shard, and one for each new key with its layer."""

    def insert(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        held = Filter.load(right["filter"][0].as_py() if len(right) else None)
        layers = held.insert(_hashes(left["key"]))
        n = len(left)
        return pa.table(
            {"shard": pa.array([key[0].as_py()] * (n + 1), pa.int32()),
             "filter": pa.array([held.dump()] + [None] * n, pa.binary()),
             "key": pa.chunked_array([pa.nulls(1, pa.binary()), *left["key"].chunks]),
             "refs": pa.chunked_array([pa.nulls(1, pa.int64()), *left["refs"].chunks]),
             "owner": pa.chunked_array([pa.nulls(1, pa.int64()), *left["owner"].chunks]),
             "layer": pa.array([None, *layers.tolist()], pa.int32())}
        )

    changed = keys.select("key", "refs", "owner", "shard").groupBy("shard")
    return changed.cogroup(filters.groupBy("shard")).applyInArrow(
        insert, f"shard int, filter binary, {_COUNTS}"
    )


def _deleted(filters: DataFrame, keys: DataFrame) -> DataFrame:
    """The filters without these keys."""

    def delete(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        held = Filter.load(right["filter"][0].as_py() if len(right) else None)
        held.delete(_hashes(left["key"]), left["layer"].to_numpy())
        return pa.table(
            {"shard": pa.array([key[0].as_py()], pa.int32()),
             "filter": pa.array([held.dump()], pa.binary())}
        )

    changed = keys.select("key", "layer", "shard").groupBy("shard")
    return changed.cogroup(filters.groupBy("shard")).applyInArrow(
        delete, "shard int, filter binary"
    )


def dropped(state: State, docs: DataFrame) -> DataFrame:
    """doc_id, th and keys: those that each row loses, for rows that lose any."""
    shared = state.counts.filter("refs >= 2 AND owner IS NOT NULL").select("key", "owner")
    found = postings_of(docs, state.min_chars).join(shared, "key")
    lost = found.filter(~F.col("doc_id").eqNullSafe(F.col("owner")))
    return lost.groupBy("doc_id", "th").agg(F.collect_set("key").alias("keys"))


def cleaned(state: State, docs: DataFrame) -> DataFrame:
    """doc_id, text (what stays), n_lines and n_dropped for each row."""
    rows, lost = _texts(docs), dropped(state, docs).withColumnsRenamed({"doc_id": "id", "th": "h"})
    same = rows["doc_id"].eqNullSafe(lost["id"]) & (rows["th"] == lost["h"])
    min_chars = state.min_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, keys in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                lines = text.split("\n")
                if keys:
                    keys = set(keys)
                    kept = [x for x in lines if line_key(x, min_chars) not in keys]
                    text = "\n".join(kept)
                else:
                    kept = lines
                texts.append(text)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()),
                 pa.array(n_dropped, pa.int64())],
                names=["doc_id", "text", "n_lines", "n_dropped"],
            )

    joined = rows.join(lost, same, "left").select("doc_id", "text", "keys")
    return joined.mapInArrow(run, "doc_id long, text string, n_lines long, n_dropped long")
