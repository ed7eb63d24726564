"""Best-fit packing with a linear grouping scheme: few sequences, few sizes to optimise over.

A document's ids (and the end id) are one piece; only longer ones are cut at the capacity.
Lengths are at most the capacity, so how many pieces have each length is a short table, and
the plan is made from that table alone:

- large lengths, longest first, are cut into groups of equal cardinality, and each is rounded
  up to the largest of its group: few sizes remain;
- configurations (how many of each size lie in one sequence) are optimised by column
  generation: a linear program over the configurations found so far, whose prices ask a
  knapsack for a better one until none is;
- configurations may leave some room for small lengths; the room that ends in the fewest
  sequences is taken;
- whole multiples of the configurations of several pieces take actual lengths, each slot the
  longest that it was rounded up for and the last one the longest that fits;
- what is left, and all small lengths, go best-fit into the gaps, longest first.

All steps handle lots, which are numbers of sequences with equal contents, so the work does
not depend on the number of documents: there are some `groups` configurations, a lot more for
each length where one runs out, and no more places in a lot than ids in a sequence. Then the
plan's places are dealt out: the n-th piece of a length takes the n-th place for it. Pieces
are counted in their tasks, and a running sum over tasks turns that into a number in the whole
table, so that no length, however frequent, meets in one task.

Defined results: a null or empty text has only the end id. Null ids are kept. Repeated rows
are packed once each. An empty table gives no pieces. Columns other than id and text are not
read. Ids stay in the stored pieces; `with_ids` attaches them.
"""

from __future__ import annotations

import bisect
import json
import os
import sys
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stakelens.llm.scratch import stored
from stakelens.llm.tokens import letters_to_bytes

CAPACITY = 4096
GROUPS = 48
SMALL = 8  # lengths up to an eighth of the capacity are small
ROOMS = (1 / 16, 0, 1 / 8, 1 / 32)  # the parts of a sequence that configurations may leave
END_ID = 1
FLUSH_BYTES = 4 << 20
CACHED_WORDS = 300_000
CACHED_LENGTH = 48
CLOSE = 4096  # no further plan is tried within such a part of the least possible number
GAIN = 1e-4  # a configuration must be worth so much more than a sequence


# -- token ids ------------------------------------------------------------------------------


class WordEncoder(dict):
    """Maps a word to the bytes of its 32-bit little-endian ids, under a tokenizer file.

    For tokenizers that drop white space: no token spans a space or an end of line, so texts
    are cut there, and the ids of short words are kept, up to `CACHED_WORDS` of them. Words of
    Latin letters, digits and signs are cut into pieces here and merged by a faster library
    with the same vocabulary; all others are left to the tokenizer itself.
    """

    def __init__(self, path: str):
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are laid out for little-endian machines")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine already
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [token["content"] for token in spec["added_tokens"]]
        self.merge = _merger(spec)

    def __missing__(self, word: str) -> bytes:
        found = array("I", self._ids(word)).tobytes()
        if len(word) <= CACHED_LENGTH and len(self) < CACHED_WORDS:
            self[word] = found
        return found

    def _ids(self, word: str) -> list[int]:
        if not self.merge or not (word.isascii() or _PLAIN.fullmatch(word)):
            return self.whole.encode(word, add_special_tokens=False).ids
        if word.isalpha():  # one piece
            return self.merge(word.lower().encode() + _WORD_END)
        if not word.isprintable() or any(s in word for s in self.special):
            return self.whole.encode(word, add_special_tokens=False).ids
        ids: list[int] = []
        for piece in _PIECE.findall(word.lower()):
            ids += self.merge(piece.encode() + _WORD_END)
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, four bytes each; none for null."""
        words = (text or "").replace("\n", " ").split(" ")
        return b"".join(map(self.__getitem__, words))


# Letters that composition leaves as they are and that have one lower-case letter each.
_PLAIN = regex.compile(r"[!-~À-ÖØ-öø-įĲ-ſƀ-ɏ]+")
# The pattern by which the tokenizer cuts words, and its mark of a word's end.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SUFFIX = "</w>"
_PIECE = regex.compile(_PATTERN)
_WORD_END = b"\xff"  # stands for the mark, as this byte is in no text


def _merger(spec: dict):
    """Ids of the bytes of a piece with `_WORD_END`; None if the file is of another kind."""
    import tiktoken

    model, cutter = spec["model"], spec["pre_tokenizer"] or {}
    cutters = cutter.get("pretokenizers", [])
    normalizers = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    if (
        model["type"] != "BPE"
        or model.get("end_of_word_suffix") != _SUFFIX
        or model.get("continuing_subword_prefix")
        or normalizers != ["NFC", "Replace", "Lowercase"]
        or [c["type"] for c in cutters] != ["Split", "ByteLevel"]
        or cutters[0]["pattern"].get("Regex") != _PATTERN
    ):
        return None
    special = {token["content"] for token in spec["added_tokens"]}
    byte_of = letters_to_bytes()
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    first = 2 * len(byte_of)  # every byte, and every byte at the end of a word
    if any(model["vocab"].get(token) != first + k for k, token in enumerate(merged)):
        return None
    ranks = {}
    for token, i in model["vocab"].items():
        if token not in special:
            ended = token.endswith(_SUFFIX) and token != _SUFFIX
            own = token[: -len(_SUFFIX)] if ended else token
            ranks[bytes(byte_of[c] for c in own) + (_WORD_END if ended else b"")] = i
    held = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    return held._encode_single_piece


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


PIECES = (
    "doc_id long, piece int, start long, length long, ids binary, doc_tokens long, "
    "part int, nth long"
)
_NAMES = [f.split()[0] for f in PIECES.split(", ")]
_TYPES = [pa.int64(), pa.int32(), *[pa.int64()] * 2, pa.binary(), pa.int64(), pa.int32(),
          pa.int64()]


def pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int = END_ID) -> DataFrame:
    """A row per piece with its ids; `nth` counts the pieces of a length within `part`, a task."""
    tail = np.asarray([end_id], "<u4").tobytes()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        arrays = [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = _encoder(tokenizer).encode, TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py()) + tail
                total = len(ids) // 4
                for k, start in enumerate(range(0, total, capacity)):
                    own = ids[4 * start : 4 * (start + capacity)]
                    length = len(own) // 4
                    name = doc_id.as_py()
                    rows.append((name, k, start, length, own, total, part, seen[length]))
                    seen[length] += 1
                    held += len(own) + 64
                if held >= FLUSH_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, PIECES)


# -- the plan -------------------------------------------------------------------------------


def grouped(counts: np.ndarray, large: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, how many) when groups of equal cardinality round up to their largest length.

    Groups that round to the same size are one. As few lengths as groups stay as they are.
    """
    falling = np.sort(large)[::-1]
    if len(falling) <= groups:
        return falling, counts[falling]
    upto = np.cumsum(counts[falling])
    total = int(upto[-1])
    starts = np.arange(0, total, -(-total // groups))
    sizes = falling[np.searchsorted(upto, starts, "right")]
    many = np.diff(np.append(starts, total))
    own, group = np.unique(-sizes, return_inverse=True)
    return -own, np.bincount(group, many).astype(np.int64)


def best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size a sequence holds for the highest summed price."""
    value = np.zeros(capacity + 1)
    layers = []
    order = np.argsort(sizes)
    for _ in range(capacity // int(sizes.min())):
        better, choice = value.copy(), np.full(capacity + 1, -1)
        for i in order:
            size = int(sizes[i])
            gain = value[: capacity + 1 - size] + prices[i]
            wins = gain > better[size:] + 1e-12
            better[size:][wins] = gain[wins]
            choice[size:][wins] = i
        if (choice < 0).all():
            break
        layers.append(choice)
        value = better
    counts, at = np.zeros(len(sizes), np.int64), capacity
    for choice in reversed(layers):
        if choice[at] >= 0:
            counts[choice[at]] += 1
            at -= int(sizes[choice[at]])
    return counts


def configurations(
    sizes: np.ndarray, wanted: np.ndarray, capacity: int
) -> list[tuple[list[int], float]]:
    """(sizes in a sequence, largest first; how often) to hold what is wanted in few sequences."""
    basis = np.diag(capacity // sizes).astype(float)
    used = np.linalg.solve(basis, wanted.astype(float))
    for _ in range(40 * len(sizes)):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        found = best_configuration(sizes, np.maximum(prices, 0), capacity)
        if found @ prices <= 1 + GAIN:
            break
        step = np.linalg.solve(basis, found.astype(float))
        ratios = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        leaves = int(ratios.argmin())
        basis[:, leaves] = found
        used = np.maximum(np.linalg.solve(basis, wanted.astype(float)), 0)
    slots = [np.repeat(sizes, basis[:, j].astype(np.int64)) for j in range(len(sizes))]
    return [(np.sort(s)[::-1].tolist(), n) for s, n in zip(slots, used.tolist(), strict=True)]


class Lots:
    """Numbers of sequences with equal contents, by the room that they have left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[tuple[int, tuple]]] = {}
        self.rooms: list[int] = []  # sorted

    def add(self, count: int, contents: tuple, room: int) -> None:
        """`contents` is a chain: (length, how many times, chain before)."""
        if count:
            if room not in self.by_room:
                bisect.insort(self.rooms, room)
                self.by_room[room] = []
            self.by_room[room].append((count, contents))

    def place(self, length: int, count: int) -> None:
        """Puts pieces of one length where least room stays, or into new sequences."""
        while count:
            k = bisect.bisect_left(self.rooms, length)
            if k == len(self.rooms):
                each = min(self.capacity // length, count)
                full = count // each
                self.add(full, (length, each, ()), self.capacity - each * length)
                count -= full * each
                continue
            room = self.rooms[k]
            # Within a lot the piece stays the tightest fit while it fits again and again.
            own, contents = self.by_room[room].pop()
            if not self.by_room[room]:
                del self.by_room[room]
                del self.rooms[k]
            each = min(room // length, count)
            used = min(own, count // each)
            self.add(own - used, contents, room)
            self.add(used, (length, each, contents), room - each * length)
            count -= used * each

    @property
    def sequences(self) -> int:
        return sum(count for held in self.by_room.values() for count, _ in held)

    def __iter__(self) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(how many sequences, [(length, times), ...]) for each lot."""
        for room in self.rooms:
            for count, chain in self.by_room[room]:
                inside = []
                while chain:
                    length, times, chain = chain
                    inside.append((length, times))
                yield count, inside


class Plan(NamedTuple):
    """Places by length and number: those from `first` on lie in sequences from `sequence` on.

    `key` is length << 44 | first, sorted; each place of a lot has a row.
    """

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and number within the length."""
        own = (length << 44) | number
        row = np.searchsorted(self.key, own, "right") - 1
        return self.sequence[row] + own - self.key[row], self.offset[row]


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """Where the pieces go, from how many there are of each length (0 to the capacity).

    Configurations may fill a sequence to the brim or leave room for small pieces; which of
    these gives the fewest sequences depends on the small ones, so each is tried until one is
    close to the fewest that the ids could fill.
    """
    counts = counts.astype(np.int64)
    least = -(-int(counts @ np.arange(capacity + 1)) // capacity)
    lots = None
    for part in ROOMS:
        tried = _lots(counts, capacity, groups, int(capacity * part))
        if lots is None or tried.sequences < lots.sequences:
            lots = tried
        if lots.sequences <= least + least // CLOSE:
            break
    rows, sequence = [], 0
    taken = [0] * (capacity + 1)
    for count, inside in lots:
        offset = 0
        for length, times in inside:
            for _ in range(times):
                rows.append(((length << 44) | taken[length], sequence, offset))
                taken[length] += count
                offset += length
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    key, first, offset = np.ascontiguousarray(table.T)
    return Plan(key, first, offset, sequence)


def _lots(counts: np.ndarray, capacity: int, groups: int, room: int) -> Lots:
    """All pieces in lots, with configurations that leave so much room."""
    lots = Lots(capacity)
    there = np.flatnonzero(counts)
    # Pieces that leave less room themselves have a sequence each.
    for length in there[there > capacity - room]:
        lots.add(int(counts[length]), (int(length), 1, ()), capacity - int(length))
    there = there[there <= capacity - room]
    if not room and len(there) and there[-1] == capacity:
        lots.add(int(counts[capacity]), (capacity, 1, ()), 0)
        there = there[:-1]
    large, small = there[there > capacity // SMALL], there[there <= capacity // SMALL]
    rest = [(int(x), int(counts[x])) for x in small]
    if len(large):
        rest += _configured(lots, counts, large, groups, room)
    for length, count in sorted(rest, reverse=True):
        lots.place(length, count)
    return lots


def _configured(
    lots: Lots, counts: np.ndarray, large: np.ndarray, groups: int, room: int
) -> list[tuple[int, int]]:
    """Fills whole multiples of configurations with actual lengths; returns what is left.

    A slot takes the longest piece that it was rounded up for; the last slot of a sequence
    the longest that fits what the others really left.
    """
    most = lots.capacity - room
    found = configurations(*grouped(counts, large, groups), most)
    left = {int(x): int(counts[x]) for x in large}
    lengths = sorted(left)
    for slots, times in sorted(found, key=lambda f: f[0], reverse=True):
        # A piece with a sequence of its own is placed by best fit, where it may find company.
        again = int(times + 1e-6) if len(slots) > 1 else 0
        while again:
            inside: Counter[int] = Counter()
            for k, size in enumerate(slots):
                held = sum(n * of for of, n in inside.items())
                fits = size if k + 1 < len(slots) else most - held
                at = bisect.bisect_right(lengths, fits) - 1
                while at >= 0 and inside[lengths[at]] == left[lengths[at]]:
                    at -= 1
                if at >= 0:
                    inside[lengths[at]] += 1
            if not inside:
                break
            # As many equal sequences as the pieces of these lengths last.
            alike = min(again, *[left[length] // n for length, n in inside.items()])
            chain: tuple = ()
            for length, n in inside.items():
                chain = (length, n, chain)
                left[length] -= n * alike
                if not left[length]:
                    del left[length]
                    lengths.remove(length)
            lots.add(alike, chain, lots.capacity - sum(n * of for of, n in inside.items()))
            again -= alike
    return list(left.items())


# -- the operator ---------------------------------------------------------------------------


def packed(
    df: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    groups: int = GROUPS,
    end_id: int = END_ID,
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, part, nth."""
    return placed(stored(pieces(df, tokenizer, capacity, end_id), "pieces"), capacity, groups)


def placed(held: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """The places of stored pieces."""
    spark = held.sparkSession
    by_part = held.groupBy("part", "length").agg(F.count(F.lit(1)).alias("rows"))
    by_part = stored(by_part, "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("rows").alias("rows")).collect():
        counts[row["length"]] = row["rows"]  # a row for each length, up to the capacity
    places = spark.sparkContext.broadcast(plan(counts, capacity, groups))
    earlier = F.sum("rows").over(W.partitionBy("length").orderBy("part")) - F.col("rows")
    # Rows for each task and length: not broadcast, though their files are small.
    starts = by_part.select("part", "length", earlier.alias("before")).hint("merge")
    narrow = held.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "nth"
    )
    numbered = narrow.join(starts, ["part", "length"]).select(
        *narrow.columns, (F.col("before") + F.col("nth")).alias("number")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = places.value.of(length, number)
            kept = [batch.column(c) for c in narrow_names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=[*narrow_names, "sequence_id", "offset"],
            )

    narrow_names = narrow.columns
    schema = (
        "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long, "
        "sequence_id long, offset long"
    )
    own = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return numbered.mapInArrow(run, schema).select(*own, "part", "nth")


def with_ids(places: DataFrame, held: DataFrame) -> DataFrame:
    """The places of `placed` with the ids of the stored pieces."""
    return places.join(held.select("part", "length", "nth", "ids"), ["part", "length", "nth"])
