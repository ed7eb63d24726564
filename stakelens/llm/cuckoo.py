"""A cuckoo filter of 64-bit hashes as numpy arrays: bulk insertion, lookup and deletion.

Buckets hold four 16-bit fingerprints; a fingerprint may lie in two buckets. A layer that is
nine tenths full is followed by a larger one, so no insertion fails or searches long. Hashes
are told which layer took them, and are deleted from that layer: another's equal fingerprint
in a layer of another size stays. Equal hashes may be inserted again and are then held as
often; a deletion removes one of them.
"""

from __future__ import annotations

import numpy as np

from stakelens.llm.textops import U, mix

SLOTS = 4
ROUNDS = 200
LOAD = 0.9
LEAST_BUCKETS = 16


class Filter:
    def __init__(self, layers: list[np.ndarray] | None = None):
        self.layers = layers or []

    @classmethod
    def load(cls, data: bytes | None) -> Filter:
        layers, at = [], 0
        while data and at < len(data):
            n = int.from_bytes(data[at : at + 8], "little")
            table = np.frombuffer(data, np.uint16, n * SLOTS, at + 8)
            layers.append(table.reshape(n, SLOTS).copy())
            at += 8 + table.nbytes
        return cls(layers)

    def dump(self) -> bytes:
        return b"".join(len(t).to_bytes(8, "little") + t.tobytes() for t in self.layers)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """False: certainly absent. True: present, or a false positive (about 1 in 8,000 a layer)."""
        found = np.zeros(len(hashes), bool)
        for table in self.layers:
            print_, first, second = _places(hashes, len(table))
            found |= (table[first] == print_[:, None]).any(1)
            found |= (table[second] == print_[:, None]).any(1)
        return found

    def insert(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the layer that took each hash."""
        layer = np.zeros(len(hashes), np.int32)
        rest = np.arange(len(hashes))
        if self.layers:
            rest = self._into_last(hashes, layer, rest)
        while len(rest):
            wanted = max(len(rest), 2 * len(self.layers[-1]) if self.layers else LEAST_BUCKETS)
            buckets = 1 << (max(LEAST_BUCKETS, wanted // 3) - 1).bit_length()
            self.layers.append(np.zeros((buckets, SLOTS), np.uint16))
            rest = self._into_last(hashes, layer, rest)
        return layer

    def _into_last(self, hashes: np.ndarray, layer: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Fills the last layer with some of the hashes; which of `rest` it did not take."""
        table = self.layers[-1]
        room = max(0, int(LOAD * table.size) - np.count_nonzero(table))
        placed = _fill(table, hashes[rest[:room]])
        layer[rest[:room][placed]] = len(self.layers) - 1
        return np.append(rest[:room][~placed], rest[room:])

    def delete(self, hashes: np.ndarray, layers: np.ndarray) -> None:
        """Removes one fingerprint for each hash from the layer that took it."""
        for h, layer in zip(hashes, layers, strict=True):
            # One by one: equal fingerprints in one call must not remove the same slot twice.
            table = self.layers[layer]
            print_, first, second = _places(np.array([h], U), len(table))
            for bucket in (first[0], second[0]):
                slots = np.flatnonzero(table[bucket] == print_[0])
                if len(slots):
                    table[bucket, slots[0]] = 0
                    break
            else:
                raise ValueError("only hashes that were inserted may be deleted")


def _places(hashes: np.ndarray, buckets: int):
    """Fingerprint, and the two buckets that it may lie in."""
    prints = (hashes >> U(48)).astype(np.uint16)
    prints[prints == 0] = 1
    mask = U(buckets - 1)
    first = hashes & mask
    return prints, first.astype(np.int64), (first ^ (mix(prints) & mask)).astype(np.int64)


def _fill(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Inserts what finds a place; whether each hash did.

    Nothing is moved until a place is free along a whole path: a fingerprint that is pushed
    out goes to its other bucket, one bucket a round, and paths that do not end are undone.
    """
    prints, first, second = _places(hashes, len(table))
    left = np.arange(len(hashes))
    for bucket_of in (first, second, first, second):
        if not len(left):
            break
        left = left[~_place(table, bucket_of[left], prints[left])]
    placed = np.ones(len(hashes), bool)
    placed[[k for k in left if not _push(table, int(first[k]), int(prints[k]))]] = False
    return placed


def _place(table: np.ndarray, buckets: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Puts fingerprints into free slots of their bucket; whether each found one."""
    order = np.argsort(buckets, kind="stable")
    ordered = buckets[order]
    opens = np.ones(len(ordered), bool)
    opens[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(opens)
    nth = np.arange(len(ordered)) - starts[np.cumsum(opens) - 1]
    free = table[ordered] == 0
    rank = np.cumsum(free, 1)
    fits = nth < rank[:, -1]
    slot = np.argmax((rank == (nth + 1)[:, None]) & free, 1)
    table[ordered[fits], slot[fits]] = prints[order][fits]
    done = np.zeros(len(buckets), bool)
    done[order] = fits
    return done


def _push(table: np.ndarray, bucket: int, held: int) -> bool:
    """Inserts one fingerprint by moving others; undone if no free slot is met."""
    mask, path = len(table) - 1, []
    for turn in range(ROUNDS):
        row = table[bucket]
        free = np.flatnonzero(row == 0)
        if len(free):
            row[free[0]] = held
            return True
        slot = (turn * 7 + bucket) % SLOTS
        path.append((bucket, slot))
        held, row[slot] = int(row[slot]), held
        other = int(mix(np.array([held], U))[0]) & mask
        bucket ^= other
    for bucket, slot in reversed(path):
        held, table[bucket, slot] = int(table[bucket, slot]), held
    return False
