"""Quality rules: base counts, and repetition found by a suffix array over the words.

The suffix array of a run of documents is built by prefix doubling on word ranks that
hold the document, so that only suffixes of one document can compare equal. The ranks of
every doubling give the longest common prefix of neighbouring suffixes, and with it, for
every word, the longest repeated substring that starts there. Spans of at least
`min_repeat` words are united; a document is rejected if they cover more than
`max_covered_pct` percent of its words, or if one repeat is longer than `max_longest` words.

Defined results: a null or empty text has no words, and fails the base rule. Null ids are
kept. Each row is judged on its own, so repeated rows and ties do not matter. Columns other
than `doc_id` and `text` are not read. Memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakelens.llm import textops as T

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MIN_REPEAT = 20
MAX_COVERED_PCT = 30
MAX_LONGEST = 100

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, n_covered_words long, "
    "longest_repeat long"
)


def longest_repeats(words: T.Words) -> np.ndarray:
    """For each word, the length of the longest run from it that its text has elsewhere too."""
    n = len(words.hash)
    best = np.zeros(n, np.int64)
    if not n:
        return best
    owner = T.owners(words.first).astype(T.U)
    ends = np.repeat(words.first[1:], words.counts)
    levels, width = [], 1
    rank, active = _first_ranks(T.mix(words.hash + owner * T.U(0xD6E8FEB86659FD93)))
    levels.append(rank)
    while len(active):
        rank, active = _doubled(rank, active, width, ends)
        levels.append(rank)
        width *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    left, right = order[:-1], order[1:]
    near = levels[0][left] == levels[0][right]
    left, right = left[near], right[near]
    shared = np.zeros(len(left), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = left + shared, right + shared
        inside = (a < ends[left]) & (b < ends[right])
        same = np.zeros(len(a), bool)
        same[inside] = levels[level][a[inside]] == levels[level][b[inside]]
        shared[same] += 1 << level
    np.maximum.at(best, left, shared)
    np.maximum.at(best, right, shared)
    return best


def _first_ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return _ranked(order, keys[order], np.zeros(len(keys), np.int32), None)


def _ranked(order, keys, rank, base):
    """Ranks of sorted `keys`: the place of the first of each group, from `base` on."""
    opens = np.ones(len(keys), bool)
    opens[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(opens)
    group = np.cumsum(opens) - 1
    place = starts[group] if base is None else base + starts[group]
    rank[order] = place
    alone = np.diff(np.append(starts, len(keys))) == 1
    return rank, order[~alone[group]]


def _doubled(rank, active, width, ends):
    """Ranks by twice as many words, for suffixes whose first `width` words are shared."""
    after = active + width
    second = np.zeros(len(active), np.int64)
    inside = after < ends[active]
    second[inside] = rank[after[inside]].astype(np.int64) + 1
    keys = rank[active].astype(np.int64) * (len(rank) + 1) + second
    by = np.argsort(keys)
    order, keys = active[by], keys[by]
    old = rank[order]
    opens = np.ones(len(old), bool)
    opens[1:] = old[1:] != old[:-1]
    starts = np.flatnonzero(opens)
    base = old - starts[np.cumsum(opens) - 1]
    return _ranked(order, keys, rank.copy(), base)


class Rules(NamedTuple):
    """Limits of the base rule and of repetition."""

    min_words: int = MIN_WORDS
    max_repeat_pct: int = MAX_REPEAT_PCT
    min_repeat: int = MIN_REPEAT
    max_covered_pct: int = MAX_COVERED_PCT
    max_longest: int = MAX_LONGEST


def _verdicts(text: pa.Array, rules: Rules) -> Iterator[list]:
    """For runs of texts, the columns of `SCHEMA` after the id."""
    for row, data, offsets in T.runs(text, T.SMALL_RUN):
        words = T.words(data, offsets)
        best = longest_repeats(words)
        n, at = words.counts, np.arange(len(best))
        repeated = T.covered(len(best), at[best >= 3], (at + best)[best >= 3])
        long = best >= rules.min_repeat
        in_long = T.covered(len(best), at[long], (at + best)[long])
        n_repeat = T.sums_by_text(repeated, words.first)
        n_covered = T.sums_by_text(in_long, words.first)
        longest = np.zeros(len(n), np.int64)
        np.maximum.at(longest, T.owners(words.first), best)
        texts = [t or "" for t in text[row : row + len(n)].to_pylist()]
        failed = (n < rules.min_words) | (100 * n_repeat > rules.max_repeat_pct * n)
        rejected = (100 * n_covered > rules.max_covered_pct * n) | (longest > rules.max_longest)
        yield [
            n,
            [len(t) - sum(map(t.count, SPACES)) for t in texts],
            [sum(map(t.count, SYMBOLS)) for t in texts],
            [_repeated_lines(t) for t in texts],
            n_repeat,
            failed,
            ~failed & ~rejected,
            n_covered,
            longest,
        ]


def judged(df: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """One row of `SCHEMA` for each row of `df`."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for columns in _verdicts(batch.column("text"), rules):
                n = len(columns[0])
                arrays = [batch.column("doc_id")[at : at + n], *map(pa.array, columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                at += n

    ids = F.col("doc_id").cast("long").alias("doc_id")
    return df.select(ids, "text").mapInArrow(T.released(judge), SCHEMA)


def kept_rows(df: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """The rows of `df` that the rules keep, with all their columns."""
    kept_at = SCHEMA.split(", ").index("kept boolean") - 1

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [columns[kept_at] for columns in _verdicts(batch.column("text"), rules)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return df.mapInArrow(T.released(keep), df.schema)


def _repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))
