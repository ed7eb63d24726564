"""Grouped packing, Merkle manifests and vector codes against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from stakelens.llm import group_packing, merkle_pivot, scratch, value_codes
from stakelens.llm.queries import WORD_TOKENIZER


def many(spark, rows, schema, parts=5):
    scratch.ship(spark)
    return spark.createDataFrame(rows, schema).repartition(parts)


# -- packing --------------------------------------------------------------------------------

DOC = "doc_id long, text string, length string, part string, piece string"
ODD_TEXTS = [
    None, "", " ", "\n\n", "A  b\tc\x0bd", "it's 12 x y", "<|endoftext|>a <|startoftext|>",
    "é ́ x\x1cy", "ΣΣ ΟΔΟΣ", "ab\ncd", "don't we'll 'S", "\U0001f600 中文",
]


def test_words_have_the_ids_of_whole_texts():
    whole, cut = Tokenizer.from_file(WORD_TOKENIZER), group_packing.WordEncoder(WORD_TOKENIZER)
    pick = random.Random(5)
    texts = [t for t in ODD_TEXTS if t]
    alphabet = "aB1'<|> \n\t́éΣ. \x85\x1f"
    texts += ["".join(pick.choice(alphabet) for _ in range(pick.randrange(30))) for _ in range(800)]
    for text in texts:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(cut.encode(text), "<u4").tolist() == ids, text
    assert cut.encode(None) == b""


def _check_packing(rows, docs, capacity):
    """Every id in one piece, sequences gapless and no longer than the capacity."""
    whole = Tokenizer.from_file(WORD_TOKENIZER)
    want = []
    for doc_id, text in docs:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[start : start + capacity], "<u4").tobytes()
            want.append((doc_id, piece, start, len(own) // 4, zlib.crc32(own)))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for inside in sequences.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    best = group_packing.Lots(capacity)  # best fit of all lengths, longest first
    for length in sorted((x[3] for x in want), reverse=True):
        best.place(length, 1)
    return len(sequences), best.sequences


def test_grouped_packing_of_odd_texts(spark):
    pick = random.Random(7)
    docs = list(enumerate(ODD_TEXTS)) + [(None, None), (None, "a b"), (3, "\n\n"), (3, "\n\n")]
    docs += [(100 + i, " ".join("ab"[: pick.randint(1, 2)] * pick.choice([1, 9, 40])
                                 for _ in range(pick.choice([1, 5, 30])))) for i in range(150)]
    docs += [(900, "word " * 5000), (901, "x " * 63), (902, "x " * 64)]
    df = many(spark, [(*d, "l", "p", "q") for d in docs], DOC)
    used, best = _check_packing(group_packing.packed(df, WORD_TOKENIZER, 64, 8).collect(), docs, 64)
    assert used <= best


def test_grouped_packing_of_nothing(spark):
    df = many(spark, [], DOC)
    out = group_packing.packed(df, WORD_TOKENIZER)
    assert out.collect() == []
    assert out.columns[:7] == [
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    ]


def test_ids_are_attached_to_places(spark):
    docs = [(i, "w " * (i % 70)) for i in range(60)]
    df = many(spark, [(*d, "l", "p", "q") for d in docs], DOC)
    held = scratch.stored(group_packing.pieces(df, WORD_TOKENIZER, 64), "pieces")
    rows = group_packing.with_ids(group_packing.placed(held, 64), held).collect()
    assert len(rows) == held.count()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    pick = np.random.default_rng(seed)
    capacity = int(pick.choice([64, 100, 257]))
    counts = pick.integers(0, 400, capacity + 1) * (pick.random(capacity + 1) < 0.3)
    counts[0] = 0
    if seed == 1:
        counts[: capacity // 8 + 1] = 0  # no small ones
    if seed == 2:
        counts[capacity // 2] = 100_000  # a third of all and more
    plan = group_packing.plan(counts, capacity)
    length = np.repeat(np.arange(capacity + 1), counts)
    number = np.concatenate([np.arange(c) for c in counts])
    sequence, offset = plan.of(length, number)
    order = np.lexsort((offset, sequence))
    sequence, offset, length = sequence[order], offset[order], length[order]
    new = np.append(True, sequence[1:] != sequence[:-1])
    assert (offset[new] == 0).all()
    assert (offset[~new] == (offset + length)[:-1][~new[1:]]).all()
    assert (offset + length).max() <= capacity
    assert new.sum() == plan.sequences == len(np.unique(sequence))
    best = group_packing.Lots(capacity)  # best fit of all lengths, longest first
    for n in range(capacity, 0, -1):
        best.place(n, int(counts[n]))
    assert plan.sequences <= 1.02 * best.sequences + 2


def test_configurations_are_optimal_on_known_sizes():
    sizes, wanted = np.array([50, 34, 33]), np.array([20, 30, 30])
    found = group_packing.configurations(sizes, wanted, 100)
    assert all(sum(slots) <= 100 for slots, _ in found)
    made = [sum(slots.count(s) * n for slots, n in found) for s in sizes]
    assert np.allclose(made, wanted)
    # Ten pairs of 50, fifteen of all three others, and the other 34s in pairs.
    assert sum(n for _, n in found) == pytest.approx(10 + 15 + 7.5)


# -- Merkle manifest ------------------------------------------------------------------------

ROWS = "doc_id long, source string, lang string, n_chars long, text string, hash string, pos int"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, source, lang, n_chars, text):
    values = (doc_id, source, lang, n_chars, text)
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def _lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _plain_manifest(docs):
    by = defaultdict(list)
    for d in docs:
        by[d[1]].append(d)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    key = lambda d: (d[0] is not None, d[0] or 0, _leaf(*d))
    held = {s: sorted(by[s], key=key) for s in order}
    trees = {s: _levels([_leaf(*d) for d in held[s]]) for s in order}
    top = _levels([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for place, s in enumerate(order):
        for i, d in enumerate(held[s]):
            seen, proof = list(d), []
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0 and d[4] is not None:
                seen[4] = _lowered(d[4])
            now = _leaf(*seen)
            for levels, at in ((trees[s], i), (top, place)):
                for nodes in levels[:-1]:
                    first = at - at % 16
                    left, right = nodes[first:at], nodes[at + 1 : first + 16]
                    proof += left + right
                    now = _h(*left, now, *right)
                    at //= 16
            out.append(
                (d[0], _leaf(*d), trees[s][-1][0], root, _h(*proof), now, now == root)
            )
    return sorted(out, key=repr)


def _documents(kind):
    if kind == "many sources":
        return [(i, f"s{i % 300:03}", "en", i, f"Text {i}") for i in range(900)]
    if kind == "hot source":
        return [(i, "hot" if i % 3 else f"s{i}", "en", i, f"T{i}") for i in range(1200)]
    if kind == "one":
        return [(7, "only", None, 3, "ABC")]
    if kind == "one source":
        return [(i, None, "en", None, "A" * i) for i in range(17)]
    odd = [(i, s, None, n, t) for i, (s, n, t) in enumerate(
        [(None, 0, ""), ("", None, None), ("é", 5, "ÉA"), ("z", 1, "Z"), ("Z", -1, "a\nB")]
    )]
    odd += [(None, "z", "en", 1, "Q"), (None, "z", "en", 1, "Q"), (3, "z", None, 1, "Z")]
    odd += [(5, "z", "en", 1, "Q" * 100_000)] * 20 + [(20, "z", "en", 2, "r")]
    return odd


@pytest.mark.parametrize("kind", ["many sources", "hot source", "one", "one source", "odd"])
def test_manifest(spark, kind):
    docs = _documents(kind)
    df = many(spark, [(*d, "x", 1) for d in docs], ROWS)
    out = merkle_pivot.manifest(df, merkle_pivot.tampered_text())
    assert out.columns == [f.split()[0] for f in merkle_pivot.RESULT.split(", ")]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == _plain_manifest(docs)


def test_manifest_of_nothing_and_without_tampering(spark):
    assert merkle_pivot.manifest(many(spark, [], ROWS)).collect() == []
    docs = _documents("one source")
    rows = merkle_pivot.manifest(many(spark, [(*d, "x", 1) for d in docs], ROWS)).collect()
    assert len(rows) == 17 and all(r.verified for r in rows)


# -- vector codes ---------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, code string, values int"


def _plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    kept = [r for r in kept if len(r[1]) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    whole = np.clip(np.floor(np.array([r[1] for r in kept], float) * 1024), -(1 << 24), 1 << 24)
    cut = whole.astype(np.int64).reshape(len(kept), parts, -1)
    books = [[list(map(int, v[p])) for v in cut[:entries]] for p in range(parts)]

    def nearest(p, v):
        far = [sum((int(x) - y) ** 2 for x, y in zip(v, e, strict=True)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for v in cut:
                members[nearest(p, v[p])[0]].append(v[p])
            for e, own in members.items():
                books[p][e] = [int(sum(map(int, c))) // len(own) for c in zip(*own, strict=True)]
    found = [[nearest(p, v[p]) for p in range(parts)] for v in cut]
    error = [sum(far for _, far in f) for f in found]
    of_label = defaultdict(int)
    for r, e in zip(kept, error, strict=True):
        of_label[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(
        (
            (r[0], "".join(f"{k:02x}" for k, _ in f), e, of_label[r[2]], sha)
            for r, f, e in zip(kept, found, error, strict=True)
        ),
        key=repr,
    )


def _vectors(seed, n, dims=8):
    pick = np.random.default_rng(seed)
    rows = [
        (int(i), [float(np.float32(x)) for x in pick.normal(0, 0.2, dims)], int(pick.integers(3)))
        for i in pick.permutation(n)
    ]
    for k in range(0, n, 3):
        rows[k] = (rows[k][0], rows[1][1], None if k % 2 else 1)  # copies, and null labels
    return rows


ODD_VECTORS = [
    (None, None, None), (1, None, 2), (None, [0.5] * 8, None), (2, [0.5] * 7 + [None], 1),
    (3, [0.5] * 7 + [float("nan")], 1), (4, [float("-inf")] + [0.0] * 7, 1), (5, [], 1),
    (6, [0.25] * 8, 1), (6, [-0.25] * 8, 1), (6, [0.25] * 8, 1), (7, [0.25] * 12, 1),
    (8, [0.25] * 6, 1), (9, [1e30, -1e30] * 4, 0),
]


@pytest.mark.parametrize("entries", [4, 16])
def test_value_codes(spark, entries):
    rows = _vectors(entries, 90) + [r for r in ODD_VECTORS if r[0] != 9]
    df = many(spark, [(*r, "c", 3) for r in rows], VECTORS)
    out = value_codes.compressed(df, entries=entries)
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = sorted((tuple(r) for r in out.select(names).collect()), key=repr)
    assert got == _plain_codes(rows, entries=entries)


def test_value_codes_of_huge_components(spark):
    rows = ODD_VECTORS + _vectors(1, 12)
    out = value_codes.compressed(many(spark, [(*r, "c", 3) for r in rows], VECTORS), entries=3)
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = sorted((tuple(r) for r in out.select(names).collect()), key=repr)
    assert got == _plain_codes(rows, entries=3)


def test_value_codes_of_nothing(spark):
    for rows in ([], [(1, None, 2, "c", 3), (2, [], 1, "c", 3)]):
        out = value_codes.compressed(many(spark, rows, VECTORS, 2))
        assert out.collect() == []
        assert set(out.columns) >= {"vec_id", "code", "error", "label_error", "codebooks_sha256"}


def test_blocks_do_not_change_the_codes(spark, monkeypatch):
    rows = _vectors(9, 60)
    df = many(spark, [(*r, "c", 3) for r in rows], VECTORS, 7)
    one = sorted(map(tuple, value_codes.compressed(df, entries=8).collect()), key=repr)
    monkeypatch.setattr(value_codes, "BLOCK_VALUES", 24)  # three vectors a block
    assert sorted(map(tuple, value_codes.compressed(df, entries=8).collect()), key=repr) == one
