"""Each operator against a plain version on small tables: nulls, empty and repeated rows."""

import hashlib
import os
import random
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from stakelens.llm import (
    co_training,
    content_sort,
    cuckoo,
    line_dedup,
    main_text,
    ngram_join,
    packing,
    quality_rules,
    scratch,
    soft_mixing,
    substring_dedup,
    textops,
    tokens,
    warc,
)
from stakelens.llm.components import components
from stakelens.llm.queries import TOKENIZER

DOC = "doc_id long, text string"
ODD = [(None, None), (None, "x y"), (0, ""), (1, "a b"), (2, "A\x0b b"), (2, "A\x0b b")]


def make(spark, rows, schema=DOC):
    """Rows over several partitions, with a column that clashes with names inside."""
    scratch.ship(spark)
    df = spark.createDataFrame(rows, schema).repartition(3)
    return df.selectExpr("*", "'x' AS digest", "1 AS n", "2 AS id", "3 AS label")


def got(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def some_texts(seed, n=60):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    rows = list(ODD)
    for i in range(3, n):
        if i % 7 == 0 and len(rows) > 9:
            kept = pick.choice(rows[6:])[1].split(" ")
            kept[pick.randrange(len(kept))] = pick.choice(words)
        else:
            kept = [pick.choice(words) for _ in range(pick.choice([4, 5, 9, 40, 120]))]
            kept = kept + kept[: pick.choice([0, 0, 30])]
        rows.append((i, pick.choice([" ", " ", "\n"]).join(kept)))
    return rows


def byte_words(text):
    return (text or "").encode().split()


def test_suffix_array_repeats():
    pick = random.Random(3)
    texts = [" ".join(pick.choice("abc") for _ in range(pick.randint(0, 25))) for _ in range(80)]
    texts += ["", "a a a a a a a a", "x"]
    for row, data, offsets in textops.runs(pa.array(texts), limit=400):
        words = textops.words(data, offsets)
        best = quality_rules.longest_repeats(words)
        for k in range(len(offsets) - 1):
            w = texts[row + k].split()
            want = []
            for i in range(len(w)):
                longest = 0
                for j in range(len(w)):
                    n = 0
                    while i != j and max(i, j) + n < len(w) and w[i + n] == w[j + n]:
                        n += 1
                    longest = max(longest, n)
                want.append(longest)
            assert list(best[words.first[k] : words.first[k + 1]]) == want


def test_quality_rules(spark):
    rows = [*ODD, (9, "# a\n# a\n" + " ".join(f"w{i}" for i in range(60))), (10, "z " * 80)]
    block = " ".join(f"v{i}" for i in range(40))
    rows.append((11, " ".join([block, *[f"u{i}" for i in range(90)], block])))
    out = {r.doc_id: r for r in quality_rules.judged(make(spark, rows)).collect()}
    assert len(got(quality_rules.judged(make(spark, rows)), "doc_id")) == len(rows)
    nine = out[9]
    assert (nine.n_words, nine.n_symbols, nine.n_dup_lines, nine.kept) == (64, 2, 1, True)
    assert nine.word_chars == 4 + sum(len(f"w{i}") for i in range(60))
    assert (out[10].n_repeat_words, out[10].base_failed, out[10].kept) == (80, True, False)
    assert (out[11].base_failed, out[11].n_covered_words, out[11].kept) == (False, 80, False)
    kept = quality_rules.kept_rows(make(spark, rows))
    assert kept.columns == make(spark, rows).columns
    assert got(kept, "doc_id") == [(9,)]


@pytest.mark.parametrize("window", [5, 8])
def test_substring_dedup(spark, window):
    rows = some_texts(window, 50)
    counted = Counter()
    for _, text in rows:
        w = byte_words(text)
        counted.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    want = []
    for doc_id, text in rows:
        w, gone = byte_words(text), set()
        for i in range(len(w) - window + 1):
            if counted[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    out = substring_dedup.summary(make(spark, rows), window)
    assert got(out, *out.columns) == sorted(want, key=repr)


def test_warc(spark, tmp_path):
    long = "y" * 100
    rows = [(None, None, None), (None, None, long), (7, "a b%\n", long), (9, None, long),
            (9, None, long), (8, "", "y" * 99), (10, "", "y" * 99)]
    pages = make(spark, rows, "page_id long, url string, html string")
    warc.write(pages, f"{tmp_path}/w")
    found = warc.resolved(warc.read(spark, f"{tmp_path}/w"))
    want = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        again = page_id == 9
        want.append((page_id, len(data), hashlib.sha256(data).hexdigest(),
                     "revisit" if again else "response", 7 if again else None, None))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"]
    assert got(found, *names) == sorted(want, key=repr)
    payload = {r.page_id: r.payload for r in warc.read(spark, f"{tmp_path}/w").collect()}
    assert bytes(payload[7]) == long.encode()


def test_warc_reports_what_is_broken():
    one = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    whole = warc.archive([one, one])
    assert [r["error"] for r in warc.records(whole)] == [None, None]
    assert next(warc.records(whole))["payload"] == b"payload"
    assert [bool(r["error"]) for r in warc.records(whole[:-3])] == [False, True]
    for wrong in (one.replace(b"Content-Length: 7", b"Content-Length: 8"),
                  one.replace(b"payload", b"payloaf"), one[:-2], b"x"):
        assert [bool(r["error"]) for r in warc.records(warc.archive([wrong]))] == [True]


@pytest.mark.parametrize("largest", [True, False])
def test_content_sort(spark, largest):
    rows = [*ODD, (5, "same"), (6, "same"), (6, "same"), (None, "same"), (4, "same ")]
    by_text = defaultdict(list)
    for doc_id, text in rows:
        by_text[text or ""].append(doc_id)
    want, left = [], Counter(rows)
    for (doc_id, text), times in left.items():
        ids = by_text[text or ""]
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        for k in range(times):
            digest = hashlib.sha256((text or "").encode()).hexdigest()
            want.append((doc_id, keep, len(ids), doc_id == keep and k == 0, digest))
    out = content_sort.decisions(make(spark, rows), largest)
    assert got(out, *out.columns) == sorted(want, key=repr)
    stay = content_sort.deduplicated(make(spark, rows), largest)
    assert stay.count() == len(by_text) and stay.columns == make(spark, rows).columns


def test_mixing_meets_its_targets(spark):
    pick, rows, labels = random.Random(2), [], []
    for i in range(600):
        kind = i % 10
        words = [f"w{pick.randrange(400)}" for _ in range(40)]
        words += ["nasty", "vile"] if kind == 0 else ["###", "!!!", "###"] * 6 if kind < 3 else []
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind not in (1, 2)), int(kind == 0)))
    docs = make(spark, [*rows, *ODD[:3]])
    known = spark.createDataFrame([*labels, (None, 1, 0), (5, None, None)],
                                  "doc_id long, quality int, toxic int")
    out = soft_mixing.rates(docs, known).toPandas()
    assert len(out) == 603 and (out.rate >= 0).all()
    assert np.allclose(out[["p_good", "p_poor", "p_toxic"]].sum(axis=1), 1)
    used = [(out.n_tokens * out.rate * out[f"p_{d}"]).sum() for d in soft_mixing.DOMAINS]
    assert used[0] / sum(used) > 0.94
    by_kind = out.dropna().groupby(out.doc_id % 10).rate.mean()
    assert by_kind[5] > 0.95 and by_kind[0] < 0.3 and by_kind[1] < 0.3
    mixed = soft_mixing.mixed(docs, known)
    assert mixed.columns == docs.columns and 400 < mixed.count() < 480


def test_main_text():
    page = ("<html><head><title>t</title></head><body><nav><a href=x>menu one</a></nav>"
            "<div class=\"ad\">buy this now</div><article><h1>Head &amp; line</h1><p>first"
            " <b>part</b>\n of it<br>goes on<p>second one with some more words<div class='comments'>no</div>"
            "<form><p>mail</form></article><script>var a='</p>'</script>"
            "<footer>&copy; foot</footer>")  # fmt: skip
    weights = main_text.fit([page, None, "<p>no labels"])
    want = "Head & line\n\nfirst part of it goes on\n\nsecond one with some more words"
    assert main_text.extract(page, weights) == want
    assert main_text.extract(page[: page.index("</article>")], weights) == want
    assert main_text.extract(None, weights) == main_text.extract("<nav>a</nav>", weights) == ""


MENU = "".join(f"<li><a href=x>item {i}</a></li>" for i in range(6))
GIVEN = (f"<body><nav><ul>{MENU}</ul></nav><article><h1>A head</h1>"
         f"<p>{'word ' * 50}</p></article><footer>foot</footer>")  # fmt: skip


@pytest.mark.parametrize("box", ["<div class=share>%s</div>", "<aside>%s</aside>", "<nav>%s</nav>"])
def test_main_text_goes_on_after_a_box(box):
    weights = main_text.fit([GIVEN] * 20)
    box = box % f"<ul>{MENU * 3}</ul>"
    page = f"<body><article><h1>Head</h1><p>{'word ' * 60}</p>{box}<p>the short end</p></article>"
    for first, last in (("Head", "the short end"), ("the short end", "Head")):
        turned = page.replace("Head", "?").replace("the short end", last).replace("?", first)
        out = main_text.extract(turned, weights).split("\n\n")
        assert [out[0], out[-1], len(out)] == [first, last, 3]


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<div id=x>", "</div>"),
                                          ("<article><div>", "</div></article>")])
def test_main_text_ends_with_a_list_of_short_items(open_, close):
    menu = f"<div><ul>{'<li>go on' * 6}</ul></div>"
    known = GIVEN.replace("<nav>", menu).replace("</article>", "<ul><li>so it is</ul></article>")
    weights = main_text.fit([known] * 20)
    items = "".join(f"<li>item {i}</li>" for i in range(9))
    page = f"<body>{menu}{open_}<p>{'word ' * 60}</p><ul>{items}</ul>{close}{menu * 4}"
    out = main_text.extract(page, weights).split("\n\n")
    assert out[0].startswith("word") and out[1:10] == [f"item {i}" for i in range(9)]
    assert len(out) == 10


@pytest.mark.parametrize("names", ['class="has-sidebar"', "class=no-comments", 'id="search-page"',
                                   'class="x page-with-header"', "class=search", "role='search'"])
def test_main_text_keeps_articles_in_named_wrappers(names):
    weights = main_text.fit([GIVEN] * 20)
    article = f"<h1>Head</h1><p>{'word ' * 30}</p><p>the end</p>"
    for tag in ("article", "main"):
        page = f"<body><div {names}><div><{tag}>{article}</{tag}></div></div><div class=menu>{MENU}</div>"
        for whole in (page, page.replace("<body>", "<body><main><h1>Site</h1>")):
            out = main_text.extract(whole, weights).split("\n\n")
            assert out[-3:] == ["Head", ("word " * 30).strip(), "the end"]
    box = "<div class=comments><article>a reply</article></div><div class='site-footer'>no</div>"
    page = f"<body><div class=has-sidebar>{article}</div>{box}"
    assert main_text.extract(f"<article>{article}</article>{box}", weights).endswith("the end")
    assert "no" not in main_text.extract(page, weights)
    assert main_text.extract(page.replace("a reply", ""), weights).endswith("the end")


@pytest.mark.parametrize("small", [2, 16])
def test_ngram_join(spark, small):
    rows = some_texts(5, 70) + [(900, "w1 w2 w3 w4 w5")]

    def grams(text):
        w = byte_words((text or "").lower())
        return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))

    sets = [grams(t) for _, t in rows]
    linked = [[j for j, b in enumerate(sets) if a and b and 5 * len(a & b) >= 4 * len(a | b)]
              for a in sets]
    want = []
    for i, (doc_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = set(linked[todo.pop()]) - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        want.append((doc_id, len(sets[i]), min(ids) if ids else None))
    out = ngram_join.joined(make(spark, rows), small).drop("td")
    assert got(out, *out.columns) == sorted(want, key=repr)


def test_one_of_each_component_with_null_and_equal_ids(spark):
    words = [[f"{c}{i}" for i in range(60)] for c in "abcd"]
    near = [" ".join([*w[:58], "x", "y"]) for w in words]
    rows = [(None, " ".join(words[0])), (None, near[0])]
    rows += [(7, " ".join(words[1])), (7, near[1]), (7, near[1])]
    rows += [(None, " ".join(words[2])), (3, near[2]), (9, " ".join(words[3]))]
    rows += [(None, None), (4, ""), (4, " ")]
    kept = ngram_join.one_of_each(make(spark, rows))
    assert kept.columns == make(spark, rows).columns
    found = got(kept, "doc_id", "text")
    worded = [r for r in found if (r[1] or "").strip()]
    assert len(worded) == 4
    assert {r[0] for r in worded} == {None, 7, 3, 9}
    assert sorted((r for r in found if r not in worded), key=repr) == sorted(rows[-3:], key=repr)


def test_a_crowd_of_near_copies_of_one_text(spark):
    """Copies of one text, each with words of its own: many pairs, most of them no links."""
    pick = random.Random(11)
    base = [f"w{pick.randrange(5000)}" for _ in range(200)]
    rows = [(5000, " ".join(base))]
    for i in range(120):
        words = list(base)
        for at in pick.sample(range(200), 4):
            words[at] = f"n{i}x{at}"
        rows.append((i, " ".join(words)))
    grams = [
        {tuple(t.split()[k : k + 5]) for k in range(196)} for _, t in rows
    ]
    label = list(range(len(rows)))
    for i, a in enumerate(grams):
        for j in range(i):
            if 100 * len(a & grams[j]) >= 80 * len(a | grams[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for x, (doc_id, _) in zip(label, rows, strict=True):
        least[x] = min(doc_id, least.get(x, doc_id))
    want = sorted((d, least[x]) for x, (d, _) in zip(label, rows, strict=True))
    out = ngram_join.joined(make(spark, rows))
    assert sorted(got(out, "doc_id", "component_id")) == want


def test_saturated_counts_pass_the_bound():
    points = np.full((2, ngram_join.GROUPS), ngram_join._MOST, np.int16)
    size = 30_000_000
    assert ngram_join.may_be_similar(int(np.minimum(*points.astype(int)).sum()), size, size)
    tree = ngram_join.RTree(points, np.array([size, size]))
    assert sorted(tree.near(ngram_join.folded(points)[0], size)) == [0, 1]


def test_rtree_loses_nothing():
    pick = np.random.default_rng(1)
    points = pick.poisson(2, (700, ngram_join.GROUPS)).astype(np.int16)
    points[350:] = points[:350] + (pick.random((350, ngram_join.GROUPS)) < 0.05)
    sizes, coarse = points.sum(1, dtype=np.int64), ngram_join.folded(points)
    tree = ngram_join.RTree(points, sizes)
    for k in range(0, 700, 13):
        bound = np.minimum(coarse, coarse[k]).sum(1)
        want = np.flatnonzero(ngram_join.similar(bound, sizes[k], sizes))
        assert sorted(tree.near(coarse[k], sizes[k])) == list(want)


def test_cuckoo_filter():
    hashes = textops.mix(np.arange(1, 40001, dtype=np.uint64))
    held = cuckoo.Filter()
    layers = np.append(held.insert(hashes[:15000]), held.insert(hashes[15000:20000]))
    held = cuckoo.Filter.load(held.dump())
    assert held.contains(hashes[:20000]).all() and held.contains(hashes[20000:]).mean() < 0.01
    held.delete(hashes[:100], layers[:100])
    assert held.contains(hashes[100:20000]).all() and held.contains(hashes[:100]).mean() < 0.1
    with pytest.raises(ValueError):
        held.delete(hashes[30000:30100], np.zeros(100, int))


def test_cuckoo_layers_forget_nothing_that_they_hold():
    """Several layers of different sizes, most keys deleted: the others are all still found."""
    n = 400_000
    hashes = textops.mix(np.arange(1, n + 1, dtype=np.uint64))
    held = cuckoo.Filter()
    cuts = np.split(hashes, [1000, 4000, 30_000, 120_000])
    layers = np.concatenate([held.insert(x) for x in cuts])
    assert len({len(t) for t in held.layers}) > 2
    assert all(np.count_nonzero(t) <= 0.9 * t.size for t in held.layers)
    gone = np.arange(n) % 4 != 0
    held.delete(hashes[gone], layers[gone])
    assert held.contains(hashes[~gone]).all()
    assert sum(map(np.count_nonzero, held.layers)) == n - gone.sum()


def test_cuckoo_insertion_into_a_full_layer_is_quick():
    hashes = textops.mix(np.arange(1, 20001, dtype=np.uint64))
    held = cuckoo.Filter()
    held.insert(hashes[:12000])
    began = time.process_time()
    held.insert(hashes[12000:])
    assert time.process_time() - began < 1
    assert held.contains(hashes).all()


def lines_left(rows):
    owner = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\v\f\r")
            if len(key) >= 10 and doc_id is not None:
                key = key.encode().lower()
                owner[key] = min(owner.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        keys = [x.strip(" \t\n\v\f\r") for x in lines]
        kept = [x for x, k in zip(lines, keys, strict=True)
                if len(k) < 10 or owner.get(k.encode().lower(), doc_id) == doc_id]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_line_dedup_and_back(spark):
    pick = random.Random(4)
    lines = ["a shared line here", " A SHARED line here\t", "short", "another common line",
             "Über ÜBER lines differ", "über ÜBER lines differ", ""]
    rows = [*ODD, *[(i, "\n".join(pick.choices([*lines, f"own line {i} of it"], k=5)))
                    for i in range(10, 40)], (None, "another common line")]
    old, new = rows[:25], rows[25:]
    state = line_dedup.insert(line_dedup.build(make(spark, old)), make(spark, new))
    out = line_dedup.cleaned(state, make(spark, rows))
    assert got(out, *out.columns) == lines_left(rows)
    gone = [r for r in rows if r[0] is not None and r[0] % 3 == 1]
    stay = [r for r in rows if r not in gone]
    state = line_dedup.delete(state, make(spark, gone))
    out = line_dedup.cleaned(state, make(spark, stay))
    assert got(out, *out.columns) == lines_left(stay)


def test_tokens_equal_those_of_the_file():
    from tokenizers import Tokenizer

    whole, fast = Tokenizer.from_file(TOKENIZER), tokens.encoder(TOKENIZER)
    assert fast.fast is not None
    pick = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "is", "'s", "<|endoftext|>", "9", "é", "\xa0", "漢", "!!"]
    for _ in range(800):
        text = "".join(pick.choices(bits, k=pick.randint(0, 12)))
        ids = np.frombuffer(fast.encode(text), "<u4").tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    rows = [*ODD, *[(i, "word " * (i * 37 % 400)) for i in range(10, 90)]]
    out = packing.packed(make(spark, rows), TOKENIZER, capacity=256, open_windows=4, min_cut=8)
    pieces = out.collect()
    full = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows[6:]}
    for doc_id, ids in full.items():
        own = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
        assert [p.start for p in own] == list(np.cumsum([0, *[p.length for p in own[:-1]]]))
        joined = b"".join(bytes(p.ids) for p in own)
        assert np.frombuffer(joined, "<u4").tolist() == ids
        assert {p.doc_tokens for p in own} == {len(ids)}
    by_window = defaultdict(list)
    for p in pieces:
        by_window[p.sequence_id].append((p.offset, p.length))
    sizes = []
    for spans in by_window.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 256
        sizes.append(end)
    assert sum(256 - s for s in sizes) <= 256 + 8 * len(sizes)


def test_co_training_on_held_out_rows(spark):
    pick, rows, labels = random.Random(6), [], []
    for i in range(900):
        good = i % 3 != 0
        pool = 50 if good else 12
        text = " ".join(f"{'g' if good else 'b'}{pick.randrange(pool)}" for _ in range(30))
        source = pick.choice(["s1", "s2"] if good else ["s2", "s3"])
        rows.append((i, text, "en", source, len(text)))
        labels.append((i, int(good)))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = make(spark, [*rows, (None, None, None, None, None)], schema)
    known = spark.createDataFrame(labels[:300], "doc_id long, quality int")
    out = {r.doc_id: r for r in co_training.scored(docs, known).collect()}
    right = np.mean([out[i].kept == bool(y) for i, y in labels[300:]])
    assert right > 0.95 and len(out) == 901
    assert 0 <= out[None].score <= 1


def test_co_training_learns_from_all_unlabelled_rows(spark):
    """Junk that no label has, in the rows that a pool by hash (4,000 of 8,000) takes last."""
    ids = spark.range(9000).selectExpr("id", "xxhash64(id, 7) AS h").orderBy("h").collect()
    pick, rows, labels = random.Random(9), [], []
    for place, (i, _) in enumerate(ids):
        good, new = place % 3 != 0, place >= 8500
        words = "z" if new else "g" if good else "b"
        text = " ".join(f"{words}{pick.randrange(12)}" for _ in range(8))
        rows.append((i, text, "en", "s3" if new or not good else "s1", len(text)))
        if place < 300:
            labels.append((i, int(good)))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r.doc_id: r for r in co_training.scored(make(spark, rows, schema), known).collect()}
    new = [out[i].text_score for i, _ in ids[8500:]]
    assert np.mean(new) < 0.1 and max(new) < 0.5


def test_empty_tables(spark):
    docs = make(spark, [], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (quality_rules.judged(docs), content_sort.decisions(docs),
                substring_dedup.summary(docs), ngram_join.joined(docs),
                line_dedup.cleaned(line_dedup.build(docs), docs), packing.packed(docs, TOKENIZER),
                soft_mixing.rates(docs, labels), co_training.scored(docs, labels)):
        assert out.count() == 0


def test_pipeline(spark, tmp_path):
    pick = random.Random(8)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    base = [" ".join(f"w{pick.randrange(5000)}" for _ in range(120)) for _ in range(40)]
    texts = [*base, base[0], base[1].replace(" ", "  ", 1), "too short", "z " * 200]
    near = base[2].split(" ")
    near[60] = "changed"
    texts.append(" ".join(near))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Of equal texts the largest id stays, of similar ones the smallest; junk goes.
    want = (set(range(40)) - {0}) | {40}
    assert {p.doc_id for p in pieces} == want
    assert all(p.ids_crc32 for p in pieces) and zlib.crc32(b"") == 0


def test_components_of_a_path_a_star_and_odd_edges(spark):
    path = [(i, i + 1) for i in range(1, 40)]
    star = [(90, i) for i in range(50, 80)] * 2
    odd = [(None, 1), (200, 200), (300, 299)]
    found = components(spark.createDataFrame(path + star + odd, "a long, b long")).collect()
    want = {i: 1 for i in range(1, 41)} | {i: 50 for i in [*range(50, 80), 90]}
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.label for r in found} == want | {299: 299, 300: 299}


def test_a_task_of_the_join_takes_its_bins_one_at_a_time(spark):
    tasks, bins = 4, 12
    words = [" ".join(f"w{k}" for k in range(n, n + 30)) for n in range(0, 60, 2)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(words * 2)], "doc_id long, text string")
    dealt = ngram_join._dealt(docs, bins)
    found = ngram_join._crowds(dealt, tasks, 2)
    # Every task has as many bins, and their rows come in order.
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bin" not in text
    assert "Sort [bin" in text
    batch = pa.RecordBatch.from_pylist([{"bin": b} for b in (0, 0, 4, 8, 8, 8)])
    held = ngram_join._by_bin(iter([batch.slice(0, 4), batch.slice(4)]))
    assert [[r["bin"] for r in rows] for rows in held] == [[0, 0], [4], [8, 8, 8]]
    # The meetings are those of all signatures, counted plainly.
    meet = {}
    for row in dealt.collect():
        names = np.frombuffer(row["sets"], np.int64)[np.frombuffer(row["member"], np.uint16)]
        signs = row["signs"]
        for k, name in enumerate(names.tolist()):
            meet.setdefault((row["bin"], signs[6 * k : 6 * k + 6]), set()).add(name)
    pairs, members = Counter(), Counter()
    for crowd in meet.values():
        if len(crowd) == 2:
            pairs[frozenset(crowd)] += 1
        elif len(crowd) > 2:
            members.update(crowd)
    got_pairs, got_members = Counter(), Counter()
    for row in found.collect():
        if row["crowd"]:
            got_members[row["b"]] += 1
        else:
            got_pairs[frozenset((row["a"], row["b"]))] += row["times"]
    assert pairs and got_pairs == pairs and got_members == members


def test_words_are_hashed_in_blocks_of_bounded_memory(monkeypatch):
    texts = ["ab c", None, "d" * 5000 + " e  f", "", "ab c " * 700]
    [(_, data, offsets)] = textops.runs(pa.array(texts))
    whole = textops.words(data, offsets, lower=True)
    powers = textops._Powers(textops._BYTE_POWERS.base)
    monkeypatch.setattr(textops, "_BYTE_POWERS", powers)
    monkeypatch.setattr(textops, "BLOCK_BYTES", 64)
    cut = textops.words(data, offsets, lower=True)
    for field in ("start", "end", "hash", "first"):
        assert np.array_equal(getattr(whole, field), getattr(cut, field))
    # Powers are kept by a worker: a run of many words needs no more of them than a block.
    textops.words(*[x for _, *x in textops.runs(pa.array(["ab c " * 40000]))][0])
    assert len(powers.up) <= 1 << 16


def test_members_of_crowds_are_stored_without_points(spark, monkeypatch):
    """Points go with pairs of sets, not with each crowd of a set; texts are filtered first."""
    kept, store = {}, ngram_join.stored

    def noted(df, name):
        kept.setdefault(name, []).append(
            (df.columns, df._jdf.queryExecution().executedPlan().toString())
        )
        return store(df, name)

    monkeypatch.setattr(ngram_join, "stored", noted)
    base = [f"w{k}" for k in range(80)]
    rows = [(i, " ".join([*base[:-2], f"x{i}", f"y{i}"])) for i in range(24)]
    rows += [(100 + i, " ".join(f"z{i}_{k}" for k in range(30))) for i in range(5)]
    out = ngram_join.joined(make(spark, rows), small=4)
    found = {r.doc_id: r.component_id for r in out.collect()}
    assert found == {i: 0 for i in range(24)} | {100 + i: 100 + i for i in range(5)}
    for name in ("members", "labelled", "apart"):
        assert kept[name] and all("point" not in columns for columns, _ in kept[name])
    [(_, plan)] = kept["candidates"]
    assert "getbit" in plan


KEPT_MEMORY = """
import random
import pyarrow as pa
from stakelens.llm import quality_rules

class Rows:
    schema = None
    def mapInArrow(self, function, schema):
        return function

def own():
    with open("/proc/self/smaps_rollup") as lines:
        return sum(int(x.split()[1]) for x in lines if x.startswith("Pss_Anon:")) // 1024

pick = random.Random(1)
words = [f"w{i}" for i in range(9999)]
texts = [" ".join(pick.choices(words, k=400)) for _ in range(4000)]
given = (pa.RecordBatch.from_pydict({"text": texts[a : a + 2000]}) for a in (0, 2000))
before = own()
kept = sum(len(batch) for batch in quality_rules.kept_rows(Rows())(given))
print(kept, own() - before)
"""


def test_a_task_gives_back_what_the_rules_have_needed():
    if not os.path.exists("/proc/self/smaps_rollup"):
        pytest.skip("tells nothing about memory")
    root = os.path.dirname(corpus_pipeline.__file__)
    told = subprocess.run(
        [sys.executable, "-c", KEPT_MEMORY], cwd=root, capture_output=True, text=True, check=True
    )
    kept, mb = map(int, told.stdout.split())
    assert kept == 4000
    assert mb < 55


def test_released_passes_batches_on_and_ends_with_its_function():
    batches = [pa.RecordBatch.from_pydict({"x": [k, k]}) for k in range(3)]
    assert list(textops.released(lambda given: (b.slice(1) for b in given))(iter(batches))) == [
        b.slice(1) for b in batches
    ]
    assert list(textops.released(iter)(iter([]))) == []


def test_batches_of_the_pipeline_are_bounded(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")], DOC)
    before = spark.conf.get(scratch.BATCH)
    try:
        for given, want in (("10000", "2000"), ("0", "2000"), ("500", "500")):
            for stage in (corpus_pipeline.quality, corpus_pipeline.packed):
                spark.conf.set(scratch.BATCH, given)
                stage(spark, docs, str(tmp_path))
                assert spark.conf.get(scratch.BATCH) == want
    finally:
        spark.conf.set(scratch.BATCH, before)
