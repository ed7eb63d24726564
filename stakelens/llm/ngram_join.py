"""Exact Jaccard join of documents on word n-grams, by count vectors.

The n-grams of a document are hashed into groups, and the counts of the groups are a point.
Two sets with a Jaccard similarity of at least 0.8 differ in at most a ninth of their summed
sizes, so

- points in the same or neighbouring size classes are dealt into parts, some more than the
  n-grams in which a pair of the class may differ: similar sets agree wholly in at least as
  many parts as there are more. Parts without n-grams are not sent, so a set's `need` is
  that number less its empty parts (a set whose parts are mostly empty sends these too);
- sets that agree in a part meet in a crowd. A pair of a crowd of at most `SMALL` sets is
  dropped if it cannot meet as often as it needs. In larger crowds only sets stay that are in
  as many of them as they need; each is linked to its crowd's first, and what these links
  leave apart is searched with an R-tree over the points;
- the overlap of two sets is at most the sum of the smaller counts of each group. Pairs are
  dropped, and branches of the R-tree skipped, if this bound is too small;
- the pairs that survive are verified on the sets themselves.

Only distinct sets are compared. Documents are linked through components of verified pairs.

Defined results: a document without words has no n-grams and is linked with nothing. With
fewer words than `WIDTH`, all its words are the only n-gram. A null id is never a component's
name unless all ids in it are null. Repeated rows have the same set. An empty table gives no
rows. Extra columns are not read. Memory of a task is bounded by a run of texts, a share of
the parts, or the points of one crowd (never their texts).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakelens.llm import textops as T
from stakelens.llm.components import components
from stakelens.llm.scratch import stored
from stakelens.operators import presence

WIDTH = 5
GROUPS = 256
COARSE = 32
SMALL = 16
QUERIES_PER_TASK = 8192
PAIRS_PER_TASK = 4096
LEAF = 32
RUN_TEXTS = 1 << 16  # a text's number in a run has 16 bits
STARS = 1  # rounds of stars after the first
_MOST = (1 << 15) - 1
_SATURATED = GROUPS * _MOST  # bound of two sets whose counts do not fit: it says nothing


def similar(shared, left, right):
    """Whether the Jaccard similarity is at least 0.8, from overlap and sizes."""
    return 9 * shared >= 4 * (left + right)


def may_be_similar(bound, left, right):
    """Whether the similarity may be at least 0.8, from a bound of the overlap and sizes."""
    return similar(bound, left, right) | (bound >= _SATURATED)


# -- sets, points and parts -----------------------------------------------------------------


class _Sets:
    """The distinct n-grams of a run of texts: hashes sorted by text, sizes and points."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = T.words(data, offsets, lower=True)
        self.n = len(offsets) - 1
        grams = [T.windows(words.hash, WIDTH)]
        at = [np.flatnonzero(T.within(words.first, WIDTH))]
        grams[0] = grams[0][at[0]]
        for length in range(1, WIDTH):
            start = words.first[:-1][words.counts == length]
            if len(start):
                grams.append(T.windows(words.hash, length, 1)[start])
                at.append(start)
        hashes, at = np.concatenate(grams), np.concatenate(at)
        owner = np.searchsorted(words.first, at, "right") - 1
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        self.hash, self.owner = hashes[new], owner[new]
        self.size = np.bincount(self.owner, minlength=self.n)
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit names of each set that do not depend on the order of its members."""
        names = []
        for salt in (3, 5):
            sums = np.zeros(self.n, T.U)
            np.add.at(sums, self.owner, T.mix(self.hash ^ T.U(salt)))
            names.append(T.mix(sums + self.size.astype(T.U)))
        return names[0], names[1]

    def points(self) -> np.ndarray:
        group = (self.hash >> T.U(40)) % T.U(GROUPS)
        cells = self.owner * GROUPS + group.astype(np.int64)
        counts = np.bincount(cells, minlength=self.n * GROUPS).reshape(self.n, GROUPS)
        counts[(counts > _MOST).any(1)] = _MOST  # of two such sets, the bound is passed over
        return counts.astype(np.int16)

    def of(self, k: int) -> np.ndarray:
        return self.hash[self.first[k] : self.first[k + 1]]


def bounds(most: int) -> np.ndarray:
    """Least sizes of the classes: sets of similar size lie in one class or in neighbours."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 5 // 4 + 1)
    return np.array([*out, out[-1] * 5 // 4 + 1])


def signatures(
    sets: _Sets, chosen: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, signature) of the parts of the chosen texts, in their class and the next.

    Third, for each text, the least number of them that any similar set shares with it.
    """
    edges = bounds(int(sets.size.max(initial=1)))
    own = np.searchsorted(edges, sets.size, "right") - 1
    member = chosen[sets.owner]
    owner, hashes = sets.owner[member], sets.hash[member]
    owners, found, need = [], [], np.full(sets.n, 0xFFFF)
    for step in (0, 1):
        level = own + step
        largest = np.append(edges, edges[-1] * 5 // 4 + 1)[level + 1] - 1
        apart = 2 * largest // 9  # n-grams in which a pair may differ
        more = 4 + apart // 8
        parts = np.where(chosen & (sets.size > 0), apart + more, 0)
        base = np.concatenate([[0], np.cumsum(parts)])
        part = (T.mix(hashes ^ T.U(0x51ED270B)) >> T.U(8)) % parts[owner].astype(T.U)
        cell = base[owner] + part.astype(np.int64)
        sums = np.zeros(base[-1], T.U)
        np.add.at(sums, cell, T.mix(hashes ^ T.U(0xA5A5)))
        filled = np.bincount(cell, minlength=base[-1]) > 0
        text = np.repeat(np.arange(sets.n), parts)
        empties = parts - np.bincount(text[filled], minlength=sets.n)
        need = np.minimum(need, np.maximum(1, more - empties))
        filled |= (empties >= more)[text]
        place = np.arange(base[-1]) - base[text]
        name = (level[text].astype(T.U) << T.U(32)) + place.astype(T.U)
        found.append(T.mix(sums + T.mix(name))[filled])
        owners.append(text[filled])
    return np.concatenate(owners), np.concatenate(found), need


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.md5(text.cast("binary"))).alias("td"),
        text.alias("text"),
    )


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, td (name of the text), n, d1 and d2 (name of the set) and point of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in T.runs(batch.column("text"), T.SMALL_RUN):
                sets = _Sets(data, offsets)
                some = batch.slice(row, sets.n)
                d1, d2 = sets.digests()
                points = pa.array(sets.points().ravel())
                starts = pa.array(np.arange(sets.n + 1, dtype=np.int32) * GROUPS)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("td"), pa.array(sets.size),
                     pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                     pa.ListArray.from_arrays(starts, points)],
                    names=["doc_id", "td", "n", "d1", "d2", "point"],
                )

    schema = "doc_id long, td binary, n long, d1 long, d2 long, point array<short>"
    return _texts(docs).mapInArrow(T.released(run), schema)


def _dealt(docs: DataFrame, bins: int) -> DataFrame:
    """For each run of texts and bin: sets (names and needs) and their signatures in the bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in T.runs(batch.column("text"), most=RUN_TEXTS):
                sets = _Sets(data, offsets)
                names, _ = sets.digests()
                chosen = np.zeros(sets.n, bool)
                chosen[np.unique(names, return_index=True)[1]] = True
                text, found, need = signatures(sets, chosen & (sets.size > 0))
                bin_ = (found % T.U(bins)).astype(np.int32)
                order = np.argsort(bin_, kind="stable")
                text, found, bin_ = text[order], found[order] >> T.U(16), bin_[order]
                cuts = np.flatnonzero(np.diff(bin_, prepend=-1, append=bins))
                rows: dict[str, list] = {
                    "bin": [], "sets": [], "needs": [], "member": [], "signs": []
                }
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    who, member = np.unique(text[a:b], return_inverse=True)
                    rows["bin"].append(int(bin_[a]))
                    rows["sets"].append(names[who].tobytes())
                    rows["needs"].append(need[who].astype(np.uint16).tobytes())
                    rows["member"].append(member.astype(np.uint16).tobytes())
                    signs = np.ascontiguousarray(found[a:b]).view(np.uint8).reshape(-1, 8)
                    rows["signs"].append(signs[:, :6].tobytes())
                types = [pa.int32(), *[pa.binary()] * 4]
                arrays = [pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=list(rows))

    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = "bin int, sets binary, needs binary, member binary, signs binary"
    return texts.mapInArrow(T.released(run), schema)


def _by_bin(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one bin after the other, from rows in the order of bins."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["bin"] != held[0]["bin"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _meetings(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature, set and need of each set of each signature of a bin, in this order."""
    keys, names, needs = [], [], []
    for row in rows:
        signs = np.frombuffer(row["signs"], np.uint8).reshape(-1, 6)
        wide = np.zeros((len(signs), 8), np.uint8)
        wide[:, :6] = signs
        keys.append(wide.view(T.U)[:, 0] | (T.U(row["bin"] & 0xFFFF) << T.U(48)))
        member = np.frombuffer(row["member"], np.uint16)
        names.append(np.frombuffer(row["sets"], T.U)[member])
        needs.append(np.frombuffer(row["needs"], np.uint16)[member])
    key, name, need = map(np.concatenate, (keys, names, needs))
    order = np.lexsort((name, key))
    key, name = key[order], name[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    return key[new], name[new], need[order[new]]


def _merged(crowds: list[tuple]) -> list[tuple]:
    """Crowds of one size (sets, times, needs), equal ones as one with the sum of its times."""
    sets, times, needs = map(np.concatenate, zip(*crowds, strict=True))
    order = np.lexsort(sets.T[::-1])
    sets = sets[order]
    first = np.flatnonzero(np.append(True, (sets[1:] != sets[:-1]).any(1)))
    return [(sets[first], np.add.reduceat(times[order], first), needs[order[first]])]


def _crowds(dealt: DataFrame, tasks: int, small: int) -> DataFrame:
    """Which sets meet how many `times`: pairs of small crowds, and members (b) of large ones.

    A task holds the signatures of one bin at a time, and the distinct small crowds of its bins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowds: dict[int, list[tuple]] = {}  # by size
        for rows in _by_bin(batches):
            key, name, need = _meetings(rows)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, len(key)))
            for k in np.unique(size[(size > 1) & (size <= small)]).tolist():
                at = first[size == k][:, None] + np.arange(k)
                mine = (name[at], np.ones(len(at), np.int64), need[at])
                crowds[k] = _merged([*crowds.get(k, []), mine])
            large = np.flatnonzero(np.repeat((size > 1) & (size > small), size))
            for a in range(0, len(large), 1 << 16):
                at = large[a : a + (1 << 16)]
                n = len(at)
                columns = [np.zeros(n, T.U), name[at], key[at], np.ones(n), np.zeros(n)]
                yield _met([[*columns, need[at]]])
        for k, [(sets, times, needs)] in crowds.items():
            i, j = np.triu_indices(k, 1)
            step = max(1, (1 << 16) // len(i))
            for a in range(0, len(sets), step):
                who, needed = sets[a : a + step], needs[a : a + step]
                often = np.repeat(times[a : a + step], len(i))
                fixed = [np.zeros(len(often), T.U), often]
                ends = [who[:, i].ravel(), who[:, j].ravel()]
                yield _met([[*ends, *fixed, needed[:, i].ravel(), needed[:, j].ravel()]])

    # As many bins in each task, in the order of bins.
    own = (F.col("bin") % tasks).cast("int")
    spread = dealt.repartitionById(tasks, own).sortWithinPartitions("bin")
    return spread.mapInArrow(
        T.released(run), "a long, b long, crowd long, times long, need_a long, need_b long"
    )


def _met(out: list[list]) -> pa.RecordBatch:
    names = ["a", "b", "crowd", "times", "need_a", "need_b"]
    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
    whole = [c.view(np.int64) if c.dtype == T.U else c.astype(np.int64) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in whole], names=names)


# -- bounds and the R-tree ------------------------------------------------------------------


def folded(points: np.ndarray) -> np.ndarray:
    """The counts of neighbouring groups, added up."""
    return points.reshape(len(points), COARSE, -1).sum(2, dtype=np.int32)


class RTree:
    """Points packed into leaves by size and then by their most varied coordinates.

    Branches are bounded on the sums of neighbouring groups, which bound the overlap too.
    """

    def __init__(self, fine: np.ndarray, sizes: np.ndarray):
        points = folded(fine)
        spread = np.argsort(-points.var(0), kind="stable")[:2]
        slab = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") // (LEAF * 64)
        tile = np.lexsort((points[:, spread[0]], slab))
        tile_of = np.empty(len(points), np.int64)
        tile_of[tile] = np.arange(len(points)) // (LEAF * 8)
        self.order = np.lexsort((points[:, spread[1]], tile_of))
        self.points, self.sizes = points[self.order], sizes[self.order]
        top, least = self.points, self.sizes
        self.levels = []  # upwards: largest coordinates and least size of each node
        while len(top) > 1:
            starts = np.arange(0, len(top), LEAF)
            top = np.maximum.reduceat(top, starts, axis=0)
            least = np.minimum.reduceat(least, starts)
            self.levels.append((top, least))

    def near(self, point: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the points whose set may be similar to one of `size` at `point`."""
        found = np.zeros(1, np.int64)
        for top, least in reversed([(self.points, self.sizes), *self.levels]):
            if len(top) > 1 or top is self.points:
                found = found[found < len(top)]
            bound = np.minimum(top[found], point).sum(1)
            found = found[may_be_similar(bound, size, least[found])]
            if top is not self.points:
                found = (found[:, None] * LEAF + np.arange(LEAF)).ravel()
        return self.order[found]


def _search(key: tuple, table: pa.Table) -> pa.Table:
    """Pairs of a crowd that lie in different components and may be similar."""
    share, shares = key[1].as_py(), table["shares"][0].as_py()
    ids, labels = (table[c].to_numpy() for c in ("id", "label"))
    sizes = table["n"].to_numpy()
    points = np.asarray(table["point"].combine_chunks().flatten()).reshape(-1, GROUPS)
    tree, coarse = RTree(points, sizes), folded(points)
    left, right = [], []
    for k in np.flatnonzero(ids % shares == share):
        near = tree.near(coarse[k], sizes[k])
        near = near[(labels[near] != labels[k]) & (ids[near] > ids[k])]
        bound = np.minimum(points[near], points[k]).sum(1, dtype=np.int64)
        near = near[may_be_similar(bound, sizes[k], sizes[near])]
        left.append(np.full(len(near), ids[k]))
        right.append(ids[near])
    none = [np.zeros(0, np.int64)]
    return pa.table({"a": np.concatenate(left or none), "b": np.concatenate(right or none)})


# -- the join -------------------------------------------------------------------------------


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids that are similar, from `texts` (id, text)."""
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    heads = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_TASK).alias("shares"))
    heads = stored(heads, "heads")
    share = F.pmod(F.xxhash64("b"), F.col("shares"))
    members = pairs.join(heads, "a").select("a", share.alias("share"), "b")
    first = heads.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    rows = members.unionByName(first.withColumn("b", F.lit(None).cast("long")))
    wanted = rows.withColumn("id", F.coalesce("b", "a")).join(texts, "id").drop("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, None
        for batch in batches:
            ids = list(zip(*(batch.column(c).to_pylist() for c in "ab"), strict=True))
            left, right = [], []
            for row, data, offsets in T.runs(batch.column("text"), T.SMALL_RUN):
                sets = _Sets(data, offsets)
                for k in range(sets.n):
                    a, b = ids[row + k]
                    if b is None:
                        head, held = a, sets.of(k)
                        continue
                    if a != head:
                        raise AssertionError("a pair came before its first set")
                    own = sets.of(k)
                    if similar(len(np.intersect1d(held, own, True)), len(held), len(own)):
                        left.append(a)
                        right.append(b)
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())}
            )

    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = wanted.repartition(tasks, "a", "share").sortWithinPartitions("a", "share", "b")
    found = spread.select("a", "b", "text").mapInArrow(T.released(run), "a long, b long")
    return stored(found, "links")


def _near(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs of set ids whose sizes (na, nb) and `points` (id, point) allow similarity.

    Only here do pairs meet points, which are many times as large: once for each pair of sets,
    however many crowds it lies in, and after the sizes are compared.
    """
    near = pairs.filter(similar(F.least("na", "nb"), F.col("na"), F.col("nb")))
    # The first end of a star is that of many pairs, so it is joined while rows are short.
    for end in ("a", "b"):
        own = points.select(F.col("id").alias(end), F.col("point").alias(f"p{end}"))
        near = near.join(own, end)
    least = F.aggregate(
        F.zip_with("pa", "pb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x.cast("int")
    )
    return near.filter(may_be_similar(least, F.col("na"), F.col("nb"))).select("a", "b")


def _sized(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of set ids with their sizes, for pairs of names."""
    left, right = (
        sets.select(
            F.col("d1").alias(end), F.col("id").alias(f"i{end}"), F.col("n").alias(f"n{end}")
        )
        for end in "ab"
    )
    both = pairs.join(left, "a").join(right, "b").filter("ia != ib")
    swap = F.col("ia") > F.col("ib")
    return both.select(
        F.least("ia", "ib").alias("a"),
        F.greatest("ia", "ib").alias("b"),
        F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"),
        F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"),
    )


def _often_enough(pairs: DataFrame, often: DataFrame) -> DataFrame:
    """Pairs (a, b) of small crowds that may meet as often as they need, large crowds included."""
    both = pairs.groupBy("a", "b").agg(
        F.sum("times").alias("times"), F.max(F.greatest("need_a", "need_b")).alias("need")
    )
    for end in ("a", "b"):
        more = often.select(F.col("b").alias(end), F.col("large").alias(f"large_{end}"))
        both = both.join(more, end, "left")
    more = F.least(F.coalesce("large_a", F.lit(0)), F.coalesce("large_b", F.lit(0)))
    return both.filter(F.col("times") + more >= F.col("need")).select("a", "b")


def _stars(members: DataFrame) -> DataFrame:
    """Pairs of members of large crowds with the most central of them, if frequent, and sizes.

    Central is what lies in most large crowds: the text that a crowd's others were copied from
    shares parts with all of them, while a copy's changed parts are its own. Only members of
    other components than the central one are paired. Which of these pairs are tried first
    does not change the result: what they leave apart is searched.
    """
    central = F.max(F.struct("large", (-F.col("id")).alias("minus"), "id", "n", "label"))
    first = members.groupBy("crowd").agg(central.alias("first"))
    pairs = members.join(first, "crowd").filter("label != first.label")
    pairs = pairs.groupBy(F.col("first.id").alias("a"), F.col("id").alias("b")).agg(
        F.count(F.lit(1)).alias("times"),
        F.min("need").alias("need"),
        F.first("n").alias("nb"),
        F.first("first.n").alias("na"),
    )
    return pairs.filter("times > 1 OR need <= 2").select("a", "b", "na", "nb")


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members of crowds that lie in several components, with the label of theirs."""
    labels = components(links).withColumnRenamed("node", "id")
    found = members.drop("label").join(labels, "id", "left")
    found = stored(found.withColumn("label", F.coalesce("label", "id")), "labelled")
    mixed = found.groupBy("crowd").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return found.join(mixed.filter("low != high").select("crowd"), "crowd", "left_semi")


def _others(members: DataFrame) -> DataFrame:
    """Members that are not in the component of their crowd's most central one."""
    central = F.max_by("label", F.struct("large", (-F.col("id")).alias("minus")))
    first = members.groupBy("crowd").agg(central.alias("of"))
    return members.join(first, "crowd").filter("label != of").drop("of")


def joined(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """doc_id, td (MD5 of the text), n_shingles, component_id for each row."""
    return classes(docs, small).drop("class")


def classes(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """The same with `class`, which names a component also where ids are null or equal.

    A row without words has none. Also stored on the way: the distinct sets and the verified
    pairs that link them.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(_sketched(docs), "rows")
    sets = (
        rows.filter("n > 0")
        .groupBy("d1", "d2", "n")
        .agg(F.min("doc_id").alias("least_doc"), F.min("td").alias("td"),
             F.first("point").alias("point"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    sets = stored(sets, "sets")
    met = stored(_crowds(_dealt(docs, 2 * tasks), tasks, small), "met")
    large = met.filter("crowd != 0").select("crowd", "b", F.col("need_b").alias("need"))
    often = large.groupBy("b").agg(F.count(F.lit(1)).alias("large"), F.min("need").alias("need"))
    often = stored(often, "often")
    stay = often.filter("large >= need").select("b", "large")
    members = large.join(stay, "b").join(sets.select(F.col("d1").alias("b"), "id", "n"), "b")
    columns = ["crowd", "id", "n", "need", "large", F.col("id").alias("label")]
    members = stored(members.select(*columns), "members")
    points = sets.select("id", "point")
    small_ones = _sized(_often_enough(met.filter("crowd = 0"), often), sets)
    direct = stored(_near(small_ones.unionByName(_stars(members)), points), "direct")
    ends = [direct.select(F.col(c).alias("id")) for c in ("a", "b")]
    wanted = ends[0].unionByName(ends[1]).unionByName(members.select("id"))
    named = stored(sets.join(wanted.distinct(), "id", "left_semi").select("id", "td"), "wanted")
    # Most texts are in no pair; a filter of their names drops nearly all before the shuffle.
    asked = presence.probably_in(_texts(docs).select("td", "text"), "td", named, "td")
    texts = asked.groupBy("td").agg(F.first("text").alias("text")).join(named, "td")
    texts = texts.select("id", "text")
    texts = stored(texts, "candidates")

    links = _verified(direct, texts)
    members = _labelled(members, links)
    rest = members
    for _ in range(STARS):  # what the first star of a crowd has left, around its own centre
        rest = _others(rest)
        links = links.unionByName(_verified(_near(_stars(rest), points), texts))
    members = _labelled(members, links).select("crowd", "id", "label", "n")
    members = stored(members, "apart")
    shares = F.ceil(F.count(F.lit(1)) / QUERIES_PER_TASK).alias("shares")
    mixed = stored(members.groupBy("crowd").agg(shares), "mixed")
    shared = members.join(mixed, "crowd").join(points, "id").withColumn(
        "share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    )
    shared = shared.repartition(tasks, "crowd", "share")
    apart = shared.groupBy("crowd", "share").applyInArrow(_search, "a long, b long")
    links = links.unionByName(_verified(apart, texts))
    labels = stored(components(links), "labels")

    named = sets.select("d1", "d2", "n", "least_doc", "id").join(
        labels.withColumnRenamed("node", "id"), "id", "left"
    )
    named = stored(named.withColumn("label", F.coalesce("label", "id")), "named")
    least = named.groupBy("label").agg(F.min("least_doc").alias("component"))
    named = named.join(least, "label").select("d1", "d2", "n", "component", "label")
    named = stored(named, "components")
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return rows.join(named, ["d1", "d2", "n"], "left").select(
        "doc_id", "td", F.col("n").alias("n_shingles"), own.alias("component_id"),
        F.col("label").alias("class"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns: that with the smallest id, null being last.

    Of rows with that id the one with the smallest MD5 of its text stays, and of equal rows
    one. Rows without words are linked with nothing, so all of them stay.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        F.unhex(F.md5(text.cast("binary"))).alias("td"),
        text.rlike(r"[^\x20\x09-\x0D]").alias("worded"),
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "td")
    kept = classes(docs).filter(F.col("class").isNotNull()).groupBy("class")
    kept = kept.agg(F.min(order).alias("first")).select("first.doc_id", "first.td")
    kept = kept.withColumnsRenamed({"doc_id": "kept_id", "td": "kept_td"})
    same = keyed["id"].eqNullSafe(kept["kept_id"]) & (keyed["td"] == kept["kept_td"])
    first = keyed.filter("worded").join(kept, same, "left_semi").dropDuplicates(["id", "td"])
    return first.unionByName(keyed.filter("NOT worded")).select("row.*")
