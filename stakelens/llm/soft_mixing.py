"""Mixing to target weights with soft membership, with DataFrame operations only.

A naive Bayes classifier, fitted on a bounded number of labelled documents, gives every
document a probability for each domain (good, poor, toxic). Its features are words that
are most typical of one domain, and the binned shares of symbols, capitals and repeated
words. Each document gets a rate >= 0, the copies of it to train on, so that the expected
tokens of the domains match the targets: least squares in the errors of the domain
totals relative to what there is, solved by projected gradient descent from rate 1 in the metric of the token counts.
A step needs only the residuals of the domains, so that a document's rate is a fold over the
few numbers of the steps so far; each iteration is one aggregation over the probabilities.

The targets are shares of the tokens that are to be used. That total is chosen so that the
first domain is used once (`budget` = 1).

Defined results: a null or empty text has no tokens and the prior probabilities. Null ids
are kept. Repeated rows get equal rates. Labels without an id, or null labels, are not used;
of several labels for an id the highest count. An empty table gives no rows; with no labels
the domains are equally likely. Extra columns are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakelens.llm.scratch import stored

DOMAINS = ("good", "poor", "toxic")
TARGETS = (0.97, 0.02, 0.01)
LABELLED = 4000
VOCABULARY = 256
LEAST_DOCS = 10
LEAST_LOG_RATIO = 3.0
MAX_RATE = 1.0
ITERATIONS = 30
TOLERANCE = 1e-3
SPACES = r"[\x20\x09-\x0D]+"


class Model(NamedTuple):
    """Log-probabilities: of the domains, and of each feature in each domain."""

    prior: tuple[float, ...]
    features: dict[str, tuple[float, ...]]
    words: list[str]


def _words() -> Column:
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _bins(words: Column) -> list[Column]:
    """Binned shares of symbols, capitals and repeated words, as feature names."""
    text = F.coalesce(F.col("text"), F.lit(""))
    length = F.greatest(F.length(text), F.lit(1))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>!", ""))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    repeated = F.size(words) - F.size(F.array_distinct(words))
    shares = {
        "symbols": symbols / length,
        "capitals": capitals / length,
        "repeated": repeated / F.greatest(F.size(words), F.lit(1)),
    }
    return [
        F.concat(F.lit(f" {name} "), F.least(F.floor(share * 10), F.lit(9)).cast("string"))
        for name, share in shares.items()
    ]


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    """The classifier, from at most `labelled` labelled documents, by the hash of their ids."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    known = labels.select(F.col("doc_id").alias("id"), domain.alias("domain")).dropna()
    known = known.groupBy("id").agg(F.max("domain").alias("domain"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(labelled)
    texts = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("id"))
    words = texts.select("domain", _words().alias("words"), "text")
    held = words.select("domain", F.array_distinct("words").alias("w"), F.array(*_bins(F.col("words"))).alias("bins"))
    held = stored(held, "labelled")
    sums = [F.sum((F.col("domain") == k).cast("long")).alias(f"n{k}") for k in range(len(DOMAINS))]
    totals = [n or 0 for n in held.agg(*sums).first()]
    every = sum(totals)
    counts = [F.col(f"n{k}") for k in range(len(DOMAINS))]

    def ratio(k: int) -> Column:
        rest = sum(c for j, c in enumerate(counts) if j != k)
        return F.log((counts[k] + 0.5) / (totals[k] + 1)) - F.log(
            (rest + 0.5) / (every - totals[k] + 1)
        )

    score = F.greatest(*[ratio(k) for k in range(len(DOMAINS))])
    found = sum(counts[1:], counts[0])
    by_word = held.select("domain", F.explode("w").alias("f")).groupBy("f").agg(*sums)
    best = by_word.filter(found >= LEAST_DOCS).filter(score >= LEAST_LOG_RATIO)
    best = best.orderBy((score * F.sqrt(found)).desc(), "f").limit(VOCABULARY)
    rows_of_words = best.collect()
    vocabulary = _strings([r["f"] for r in rows_of_words])
    bins = F.concat("bins", F.array(_met(F.array_intersect("w", vocabulary))))
    by_bin = held.select("domain", F.explode(bins).alias("f")).groupBy("f").agg(*sums)
    features, words_ = {}, []
    for rows, is_word in ((rows_of_words, True), (by_bin.collect(), False)):
        for name, *n in rows:
            smooth = zip(n, totals, strict=True)
            features[name] = tuple(math.log((a + 0.5) / (b + 1.0)) for a, b in smooth)
            words_ += [name] * is_word
    prior = tuple(math.log((t + 1) / (every + len(DOMAINS))) for t in totals)
    return Model(prior, features, words_)


def _met(hits: Column) -> Column:
    """A feature that says whether a text has any word of the vocabulary."""
    return F.when(F.size(hits) > 0, " some words").otherwise(" no words")


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def memberships(docs: DataFrame, model: Model, keep: list[Column]) -> DataFrame:
    """The columns `keep`, `tokens`, and `p0`, `p1`, ... : a probability for each domain."""
    words = F.col("mixing words")
    base = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(keep)], "text", _words().alias("mixing words"))
    hits = F.array_intersect(words, _strings(model.words))
    table = base.select(
        *[f"k{i}" for i in range(len(keep))],
        F.size(words).cast("long").alias("tokens"),
        F.concat(hits, F.array(*_bins(words), _met(hits))).alias("features"),
    )
    names = _strings(list(model.features))
    logs = []
    for k, prior in enumerate(model.prior):
        values = F.array(*[F.lit(v[k]) for v in model.features.values()]).cast("array<double>")
        add = _adder(F.map_from_arrays(names, values))
        logs.append(F.aggregate("features", F.lit(prior), add))
    scored = table.withColumns({f"l{k}": log for k, log in enumerate(logs)})
    top = F.greatest(*[F.col(f"l{k}") for k in range(len(logs))])
    raised = [F.exp(F.col(f"l{k}") - top) for k in range(len(logs))]
    total = sum(raised[1:], raised[0])
    return scored.select(
        *[f"k{i}" for i in range(len(keep))],
        "tokens",
        *[(r / total).alias(f"p{k}") for k, r in enumerate(raised)],
    )


def _adder(weight: Column):
    """Adds the weight of a feature, none for those that the model has not."""
    return lambda total, name: total + F.coalesce(F.try_element_at(weight, name), F.lit(0.0))


def rate_of(steps: list[tuple[float, ...]], max_rate: float | None) -> Column:
    """A document's rate after these gradient steps, projected after each of them."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*[F.array(*[F.lit(e) for e in step]) for step in steps])

    def move(rate: Column, step: Column) -> Column:
        for k in range(len(steps[0])):
            rate = rate - F.col(f"p{k}") * step[k]
        rate = F.greatest(rate, F.lit(0.0))
        return rate if max_rate is None else F.least(rate, F.lit(max_rate))

    return F.aggregate(moves, F.lit(1.0), move)


def solve(
    table: DataFrame,
    targets: tuple[float, ...] = TARGETS,
    budget: float = 1.0,
    max_rate: float | None = MAX_RATE,
    iterations: int = ITERATIONS,
) -> list[tuple[float, ...]]:
    """The gradient steps that fit the rates of `table` (tokens, p0, p1, ...) to the targets."""
    k = range(len(targets))
    p = [F.col(f"p{i}") for i in k]
    tokens = F.col("tokens").cast("double")
    moments = [F.sum(tokens * p[i] * p[j]) for i in k for j in k]
    row = table.agg(*[F.sum(tokens * x) for x in p], *moments).first()
    held = list(row[: len(targets)])
    if not held[0] or not sum(held):
        return []
    goal = [budget * held[0] * t / targets[0] for t in targets]
    weight = [1 / max(h, 1.0) for h in held]
    gram = [[row[len(targets) * (1 + i) + j] for j in k] for i in k]
    step = 1 / _largest([[weight[i] ** 0.5 * gram[i][j] * weight[j] ** 0.5 for j in k] for i in k])
    steps: list[tuple[float, ...]] = []
    last = None
    for _ in range(iterations):
        rate = rate_of(steps, max_rate)
        found = table.agg(*[F.sum(tokens * rate * x) for x in p]).first()
        errors = [(f - g) * w for f, g, w in zip(found, goal, weight, strict=True)]
        if last is not None and max(abs(a - b) for a, b in zip(errors, last, strict=True)) < TOLERANCE:
            break
        steps.append(tuple(step * e for e in errors))
        last = errors
    return steps


def _largest(matrix: list[list[float]]) -> float:
    """The largest eigenvalue of a small symmetric matrix without negative entries."""
    x, value = [1.0] * len(matrix), 1.0
    for _ in range(200):
        y = [sum(a * b for a, b in zip(row, x, strict=True)) for row in matrix]
        value = max(y) or 1.0
        x = [v / value for v in y]
    return value


def rates(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, n_tokens, a probability for each domain, and the rate of each row."""
    table = memberships(docs, fit(docs, labels), [F.col("doc_id").cast("long")])
    table = stored(table, "memberships")
    rate = rate_of(solve(table, **options), options.get("max_rate", MAX_RATE))
    names = [F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    return table.select(F.col("k0").alias("doc_id"), F.col("tokens").alias("n_tokens"), *names, rate.alias("rate"))


def mixed(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` as often as their rates say, the fraction decided by the id's hash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # Stored with its rows: else each step of the fold would work out the features again.
    table = stored(memberships(docs, fit(docs, labels), [row]), "memberships")
    steps = solve(table, **options)
    share = F.pmod(F.xxhash64(F.col("k0.doc_id"), F.lit(5)), F.lit(1 << 20)) / (1 << 20)
    times = F.floor(rate_of(steps, options.get("max_rate", MAX_RATE)) + share).cast("int")
    chosen = table.select("k0", times.alias("times")).filter("times > 0")
    repeated = chosen.select("k0", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"))
    return repeated.select("k0.*")
