"""Soft-membership mixing of documents to target weights, in DataFrame functions alone."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize
from quern.llm.quality import let, split_words

#: Domains by the label table, and the shares of tokens that they are to have.
DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}
#: Labelled rows that the classifier is fitted on (those with the least hashes of doc_id), hashed words, and words kept.
TRAIN_ROWS, BUCKETS, FEATURES = 20_000, 1 << 15, 2048
#: The chi-square of a word kept: chance gives it to one word in a thousand.
MIN_GAIN = 10.83
#: Words of the common mixture that each domain is given besides its own.
PRIOR_WORDS = 200
#: The log prior of a domain without labelled rows.
NEVER = -1e6
#: Steps of the rate fit, and the error in token shares that ends it.
STEPS, TOLERANCE = 30, 1e-3
#: What separates words for the classifier.
EDGES = "[ \\t\\n\\x0b\\f\\r.,;:!?\"'()\\[\\]]+"


def domain_of(quality: Column, toxic: Column) -> Column:
    """The domain's number of a label row; null where both labels are null."""
    number = F.when(toxic == 1, 2).when(quality == 0, 1).when(quality.isNotNull() | toxic.isNotNull(), 0)
    return number.cast("int")


def _buckets(text: Column) -> Column:
    """The hashed words of a text. A text that begins or ends with a separator has the empty word too."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), EDGES)
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _constant(values: np.ndarray, kind: str) -> Column:
    """An array that the optimizer folds to one literal."""
    return F.split(F.lit(",".join(map(repr, values.tolist()))), ",").cast(f"array<{kind}>")


class Classifier:
    """Naive Bayes over the distinct hashed words of a text, at most FEATURES of them. A word's chance is its share of all
    words of a domain, so a text's length says nothing. Sizes are parameters, so weights are constants of a plan."""

    def __init__(self, priors: np.ndarray, rows: np.ndarray, weights: np.ndarray, others: np.ndarray):
        self.priors, self.rows, self.weights = priors, rows, weights  # rows: by bucket, 1 + the weight row or 0
        self.others = others  # what each distinct word that is not kept says for a domain

    def posterior(self, text: Column) -> Column:
        """The domains' probabilities as an array."""
        rows = _constant(self.rows, "int")

        def chances(buckets: Column) -> Column:
            def score(k: int, found: Column) -> Column:
                column = _constant(self.weights[:, k], "double")
                start = F.lit(float(self.priors[k])) + (F.size(buckets) - F.size(found)) * F.lit(float(self.others[k]))
                return F.aggregate(found, start, lambda a, r: a + F.get(column, r - 1))

            def scores(found: Column) -> Column:
                return F.array(*(score(k, found) for k in range(len(self.priors))))

            def softmax(values: Column) -> Column:
                top = F.array_max(values)
                return let(F.transform(values, lambda s: F.exp(s - top)), lambda e: _scaled(e))

            return let(let(F.filter(F.transform(buckets, lambda b: F.get(rows, b)), lambda r: r > 0), scores), softmax)

        return let(F.array_distinct(_buckets(text)), chances)


def _scaled(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return let(total, lambda t: F.transform(values, lambda x: x / t))


def fit_classifier(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Classifier:
    """Fits on at most train_rows labelled rows. Words are counted in Spark; BUCKETS x domains counts come to the driver.

    A domain without labelled rows has probability 0; with none at all every domain is as likely as any other.
    """
    n = len(DOMAINS)
    labelled = labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")).filter("domain is not null")
    labelled = labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(train_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(labelled), "doc_id")
    counted = texts.select("domain", F.explode(F.concat(F.array(F.lit(-1)), F.array_distinct(_buckets(F.col("text"))))).alias("bucket"))
    table = np.zeros((BUCKETS + 1, n))
    for row in counted.groupBy("bucket", "domain").count().collect():
        table[row["bucket"], row["domain"]] = row["count"]
    sizes, table = table[-1], table[:-1]
    total, mass = sizes.sum(), table.sum(axis=0)
    if not total or not mass.sum():
        return Classifier(np.full(n, -math.log(n)), np.zeros(BUCKETS, np.int64), np.zeros((1, n)), np.zeros(n))
    share = table.sum(axis=1) / mass.sum()
    expected = share[:, None] * mass[None, :]
    gain = ((table - expected) ** 2 / np.maximum(expected, 0.5)).sum(axis=1)
    picked = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
    picked = picked[gain[picked] > MIN_GAIN]
    chance = (table[picked] + PRIOR_WORDS * share[picked][:, None]) / (mass + PRIOR_WORDS)
    weights = np.log(chance) - np.log(share[picked])[:, None]
    others = np.log1p(-chance.sum(axis=0)) - np.log1p(-share[picked].sum())
    weights[:, sizes == 0] = others[sizes == 0] = 0
    rows = np.zeros(BUCKETS, np.int64)
    rows[picked] = np.arange(1, len(picked) + 1)
    priors = np.where(sizes > 0, np.log((sizes + 0.5) / (total + 0.5 * n)), NEVER)
    return Classifier(priors, rows, weights if len(picked) else np.zeros((1, n)), others)


def _rate(steps: list[list[float]]) -> Column:
    """A document's rate after these steps, from 1 on, each projected to at least 0."""
    if not steps:
        return F.lit(1.0)
    dot = lambda step: F.aggregate(F.zip_with("posterior", step, lambda p, s: p * s), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(F.lit(steps), F.lit(1.0), lambda r, step: F.greatest(F.lit(0.0), r - dot(step)))


def fit_rates(scored: DataFrame, targets: dict[str, float], kept: tuple[str, ...] = ()) -> Column:
    """The rate column for scored (posterior, n_tokens): nonnegative rates whose expected domain tokens meet the targets.
    Warns if some target is out of reach, as of a domain without documents."""
    return _fitted_rates(scored, targets, kept)[0]


def _fitted_rates(scored: DataFrame, targets: dict[str, float], kept: tuple[str, ...]) -> tuple[Column, bool]:
    """The rate column, and whether all domains are within ten times TOLERANCE of their goals.

    Least squares over token shares by projected gradient from rate 1. All documents move along their posterior, so a
    step is one vector of as many numbers as domains, and a rate is a fold over the steps: nothing but those vectors is
    kept, and each step is one aggregate over all documents. Steps are scaled by the documents still above 0, and halved
    where they do not lessen the error. The budget is all tokens. With `kept`, those domains are to keep the tokens that
    they have, and the others' targets are in proportion to them.
    """
    n = len(DOMAINS)

    def totals(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        rated = scored.select("posterior", "n_tokens", _rate(steps).alias("rate"))
        part = lambda k: F.get("posterior", F.lit(k))
        sums = [F.sum(F.col("n_tokens") * F.col("rate") * part(k)) for k in range(n)]
        live = F.when(F.col("rate") > 0, F.col("n_tokens")).otherwise(0)
        grams = [F.sum(live * part(i) * part(j)) for i in range(n) for j in range(n)]
        row = [float(x or 0) for x in rated.agg(*(c.alias(f"c{i}") for i, c in enumerate(sums + grams))).first()]
        return np.array(row[:n]), np.array(row[n:]).reshape(n, n)

    have, gram = totals([])
    share, stays = np.array([targets[d] for d in DOMAINS]), np.array([d in kept for d in DOMAINS])
    budget = have.sum()
    if not budget or (stays.any() and not have[stays].sum()):
        return F.lit(1.0), False
    goal = share / share.sum() * budget
    if stays.any():
        goal = np.where(stays, have, share / share[stays].sum() * have[stays].sum())
    steps, scale = [], 1.0
    error = float((((have - goal) / budget) ** 2).sum())
    for _ in range(STEPS):
        if error < TOLERANCE**2 or scale < 1e-3:
            break
        ridge = 1e-9 * max(np.trace(gram), 1.0) * np.eye(n)
        step = scale * np.linalg.solve(gram + ridge, have - goal)
        after, after_gram = totals([*steps, step.tolist()])
        after_error = float((((after - goal) / budget) ** 2).sum())
        if after_error < error * (1 - 1e-6):
            have, gram, error, scale = after, after_gram, after_error, min(1.0, 2 * scale)
            steps.append(step.tolist())
        else:
            scale /= 2
    unmet = [f"{d}: {h / budget:.4f} for {g / budget:.4f}" for d, h, g in zip(DOMAINS, have, goal, strict=True) if abs(h - g) > 10 * TOLERANCE * budget]
    if unmet:
        warnings.warn(f"shares of tokens that are not met: {', '.join(unmet)}", stacklevel=3)
    return _rate(steps), not unmet


def mix(
    docs: DataFrame,
    labelled_docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] = TARGETS,
    kept: tuple[str, ...] = (),
    nearest: bool = False,
    tokens: str | None = None,
) -> DataFrame:
    """doc_id, n_tokens, p_clean, p_low, p_toxic, domain (the likeliest), rate, copies and targets_met of each row.

    n_tokens is the column of docs that `tokens` names, as an operator of token counts gives it, or the number of words.
    copies is the rate rounded: to the nearest number, or up or down by a hash of doc_id and text so that its mean is the
    rate. targets_met is false on all rows if some target is out of reach. Null texts have no words and the priors; null
    doc_ids are rows like others; repeated rows get the same copies; an empty table gives no rows; other columns are not
    read. No Python runs on the executors, and the scored rows, numbers alone, are written to shared storage.
    """
    classifier = fit_classifier(labelled_docs, labels)
    scored = materialize(_scored(docs, classifier, tokens, F.col("doc_id")), "scored")
    rate, met = _fitted_rates(scored, targets, kept)
    rated = scored.withColumn("rate", rate)
    top = F.array_position("posterior", F.array_max("posterior")).cast("int")
    return rated.select(
        "doc_id",
        "n_tokens",
        *(F.get("posterior", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(DOMAINS)),
        F.element_at(F.array(*map(F.lit, DOMAINS)), top).alias("domain"),
        "rate",
        _copies(nearest).alias("copies"),
        F.lit(met).alias("targets_met"),
    )


def _scored(docs: DataFrame, classifier: Classifier, tokens: str | None, *columns: Column) -> DataFrame:
    """The columns with n_tokens, posterior and draw, a number from 0 to 1 by a hash of doc_id and text."""
    count = F.col(tokens) if tokens else F.size(split_words(F.coalesce(F.col("text"), F.lit(""))))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit("mix")), 11) * F.lit(2.0**-53)
    return docs.select(*columns, count.cast("long").alias("n_tokens"), classifier.posterior(F.col("text")).alias("posterior"), draw.alias("draw"))


def _copies(nearest: bool) -> Column:
    return F.floor(F.col("rate") + (F.lit(0.5) if nearest else F.col("draw"))).cast("int")


def apply_mix(
    docs: DataFrame,
    labelled_docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float],
    kept: tuple[str, ...] = (),
    nearest: bool = True,
    tokens: str | None = None,
) -> DataFrame:
    """docs with all their columns, each row as many times as its copies say.

    Null texts have the priors' rate, null doc_ids are rows like others, repeated rows get the same copies, and an empty
    table gives an empty table. Texts are scored once: the rows are written to shared storage with their scores.
    """
    classifier = fit_classifier(labelled_docs, labels)
    scored = materialize(_scored(docs, classifier, tokens, F.struct("*").alias("_row")), "scored")
    counted = scored.withColumn("rate", _fitted_rates(scored, targets, kept)[0]).withColumn("_n", _copies(nearest)).filter("_n > 0")
    copied = counted.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
    return copied.select("_row.*")
