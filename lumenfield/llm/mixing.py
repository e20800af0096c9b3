"""Mixing to target weights with soft domain membership.

1. A classifier learns the domains of the ``labels`` table, toxic (toxic = 1), low (quality = 0) and good (all other), from a sample of at most ``SAMPLE`` labelled
   documents (lowest MD5 of id): softmax regression over hashed words and a few shape features of the whole text. It gives every document posteriors over the domains.
2. Every document gets a rate x >= 0, how often to take it, such that the expected tokens of each domain, the sum of rate x tokens x posterior,
   match the targets: least squares, with a weak pull towards rate 1, by accelerated projected gradient. A document's gradient needs only its own
   posteriors and the domains' residuals, so an iteration is one pass that returns one sum per domain. Rates follow from the residuals so far; no per-document state is kept
   between passes, and a lost task is simply computed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.llm import words
from lumenfield.llm.tables import TEXT_BYTES, Workspace, giving_back, picked, unit_draw, with_schema, with_texts

DOMAINS = ("good", "low", "toxic")
BUCKETS, DENSE = 1 << 18, 7
SAMPLE, EPOCHS, SIGNIFICANT = 6000, 60, 40.0
PULL, STEPS, TOLERANCE = 0.002, 40, 1e-5
POSTERIORS = "doc_id long, n_tokens long, p array<double>"
RATES = "doc_id long, n_tokens long, p_good double, p_low double, p_toxic double, rate double"


def shape_features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each text: sorted distinct word buckets, dense features, number of words."""
    hashes, at = words.word_hashes(data, offsets)
    n = np.diff(at)
    total = np.maximum(np.diff(offsets), 1)
    count = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
    upper = count((data >= 65) & (data < 91))
    lower = count((data >= 97) & (data < 123))
    mark = count((data > 32) & (data < 127) & ~((data >= 48) & (data < 58)) & ~((data >= 65) & (data < 91)) & ~((data >= 97) & (data < 123)))
    digit = count((data >= 48) & (data < 58))
    buckets, distinct, repeats = [], np.zeros(len(n)), np.zeros(len(n))
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        w = hashes[a:b]
        distinct[i] = len(np.unique(w))
        repeats[i] = (w[1:] == w[:-1]).sum()
        buckets.append(np.unique((w >> np.uint64(46)).astype(np.int64)))
    words_ = np.maximum(n, 1)
    dense = np.stack([np.log1p(n) / 5, distinct / words_, repeats / words_, upper / np.maximum(upper + lower, 1), 5 * mark / total, 5 * digit / total, total / words_ / 10], axis=1)
    return buckets, dense, n


def _softmax(owner: np.ndarray, flat: np.ndarray, dense: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Posteriors from the word buckets ``flat`` of documents ``owner``. weights: (BUCKETS + DENSE + 1, domains)."""
    z = dense @ weights[BUCKETS:-1] + weights[-1]
    for d in range(weights.shape[1]):
        z[:, d] += np.bincount(owner, weights[flat, d], minlength=len(dense))
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _posterior(buckets: list[np.ndarray], dense: np.ndarray, weights: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(buckets)), [len(b) for b in buckets])
    return _softmax(owner, np.concatenate(buckets) if buckets else np.zeros(0, np.int64), dense, weights)


def fit_classifier(texts: list[str], domains: np.ndarray) -> np.ndarray:
    """Weights of the softmax regression; without examples all 0 (equal posteriors)."""
    weights = np.zeros((BUCKETS + DENSE + 1, len(DOMAINS)))
    if not len(texts):
        return weights
    data, offsets = words.text_bytes(pa.array(texts, pa.string()))
    buckets, dense = [], []
    for a, b in words.slices(offsets):
        x, y, _ = shape_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        buckets += x
        dense.append(y)
    dense = np.concatenate(dense)
    sizes = np.array([len(b) for b in buckets])
    flat, owner = np.concatenate(buckets), np.repeat(np.arange(len(buckets)), sizes)
    # only words whose documents are spread over the domains unlike all documents (chi-square), the more so the rarer a domain
    share = np.bincount(domains, minlength=len(DOMAINS)) / len(texts)
    seen = np.stack([np.bincount(flat, (domains == d)[owner], minlength=BUCKETS) for d in range(len(DOMAINS))], axis=1)
    wanted = seen.sum(1, keepdims=True) * share
    telling = ((seen - wanted) ** 2 / np.maximum(wanted, 1e-9)).sum(1) >= SIGNIFICANT
    use = telling[flat]
    flat, owner = flat[use], owner[use]
    truth = np.eye(len(DOMAINS))[domains]
    moment, square = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, EPOCHS + 1):
        miss = (_softmax(owner, flat, dense, weights) - truth) / len(texts)
        grad = 2e-6 * weights
        for d in range(len(DOMAINS)):
            grad[:BUCKETS, d] += np.bincount(flat, miss[owner, d], minlength=BUCKETS)
        grad[BUCKETS:-1] += dense.T @ miss
        grad[-1] += miss.sum(0)
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        weights -= 0.15 * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return weights


def domain_of(quality, toxic):
    return F.when(toxic == 1, 2).when(quality == 0, 1).otherwise(0)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Classifier from the labelled documents of the sample. Labels with a null id, quality or toxic are not used."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    sample = known.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")).orderBy(F.md5(F.col("doc_id").cast("string")), "domain").limit(SAMPLE)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # at most SAMPLE rows of two numbers
    rows = texts.join(F.broadcast(sample), "doc_id").orderBy("doc_id", "text").limit(SAMPLE).collect()
    return fit_classifier([r.text for r in rows], np.array([r.domain for r in rows], np.int64))


def posteriors(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", *, plan: Plan | None = None, carry: bool = False) -> DataFrame:
    """doc_id, n_tokens, p (array, one per domain) of every row; carry: and the row; plan: p_good, p_low, p_toxic and the plan's rate in place of p, by the same
    Python worker. Texts without words keep the posteriors of an empty text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in with_texts(batches, text_col) if carry else batches:
            data, offsets = words.text_bytes(batch.column(1))
            for a, b in words.slices(offsets):
                buckets, dense, n = shape_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                # rounded so that equal texts are equal whatever stands beside them
                p = np.round(_posterior(buckets, dense, weights), 9)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(DOMAINS)), pa.array(p.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), lists, *(c.slice(a, b - a) for c in batch.columns[2:])], names=["doc_id", "n_tokens", "p", *(["row"] if carry else [])])

    run, columns = (each, POSTERIORS) if plan is None else (lambda batches: _rated(each(batches), plan), RATES)
    return picked(docs, id_col, text_col, carry=carry, once=True).mapInArrow(giving_back(run), with_schema(docs, columns, carry=carry))


class Plan:
    """Residuals of all steps so far; gives the rates of any documents."""

    def __init__(self, step: float, pull: float, max_rate: float):
        self.step, self.pull, self.max_rate = step, pull, max_rate
        self.residuals: list[np.ndarray] = []
        self.momenta: list[float] = []

    def rates(self, p: np.ndarray) -> np.ndarray:
        x = last = np.minimum(np.ones(len(p)), self.max_rate)
        for r, m in zip(self.residuals, self.momenta, strict=True):
            z = x + m * (x - last)
            last, x = x, np.clip(z - self.step * (p @ r + self.pull * (z - 1)), 0, self.max_rate)
        return x


def _p(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _rated(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Posteriors as a column each, and the rate, of batches (doc_id, n_tokens, p, …)."""
    for b in batches:
        p = _p(b.column(2))
        cells = [b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(p[:, d])) for d in range(len(DOMAINS))), pa.array(np.round(plan.rates(p), 9))]
        yield pa.RecordBatch.from_arrays([*cells, *b.columns[3:]], names=["doc_id", "n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", *b.schema.names[3:]])


def fit_rates(table: DataFrame, weights: dict[str, float], budget: float | None = None, max_rate: float = np.inf) -> tuple[Plan, dict[str, float]]:
    """Plan whose rates bring the domains' expected tokens to ``weights`` of ``budget`` tokens, and the expected tokens it reaches.

    budget None: as many tokens as take the domain with the largest target once; a scarcer one is repeated as far as ``max_rate`` allows. An empty table, or one without tokens, leaves all rates at 1.
    """
    goal = np.array([weights.get(d, 0.0) for d in DOMAINS])
    goal = goal / max(goal.sum(), 1e-300)

    def sums(plan: Plan) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(DOMAINS))
            for b in batches:
                p = _p(b.column(1))
                total += (plan.rates(p) * b.column(0).to_numpy()) @ p
            yield pa.RecordBatch.from_arrays([pa.array([d]) for d in total], names=[*DOMAINS])

        made = table.select("n_tokens", "p").mapInArrow(run, ", ".join(f"{d} double" for d in DOMAINS))
        row = made.agg(*[F.coalesce(F.sum(d), F.lit(0.0)) for d in DOMAINS]).first()
        return np.array(row, dtype=float)

    start = sums(Plan(0, 0, np.inf))
    total = start.sum()
    plan = Plan(1 / (1 + PULL), PULL, max_rate)
    if total <= 0:
        return plan, dict(zip(DOMAINS, start.tolist(), strict=True))
    if budget is None:
        main = int(goal.argmax())
        budget = start[main] / goal[main] if goal[main] > 0 else total
    target = goal * budget / total
    last = now = sums(plan) / total
    for k in range(STEPS):
        m = k / (k + 3)
        z = now + m * (now - last)
        # digits beyond the twelfth depend on the order of summation
        plan.residuals.append(np.round(z - target, 12))
        plan.momenta.append(m)
        last, now = now, sums(plan) / total
        if np.abs(now - last).max() < TOLERANCE:
            break
    return plan, dict(zip(DOMAINS, (now * total).tolist(), strict=True))


def mix(
    docs: DataFrame, labels: DataFrame, weights: dict[str, float], budget: float | None = None, max_rate: float = np.inf, id_col: str = "doc_id", text_col: str = "text", *, carry: bool = False
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, p_good, p_low, p_toxic, rate, copies (rate rounded up or down by a draw that the id decides). carry: and the input row as ``row``.

    Null and empty texts have no tokens and the posteriors of an empty text; they get a rate like all others. Equal texts have equal rates, repeated rows come
    back as often as given, rows with a null id share one draw. An empty ``docs`` gives an empty result; without labels all posteriors are equal. Other columns are not looked at.
    """
    model = learn(docs, labels, id_col, text_col)
    table = Workspace(docs.sparkSession, TEXT_BYTES).save(posteriors(docs, model, id_col, text_col), "posteriors")
    plan, _ = fit_rates(table, weights, budget, max_rate)
    rated = posteriors(docs, model, id_col, text_col, plan=plan, carry=True) if carry else table.mapInArrow(lambda batches: _rated(batches, plan), RATES)
    return rated.withColumn("copies", F.floor(F.col("rate") + unit_draw(F.lit("mix"), F.col("doc_id"))).cast("int"))
