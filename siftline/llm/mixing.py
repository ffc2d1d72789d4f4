"""Mixing documents to target weights with soft domain membership.

A classifier, fitted on a bounded sample of labelled rows, gives each document the posterior of
every domain. A document has a rate r >= 0, and domain k the expected tokens sum(r * tokens *
p_k). Least squares of these against the targets is solved by projected gradient: a step of
the rates is the residual (one number per domain) times the posteriors, scaled by the inverse
of sum(tokens * p p') over the rates that aren't held at 0, and cut off below at 0; that step,
shorter ones and plain gradient steps of several lengths are tried in the same pass, and the one with the
least residual is taken. As all that a step has to know are as
many numbers as there are domains, rates are never stored: tasks replay the steps on their
own rows, and a round is one aggregate of a few numbers per task.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, thrifty

#: Labelled rows that the classifier is fitted on, at most; rounds; residual as a share of all tokens.
SAMPLE, ROUNDS, CLOSE = 20_000, 40, 1e-6
#: Lengths of the plain gradient steps that a round tries at once.
GRADIENTS = (1.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0)
DOMAINS = ("good", "low", "toxic")
#: Share of all tokens that each domain is to have.
TARGETS = {"good": 0.88, "low": 0.08, "toxic": 0.04}
#: The byte groups whose shares are features: each letter, and other bytes by kind.
_GROUPS = np.array([b - 97 if 97 <= b < 123 else 26 if 65 <= b < 91 else 27 if 48 <= b < 58 else 28 if b == 10 else 29 if b == 32 else 30 + b % 8 if b in b"#*$%&|<>" else 38 if b in b".,;:!?" else 39 if b < 128 else 40 + b % 24 for b in range(256)])
N_FEATURES = 64 + 5
#: Partitions of the sample while it is fitted.
PARTS = 6
#: Buckets of the hashed words that the classifier looks at as well.
BUCKETS = 1 << 12


def features(text: str | None) -> tuple[int, np.ndarray]:
    """(words, features): byte group shares, and lengths and repetition, of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    out = np.zeros(N_FEATURES, np.float32)
    if words:
        out[:64] = np.bincount(_GROUPS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=64)[:64] / len(raw)
        lines = raw.split(b"\n")
        out[64:] = np.log1p(len(words)) / 10, len(raw) / len(words) / 20, len(set(words)) / len(words), len(set(lines)) / len(lines), len(lines) / len(words)
    return len(words), out


@F.pandas_udf(T.StructType([T.StructField("tokens", T.LongType()), T.StructField("features", T.ArrayType(T.FloatType()))]))
def _features(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(t) for t in batch]
            yield pd.DataFrame({"tokens": [n for n, _ in found], "features": [f for _, f in found]})

    return thrifty(run)(texts)


def with_posteriors(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domains=DOMAINS, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``_tokens`` (words) and ``_p`` (posterior of each of ``domains``).

    ``labelled``: (id_col, domain) rows; at most ``sample`` of them, by a hash of their ids, are
    learned from. With labels of one domain only, or none, all documents get the shares of
    what labels there are (or equal ones).
    """
    place = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1
    known = labelled.select(F.col(id_col).cast("long").alias("_lid"), place.cast("double").alias("_d")).where("_lid IS NOT NULL AND _d >= 0")
    known = known.orderBy(F.xxhash64("_lid"), "_lid", "_d").limit(sample)
    # at most ``sample`` rows of two numbers
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(known), F.col("_id") == F.col("_lid"))
    rows = materialise(rows.select(F.col("_d").alias("label"), "_text", _features("_text").alias("_f")), "training").coalesce(PARTS)
    shares = {int(r.label): r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    text = docs.withColumn("_text", F.col(text_col).cast("string")).withColumn("_f", _features("_text")).withColumn("_tokens", F.col("_f.tokens"))
    if len(shares) < 2:
        total = sum(shares.values())
        flat = [shares.get(k, 0) / total if total else 1 / len(domains) for k in range(len(domains))]
        return text.withColumn("_p", F.array(*map(F.lit, flat))).drop("_f", "_text")
    fitter = LogisticRegression(family="multinomial", maxIter=30, regParam=1e-3, featuresCol="_v", labelCol="label", probabilityCol="_probability")
    model = fitter.fit(_vectors(rows).select("label", "_v"))
    out = model.transform(_vectors(text))
    p = vector_to_array("_probability")
    full = F.array(*[F.get(p, F.lit(k)) if k < model.numClasses else F.lit(0.0) for k in range(len(domains))])
    return out.withColumn("_p", full).drop("_f", "_text", "_words_in", "_dense", "_hashed", "_v", "_probability", "rawPrediction", "prediction")


def _vectors(rows: DataFrame) -> DataFrame:
    """``_v`` from ``_text`` and ``_f``: the text's features, and which buckets its words fall in."""
    words = F.split(F.lower(F.coalesce("_text", F.lit(""))), r"[^\p{L}\p{N}]+")
    rows = rows.withColumn("_words_in", words).withColumn("_dense", array_to_vector("_f.features"))
    rows = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="_words_in", outputCol="_hashed").transform(rows)
    # the size is stated: the assembler would read a first row for it, and fail where there is none
    rows = VectorSizeHint(inputCol="_dense", size=N_FEATURES, handleInvalid="optimistic").transform(rows)
    return VectorAssembler(inputCols=["_dense", "_hashed"], outputCol="_v").transform(rows)


def replay(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rates of rows with posteriors ``p`` after the projected steps, from 1."""
    rate = np.ones(len(p))
    for step in steps:
        rate = np.maximum(0.0, rate - p @ step)
    return rate


def _sums(posteriors: DataFrame, steps: list[np.ndarray], k: int, tries: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each step that may come next, (expected tokens by domain, sum of tokens * p p' over rates above 0), in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros((len(tries), k)), np.zeros((len(tries), k, k))
        for batch in batches:
            tokens = batch.column(0).to_numpy().astype(float)
            p = batch.column(1).flatten().to_numpy().reshape(-1, k)
            before = replay(p, steps)
            for n, step in enumerate(tries):
                rate = np.maximum(0.0, before - p @ step)
                total[n] += (tokens * rate) @ p
                free = p * np.sqrt(tokens * (rate > 0))[:, None]
                square[n] += free.T @ free
        flat = np.concatenate((total.ravel(), square.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat))), pa.array(flat)], ["at", "value"])

    rows = posteriors.select("_tokens", "_p").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(len(tries) * (k + k * k))
    for r in rows:
        flat[r.at] = r.value
    cut = len(tries) * k
    return list(zip(flat[:cut].reshape(-1, k), flat[cut:].reshape(-1, k, k)))


class Fit(NamedTuple):
    """Steps that ``replay`` turns into rates, how far the expected tokens are from their targets
    (the norm of the differences, as a share of all tokens), and whether no further round would have
    brought them nearer: the targets are met, or no projected gradient step lowers the residual."""

    steps: list[np.ndarray]
    residual: float
    settled: bool


def fit_rates(posteriors: DataFrame, shares: list[float], rounds: int = ROUNDS, close: float = CLOSE) -> Fit:
    """The steps of the rates, from (_tokens, _p) rows.

    ``shares``: each domain's part of all tokens. Targets that no rates reach are met as
    nearly as least squares can. No tokens: no steps. A fit that ``rounds`` did not settle says so.
    """
    k = len(shares)
    now, square = _sums(posteriors, [], k, [np.zeros(k)])[0]
    whole = now.sum()
    if not whole > 0:
        return Fit([], 0.0, True)
    goal, largest = whole * np.array(shares) / sum(shares), np.linalg.eigvalsh(square)[-1]
    steps: list[np.ndarray] = []
    settled = False
    for _ in range(rounds):
        gap = now - goal
        if np.abs(gap).max() <= close * whole:
            settled = True
            break
        newton = np.linalg.solve(square + 1e-9 * largest * np.eye(k), gap)
        # plain gradients of growing length follow targets that only few rows can meet
        tries = [newton * f for f in (1.0, 0.5, 0.1)] + [gap / largest * f for f in GRADIENTS]
        found = _sums(posteriors, steps, k, tries)
        far = [np.linalg.norm(then - goal) for then, _ in found]
        best = int(np.argmin(far))
        if not far[best] < np.linalg.norm(gap) * (1 - 1e-9):
            settled = True
            break
        steps.append(tries[best])
        now, square = found[best]
    return Fit(steps, float(np.linalg.norm(now - goal) / whole), settled or bool(np.abs(now - goal).max() <= close * whole))


def rate_of(p: Column, steps: list[np.ndarray]) -> Column:
    @F.pandas_udf(T.DoubleType())
    def made(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(replay(np.array(batch.tolist(), float), steps) if len(batch) else np.zeros(0))

        return thrifty(run)(rows)

    return made(p)


def copies_of(rate: Column, *key: Column) -> Column:
    """Whole copies whose mean is the rate: the part after the point is drawn by a hash of ``key``."""
    draw = F.pmod(F.xxhash64(F.lit(2024), *key), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + draw).cast("int")


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from labels: toxic, else low (quality 0), else good; null labels drop out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("quality") == 1) & (F.col("toxic") == 0), "good")
    return labels.select("doc_id", domain.alias("domain")).where("domain IS NOT NULL")


def mixing_rates(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> DataFrame:
    """(id_col, n_tokens, p_<domain>..., rate, copies, residual, settled): one row per row of ``docs``.

    ``residual`` and ``settled`` are the fit's, the same in every row: see ``Fit``.

    Texts without words (null too) have no tokens and don't count; they get a rate as others do.
    A null id is allowed; repeated rows get equal rates and copies.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    chosen = docs.select(F.col(id_col).cast("long").alias(id_col), text.alias("_words"), F.xxhash64(text).alias("_tx"))
    posteriors = with_posteriors(chosen, labelled, id_col, "_words", tuple(targets), sample).select(id_col, "_tx", "_tokens", "_p")
    posteriors = materialise(posteriors, "posteriors")
    fit = fit_rates(posteriors, list(targets.values()))
    out = posteriors.withColumn("rate", rate_of(F.col("_p"), fit.steps))
    named = [F.col("_p")[k].alias(f"p_{d}") for k, d in enumerate(targets)]
    return out.select(id_col, F.col("_tokens").alias("n_tokens"), *named, "rate", copies_of(F.col("rate"), F.col(id_col), F.col("_tx")).alias("copies"), F.lit(fit.residual).alias("residual"), F.lit(fit.settled).alias("settled"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as many times as its rate says; columns as given, whatever their names.

    Null and empty texts have no tokens; they get rates, and so copies, as others do. Rows of
    one id and text get equal numbers of copies, null ids too. Without labels of two domains
    the rates are equal; an empty table gives an empty one. A fit that isn't settled is warned of.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    chosen = docs.select(F.col(id_col).cast("long").alias("_mid"), text.alias("_words"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"))
    labelled = labelled.withColumnRenamed(id_col, "_mid")
    tagged = with_posteriors(chosen, labelled, "_mid", "_words", tuple(targets))
    # kept with the rows, so that texts are looked at once
    tagged = materialise(tagged.select("_row", "_mid", F.xxhash64("_words").alias("_tx"), "_tokens", "_p"), "posteriors")
    fit = fit_rates(tagged.select("_tokens", "_p"), list(targets.values()))
    if not fit.settled:
        warnings.warn(f"rates did not settle: targets are missed by {fit.residual:.2g} of all tokens", stacklevel=2)
    copies = copies_of(rate_of(F.col("_p"), fit.steps), F.col("_mid"), F.col("_tx"))
    return tagged.withColumn("_n", F.explode(F.array_repeat(F.lit(1), copies))).select("_row.*")
