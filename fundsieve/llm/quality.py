"""Quality classifier with hierarchical empirical Bayes (operator 7).

A logistic model of text features, trained on labelled documents, gives each document its evidence: the logarithm of
its likelihood ratio, i.e. the model's log odds less those of the training rows. Sites are hosts and paths below
them. Grouped sums over all documents give each site's share of good documents; an empirical-Bayes estimate shrinks
a host's share toward the global one and a path's share toward its host's, the more the fewer documents it has. How
strongly is estimated from the spread of the shares themselves (method of moments). A document's posterior adds its
evidence to the log odds of its path's prior, so a sparse site is judged near the global prior.

The model is fitted on at most TRAIN_ROWS labelled texts, chosen by hash; counts and sites cover all rows. A document
counts for its own site too, so a site of one document leans to that document's evidence by its small share of the
site's prior.

For `documents` the host is `source` and the path is `lang` within it.

Defined results: a null text is empty. Null hosts and paths are sites of their own. Labels that are null, or whose
document is missing, do not train; a text and label that are repeated train once, and each text of an id trains. Without labels of both kinds the evidence is
zero. Repeated rows come out repeated. Extra columns are not read. Empty tables give empty tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, small, tidy

TRAIN_ROWS, KEEP = 8_000, 0.5
FEATURES = ("log_words", "upper", "digits", "symbols", "marks_at_ends", "word_length", "distinct", "line_repeats", "short_words", "bars", "non_ascii")
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
SYMBOLS = b"!\"#$%&()*+/:;<=>?@[\\]^_`{|}~"


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw) or 1
    words = raw.split()
    m = len(words) or 1
    lines = [x for x in raw.split(b"\n") if x]
    count = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    solid = n - raw.count(b" ")
    kinds = set(words)
    return [
        np.log1p(len(words)),
        count(UPPER),
        count(DIGITS),
        count(SYMBOLS),
        sum(1 for w in kinds if w[-1] in SYMBOLS) / (len(kinds) or 1),
        solid / m,
        len(kinds) / m**0.8,
        1 - len(set(lines)) / (len(lines) or 1),
        sum(1 for w in kinds if len(w) < 4) / (len(kinds) or 1),
        raw.count(b"|") / m,
        sum(1 for w in kinds if not w.isascii()) / (len(kinds) or 1),
    ]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> dict:
    """A logistic model on standardised features and their squares, by Newton steps."""
    low, high = np.quantile(x, [0.001, 0.999], axis=0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model = {"low": low, "high": high, "mean": mean, "scale": scale, "prior": float(np.log(max(y.sum(), 1) / max(len(y) - y.sum(), 1)))}
    z = expand(x, model)
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * len(y) / 10 * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + (ridge * len(y) / 10 + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return model | {"w": w}


def expand(x: np.ndarray, model: dict) -> np.ndarray:
    z = (np.clip(x, model["low"], model["high"]) - model["mean"]) / model["scale"]
    return np.hstack([z, np.clip(z * z, 0, 25), np.ones((len(z), 1))])


def log_odds(x: np.ndarray, model: dict) -> np.ndarray:
    return np.clip(expand(x, model) @ model["w"], -30, 30)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> dict | None:
    """A model from at most `rows` labelled texts; docs: doc_id, text. None if a class is missing.

    Pairs of text and label are chosen by the hash of id, text and label, repeated ones once: first about twice as many
    labels by the hash of their ids, so that no task or driver gets much more than the sample.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    share = min(1.0, 2 * rows / max(known.count(), 1))
    drawn = known.where(F.xxhash64("doc_id") < int(-(2**63) + share * (2**64 - 1))) if share < 1 else known
    drawn = durable(drawn.distinct(), "labels")

    def run(batches):
        for b in batches:
            x = [features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["h", "y", "x"])

    joined = docs.join(small(drawn, drawn.count()), "doc_id").select(F.xxhash64("doc_id", "text", "y").alias("h"), "y", "text")
    made = joined.mapInArrow(tidy(run), "h long, y int, x array<double>").groupBy("h", "y").agg(F.min("x").alias("x"))
    got = made.orderBy("h", "y").limit(rows).collect()
    y = np.array([r["y"] for r in got], float)
    return fit(np.array([r["x"] for r in got], float), y) if 0 < y.sum() < len(y) else None


def evidence(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, host, path, llr: docs (doc_id, host, path, text) with the evidence of their texts."""

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(3).to_pylist()], float).reshape(-1, len(FEATURES))
            llr = log_odds(x, model) - model["prior"] if model else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(llr, pa.float64())], ["doc_id", "host", "path", "llr"])

    return docs.select("doc_id", "host", "path", "text").mapInArrow(tidy(run), "doc_id long, host string, path string, llr double")


def sites(scored: DataFrame, prior: float) -> DataFrame:
    """host, path, host_prior, path_prior: shares of good documents, shrunk; scored has llr. One row a path."""
    p = 1 / (1 + F.exp(-(F.col("llr") + F.lit(prior))))
    paths = durable(scored.withColumn("p", p).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    whole = hosts.agg(F.sum("hs") / F.sum("hn")).first()[0]
    if whole is None:
        return paths.select("host", "path", F.lit(0.5).alias("host_prior"), F.lit(0.5).alias("path_prior"))
    strength = shrinkage(hosts.select(F.col("hn").alias("n"), (F.col("hs") / F.col("hn")).alias("share"), F.lit(float(whole)).alias("centre")))
    shrunk = hosts.select("host", ((F.col("hs") + strength * F.lit(float(whole))) / (F.col("hn") + strength)).alias("host_prior"))
    both = paths.join(shrunk.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    below = shrinkage(both.select("n", (F.col("s") / F.col("n")).alias("share"), F.col("host_prior").alias("centre")))
    return both.select("host", "path", "host_prior", ((F.col("s") + below * F.col("host_prior")) / (F.col("n") + below)).alias("path_prior"))


def shrinkage(shares: DataFrame) -> float:
    """How many documents the prior is worth: from the shares' spread about their centre, by the method of moments."""
    v = F.greatest(F.col("centre") * (1 - F.col("centre")), F.lit(1e-9))
    spread = F.col("n") * F.pow(F.col("share") - F.col("centre"), 2) / v
    r = shares.agg(F.count(F.lit(1)).alias("k"), F.sum(spread).alias("q"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not r["k"] or r["k"] < 2:
        return 100.0
    width = r["n"] - r["nn"] / r["n"]
    between = (r["q"] - (r["k"] - 1)) / width if width > 0 else 0.0  # variance between sites, in units of v
    return float(min(max(1 / max(between, 1e-9) - 1, 10.0), 1e6))


def posterior(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", keep: float = KEEP) -> DataFrame:
    """doc_id, evidence, host_prior, path_prior, quality (posterior) and kept, of every row."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    model = train(rows.select("doc_id", "text"), labels)
    scored = durable(evidence(rows, model), "evidence")
    prior = model["prior"] if model else 0.0
    site = sites(scored, prior)
    site = small(site.select(F.col("host").alias("h"), F.col("path").alias("q"), "host_prior", "path_prior"), site.count())
    joined = scored.join(site, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")), "left")
    odds = F.log(F.greatest(F.col("path_prior"), F.lit(1e-6)) / F.greatest(1 - F.col("path_prior"), F.lit(1e-6)))
    quality = 1 / (1 + F.exp(-(F.col("llr") + odds)))
    return joined.select("doc_id", F.col("llr").alias("evidence"), "host_prior", "path_prior", quality.alias("quality"), (quality >= keep).alias("kept"))
