"""Language identification: averaged hashed subword embeddings with a linear softmax.

Trained by stochastic gradient descent in numpy on a bounded sample of labelled
rows; probabilities are calibrated by a temperature and a rejection threshold,
both chosen on sample rows that training did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

_KEEP = np.full(256, 32, np.uint8)
_KEEP[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_KEEP[128:] = np.arange(128, 256)
#: Multipliers of the rolling subword hash (odd constants).
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def subwords(text: str, buckets: int) -> np.ndarray:
    """Hashed byte n-grams (2 to 4) of the lower-cased letters, words set off by spaces."""
    raw = _KEEP[np.frombuffer(f" {text} ".lower().encode(), np.uint8)]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    b = raw[keep].astype(np.uint32)
    out, h = [], b * _MIX[0]
    for n in range(2, 5):
        if len(b) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(13))) * _MIX[n - 1] + b[n - 1 :]
        out.append((h ^ (h >> np.uint32(15))) & np.uint32(buckets - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def features(text: str, buckets: int) -> np.ndarray:
    """Share of each bucket among the text's subwords."""
    grams = subwords(text, buckets)
    return (np.bincount(grams, minlength=buckets) / max(1, len(grams))).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    """Averaged subword embeddings and a linear softmax over the learned languages."""

    languages: list[str]
    buckets: int = 4096
    embedding: np.ndarray = field(default=None)
    weights: np.ndarray = field(default=None)
    bias: np.ndarray = field(default=None)
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.embedding) @ self.weights + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, accepted); ``und`` for texts without a letter."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, False
        p = _softmax(self.logits(features(text, self.buckets)) / self.temperature)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k]), bool(p[k] >= self.threshold)


def train(texts: list[str], langs: list[str], *, buckets: int = 4096, size: int = 16, epochs: int = 12, batch: int = 32, rate: float = 8.0, seed: int = 7, max_error: float = 0.02) -> Model:
    """Fit on whole texts and on short random excerpts of them, so that short texts are known too."""
    model = Model(sorted(set(langs)), buckets)
    if not model.languages:
        return model
    rng = np.random.default_rng(seed)
    code = {c: i for i, c in enumerate(model.languages)}
    x, y = [], []
    for text, lang in zip(texts, langs):
        pieces = [text]
        for length in (12, 40, 160):
            if len(text) > length:
                at = int(rng.integers(0, len(text) - length))
                pieces.append(text[at : at + length])
        for p in pieces:
            if has_letter(p):
                x.append(features(p, buckets))
                y.append(code[lang])
    if not y:
        return Model([], buckets)
    x, y = np.stack(x), np.array(y)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    k = len(model.languages)
    model.embedding = rng.normal(0, 0.1, (buckets, size)).astype(np.float32)
    model.weights = rng.normal(0, 0.1, (size, k)).astype(np.float32)
    model.bias = np.zeros(k, np.float32)
    model.embedding *= np.sqrt(buckets) / 8  # averages of many subwords are small
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in range(0, len(fit), batch):
            rows = rng.choice(fit, batch)
            xb = x[rows]
            hidden = xb @ model.embedding
            error = _softmax(hidden @ model.weights + model.bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            back = error @ model.weights.T
            model.weights -= step * 0.1 * hidden.T @ error
            model.bias -= step * 0.1 * error.sum(axis=0)
            model.embedding -= step * buckets / 64 * (xb.T @ back)
    if len(held):
        z, t = model.logits(x[held]), y[held]
        at = np.arange(len(held))
        model.temperature = float(min(np.geomspace(0.2, 10, 60), key=lambda c: -np.log(_softmax(z / c)[at, t] + 1e-12).mean()))
        p = _softmax(z / model.temperature)
        best, right = p.max(axis=1), p.argmax(axis=1) == t
        low_first = np.argsort(best)
        error = np.cumsum((~right)[low_first][::-1])[::-1] / np.arange(len(held), 0, -1)
        good = np.flatnonzero(error <= max_error)
        model.threshold = float(best[low_first[good[0]]]) if len(good) else 1.0
    return model


def training_sample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 1200, least: int = 20, max_chars: int = 20_000) -> tuple[list[str], list[str]]:
    """About ``max_docs`` labelled texts, spread over the languages by id hash, held-out rows excluded.

    Every language is learned: each gets an equal share of ``max_docs``, at
    least ``least`` rows, so the sample grows with the number of languages only.
    Texts over ``max_chars`` are not sampled (they would unbound what reaches the
    driver); prediction reads whole texts.
    """
    open_rows = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) != 2
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where(
        F.col("t").isNotNull() & F.col("l").isNotNull() & (F.length("t") <= max_chars) & F.when(F.col("i").isNotNull(), open_rows).otherwise(False)
    )
    counts = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    n_langs = counts.count()
    if not n_langs:
        return [], []
    per = max(least, max_docs // n_langs)
    shares = counts.select("l", (F.least(F.lit(1.0), per / F.col("n")) * 2**32).cast("long").alias("share"))
    # one row per language, as the model has
    chosen = rows.join(F.broadcast(shares), "l").where(F.pmod(F.xxhash64("i"), F.lit(2**32)) < F.col("share")).select("i", "t", "l").toPandas()
    chosen = chosen.sort_values(["i", "t"])
    return chosen["t"].tolist(), chosen["l"].tolist()


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with a struct (lang_pred, score, accepted). Whole texts are read; no shuffle."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([told.value.predict(t) for t in texts], columns=["lang_pred", "score", "accepted"])

    return docs.withColumn(out_col, predict.asNondeterministic()(F.col(text_col).cast("string")))


def predict_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 1200) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted of every document.

    Held out are the rows whose crc32 of the id as text leaves 2 modulo 4; rows
    without an id are neither held out nor learned from. Null texts and texts
    without a letter are ``und`` with score 0, as is every text if no language
    can be learned. Of equally likely languages the first by name counts.
    Repeated rows are predicted alike; texts of any length are read whole; an
    empty table gives an empty result; other columns are not read.
    """
    model = train(*training_sample(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, max_docs=max_docs))
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, model).select("doc_id", "held_out", "language.lang_pred", "language.score", "language.accepted")
