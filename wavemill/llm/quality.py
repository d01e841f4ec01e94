"""Quality rules with risk-controlled cutoffs.

Fixed base rules reject very short and very repetitive texts. On top, each
stratum gets cutoffs of rules on ratios (symbols per word, capitals per
character, ...): one half of the labelled documents proposes them, the other
half must show, by an exact binomial bound, that together they reject no more
than the allowed share of good documents. The proposal and ever more lenient
forms of it are tested in a fixed sequence, from the most lenient on, and the
level is divided by the number of strata with a proposal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import broadcast_if_small, fresh, materialize, utf8

_SPACE = b" \t\n\r\x0b\x0c"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))

_METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_calls")
METRICS_SCHEMA = ", ".join(f"{m} long" for m in _METRICS)


def repeated_window_words(words: list[bytes], width: int = 5) -> int:
    """Words covered by ``width``-word windows that occur twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(code) == len(words):
        return 0
    ids = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
    key, bound = ids[:n], len(code)
    for k in range(1, width):
        if bound * len(code) >= 1 << 62:
            values, key = np.unique(key, return_inverse=True)
            bound = len(values)
        key, bound = key * len(code) + ids[k : k + n], bound * len(code)
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    start = np.flatnonzero(np.isin(key, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_metrics(text: bytes | None) -> tuple[int, ...]:
    """The counts of one text, in the order of the schema; null counts as empty."""
    if not text:
        return (0,) * len(_METRICS)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, _SPACE + _CONTINUATION)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_window_words(words),
        len(lines),
        len(text) - len(text.translate(None, _CAPITALS)),
        text.count(b"!") + text.count(b"?"),
    )


def _metrics_udf():
    @F.pandas_udf(METRICS_SCHEMA)
    def metrics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([text_metrics(t) for t in texts], columns=list(_METRICS))

    return metrics.asNondeterministic()


def with_metrics(docs: DataFrame, *, text_col: str = "text", out_col: str = "metrics") -> DataFrame:
    """``docs`` with a struct of the text's counts. Null text counts as empty."""
    return docs.withColumn(out_col, _metrics_udf()(utf8(text_col)))


def _ratio(top: str, bottom: str):
    return lambda m: m[top] / F.greatest(m[bottom], F.lit(1))


@dataclass(frozen=True)
class Rule:
    """Rejects a text whose ratio is above the cutoff; ``grid`` lists possible cutoffs in ascending order."""

    name: str
    ratio: object
    grid: tuple[float, ...]


def default_rules() -> list[Rule]:
    steps = tuple(round(0.025 * k, 3) for k in range(1, 41))
    return [
        Rule("symbols_per_word", _ratio("n_symbols", "n_words"), steps),
        Rule("calls_per_word", _ratio("n_calls", "n_words"), steps),
        Rule("capitals_per_char", _ratio("n_capitals", "word_chars"), steps),
        Rule("duplicate_lines", _ratio("n_dup_lines", "n_lines"), steps),
        Rule("repeated_words", _ratio("n_repeat_words", "n_words"), tuple(x for x in steps if x <= 0.2)),
        Rule("chars_per_word", _ratio("word_chars", "n_words"), tuple(8.0 + k for k in range(33))),
    ]


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable, summed exactly in logarithms."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    log_p, log_q, total = math.log(p), math.log1p(-p), math.lgamma(n + 1)
    return min(1.0, sum(math.exp(total - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q) for i in range(k + 1)))


def certified(rejected: int, good: int, share: float, level: float) -> bool:
    """Whether the exact upper bound (at confidence 1 - ``level``) on the false-rejection rate is at most ``share``."""
    return good > 0 and binomial_cdf(rejected, good, share) <= level


#: Grid steps by which all cutoffs of a proposal are made more lenient, from the most lenient form to the proposal itself.
LADDER = (12, 8, 5, 3, 2, 1, 0)


def propose(counts: pd.DataFrame, grids: list[int], share: float) -> list[int]:
    """Grid steps of one stratum's proposed cutoffs, -1 for rules without one.

    ``counts`` has (rule, step, good, n) of the proposing half, ``step`` being
    the number of grid cutoffs that a ratio exceeds. The cutoff with the largest
    gain is proposed: the share of bad documents rejected, less the share of
    good ones over ``share``, so that a rule must reject that many times more of
    the bad than of the good. Of equal gains the most lenient counts.
    """
    out = []
    for rule, grid in enumerate(grids):

        def over(good: bool) -> np.ndarray:
            c = np.zeros(grid + 1)
            own = counts[(counts["rule"] == rule) & (counts["good"] == good)]
            np.add.at(c, own["step"].to_numpy(int), own["n"].to_numpy(float))
            return (c.sum() - np.cumsum(c)[:grid]) / max(1.0, c.sum())

        gain = over(False) - over(True) / share
        best = grid - 1 - int(np.argmax(gain[::-1]))
        out.append(best if gain[best] > 0 else -1)
    return out


def certify(rejected: list[int], good: int, share: float, level: float) -> int | None:
    """The last place of the ladder reached, of ``rejected`` good holdout documents by place: tests stop at the first that fails."""
    last = None
    for place, k in enumerate(rejected):
        if not certified(k, good, share, level):
            break
        last = place
    return last


def fit_cutoffs(measured: DataFrame, labels: DataFrame, rules: list[Rule], *, id_col: str = "doc_id", stratum_col: str = "lang", share: float = 0.05, level: float = 0.05) -> DataFrame:
    """Certified cutoffs (stratum, limits: one per rule, null for none) from labelled rows of ``measured`` (with struct ``metrics``).

    Labels without id or quality are ignored; of conflicting labels of one id
    the lower counts. The null stratum is a stratum of its own (the empty
    string). Counts per stratum, rule and step are made by Spark and each
    stratum is decided in its own group; only the number of strata with a
    proposal reaches the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg((F.min("quality") > 0).alias("good"))
    m, grids = F.col("metrics"), [len(r.grid) for r in rules]

    def step(rule: Rule) -> Column:
        grid = F.array(*[F.lit(x) for x in rule.grid])
        return F.size(F.filter(grid, lambda c: c < rule.ratio(m)))

    rows = measured.select(
        F.col(id_col).alias("__id"),
        F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
        F.array(*[step(r) for r in rules]).alias("steps"),
    ).join(known, "__id")
    holdout = F.pmod(F.crc32(F.col("__id").cast("string").cast("binary")), F.lit(2)) == 1
    rows = materialize(rows.select("stratum", "good", holdout.alias("holdout"), "steps"))
    counts = rows.where("not holdout").select("stratum", "good", F.posexplode("steps").alias("rule", "step")).groupBy("stratum", "rule", "step", "good").agg(F.count(F.lit(1)).alias("n"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen = propose(pdf, grids, share)
        found = any(k >= 0 for k in chosen) and pdf["good"].any() and not pdf["good"].all()
        return pd.DataFrame([(pdf["stratum"].iat[0], chosen)] if found else [], columns=["stratum", "chosen"], dtype=object)

    proposed = materialize(counts.groupBy("stratum").applyInPandas(choose, "stratum string, chosen array<int>"))
    tests = proposed.count()
    size = F.array(*[F.lit(g) for g in grids])

    def at_place(lenient: int) -> Column:
        """Cutoff steps at one place of the ladder; a rule without a proposal has a step that nothing exceeds."""
        return F.zip_with("chosen", size, lambda c, g: F.when(c < 0, g).otherwise(F.least(c + lenient, g)))

    def hit(lenient: int) -> Column:
        return F.exists(F.zip_with("steps", at_place(lenient), lambda s, c: s > c), lambda x: x)

    good = rows.where("holdout and good").join(broadcast_if_small(proposed, 10_000), "stratum").groupBy("stratum", "chosen").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(hit(k)).alias(f"r{i}") for i, k in enumerate(LADDER)]
    )

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                place = certify([int(getattr(r, f"r{i}")) for i in range(len(LADDER))], int(r.n), share, level / tests)
                if place is not None:
                    limits = [rules[k].grid[c + LADDER[place]] if c >= 0 and c + LADDER[place] < grids[k] else None for k, c in enumerate(r.chosen)]
                    out.append((r.stratum, limits, int(r.n), int(getattr(r, f"r{place}"))))
            yield pd.DataFrame(out, columns=["stratum", "limits", "n_good", "n_rejected"], dtype=object)

    return materialize(good.mapInPandas(decide, "stratum string, limits array<double>, n_good long, n_rejected long"))


def verdicts(measured: DataFrame, rules: list[Rule], cutoffs: DataFrame, *, metrics_col: str, stratum_col: str, out_col: str) -> DataFrame:
    """``measured`` with a boolean: passes the base rules and every certified cutoff of its stratum."""
    m, key, limits = F.col(metrics_col), fresh("stratum", measured), fresh("limits", measured)
    told = broadcast_if_small(cutoffs.select(F.col("stratum").alias(key), F.col("limits").alias(limits)), 10_000)
    ratios = F.array(*[r.ratio(m).cast("double") for r in rules])
    over = F.exists(F.zip_with(ratios, limits, lambda x, c: F.coalesce(x > c, F.lit(False))), lambda x: x)
    kept = ~base_failed(m) & ~F.coalesce(over, F.lit(False))
    return measured.withColumn(key, F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))).join(told, key, "left").withColumn(out_col, kept).drop(key, limits)


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", share: float = 0.05, level: float = 0.05) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document.

    Null text has no words and fails the base. Without usable labels only the
    base rules reject. A ratio equal to a cutoff passes. Texts of any length are
    read whole; repeated rows are judged alike; an empty table gives an empty
    result; other columns are not read.
    """
    rules = default_rules()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("lang"), F.col(text_col).alias("text"))
    measured = materialize(with_metrics(rows).select("doc_id", "lang", "metrics"))
    cutoffs = fit_cutoffs(measured, labels, rules, share=share, level=level)
    m = F.col("metrics")
    return verdicts(measured, rules, cutoffs, metrics_col="metrics", stratum_col="lang", out_col="kept").select(
        "doc_id", *[m[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base_failed(m).alias("base_failed"), "kept"
    )


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", share: float = 0.05, level: float = 0.05) -> DataFrame:
    """The documents that pass, all columns kept; see ``judge`` for nulls, ties, repeated rows and empty tables.

    Counts are made once and written with the rows, for the fit and the decision.
    """
    rules, names = default_rules(), docs.columns
    metrics, kept = fresh("metrics", docs), fresh("kept", docs)
    measured = materialize(with_metrics(docs, text_col=text_col, out_col=metrics))
    fit = measured.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("lang"), F.col(metrics).alias("metrics"))
    cutoffs = fit_cutoffs(fit, labels, rules, share=share, level=level)
    return verdicts(measured, rules, cutoffs, metrics_col=metrics, stratum_col=stratum_col, out_col=kept).where(kept).select(*names)
