"""Personal data: fixed formats plus a skip-chain conditional random field per document.

The fixed formats give the base spans. The field labels further candidates: runs
of digits and addresses written in other ways. Candidates next to each other
share a chain potential; repeated or similar ones anywhere in the document share
a skip potential, by which loopy message passing carries a label from where the
format is plain to where the same value stands bare. All weights are learned on
a bounded sample of texts into which altered forms of their own values and
unrelated numbers are set, with the format of some occurrences hidden.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
# The base formats. A digit run never helps by being cut, so the address begins at its run's start.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TOKEN = re.compile(r"[^\s]+")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Addresses, found from their at signs: the longest local part before each, after the previous match."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        last = domain.end() if domain else at + 1
        if domain:
            out.append((start, last, "email"))
        at = text.find("@", last)
    return out


class Cover:
    """Which span of a sorted list first overlaps a stretch, by binary search."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts = [s for s, _, _ in spans]
        self.reach = list(accumulate((e for _, e, _ in spans), max))

    def first(self, start: int, end: int) -> int | None:
        i = bisect_right(self.reach, start)
        return i if i < len(self.starts) and self.starts[i] < end else None


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed formats: leftmost non-overlapping per kind, failing matches dropped."""
    out: list[Span] = []
    out += _emails(text)
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@dataclass(frozen=True)
class Token:
    start: int
    end: int
    text: str
    before: tuple[str, ...]


#: Candidates: digits with up to three separators between them, and addresses with a written at sign.
_DIGITS = re.compile(r"[0-9](?:[\x20()./\[\]-]{0,3}[0-9])+")
_AT = re.compile(r"\x20?(?:\((?:at|AT)\)|\[(?:at|AT)\]|\{(?:at|AT)\})\x20?|\x20(?:at|AT)\x20")
_DOT = r"(?:\.|\x20?(?:\((?:dot|DOT)\)|\[(?:dot|DOT)\]|\{(?:dot|DOT)\})\x20?|\x20(?:dot|DOT)\x20)"
_SPELLED = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+")
_LEAST_DIGITS, _MOST_DIGITS = 7, 19

#: Words that announce a kind, and words that announce other numbers; features among others.
_KIND_WORDS = {
    "email": ("mail", "email", "e-mail", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "telefon", "whatsapp", "dial", "text"),
    "other": ("order", "invoice", "ref", "reference", "no", "nr", "id", "ticket", "page", "year", "version", "total", "item", "code", "isbn", "case", "serial"),
}
_HINTS = {w: LABELS.index(k) for k, words in _KIND_WORDS.items() for w in words}


def _before(text: str, start: int) -> tuple[str, ...]:
    return tuple(w.lower().strip(_OUTER) for w in text[max(0, start - 32) : start].split()[-3:])


_OUTER = ".,;:!?\"'<>[]{}()*#|="


def _spelled_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Stretches ``name (at) host (dot) name`` and the like; without brackets both words must be written out."""
    for m in _AT.finditer(text):
        start = m.start()
        while start > 0 and m.start() - start < 64 and text[start - 1] in _LOCAL:
            start -= 1
        host = _SPELLED.match(text, m.end()) if start < m.start() else None
        if host and (m[0].strip() not in ("at", "AT") or " dot " in host[0].lower()):
            yield start, host.end()


def tokens(text: str, spans: list[Span]) -> list[Token]:
    """Candidates in text order: base spans whole; elsewhere spelled addresses and runs of seven digits or more.

    A run that is too long for any kind, or has long groups, is several numbers:
    its white-space parts are candidates of their own.
    """
    cover, out = Cover(spans), [(s, e) for s, e, _ in spans]
    spelled = sorted(set(_spelled_addresses(text))) if "at" in text or "AT" in text else []
    out += [(s, e) for s, e in spelled if cover.first(s, e) is None]
    taken = Cover(sorted([*spans, *[(s, e, "") for s, e in spelled]]))
    for m in _DIGITS.finditer(text):
        run, parts = m[0], [(m.start(), m.end())]
        digits = len(_NOT_DIGIT.sub("", run))
        if digits > _MOST_DIGITS or (" " in run and max(len(g) for g in _NOT_DIGIT.split(run)) > 8):
            parts = [(m.start() + p.start(), m.start() + p.end()) for p in _TOKEN.finditer(run)]
        for s, e in parts:
            body = text[s:e]
            if len(_NOT_DIGIT.sub("", body)) >= _LEAST_DIGITS and taken.first(s, e) is None and (s == 0 or not text[s - 1].isalnum()) and (e == len(text) or not text[e].isalnum()):
                out.append((s - (s > 0 and text[s - 1] == "(" and ")" in body and taken.first(s - 1, s) is None), e))
    return [Token(s, e, text[s:e], _before(text, s)) for s, e in sorted(out)]


def _digits(text: str) -> str:
    return _NOT_DIGIT.sub("", text)


def _address(text: str) -> str:
    """One form of an address: at signs and dots however they are written."""
    text = re.sub(r"\s*[(\[{]at[)\]}]\s*|\s+at\s+", "@", text.lower())
    return re.sub(r"\s*[(\[{]dot[)\]}]\s*|\s+dot\s+", ".", text)


N_FEATURES = 64
#: Numbers of digits are told apart at these counts only, so that one country's numbers teach about another's.
_LENGTHS = (0, 6, 8, 11, 13, 15, 16, 19)


def token_features(t: Token, bare: bool = False) -> list[int]:
    """Numbers of the binary features that hold; ``bare`` leaves out what shows the format."""
    digits, letters = _digits(t.text), any(c.isalpha() for c in t.text)
    on = [0, 1 + bisect_right(_LENGTHS, len(digits))] + [22 + h for h in {_HINTS[w] for w in t.before if w in _HINTS}]
    on += [27] if letters else []
    if bare:
        return [*on, 63]
    groups = [g for g in _NOT_DIGIT.split(t.text) if g]
    on += [28] if t.text.startswith("+") else []
    on += [29] if "@" in t.text else []
    on += [30] if letters and "@" not in t.text else []
    on += [31 + min(len(groups), 6)]
    on += [38] if "(" in t.text else []
    on += [39] if "-" in t.text else []
    on += [40] if "." in t.text else []
    on += [41] if not letters and 12 <= len(digits) <= 19 and luhn(digits) else []
    on += [42] if not letters and len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) else []
    on += [43] if groups and len(groups[-1]) == 4 and len(groups) > 1 else []
    on += [44] if len(groups) == 4 and all(len(g) == 4 for g in groups) else []
    on += [45] if digits.startswith("0") else []
    return on


def feasible(t: Token) -> np.ndarray:
    """Which labels a candidate can have at all: counts of digits and the presence of an at sign."""
    n, letters = len(_digits(t.text)), any(c.isalpha() for c in t.text)
    groups = [g for g in _NOT_DIGIT.split(t.text) if g]
    number = not letters
    return np.array([True, letters, number and len(groups) == 4 and n <= 12, number and 12 <= n <= 19, number and 7 <= n <= 15])


def similar_groups(found: list[Token]) -> list[list[int]]:
    """Groups of candidates that are one address however written, or numbers with the same last seven digits."""
    groups: dict[str, list[int]] = defaultdict(list)
    for i, t in enumerate(found):
        if any(c.isalpha() for c in t.text):
            groups["a" + _address(t.text)].append(i)
        elif len(_digits(t.text)) >= _LEAST_DIGITS:
            groups["d" + _digits(t.text)[-_LEAST_DIGITS:]].append(i)
    return [g for g in groups.values() if len(g) > 1]


def edges(found: list[Token]) -> list[tuple[int, int, int]]:
    """(i, j, type): chain edges (0) between close candidates, skip edges (1) along each group of similar ones.

    A group is linked as a cycle through its members, so that n repeats cost n
    edges and evidence still reaches every member from both sides.
    """
    out = [(i, i + 1, 0) for i in range(len(found) - 1) if found[i + 1].start - found[i].end <= 2]
    for g in similar_groups(found):
        out += [(a, b, 1) for a, b in zip(g, g[1:])]
        if len(g) > 2:
            out.append((g[0], g[-1], 1))
    return out


@dataclass
class Field:
    """Node weights by feature and label, and edge potentials by edge type and label pair."""

    node: np.ndarray = field(default_factory=lambda: np.zeros((N_FEATURES, len(LABELS))))
    edge: np.ndarray = field(default_factory=lambda: np.zeros((2, len(LABELS), len(LABELS))))

    def node_scores(self, found: list[Token]) -> np.ndarray:
        if not found:
            return np.zeros((0, len(LABELS)))
        return np.stack([np.where(feasible(t), self.node[token_features(t)].sum(axis=0), _NEVER) for t in found])


_NEVER = -50.0


def _normal(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def marginals(scores: np.ndarray, links: list[tuple[int, int, int]], potentials: np.ndarray, clamp: dict[int, int], *, rounds: int = 20, damping: float = 0.3) -> np.ndarray:
    """Label marginals by loopy sum-product messages, all edges at once, at most ``rounds`` times."""
    log_node = scores.copy()
    for i, label in clamp.items():
        log_node[i] = _NEVER
        log_node[i, label] = 0.0
    if not links:
        return _normal(log_node)
    a, b, kind = (np.array(x) for x in zip(*links))
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    pair = np.concatenate([potentials[kind], potentials[kind].transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    message = np.zeros((len(source), log_node.shape[1]))
    for _ in range(rounds):
        total = log_node.copy()
        np.add.at(total, target, message)
        cavity = total[source] - message[back]
        new = cavity[:, :, None] + pair
        top = new.max(axis=1, keepdims=True)
        new = np.log(np.exp(new - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        change = np.abs(new - message).max()
        message = damping * message + (1 - damping) * new
        if change < 1e-4:
            break
    total = log_node.copy()
    np.add.at(total, target, message)
    return _normal(total)


def weak_labels(found: list[Token], spans: list[Span]) -> list[int]:
    """Label of each candidate: the kind of the span that covers part of it, else other."""
    cover = Cover(spans)
    first = [cover.first(t.start, t.end) for t in found]
    return [0 if i is None else LABELS.index(spans[i][2]) for i in first]


# --- training texts ---------------------------------------------------------------------------------


def altered(value: str, kind: str, rng: np.random.Generator) -> str:
    """Another way to write a value of the fixed formats, which those formats do not find."""
    if kind == "email":
        name, _, host = value.partition("@")
        at, dot = [("(at)", "."), ("[at]", "."), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] ")][rng.integers(6)]
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return value.replace(".", ["[.]", " . ", "(.)"][rng.integers(3)])
    digits = _digits(value)
    if kind == "card":
        sep = ["/", ".", "  "][rng.integers(3)]
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    short = digits[-10:] if len(digits) > 10 else digits
    sep = ["-", " ", ".", ""][rng.integers(4)]
    local = sep.join([short[:-7], short[-7:-4], short[-4:]]).strip(sep or None)
    return [local, digits, f"({short[:-7]}) {short[-7:-4]}-{short[-4:]}" if len(short) > 7 else local][rng.integers(3)]


def _number(rng: np.random.Generator) -> str:
    """A number that is no personal data, in the forms that such data has too."""
    n = int(rng.integers(7, 17))
    digits = "".join(map(str, rng.integers(0, 10, n)))
    if 12 <= n and luhn(digits):
        digits = digits[:-1] + str((int(digits[-1]) + 1) % 10)
    form = rng.integers(4)
    if form == 0 and n >= 9:
        return f"{digits[:-7]}-{digits[-7:-4]}-{digits[-4:]}"
    if form == 1:
        return ".".join([digits[:3], digits[3:6], digits[6:]])
    return digits


def with_planted(text: str, rng: np.random.Generator) -> tuple[str, list[Span]]:
    """``text`` with altered forms of its own values and with other numbers set in, and the spans of the altered forms.

    An altered form stands bare where its value stands plainly in the text too;
    else it follows a word that announces its kind.
    """
    base = base_spans(text)
    values = [(text[s:e], k) for s, e, k in base]
    if values and rng.random() < 0.4:  # a text without the plain values: only their altered forms, announced
        keep = np.ones(len(text), bool)
        for s, e, _ in base:
            keep[s:e] = False
        text, plain = "".join(c for c, k in zip(text, keep) if k), False
    else:
        plain = True
    inserts: list[tuple[str, str]] = []
    for value, kind in values:
        for _ in range(int(rng.integers(1, 3))):
            words = _KIND_WORDS[kind]
            lead = words[rng.integers(len(words))] + [" ", ": "][rng.integers(2)] if not plain or rng.random() < 0.3 else ""
            inserts.append((lead + altered(value, kind, rng), kind))
    for _ in range(int(rng.integers(1, 4))):
        words = _KIND_WORDS["other"]
        number = _number(rng)
        for _ in range(int(rng.integers(1, 3))):
            inserts.append((words[rng.integers(len(words))] + " " + number if rng.random() < 0.6 else number, "other"))
    gaps = [m.start() for m in re.finditer(r"\s", text)] or [len(text)]
    places = sorted((int(gaps[rng.integers(len(gaps))]), k) for k in range(len(inserts)))
    out, spans, at, size = [], [], 0, 0
    for place, k in places:
        body, kind = inserts[k]
        out += [text[at:place], " ,; ", body, " ;"]
        size += place - at + 4
        if kind != "other":
            spans.append((size, size + len(body), kind))
        size += len(body) + 2
        at = place
    return "".join([*out, text[at:]]), spans


def train(texts: list[str], *, epochs: int = 300, rate: float = 0.05, prior: float = 1e-3, hidden: float = 0.3, seed: int = 17) -> Field:
    """Pseudo-likelihood on texts with planted forms; all weights start at zero.

    Labels are those of the base spans and of the planted forms. Of the base
    occurrences that have a similar one, a share ``hidden`` shows only its
    number of digits and its surroundings, so that the skip potential must be
    learned from occurrences whose format tells nothing.
    """
    crf, rng = Field(), np.random.default_rng(seed)
    x, y, can, links, at = [], [], [], [], 0
    for text in texts:
        text, planted = with_planted(text, rng)
        base = base_spans(text)
        cover = Cover(base)
        found = tokens(text, base)
        if not found:
            continue
        spans = sorted([*base, *[p for p in planted if cover.first(p[0], p[1]) is None]])
        similar = {i for g in similar_groups(found) for i in g}
        for i, t in enumerate(found):
            row = np.zeros(N_FEATURES)
            row[token_features(t, bare=i in similar and rng.random() < hidden)] = 1
            x.append(row)
            can.append(feasible(t))
        label = np.array(weak_labels(found, spans))
        y.append(np.where(np.stack(can[-len(found) :])[np.arange(len(found)), label], label, 0))
        links += [(i + at, j + at, k) for i, j, k in edges(found)]
        at += len(found)
    if not x:
        return crf
    x, y, can = np.stack(x), np.concatenate(y), np.stack(can)
    n, hot = len(y), np.eye(len(LABELS))[y]
    a, b, kind = (np.array(v, int) for v in zip(*links)) if links else (np.zeros(0, int),) * 3
    weights = [crf.node, crf.edge]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, epochs + 1):
        score = np.where(can, x @ crf.node, _NEVER)
        np.add.at(score, a, crf.edge[kind, :, y[b]])
        np.add.at(score, b, crf.edge[kind, y[a], :])
        gap = hot - _normal(score)
        edge = np.zeros_like(crf.edge)
        np.add.at(edge.transpose(0, 2, 1), (kind, y[b]), gap[a])
        np.add.at(edge, (kind, y[a]), gap[b])
        for k, g in enumerate((x.T @ gap / n, edge / n)):
            g = g - prior * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            weights[k] += rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return crf


def all_spans(text: str, crf: Field, *, sure: float = 0.8) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans): added are candidates outside all base spans that the field labels with at least ``sure``."""
    base = base_spans(text)
    found = tokens(text, base)
    if len(found) == len(base):
        return base, []
    own = {(s, e): LABELS.index(k) for s, e, k in base}
    clamp = {i: own[(t.start, t.end)] for i, t in enumerate(found) if (t.start, t.end) in own}
    p = marginals(crf.node_scores(found), edges(found), crf.edge, clamp)
    added, end = [], 0
    for i, t in enumerate(found):
        if i not in clamp and p[i].argmax() and p[i].max() >= sure and t.start >= end:
            added.append((t.start, t.end, LABELS[int(p[i].argmax())]))
            end = t.end
    return base, added


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


#: Without any of these a text has neither a base span nor a candidate.
_EVIDENCE = re.compile(r"@|[0-9]\.[0-9]|\+[0-9]|[0-9](?:[^0-9A-Za-z]{0,3}[0-9]){6}|[(\[{](?:at|AT)[)\]}]|\x20(?:at|AT)\x20")


def _is_candidate(text: str | None) -> bool:
    return text is not None and _EVIDENCE.search(text) is not None


def find_personal_data(docs: DataFrame, crf: Field, *, text_col: str = "text", out_col: str = "personal") -> DataFrame:
    """``docs`` with a struct: counts of base spans, their digest, all spans and their number. No shuffle; null counts as empty."""
    model = docs.sparkSession.sparkContext.broadcast(crf)
    nothing = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)

    def one(text: str | None) -> tuple:
        if not _is_candidate(text):
            return nothing
        base, added = all_spans(text, model.value)
        digest = hashlib.sha256(spans_text(base).encode()).hexdigest()
        return (*[sum(k == kind for _, _, k in base) for kind in KINDS], digest, spans_text(base + added), len(base) + len(added))

    @F.pandas_udf(RESULT)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return docs.withColumn(out_col, find.asNondeterministic()(F.col(text_col).cast("string")))


def training_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 1000, max_chars: int = 20_000) -> list[str]:
    """About ``max_docs`` texts of at most ``max_chars`` that hold digits or an at sign, chosen by id hash."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where(F.col("t").rlike("[0-9]{3}|@") & (F.length("t") <= max_chars))
    n = rows.count()
    if not n:
        return []
    share = min(1.0, max_docs / n)
    return sorted(r["t"] for r in rows.where(F.pmod(F.xxhash64("i"), F.lit(1 << 32)) < int(share * (1 << 32))).collect())


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 1000) -> DataFrame:
    """doc_id, counts, base_sha256 and spans of every document; rows are neither added nor lost.

    Null and empty texts have no spans; texts of any length are read whole; of
    candidates that overlap the first counts; of spans with one start the kinds
    come in their order; repeated rows are judged alike, given the same trained
    field; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    crf = train(training_texts(rows, max_docs=max_docs))
    p = "personal"
    return find_personal_data(rows, crf, out_col=p).select("doc_id", *[f"{p}.{c.split()[0]}" for c in RESULT.split(", ")])
