"""Secret scans over a trigram inverted index, with DataFrame functions only.

Every rule's regular expression yields a Boolean query of trigrams that any
match must contain. The postings of those trigrams are intersected per clause to
find candidate documents, and only candidates are verified by the expression.
Rules without mandatory trigrams scan every document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import broadcast_if_small, fresh, materialize

#: More alternatives than this for one stretch of literals are not spelled out.
_MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: all leftmost non-overlapping matches whose ``group`` has ``min_length`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1


#: The base kinds in their order. For hex, runs under the minimum are skipped by the pattern itself.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Further kinds that announce themselves: key blocks, signed tokens, provider prefixes, credentials in addresses and headers.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]{32,}-----END [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"),
    Rule("prefixed_token", r"(ghp_|gho_|ghs_|xoxb-|xoxp-|sk_live_|rk_live_|glpat-|AIza)[A-Za-z0-9_-]{16,}"),
    Rule("address_login", r"[a-z][a-z0-9+.-]{1,20}://[^/:@\x20\x09-\x0D]{1,64}:[^/:@\x20\x09-\x0D]{3,128}@"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9+/_.=-]{20,}"),
    Rule("account_key", r"(?i:accountkey|sharedaccesskey)=[A-Za-z0-9+/]{32,}={0,2}"),
)
ALL_RULES = BASE_RULES + MORE_RULES

Clauses = list[frozenset[str]]


def _and(a: Clauses, b: Clauses) -> Clauses:
    return _minimal([x | y for x in a for y in b])


def _minimal(clauses: Clauses) -> Clauses:
    """Without clauses that another clause implies."""
    unique = sorted(set(clauses), key=len)
    return [c for i, c in enumerate(unique) if not any(d <= c for d in unique[:i])]


def _grams(strings: set[str]) -> Clauses:
    return _minimal([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


#: What one node of an expression can be: all strings it matches (None: too many), and clauses that every match satisfies.
_Node = tuple[set[str] | None, Clauses]
_ANY: _Node = (None, [frozenset()])


class _Reader:
    """Reads an expression of literals, classes, groups, alternatives and repeats; other syntax raises ValueError."""

    def __init__(self, pattern: str) -> None:
        self.pattern, self.at = pattern, 0

    def peek(self, text: str) -> bool:
        return self.pattern.startswith(text, self.at)

    def take(self, text: str) -> bool:
        found = self.peek(text)
        self.at += len(text) if found else 0
        return found

    def alternatives(self) -> _Node:
        parts = [self.sequence()]
        while self.take("|"):
            parts.append(self.sequence())
        strings = set().union(*[s for s, _ in parts if s is not None]) if all(s is not None for s, _ in parts) else None
        return (strings if strings is None or len(strings) <= _MAX_STRINGS else None), _minimal([c for _, clauses in parts for c in clauses])

    def sequence(self) -> _Node:
        """Literals are joined while there are few; where they end, their trigrams become mandatory."""
        whole, run, clauses = {""}, {""}, [frozenset()]
        while self.at < len(self.pattern) and not self.peek("|") and not self.peek(")"):
            strings, inner = self.repeated(self.atom())
            clauses = _and(clauses, inner)
            if strings is None or len(run) * len(strings) > _MAX_STRINGS:
                clauses, run, whole = _and(clauses, _grams(run)), strings or {""}, None
            else:
                run = {a + b for a in run for b in strings}
                whole = run if whole is not None else None
        return whole, _and(clauses, _grams(run))

    def atom(self) -> _Node:
        if self.take("("):
            if self.take("?") and not (self.take("i:") or self.take(":")):
                raise ValueError(f"unknown group in {self.pattern!r}")
            node = self.alternatives()
            if not self.take(")"):
                raise ValueError(f"open group in {self.pattern!r}")
            return node
        if self.take("["):
            negated, chars = self.take("^"), set()
            while not self.take("]"):
                low = self.character()
                if self.peek("-") and self.pattern[self.at + 1 : self.at + 2] != "]":
                    self.at += 1
                    chars.update(chr(c) for c in range(ord(low), ord(self.character()) + 1))
                else:
                    chars.add(low)
            chars = {c.lower() for c in chars}
            return (chars, [frozenset()]) if not negated and len(chars) <= 4 else _ANY
        if self.take("."):
            return _ANY
        return {self.character().lower()}, [frozenset()]

    def character(self) -> str:
        if not self.take("\\"):
            self.at += 1
            return self.pattern[self.at - 1]
        if self.take("x"):
            self.at += 2
            return chr(int(self.pattern[self.at - 2 : self.at], 16))
        self.at += 1
        if self.pattern[self.at - 1].isalnum():
            raise ValueError(f"unknown escape in {self.pattern!r}")
        return self.pattern[self.at - 1]

    def repeated(self, node: _Node) -> _Node:
        if self.take("*"):
            low, high = 0, None
        elif self.take("+"):
            low, high = 1, None
        elif self.take("?"):
            low, high = 0, 1
        elif self.take("{"):
            end = self.pattern.index("}", self.at)
            first, _, last = self.pattern[self.at : end].partition(",")
            low, high, self.at = int(first), int(last or first) if "," not in self.pattern[self.at : end] or last else None, end + 1
        else:
            return node
        strings, clauses = node
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, [frozenset()]
        return None, clauses if low else [frozenset()]


def trigram_query(pattern: str) -> Clauses:
    """Alternative sets of lower-case trigrams; a match contains all of at least one set. ``[{}]`` means: scan."""
    reader = _Reader(pattern)
    clauses = reader.alternatives()[1]
    if reader.at < len(pattern):
        raise ValueError(f"closing bracket too many in {pattern!r}")
    return clauses


#: Letters from frequent to rare in running text; other characters are rarer still.
_FREQUENT = "etaoinsrhldcumfpgwybvkxjqz"


def _rarity(gram: str) -> tuple[int, str]:
    return -sum(_FREQUENT.find(c) if c in _FREQUENT else len(_FREQUENT) for c in gram), gram


def rare_query(clauses: Clauses, per_clause: int = 2) -> Clauses:
    """Every clause with its rarest trigrams only: any part of a clause is mandatory too, so no match is lost.

    Rare is judged by the letters, so that the index holds few long lists.
    """
    return _minimal([frozenset(sorted(c, key=_rarity)[:per_clause]) for c in clauses])


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def build_postings(docs: DataFrame, clauses: Clauses | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: one row (trigram, key) per distinct trigram of a document, folded to lower case.

    With ``clauses`` only the postings that a clause can use: those of its
    trigrams in documents that hold them all. The rarest trigram of a clause is
    looked for first and the others only where it stands, so a text is read
    about once per clause. Without, the postings of every trigram of the text.
    Null texts have none.
    """
    # folded once, in a projection of its own
    low = docs.where(F.col(text_col).isNotNull()).select(row_key(id_col, text_col).alias("key"), F.lower(F.col(text_col)).alias("low"))
    if clauses is None:
        return low.select("key", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit("(?s)(?=(...))"), F.lit(1)))).alias("trigram"))
    # clauses with an underscore are tried only where the text has one
    seen = low.select("key", "low", F.col("low").contains("_").alias("under"))

    def holds(clause: frozenset[str]) -> Column:
        tests = [F.col("low").contains(t) for t in sorted(clause, key=_rarity)]
        return reduce(lambda a, b: a & b, [F.col("under"), *tests] if any("_" in t for t in clause) else tests)

    words = [clauses[i : i + 62] for i in range(0, len(clauses), 62)]

    def flags(word: Clauses) -> Column:
        return reduce(lambda a, b: a.bitwiseOR(b), [F.when(holds(c), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(word)])

    def any_of(x: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, x)

    flagged = seen.select("key", *[flags(w).alias(f"w{k}") for k, w in enumerate(words)]).where(any_of([F.col(f"w{k}") != 0 for k in range(len(words))]))
    of: dict[str, list[Column]] = {}
    for k, w in enumerate(words):
        for i, c in enumerate(w):
            for t in c:
                of.setdefault(t, []).append(F.col(f"w{k}").bitwiseAND(F.lit(1 << i).cast("long")) != 0)
    held = [F.when(any_of(x), F.lit(t)) for t, x in sorted(of.items())]
    return flagged.select("key", F.explode(F.array_compact(F.array(*held))).alias("trigram"))


def candidates(postings: DataFrame, queries: dict[str, Clauses]) -> DataFrame:
    """(key, kinds): documents whose postings satisfy a clause, by intersection of each clause's lists.

    Postings are folded into one bit set per (document, clause) before the
    shuffle, so a trigram in very many documents makes no hot task. Of a clause
    of over 62 trigrams 62 are used: documents that lack the others are found
    out when candidates are verified.
    """
    rows = []
    for kind, clauses in queries.items():
        for n, c in enumerate(clauses):
            used = sorted(c)[:62]
            rows += [(t, kind, n, 1 << i, (1 << len(used)) - 1) for i, t in enumerate(used)]
    terms = postings.sparkSession.createDataFrame(rows, "trigram string, kind string, clause int, bit long, full long")
    # the terms of the rule set: their number is fixed by the rules
    hits = postings.join(F.broadcast(terms), "trigram").groupBy("key", "kind", "clause", "full").agg(F.bit_or("bit").alias("bits"))
    return hits.where("bits = full").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Matches as array<struct<start, ord, end, kind>>, in code points, end exclusive.

    Splitting at the matches gives the stretches between them; the running sum
    of both lengths gives the positions.
    """
    between = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    checked = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    lengths = F.arrays_zip(
        F.transform(F.slice(between, 1, F.size(found)), lambda s: F.length(s)).alias("gap"),
        F.transform(found, lambda s: F.length(s)).alias("n"),
        F.transform(checked, lambda s: F.length(s)).alias("m"),
    )
    kind = "struct<at:int,out:array<struct<start:int,ord:int,end:int,kind:string>>>"

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + x["n"]
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["m"] >= rule.min_length, F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    start = F.from_json(F.lit('{"at":0,"out":[]}'), kind)
    return F.aggregate(lengths, start, step, lambda s: s["out"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = ALL_RULES, *, id_col: str = "doc_id", text_col: str = "text", out_col: str = "secrets", small_rows: int = 500_000) -> DataFrame:
    """``docs`` with the sorted spans of all rules in a new column (a column of its name is replaced), others kept.

    Documents meet their candidate kinds by a hash of id and text: a chance
    collision or a repeated row only adds a candidate, and candidates are
    verified. Candidates are written, counted and broadcast only up to
    ``small_rows``; beyond, the join is left to Spark, which can split repeated
    rows. Null texts count as empty. Rows are neither added nor lost.
    """
    queries = {r.kind: rare_query(trigram_query(r.pattern)) for r in rules}
    indexed = {k: q for k, q in queries.items() if frozenset() not in q}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = [c for c in docs.columns if c.lower() != out_col.lower()]
    key, kinds = fresh("__key", docs), fresh("__kinds", docs)
    if indexed:
        clauses = sorted({c for q in indexed.values() for c in q}, key=sorted)
        found = candidates(build_postings(docs.select(id_col, text_col), clauses, id_col=id_col, text_col=text_col), indexed)
        found = materialize(found.withColumnsRenamed({"key": key, "kinds": kinds}))
        docs = docs.withColumn(key, row_key(id_col, text_col)).join(broadcast_if_small(found, small_rows), key, "left")
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    per_rule = []
    for order, rule in enumerate(rules):
        run = text.rlike(rule.pattern)
        if rule.kind in indexed:
            run = F.coalesce(F.array_contains(kinds, rule.kind), F.lit(False)) & run
        per_rule.append(F.when(run, rule_spans(text, rule, order)).otherwise(empty))
    return docs.select(*names, F.array_sort(F.concat(*per_rule)).alias(out_col))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = ALL_RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a count per base kind, base_sha256 and spans of every document; other columns are not read.

    ``spans`` has the spans of all kinds in order of start, ties in the order of
    the rules; those of further kinds may lie inside others. Null and empty
    texts have none; texts of any length are read whole; repeated rows are
    judged alike; an empty table gives an empty result.
    """
    found = find_secrets(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rules)
    base = [r.kind for r in BASE_RULES]
    s = F.col("secrets")

    def count(kind: str) -> Column:
        return F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(spans_text(F.filter(s, lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        spans_text(s).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = ALL_RULES, *, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mask``; all rows and columns are kept, null texts too.

    Spans that overlap are replaced by one mask.
    """
    names = docs.columns
    spans = fresh("__spans", docs)
    found = find_secrets(docs, rules, id_col=id_col, text_col=text_col, out_col=spans)
    text = F.col(text_col)

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, s["at"] + 1, x["start"] - s["at"])
        put = F.when(x["start"] >= s["at"], F.concat(s["out"], gap, F.lit(mask))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), put.alias("out"))

    clean = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    )
    return found.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).select(*names)
