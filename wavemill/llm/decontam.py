"""Benchmark decontamination with an FM-index per training shard.

Every Arrow batch of documents is a shard. Its words become symbols of the
phrase vocabulary; words of no test phrase cannot be part of a match and fall
together into one separator, and runs shorter than the shortest window are
left out. The shard's suffix array gives its Burrows-Wheeler transform, held in
a wavelet tree stored level by level. All windows are searched backward through
the tree at once, occurrences are located by walking to sampled suffix
positions, and their word spans are merged per document.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import delete, fresh, materialize, utf8, work_dir

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z to a-z; every byte that is in no word to a space.
_FOLD = bytes(ord(" ") if not _WORD.fullmatch(bytes([b]).lower()) else bytes([b]).lower()[0] for b in range(256))
#: A shard is indexed once this many bytes of text are held; a longer document is still one shard.
_SHARD_BYTES = 6 << 20
#: A long test item is cut into overlapping stretches of this many words.
_PIECE_WORDS = 50_000

RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Phrases:
    """The distinct windows of a block of test items, as symbol rows by length, with the items each belongs to.

    Pickles as the texts it was made from: a worker rebuilds the arrays, about
    40 bytes a word for the windows and 12 for their items.
    """

    def __init__(self, items: list[tuple[object, bytes | None]], width: int) -> None:
        self.made_from = items, width
        self.symbols: dict[bytes, int] = {}
        self.names: list[str] = sorted({"" if i is None else str(i) for i, _ in items})
        number = {n: k for k, n in enumerate(self.names)}
        by_length: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for item, text in items:
            words = words_of(text)
            if words:
                ids = np.fromiter((self.symbols.setdefault(w, len(self.symbols) + 2) for w in words), np.int32, len(words))  # 0 ends a shard, 1 separates
                by_length[min(width, len(ids))].append((ids, number["" if item is None else str(item)]))
        #: (windows, first, owners): the owners of window w are names[owners[first[w] : first[w + 1]]]
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in sorted(by_length):
            held = by_length.pop(n)
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, n) for ids, _ in held])
            owner = np.concatenate([np.full(len(ids) - n + 1, k, np.int32) for ids, k in held])
            order = np.lexsort((owner, *rows.T[::-1]))
            rows, owner = rows[order], owner[order]
            new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
            keep = new | np.concatenate([[True], owner[1:] != owner[:-1]])
            self.by_length.append((rows[new], np.append(np.flatnonzero(new[keep]), keep.sum()), owner[keep]))
        self.shortest = self.by_length[0][0].shape[1] if self.by_length else 0

    def __reduce__(self):
        return Phrases, self.made_from


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ``text`` ends with its only smallest symbol."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank, step = rank.astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1 if step < n else 0
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletTree:
    """Ranks over a symbol sequence: one bit row per symbol bit, zeros before ones from level to level."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(sequence) - int(self.ones[-1][-1]))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position ``end``, element by element."""
        low, high = np.zeros_like(end), end
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            low_ones, high_ones = ones[low], ones[high]
            low = np.where(bit, zeros + low_ones, low - low_ones)
            high = np.where(bit, zeros + high_ones, high - high_ones)
        return high - low


class FMIndex:
    """Backward search and location over one shard."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 16) -> None:
        order = suffix_array(text)
        self.last = text[order - 1].astype(np.int64)  # the transform; position -1 is the end symbol
        self.tree = WaveletTree(self.last, symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.int64)
        self.sampled = order % sample == 0
        self.slot = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]
        self.n = len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix rows [low, high) that start with each pattern (one per row)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, k].astype(np.int64)
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps to the preceding suffix until a sampled one."""
        steps, at = np.zeros(len(rows), np.int64), rows.copy()
        walking = np.flatnonzero(~self.sampled[at])
        while len(walking):
            symbol = self.last[at[walking]]
            at[walking] = self.before[symbol] + self.tree.rank(symbol, at[walking])
            steps[walking] += 1
            walking = walking[~self.sampled[at[walking]]]
        return self.samples[self.slot[at]] + steps


def _runs(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of vocabulary words that can hold a window; 0 is any other word."""
    inside = np.concatenate([[False], ids > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    keep = end - start >= shortest
    return start[keep], end[keep]


def find_in_shard(texts: list[bytes | None], phrases: Phrases) -> list[tuple[int, set[str], list[tuple[int, int]]]]:
    """Per document: number of words, items with a window in it, and merged word spans [start, end) hit."""
    get, zero = phrases.symbols.get, repeat(0)
    counts, parts = [], []
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        parts.append(np.fromiter(map(get, words, zero), np.int32, len(words)))
        parts.append(np.zeros(1, np.int32))  # no window crosses documents
    found: list[tuple[int, set[str], list[tuple[int, int]]]] = [(n, set(), []) for n in counts]
    if not phrases.by_length or not counts:
        return found
    ids = np.concatenate(parts)
    first = np.cumsum(np.array(counts) + 1) - (np.array(counts) + 1)  # of each document in ids
    start, end = _runs(ids, phrases.shortest)
    if not len(start):
        return found
    length = end - start + 1  # and a separator
    place = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
    text = np.append(ids[place], 0)
    text[:-1][text[:-1] == 0] = 1
    index = FMIndex(text, len(phrases.symbols) + 2)
    hit_start, hit_end = [], []
    for patterns, owner_first, owners in phrases.by_length:
        low, high = index.search(patterns)
        some = np.flatnonzero(high > low)
        if not len(some):
            continue
        n = (high - low)[some]
        rows = np.repeat(low[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = place[index.locate(rows)]
        hit_start.append(at)
        hit_end.append(at + patterns.shape[1])
        doc = np.searchsorted(first, at, side="right") - 1
        for d, w in np.unique(np.stack([doc, np.repeat(some, n)], 1), axis=0).tolist():
            found[d][1].update(phrases.names[k] for k in owners[owner_first[w] : owner_first[w + 1]])
    if hit_start:
        s, e = np.concatenate(hit_start), np.concatenate(hit_end)
        order = np.argsort(s, kind="stable")
        s, e = s[order], np.maximum.accumulate(e[order])
        new = np.concatenate([[True], s[1:] > e[:-1]])
        s, e = s[new], e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(e) - 1]])]
        doc = np.searchsorted(first, s, side="right") - 1
        for d, a, b in zip(doc.tolist(), (s - first[doc]).tolist(), (e - first[doc]).tolist()):
            found[d][2].append((a, b))
    return found


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between words of one span."""
    at = [m.span() for m in re.finditer(rb"\S+", text.translate(_FOLD))]
    kept, last = [], 0
    for a, b in spans:
        kept.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*kept, text[last:]]).decode(errors="ignore")


def _search_udf(phrases_broadcast, chained: bool, cut: bool):
    """A column of search results per text; with ``cut`` also the text without its spans, null where none was hit."""
    names = ["n_words", "n_hit", "items", "spans", *["clean"] * cut]

    def shard(texts: list[bytes | None], before: list | None) -> list[tuple]:
        rows = []
        for k, (n, items, spans) in enumerate(find_in_shard(texts, phrases_broadcast.value)):
            if before is not None:
                items = items | set(before[k]["items"])
                spans = _merge(spans + [(int(x["start"]), int(x["end"])) for x in before[k]["spans"]])
            row = (n, sum(b - a for a, b in spans), sorted(items), [{"start": a, "end": b} for a, b in spans])
            rows.append((*row, without_spans(texts[k], spans) if spans else None) if cut else row)
        return rows

    def shards(series: pd.Series, before: pd.DataFrame | None) -> pd.DataFrame:
        held, n, first, rows = [], 0, 0, []
        told = None if before is None else before.to_dict("records")
        for i, text in enumerate(series):
            held.append(text)
            n += len(text or b"")
            if n >= _SHARD_BYTES or i == len(series) - 1:
                rows += shard(held, told and told[first : i + 1])
                held, n, first = [], 0, i + 1
        return pd.DataFrame(rows, columns=names)

    schema = RESULT + ", clean string" * cut
    if chained:

        @F.pandas_udf(schema)
        def search(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
            for series, before in batches:
                yield shards(series, before)

    else:

        @F.pandas_udf(schema)
        def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for series in batches:
                yield shards(series, None)

    return search.asNondeterministic()


def _pieces(benchmark: DataFrame, item: Column, text: Column, width: int) -> DataFrame:
    """Distinct (i, t): items as text, long ones in stretches that share ``width - 1`` words, so that no window is lost."""
    rows = benchmark.select(item.alias("i"), text.alias("t")).where(F.octet_length("t") > 0).distinct()

    @F.pandas_udf("array<binary>")
    def cut(texts: pd.Series) -> pd.Series:
        def one(text: bytes) -> list[bytes]:
            if len(text) <= _PIECE_WORDS:
                return [text]
            words = words_of(text)
            return [b" ".join(words[s : s + _PIECE_WORDS + width - 1]) for s in range(0, max(1, len(words) - width + 1), _PIECE_WORDS)]

        return texts.map(one)

    return rows.select("i", F.explode(cut("t")).alias("t")).distinct()


def find_spans(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, block_bytes: int = 4 << 20, out_col: str = "leaks", cut: bool = False) -> DataFrame:
    """``docs`` with a struct column: n_words, n_hit, items (sorted as strings) and merged word spans.

    With ``cut`` the struct also has ``clean``, the text without the spans, null where nothing was hit.

    The benchmark is a stated query set. Its distinct texts are cut into bounded
    stretches and searched in blocks of about ``block_bytes``, each sent to the
    executors once. Between blocks the result so far is written, so that a
    worker holds one block at a time; the results of the blocks are merged. No
    rows are shuffled. Null and wordless texts have no words; null and wordless
    items have no window; an item without id counts under the empty string;
    repeated items count once; texts and items of any length are searched whole.
    """
    spark = docs.sparkSession
    pieces = materialize(_pieces(benchmark, F.col(item_col).cast("string"), utf8(item_text_col), width))
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    before = None
    for b in range(blocks):
        # one block of the stated query set, its size set by block_bytes
        rows = pieces.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        phrases = spark.sparkContext.broadcast(Phrases([(r["i"], bytes(r["t"])) for r in rows], width))
        docs = docs.withColumn(out_col, _search_udf(phrases, b > 0, cut and b == blocks - 1)(utf8(text_col), *([F.col(out_col)] if b else [])))
        if b < blocks - 1:
            path = work_dir(spark)
            docs = materialize(docs, path)
            if before:
                delete(spark, before)
            before = path
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document; other columns are not read.

    Rows are neither added nor lost: repeated rows and texts without words have
    rows too; an empty table gives an empty result. See ``find_spans`` for nulls
    and repeated items.
    """
    found = find_spans(docs.select(F.col(id_col).alias("doc_id"), F.col("text")), benchmark, width=width, out_col="leaks")
    return found.select(
        "doc_id",
        "leaks.n_words",
        "leaks.n_hit",
        F.size("leaks.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leaks.items", ","), 256).alias("items_sha256"),
        (F.col("leaks.n_hit") > 0).alias("contaminated"),
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", width: int = 10) -> DataFrame:
    """``docs`` with every occurrence of a benchmark window cut out of the text, all columns kept.

    A document whose words were all removed is dropped; one that had none is
    kept. Null texts stay null.
    """
    names, leaks = docs.columns, fresh("__leaks", docs)
    found = find_spans(docs, benchmark, text_col=text_col, width=width, out_col=leaks, cut=True)
    kept = found.where((F.col(f"{leaks}.n_hit") == 0) | (F.col(f"{leaks}.n_hit") < F.col(f"{leaks}.n_words")))
    return kept.withColumn(text_col, F.coalesce(f"{leaks}.clean", text_col)).select(*names)
