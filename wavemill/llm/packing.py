"""Best-fit packing of tokenised documents into fixed-length sequences, by hierarchical residual packing.

Each partition packs its own pieces best-fit; nearly full bins are final there.
Underfull bins become items of the next round, where fewer groups pack them
again, until one bounded group is left or a round merges nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fresh, materialize

#: At most so many text chunks are remembered per Python worker (about 80 MB).
_CACHE_CHUNKS = 400_000


class ChunkTokenizer:
    """Token ids of whole texts as little-endian bytes, four per id.

    Byte-level BPE splits texts before every white-space run that follows other
    characters and after every run of letters, so texts of single spaces and
    line ends are cut there and each distinct chunk is tokenised once. Texts
    with any other white space, or with the string of a special token, go
    through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        # in the byte-level alphabet every character of a token stands for one byte
        vocabulary = self._tokenizer.get_vocab()
        self._bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self._bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        spaces = [chr(i) for i in range(0x10000) if chr(i).isspace() and chr(i) not in " \n"]
        special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]  # their strings in a text are one id each
        self._odd = ["  ", "\n\n", " \n", "\n ", *spaces, *special]
        # a run of Latin letters is cut off where white space or plain punctuation shows that it ends
        self._chunks = re.compile(r"[ \n]?[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[ \n.,;:!?]|\Z)|[ \n]?[^ \n]+|[ \n]")
        self._known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """Codes of chunks. Those that begin with white space are joined, tokenised at once and cut by their bytes."""
        joined = [c for c in chunks if len(c) > 1 and c[0] in " \n"]
        single = [c for c in chunks if len(c) == 1 or c[0] not in " \n"]
        codes = dict(zip(single, self._encode(single)))
        if joined:
            raw = self._encode(["".join(joined)])[0]
            token_ends = np.cumsum(self._bytes[np.frombuffer(raw, "<u4")])
            chunk_ends = np.cumsum([len(c.encode()) for c in joined])
            cuts = np.searchsorted(token_ends, chunk_ends)
            if not (token_ends[cuts] == chunk_ends).all():
                raise AssertionError("a token crosses a chunk boundary")
            start = 0
            for c, k in zip(joined, (4 * (cuts + 1)).tolist()):
                codes[c] = raw[start:k]
                start = k
        return codes

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self._odd):
            return self._encode([text])[0]
        chunks = self._chunks.findall(text)
        codes = list(map(self._known.get, chunks))
        if None in codes:
            new = self._encode_chunks(list(dict.fromkeys(c for c, code in zip(chunks, codes) if code is None)))
            if len(self._known) + len(new) <= _CACHE_CHUNKS:
                self._known.update(new)
            codes = [code if code is not None else new[c] for c, code in zip(chunks, codes)]
        return b"".join(codes)


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole unless longer than a sequence, then the first may be shorter."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of every document. Null text is empty: the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = _tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at, piece, start, length, crc = [], [], [], [], []
            for i in range(batch.num_rows):
                codes = tokenizer.encode(texts[i].as_py() or "") + end
                for k, (s, n) in enumerate(cut(len(codes) // 4, capacity)):
                    at.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(codes[4 * s : 4 * (s + n)]))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of every item, and the fill of every bin.

    Open bins are kept by residual; a bit mask of the residuals in use finds
    the tightest bin that still takes an item in constant time.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = used >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                used &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        room -= size
        if room:
            by_room[room].append(b)
            used |= 1 << room
    return bins, offsets, np.array(fill, np.int64)


def pack(pieces: DataFrame, *, capacity: int = 2048, slack: int = 8, block_rows: int = 200_000, group_rows: int = 500_000) -> DataFrame:
    """``pieces`` (column ``length`` from 1 to ``capacity``) with sequence_id and offset.

    A partition packs at most ``block_rows`` pieces at a time. Bins with more
    than ``slack`` free places are items of the next round, dealt by round into
    groups of at most about ``group_rows`` (two numbers each): half as many
    groups as before, until one is left or no two open bins fit together. Equal
    lengths are packed in the order they are read; repeated rows are separate
    items; an empty table gives an empty result. Columns named sequence_id or
    offset are replaced.
    """
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    pieces = pieces.select(names)
    at = names.index("length")
    filled, into, base_col = fresh("fill", pieces), fresh("into", pieces), fresh("base", pieces)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, held
            table = pa.Table.from_batches(held)
            bins, offsets, fill = best_fit(table.column(at).to_numpy(), capacity)
            table = table.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets)).append_column(filled, pa.array(fill[bins]))
            base, held = base + len(fill), []
            yield from table.to_batches(max_chunksize=10_000)

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= block_rows:
                yield from flush()
                rows = 0
        if rows:
            yield from flush()

    kinds = dict(pieces.dtypes)
    placed = materialize(pieces.mapInArrow(local, ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", sequence_id long, offset long, `{filled}` long"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets, fill = best_fit(pdf["fill"].to_numpy(), capacity)
        ids = pdf["bin"].to_numpy()
        head = np.empty(len(fill), np.int64)
        head[bins[offsets == 0]] = ids[offsets == 0]  # a merged bin is named after its first item
        return pd.DataFrame({"bin": ids, "into": head[bins], "base": offsets, "fill": fill[bins]})

    def open_of(bins: DataFrame) -> tuple[DataFrame, int]:
        """The open bins that the smallest of them still fits into, and their number."""
        bins = materialize(bins.where(F.col("fill") < capacity - slack).distinct())
        least = bins.agg(F.min("fill")).first()[0]
        fitting = bins.where(F.col("fill") + F.lit(least or 0) <= capacity)
        return fitting, fitting.count()

    open_bins, count = open_of(placed.select(F.col("sequence_id").alias("bin"), F.col(filled).alias("fill")))
    moves, groups, turn = None, None, 0
    while count > 1 and groups != 1:
        groups = max(-(-count // group_rows), 1 if groups is None else -(-groups // 2))
        dealt = open_bins.withColumn("g", F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups)))
        merged = materialize(dealt.groupBy("g").applyInPandas(lambda pdf: merge(pdf), "bin long, into long, base long, fill long"))
        step = merged.select(F.col("bin").alias("into"), F.col("into").alias("to"), F.col("base").alias("more"))
        if moves is None:
            moves = merged.select("bin", "into", "base")
        else:  # every open bin is named after one of the first round, which is listed as its own target
            moves = materialize(moves.join(step, "into", "left").select("bin", F.coalesce("to", "into").alias("into"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base")))
        open_bins, left = open_of(merged.select(F.col("into").alias("bin"), "fill"))
        if left == count and turn % 2 and groups == -(-count // group_rows):
            break  # two rounds of other neighbours merged nothing, and the groups cannot be fewer
        count, turn = left, turn + 1
    placed = placed.drop(filled)
    if moves is None:
        return placed
    joined = placed.join(moves.withColumnsRenamed({"bin": "sequence_id", "into": into, "base": base_col}), "sequence_id", "left")
    return joined.select(
        *names, F.coalesce(into, "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce(base_col, F.lit(0))).alias("offset")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces placed in sequences of at most ``capacity`` ids.

    Null and empty texts are the end id alone; a very long text is cut into
    pieces of ``capacity`` ids, its first piece may be shorter; repeated rows are
    packed as often as they occur; an empty table gives an empty result; other
    columns are not read.
    """
    return pack(materialize(token_pieces(docs, tokenizer_path, capacity=capacity, id_col=id_col, text_col=text_col)), capacity=capacity)
