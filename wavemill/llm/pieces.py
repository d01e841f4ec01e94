"""Sentence pieces with their place in the original text.

A text is normalised here, by longest prefixes of the model's compiled character
map, and every normalised byte keeps the source offset it came from. The
library then cuts the normalised text into pieces (with a copy of the model whose
own normaliser does nothing), and each piece's stretch of normalised bytes is
projected through the alignment to a span of the original UTF-8 bytes.

Null texts count as empty: only the end id, if asked for, at span (0, 0). Texts of
any length are read whole, one at a time, so a worker holds the pieces of one
Arrow slice of bounded text. Equal rows get equal pieces; nothing depends on order.
An empty table gives an empty table. Existing columns pass unread; new
names are lengthened where a column has them already.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import fresh

_SPACE = np.frombuffer("▁".encode(), np.uint8)
#: Kinds of pieces in the model file.
_UNKNOWN, _CONTROL, _USER, _BYTE = 2, 3, 4, 6
_SLICE_CHARS = 1_000_000


class CharacterMap:
    """The compiled map: a double-array trie of byte strings whose leaves point at zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4) if size else np.zeros(0, np.uint32)
        self.strings = blob[4 + size :]

    def longest(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, replacement offset) of the longest prefix at every start, length 0 where none; all starts go down the trie at once."""
        length, value = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if not len(self.units):
            return length, value
        open_ = np.arange(len(starts))
        node = np.full(len(starts), self._child(self.units[:1])[0], np.int64)
        depth = 0
        while len(open_):
            inside = starts[open_] + depth < len(data)
            open_, node = open_[inside], node[inside]
            byte = data[starts[open_] + depth].astype(np.int64)
            at = node ^ byte
            unit = self.units[at]
            same = (unit & np.uint32(0x800000FF)) == byte
            open_, at, unit = open_[same], at[same], unit[same]
            node = at ^ self._child(unit)
            depth += 1
            leaf = (unit >> np.uint32(8)) & np.uint32(1) == 1
            length[open_[leaf]] = depth
            value[open_[leaf]] = self.units[node[leaf]] & np.uint32(0x7FFFFFFF)
        return length, value

    @staticmethod
    def _child(unit: np.ndarray) -> np.ndarray:
        return (unit >> np.uint32(10)).astype(np.int64) << ((unit & np.uint32(512)) >> np.uint32(6)).astype(np.int64)

    def replacement(self, at: int) -> bytes:
        return self.strings[at : self.strings.index(b"\0", at)]


class Normalizer:
    """The model's normalisation with alignment: ``run`` gives the bytes, and for each of them (and the end) its source offset."""

    def __init__(self, spec, symbols: list[str]):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        found = b"|".join(re.escape(s.encode()) for s in sorted(symbols, key=lambda s: -len(s.encode())))
        self.symbols = re.compile(b"(?=(" + found + b"))") if symbols else None

    def _replaced(self, raw: bytes, data: np.ndarray) -> list[tuple[int, int, bytes]]:
        """(start, end, replacement) of the prefixes taken from left to right; all else goes through character by character."""
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        length, value = self.map.longest(data, starts)
        hits = {int(starts[i]): (int(length[i]), None, int(value[i])) for i in np.flatnonzero(length)}
        if self.symbols:  # symbols of the model stay as they are
            hits |= {m.start(): (len(m[1]), m[1], 0) for m in self.symbols.finditer(raw)}
        out, at = [], 0
        for start in sorted(hits):
            if start >= at:
                n, text, place = hits[start]
                out.append((start, start + n, self.map.replacement(place) if text is None else text))
                at = start + n
        return out

    def run(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(raw, np.uint8)
        if not len(data):
            return data, np.zeros(1, np.int64)
        source = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(len(data)), 0))
        parts, aligned, at, made, wide = [], [], 0, 0, []
        swaps = self._replaced(raw, data)
        for start, end, text in swaps:
            parts += [data[at:start], np.frombuffer(text, np.uint8)]
            aligned += [source[at:start], np.full(len(text), start, np.int64)]
            made += start - at
            if len(text) > 1 and b" " in text:
                wide.append((made, made + len(text)))
            made, at = made + len(text), end
        out, source = np.concatenate([*parts, data[at:]]), np.concatenate([*aligned, source[at:]])
        first = 0
        if self.squeeze:
            first = self._leading(data, swaps)
            out, source = self._squeezed(out, source, wide)
        if self.prefix:
            out, source = np.concatenate([[np.uint8(32)], out]), np.concatenate([[first], source])
            fixed = np.concatenate([[True], np.zeros(len(out) - 1, bool)])  # a space even where spaces are not escaped
        else:
            fixed = np.zeros(len(out), bool)
        if self.escape or fixed.any():
            blank = out == 32 if self.escape else fixed & False
            times = np.where(blank, 3, 1)
            where = np.cumsum(times) - times
            out, source = np.repeat(out, times), np.repeat(source, times)
            for i in range(3):
                out[where[blank] + i] = _SPACE[i]
        end = len(data)
        if self.squeeze:
            space = _SPACE if self.escape else np.array([32], np.uint8)
            keep = len(out)
            while keep >= len(space) and (out[keep - len(space) : keep] == space).all():
                keep -= len(space)
                end = int(source[keep])
            out, source = out[:keep], source[:keep]
        return out, np.append(source, end)

    @staticmethod
    def _leading(data: np.ndarray, swaps: list[tuple[int, int, bytes]]) -> int:
        """Where the text starts after prefixes that become one space."""
        at, told = 0, {s: (e, t) for s, e, t in swaps}
        while at < len(data):
            end, text = told.get(at, (at + 1, bytes(data[at : at + 1])))
            if text != b" ":
                break
            at = end
        return at

    @staticmethod
    def _squeezed(out: np.ndarray, source: np.ndarray, wide: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Without spaces that follow a space; inside a replacement only its leading ones can go."""
        space = out == 32
        drop = space & np.concatenate([[True], space[:-1]])
        for a, b in wide:
            lead = a
            while lead < b and space[lead]:
                lead += 1
            drop[a:lead] = a == 0 or space[a - 1]
            drop[lead:b] = False
        return out[~drop], source[~drop]


class PieceModel:
    """A model's pieces, its normaliser with alignment, and the library for cutting and decoding."""

    def __init__(self, blob: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(blob)
        if model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with white space as a suffix are not covered")
        self.normalizer = Normalizer(model.normalizer_spec, [p.piece for p in model.pieces if p.type == _USER])
        self.bytes_of = np.array([1 if p.type == _BYTE else 0 if p.type == _CONTROL else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=blob)
        spec = model.normalizer_spec
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.unknown, self.end = self.whole.unk_id(), self.whole.eos_id()

    def encode(self, text: str, end: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends): spans are offsets in the text's UTF-8 bytes; of a character in byte pieces the last has the whole span."""
        raw = text.encode("utf-8", "replace")
        data, source = self.normalizer.run(raw)
        said = data.tobytes().decode()
        ids = self.cutter.encode(said, return_type="numpy").astype(np.int32, copy=False)
        lengths = self.bytes_of[ids] if len(ids) else np.zeros(0, np.int64)
        if (ids == self.unknown).any():  # a run of unknown characters is one piece of any length
            lengths = np.array([len(p.surface.encode()) for p in self.cutter.encode(said, return_type="proto").pieces], np.int64)
        places = np.concatenate([[0], np.cumsum(lengths)])
        begins, ends = source[places[:-1]], source[places[1:]]
        if end:
            ids, begins, ends = np.append(ids, np.int32(self.end)), np.append(begins, len(raw)), np.append(ends, len(raw))
        return ids, begins.astype(np.int32), ends.astype(np.int32)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return self.whole.decode(ids)


@lru_cache(maxsize=2)
def load(blob: bytes) -> PieceModel:
    return PieceModel(blob)


def _blob(model: str | bytes) -> bytes:
    """The model file's content; a path is read on the driver and its content goes with the tasks."""
    return model if isinstance(model, bytes) else Path(model).read_bytes()


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)]), pa.int32()))


def _slices(batch: pa.RecordBatch, sizes: list[int], most: int) -> Iterator[pa.RecordBatch]:
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _with(df: DataFrame, fields: list[StructField], run) -> DataFrame:
    return df.mapInArrow(run, StructType([*df.schema.fields, *fields]))


def encode_pieces(docs: DataFrame, model: str | bytes, *, text_col: str = "text", end: bool = True, names: tuple[str, str, str] = ("ids", "begins", "ends")) -> DataFrame:
    """``docs`` with the ids of each text and the byte span of each id. Nothing is shuffled."""
    blob = _blob(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(blob)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at)
            sizes = [0 if n is None else n for n in pa.compute.binary_length(texts.cast(pa.large_string())).to_pylist()]
            for part in _slices(batch, sizes, _SLICE_CHARS):
                rows = [codec.encode(t or "", end) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, *[_lists([r[i] for r in rows]) for i in range(3)]], names=[*batch.schema.names, *new])

    import pyarrow.compute  # noqa: F401  makes pa.compute known

    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    new = [fresh(n, docs) for n in names]
    return _with(docs, [StructField(n, ArrayType(IntegerType(), False), False) for n in new], run)


def decode_pieces(df: DataFrame, model: str | bytes, *, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids stand for; null ids count as none."""
    blob = _blob(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(blob)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            sizes = [0 if n is None else 4 * n for n in pa.compute.list_value_length(batch.column(at)).to_pylist()]
            for part in _slices(batch, sizes, _SLICE_CHARS):
                lists = part.column(at)
                sizes_of = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                rows = np.split(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32, copy=False), np.cumsum(sizes_of)[:-1])
                texts = pa.array([codec.decode(ids) if len(ids) else "" for ids in rows], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*batch.schema.names, new])

    import pyarrow.compute  # noqa: F401  makes pa.compute known

    new = fresh(name, df)
    return _with(df, [StructField(new, StringType(), False)], run)


def piece_digests(docs: DataFrame, model: str | bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256): encoded, then decoded; only the id and the text are read."""
    told = decode_pieces(encode_pieces(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model), model)

    def joined(c: str):
        return F.array_join(F.col(c).cast("array<string>"), " ")

    return told.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined("ids"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(F.concat_ws("|", joined("begins"), joined("ends")), 256).alias("spans_sha256"),
    )
