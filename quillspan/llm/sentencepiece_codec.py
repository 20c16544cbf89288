"""SentencePiece encoding with the original byte span of every piece, and decoding.

The text is normalised by longest prefixes through the model's compiled
character map, which records where each normalised byte comes from; pieces are
laid over the normalised text and projected back to byte spans of the input.

Pieces of the models handled here never continue past a white-space mark, so
the normalised text falls into chunks (marks, then other characters) that are
encoded on their own. A worker remembers the pieces of chunks it has met. Where
a model lacks that property, whole texts go to the library.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import documents, slices

MARK = "▁"
MARK_BYTES = MARK.encode()
#: A worker forgets its chunks beyond so many chunks or pieces.
CACHE_CHUNKS, CACHE_PIECES = 300_000, 4_000_000


class CharacterMap:
    """The compiled map of a model: a double-array trie of source strings, then their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if blob else []
        self.strings = blob[4 + size :] if blob else b""

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest source string at `at`, and its replacement."""
        if not self.units:
            return None
        units, node, found = self.units, 0, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.strings.find(b"\0", found[1])
        return found[0], self.strings[found[1] : end]


class Normalizer:
    """Normalised bytes and, for each of them and the end, the byte of the source it comes from."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.plain = not self.map.units and not self.squeeze and self.escape

    def align(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if not text:
            return b"", np.zeros(1, np.int32)
        return self._plain(text) if self.plain else self._mapped(text)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """No entry of the map matches: every byte is its own longest prefix, blanks become marks."""
        out = text.replace(b" ", MARK_BYTES)
        width = np.where(np.frombuffer(text, np.uint8) == 32, 3, 1)
        source = np.repeat(np.arange(len(text), dtype=np.int32), width)
        head = 3 if self.dummy else 0
        return MARK_BYTES * bool(head) + out, np.concatenate((np.zeros(head, np.int32), source, [len(text)])).astype(np.int32)

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        blank = MARK_BYTES if self.escape else b" "
        pieces: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(text):
            hit = self.map.longest(text, at)
            if hit is None:
                width = 1 if text[at] < 0xC0 else 2 if text[at] < 0xE0 else 3 if text[at] < 0xF0 else 4
                hit = (width, text[at : at + width])
            pieces.append((hit[1], at, at + hit[0]))
            at += hit[0]
        out, source = bytearray(), []
        quiet = self.squeeze  # leading blanks go
        if self.dummy:
            out += blank
            source += [0] * len(blank)
        end = 0
        for new, start, stop in pieces:
            for k in range(len(new)):
                byte = new[k : k + 1]
                if byte == b" ":
                    if quiet:
                        continue
                    quiet, byte = self.squeeze, blank
                else:
                    quiet = False
                out += byte
                source += [start] * len(byte)
            end = stop
        if self.squeeze:
            while out.endswith(blank) and len(out) > len(blank) * self.dummy:
                end = source[-len(blank)]
                del out[-len(blank) :], source[-len(blank) :]
            if bytes(out) == blank:
                return b"", np.zeros(1, np.int32)
        return bytes(out), np.array([*source, end], dtype=np.int32)


class Codec:
    """Encodes and decodes as the library does, with byte spans."""

    def __init__(self, model_path: str | None = None, model: bytes | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = model or open(model_path, "rb").read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.normalizer = Normalizer(proto.normalizer_spec)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.width = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces], dtype=np.int64)
        self.fallback = proto.trainer_spec.byte_fallback
        inner = any(MARK in p.piece.lstrip(MARK) or p.type == kinds.USER_DEFINED for p in proto.pieces)
        self.chunked = self.normalizer.plain and self.normalizer.dummy and self.fallback and proto.trainer_spec.model_type == 2 and not inner
        self.alone = [self.library.piece_to_id(MARK)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.begin = array("i"), array("q", [0])

    def _learn(self, chunk: str) -> None:
        self.known[chunk] = len(self.begin) - 1
        self.flat.extend(self.library.encode(chunk) if chunk else self.alone)
        self.begin.append(len(self.flat))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offset at which each text's ids begin."""
        if not self.chunked:
            ids = self.library.encode(texts, num_threads=1) if texts else []
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((x for row in ids for x in row), np.int32, int(sizes.sum())), np.concatenate(([0], np.cumsum(sizes)))
        if len(self.known) > CACHE_CHUNKS or len(self.flat) > CACHE_PIECES:
            self.forget()
        known, chunks, sizes = self.known, [], []
        for text in texts:
            text = text.replace(MARK, " ")
            parts = text.split(" ") if text else []
            if "" in parts:  # several blanks in a row, or at an end
                parts = [p[1:] for p in re.findall(r" +[^ ]*", " " + text)]
            sizes.append(len(parts))
            chunks += parts
        for chunk in set(chunks).difference(known):
            self._learn(chunk)
        number = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
        begin, flat = np.frombuffer(self.begin, np.int64), np.frombuffer(self.flat, np.int32) if self.flat else np.zeros(0, np.int32)
        count = begin[number + 1] - begin[number] if len(number) else number
        total = np.concatenate(([0], np.cumsum(count)))
        ids = flat[np.repeat(begin[number] - total[:-1], count) + np.arange(total[-1])] if len(number) else flat[:0]
        return ids, total[np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64)))).astype(np.int64)]

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end bytes in `text` of each piece."""
        _, source = self.normalizer.align(text)
        if not self.fallback and (ids == self.library.unk_id()).any():
            return self._library_spans(text)
        ends = np.cumsum(self.width[ids])
        return source[ends - self.width[ids]], source[ends]

    def _library_spans(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Unknown pieces have the width of their characters, which only the library tells."""
        norm, source = self.normalizer.align(text)
        widths = [len(p.encode()) for p in self.library.encode_as_pieces(text.decode("utf-8", "replace"))]
        ends = np.cumsum(widths)
        return source[ends - widths], source[ends]


def _encode(model: bytes, columns: list[str], fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model=model)
        for batch in slices(batches, 500):
            raw = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            ids, begin = codec.encode([t.decode("utf-8", "replace") for t in raw])
            starts, ends = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32)
            for i, text in enumerate(raw):
                part = slice(begin[i], begin[i + 1])
                starts[part], ends[part] = codec.spans(text, ids[part])
            offsets = pa.array(begin.astype(np.int32))
            made = {"ids": ids, "span_starts": starts, "span_ends": ends}
            out = [pa.ListArray.from_arrays(offsets, pa.array(made[c])) for c in columns if c in made]
            if "decoded" in columns:
                flat = ids.tolist()
                out.append(pa.array(codec.library.decode([flat[begin[i] : begin[i + 1]] for i in range(len(raw))]), pa.string()))
            yield pa.record_batch([*(batch.column(c) for c in fields), *out], names=[*fields, *columns])

    return run


TYPES = {"ids": "array<int>", "span_starts": "array<int>", "span_ends": "array<int>", "decoded": "string"}


def encode(docs: DataFrame, model_path: str, columns: tuple[str, ...] = ("ids", "span_starts", "span_ends", "decoded")) -> DataFrame:
    """docs with the chosen columns of: ids, span_starts, span_ends (bytes of text in UTF-8), decoded.

    ids equal the library's, without begin or end ids. All columns of docs are
    kept, but for those of the same names. Null text is empty: no ids, decoded
    "". A row depends on its text alone, so repeated rows and empty tables need
    no care. The model file is read on the driver and travels with the tasks.
    """
    columns = tuple(c for c in TYPES if c in columns)
    docs = docs.drop(*columns)
    with open(model_path, "rb") as f:
        model = f.read()
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(_encode(model, list(columns), docs.columns), ", ".join([*fields, *(f"{c} {TYPES[c]}" for c in columns)]))


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode(documents(spark, sf_dir).select("doc_id", "text"), model_path)
    covered = F.when(F.size("ids") > 0, F.element_at("span_ends", -1) - F.element_at("span_starts", 1)).otherwise(0)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        covered.cast("long").alias("covered_bytes"),
    )
