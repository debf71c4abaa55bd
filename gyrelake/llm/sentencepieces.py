"""SentencePiece encoding and decoding with source offsets.

A model file holds a compiled character map (a double array whose values point at replacement strings). `Normaliser`
walks it for the longest prefix at each place, as the library does, and records for every byte it writes the source byte
it comes from. Pieces cover the normalised text without gaps, so the lengths of their surfaces, added up, project each
piece to its span of source bytes.

Defined results: a null text equals an empty one, which encodes to the end id alone and decodes to an empty text; white
space, control characters and bytes outside the vocabulary are kept through the model's byte pieces; repeated rows are
encoded each for itself; an empty table gives an empty result; a null doc_id is kept.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The mark that stands for a space in the normalised text (the format's fixed value), in UTF-8.
SPACE = "▁".encode()
#: Characters of the texts that a task remembers, to answer copies without encoding them again.
REMEMBERED = 16_000_000
ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("source_bytes", pa.int64()), ("spans_sha256", pa.string()), ("covered_bytes", pa.int64())])
PIECES = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


class Normaliser:
    """Longest-prefix normalisation through a compiled character map, with the source byte of every byte written.

    The map is: a little-endian 32-bit size, so many bytes of double-array units, then the replacements, each ended by
    a zero byte. Without a map every character stands for itself.
    """

    def __init__(self, charsmap: bytes, dummy_prefix: bool = True, squeeze: bool = True, escape: bool = True):
        self.dummy_prefix, self.squeeze = dummy_prefix, squeeze
        self.space = SPACE if escape else b" "
        self.units = self.texts = b""
        if charsmap:
            (size,) = struct.unpack_from("<I", charsmap)
            self.units = np.frombuffer(charsmap, "<u4", size // 4, 4).tolist()
            self.texts = charsmap[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, int] | None:
        """(bytes read, place of the replacement) of the longest key that begins at `at`; a unit holds an offset to its
        children, a label and, where a key ends, a flag for the child that holds the value."""
        units, best = self.units, None
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(raw)):
            node ^= raw[i]
            unit = units[node]
            if unit & 0x800000FF != raw[i]:
                return best
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best = (i + 1 - at, units[node] & 0x7FFFFFFF)
        return best

    def __call__(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and, for each of them and for the end, the source byte it comes from."""
        if self.units:
            out, source = self._mapped(raw)
        else:
            out, source = raw, np.arange(len(raw) + 1)
        if self.squeeze:
            out, source = self._squeezed(out, source)
        if len(self.space) > 1:
            width = np.ones(len(source), np.int64)
            width[np.flatnonzero(np.frombuffer(out, np.uint8) == 32)] = len(self.space)
            source = np.repeat(source, width)
        out = out.replace(b" ", self.space)
        if self.dummy_prefix and out:
            out, source = self.space + out, np.append(np.full(len(self.space), source[0]), source)
        return out, source

    def _mapped(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        parts, source, at = [], [], 0
        while at < len(raw):
            found = self.longest(raw, at)
            if found:
                read, place = found
                text = self.texts[place : self.texts.index(b"\0", place)]
            else:
                read = 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
                text = raw[at : at + read]
            parts.append(text)
            source += [at] * len(text) if found else range(at, at + read)
            at += read
        return b"".join(parts), np.array([*source, len(raw)], np.int64)

    @staticmethod
    def _squeezed(out: bytes, source: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Without spaces at both ends and after another space."""
        chars = np.frombuffer(out, np.uint8)
        space = chars == 32
        keep = ~space | ~np.append(True, space[:-1])[: len(space)]
        kept = np.flatnonzero(keep)
        if len(kept) and space[kept[-1]]:
            kept = kept[:-1]
        end = source[kept[-1] + 1] if len(kept) else source[-1]
        return chars[kept].tobytes(), np.append(source[kept], end)


class Pieces:
    """Encoding to ids and spans, and decoding, with a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.normalise = Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end_id = self.library.eos_id()
        self.unknown = self.library.unk_id()
        kinds = model.SentencePiece
        self.width = np.array([1 if p.type == kinds.BYTE else 0 if p.type == kinds.CONTROL else len(p.piece.encode()) for p in model.pieces])

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text) + [self.end_id]

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray] | None:
        """Start and end source bytes of every id. A piece written from one source place takes all of it. None if the
        pieces are not those of our own normalised text, as with a model whose rules the walk does not know."""
        out, source = self.normalise(text.encode())
        width = self.width[ids]
        if self.unknown in ids:
            width[np.equal(ids, self.unknown)] = self._unknown(text)
        ends = np.cumsum(width)
        if ends[-1] != len(out):
            return None
        first, last, after = source[ends - width], source[np.maximum(ends - 1, 0)], source[ends]
        inside = (after == last) & (width > 0)  # the next piece begins in what the same source place wrote
        if inside.any():
            after[inside] = source[np.searchsorted(source, last[inside], side="right")]
        return first, after

    def _unknown(self, text: str) -> list[int]:
        proto = self.library.encode(text, out_type="immutable_proto")
        return [len(p.piece.encode()) for p in proto.pieces if p.id == self.unknown]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def _digests(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = Pieces(path)
    words = [str(i) for i in range(model.library.get_piece_size())]
    met: dict[str, tuple] = {}
    held = 0

    def row(text: str) -> tuple:
        ids = model.ids(text)
        joined = " ".join(map(words.__getitem__, ids)).encode()
        decoded = model.decode(ids).encode()
        spans = model.spans(text, ids)
        told = (hashlib.sha256(np.stack(spans).astype("<i8").tobytes()).hexdigest(), _covered(*spans)) if spans else (None, None)
        return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest(), len(text.encode()), *told

    for batch in batches:
        rows = []
        for text in batch["text"].to_pylist():
            text = text or ""
            if (found := met.get(text)) is None:
                found = row(text)
                if held + len(text) > REMEMBERED:
                    met.clear()
                    held = 0
                if len(text) <= REMEMBERED // 100:
                    met[text] = found
                    held += len(text)
            rows.append(found)
        columns = [*zip(*rows, strict=True)] or [[]] * (len(ENCODED) - 1)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, f.type) for c, f in zip(columns, [*ENCODED][1:], strict=True))], schema=ENCODED)


def _covered(first: np.ndarray, last: np.ndarray) -> int:
    """Bytes in the union of spans that begin in order."""
    reach = np.maximum.accumulate(np.append(0, last))
    return int(np.maximum(last - np.maximum(first, reach[:-1]), 0).sum())


def _spanned(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = Pieces(path)
    for batch in batches:
        out = {name: [] for name in PIECES.names}
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            ids = model.ids(text or "")
            first, last = model.spans(text or "", ids) or (None, None)
            for name, x in zip(PIECES.names, (doc_id, ids, first, last), strict=True):
                out[name].append(x)
        yield pa.RecordBatch.from_pydict(out, PIECES)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (with the end id), starts and ends: each id's span of source bytes (null where they cannot be told)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_spanned, path), "doc_id long, ids array<int>, starts array<long>, ends array<long>")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, source_bytes, spans_sha256 (of all starts, then all ends,
    as little-endian 64-bit numbers) and covered_bytes (bytes in a piece's span)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        partial(_digests, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, source_bytes long, spans_sha256 string, covered_bytes long"
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(path)
        for batch in batches:
            texts = [model.decode([] if x is None else x) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
