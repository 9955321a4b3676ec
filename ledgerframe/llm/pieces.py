"""SentencePiece encoding that keeps the source bytes of every piece.

Normalisation takes, at each place of the text, the longest prefix that the model's compiled character map holds (a double-array
trie of the model's own file) and records which source bytes it came from; white space then becomes the escape U+2581. Pieces cover the normalised bytes in order, so
their byte lengths project every piece back to a span of the original text. A model without a map leaves all bytes as they
are; there, whole texts are aligned by numpy.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fixed_path, slices

MODEL = "piece_bpe_32k.model"
_ESCAPE = "▁".encode()


class CharMap:
    """The compiled character map: a little-endian size, a double-array trie of so many bytes, then replacements ended by a zero byte."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest prefix of ``text[at:]`` in the map: its bytes and what replaces it."""
        if not self.units:
            return None
        found, units, unit = None, self.units, self.units[0]
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
                start = units[node] & 0x7FFFFFFF
                found = (i - at + 1, self.strings[start : self.strings.index(b"\0", start)])
        return found


class Pieces:
    """A SentencePiece model with source spans. ``add_dummy_prefix`` and ``remove_extra_whitespaces`` are followed as the model says."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self._take(proto)

    @classmethod
    def of(cls, proto) -> Pieces:
        """The model of a parsed model file."""
        pieces = cls.__new__(cls)
        pieces._take(proto)
        return pieces

    def _take(self, proto) -> None:
        spec = proto.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        lengths = [1 if self.model.is_byte(i) else len(self.model.id_to_piece(i).encode()) for i in range(self.model.get_piece_size())]
        self.lengths = np.array(lengths, np.int64)
        self.unknown = self.model.unk_id()

    def align(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where in the source each byte of the normalised text begins and ends."""
        raw = text.encode()
        if not raw:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.map.units and not self.squeeze and self.escape:
            space = np.frombuffer(raw, np.uint8) == 0x20
            times = np.where(space, len(_ESCAPE), 1)
            begin = np.repeat(np.arange(len(raw)), times)
            end = begin + 1
            head = len(_ESCAPE) * bool(self.prefix)
            return np.concatenate([np.zeros(head, np.int64), begin]), np.concatenate([np.zeros(head, np.int64), end])
        out: list[tuple[bytes, int, int]] = []
        at, spaced = 0, False
        while at < len(raw):
            if hit := self.map.longest(raw, at):
                n, new = hit
            else:
                n = 1 + sum(raw[at] >= x for x in (0xC0, 0xE0, 0xF0))
                new = raw[at : at + n]
            if spaced and self.squeeze:
                new = new.lstrip(b" ")
            out.append((new, at, at + n))
            spaced = new.endswith(b" ") if new else spaced
            at += n
        if self.squeeze:  # no white space at either end
            while out and not out[0][0].strip(b" "):
                out.pop(0)
            if out:
                out[0] = (out[0][0].lstrip(b" "), *out[0][1:])
            while out and not out[-1][0].strip(b" "):
                out.pop()
            if out:
                out[-1] = (out[-1][0].rstrip(b" "), *out[-1][1:])
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.prefix:
            out.insert(0, (b" ", out[0][1], out[0][1]))
        spans = [(a, b) for new, a, b in out for _ in range(len(new.replace(b" ", _ESCAPE) if self.escape else new))]
        begin, end = np.array(spans, np.int64).reshape(-1, 2).T
        return begin, end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The source bytes [start, end) of every piece."""
        begin, end = self.align(text)
        lengths = self.lengths[ids]
        if (ids == self.unknown).any():  # an unknown piece is as long as what it stands for, which only the library knows
            lengths = np.array([len(p.piece.encode()) if p.id == self.unknown else n for p, n in zip(self.model.encode(text, out_type="proto").pieces, lengths, strict=True)], np.int64)
        stop = np.cumsum(lengths)
        if len(stop) and stop[-1] != len(begin):
            raise ValueError("the pieces do not cover the normalised text")
        return begin[stop - lengths], end[stop - 1]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        eos = pieces.model.eos_id()
        for batch in slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = pieces.encode(texts)
            spans = [pieces.spans(t, x) for t, x in zip(texts, ids, strict=True)]
            decoded = pieces.model.decode([x.tolist() for x in ids]) if ids else []
            size = np.array([len(t.encode()) for t in texts], np.int64)
            offsets = pa.array(np.cumsum([0, *(len(x) + 1 for x in ids)]).astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([z for x, n in zip(part, size, strict=True) for z in (x, last(n))]).astype(np.int32)))
                for part, last in ((ids, lambda n: [eos]), ([a for a, _ in spans], lambda n: [n]), ([b for _, b in spans], lambda n: [n]))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "starts", "ends", "decoded"])

    return run


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends, decoded) of every row: the library's ids and an end id, each id's source bytes, the decoded text.

    ids are those of the sentencepiece library without sampling; the end id's span is empty, at the text's end. Null texts are empty
    texts (an end id alone), very long texts are encoded whole. Ids may be null or repeated; each row stands for itself. Other columns, whatever
    their names, are ignored. An empty table gives an empty result. ``model``: a model's path, else the public one named in ``MODEL``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(fixed_path(MODEL, model)), "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, starts, ends = (batch.column(i) for i in (1, 2, 3))
        offsets = np.asarray(ids.offsets)
        first, last = (np.asarray(x.flatten()).astype("<u4") for x in (starts, ends))
        numbers = pa.compute.binary_join(pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.string())), " ")
        texts = [hashlib.sha256(x.as_buffer()).hexdigest() for x in numbers]
        decoded = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(4)]
        spans = []
        for a, b in zip((offsets - offsets[0]).tolist(), (offsets[1:] - offsets[0]).tolist(), strict=False):
            digest = hashlib.sha256(first[a:b])
            digest.update(last[a:b])
            spans.append(digest.hexdigest())
        counts = pa.array(np.diff(offsets).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), counts, *(pa.array(x, pa.string()) for x in (texts, decoded, spans))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256) of rows of ``encode``.

    SHA-256 of the decimal ids joined by a space, of the decoded text, and of all starts, then all ends, as little-endian unsigned 32-bit integers.
    """
    return encoded.select("doc_id", "ids", "starts", "ends", "decoded").mapInArrow(_digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
