"""Byte-level BPE by a sentencepiece model that is written straight from a vocabulary of ranks.

The model's pieces are the vocabulary's byte strings, each byte mapped to one printable code point, scored
by negative rank, with identity normalisation. A BPE step of sentencepiece joins the adjacent pair whose
piece scores best, leftmost first, which is the pair of least rank: the same ids as by the ranks.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .blocks import lean
from .workspace import small_batches

#: Distinct pre-tokens whose ids a worker keeps; when full, it starts again.
CACHE = 150_000


def byte_characters() -> list[str]:
    """One printable character per byte: the byte's own where Latin-1 prints it, else the next one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in set(own) else chr(next(other)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a vocabulary file with a base64 string and a rank a line, by rank. Ranks must be 0, 1, 2 and so on, and hold every single byte."""
    pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line.strip()]
    by_rank = {int(rank): base64.b64decode(piece) for piece, rank in pairs}
    pieces = [by_rank[k] for k in range(len(by_rank))]
    if len(set(pieces)) != len(pieces) or not {bytes([b]) for b in range(256)} <= set(pieces):
        raise ValueError("not a byte-level vocabulary")
    return pieces


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while True:
        out.append((n & 0x7F) | (0x80 if n > 0x7F else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(int(value))


def model_proto(pieces: list[bytes]) -> bytes:
    """A serialised sentencepiece model: piece k is pieces[k] with its bytes mapped and score -k; the unknown piece comes last."""
    to = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    out = [_field(1, _field(1, "".join(to[b] for b in piece).encode()) + _field(2, -float(rank)) + _field(3, normal)) for rank, piece in enumerate(pieces)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, -float(len(pieces))) + _field(3, unknown)))
    # trainer_spec: model_type, vocab_size, treat no whitespace specially, unk/bos/eos/pad ids
    out.append(_field(2, _field(3, bpe) + _field(4, len(pieces) + 1) + _field(22, 0) + _field(40, len(pieces)) + _field(41, -1) + _field(42, -1) + _field(43, -1)))
    # normalizer_spec: identity, no dummy prefix, keep and don't escape whitespace
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class ByteBpe:
    """Encoder and decoder of one vocabulary, built once per worker."""

    def __init__(self, pieces: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.pieces = pieces
        self._find = regex.compile(pattern).findall
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(pieces))
        self._to = {b: c for b, c in enumerate(byte_characters())}
        self._known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers, the text's pre-tokens each by itself."""
        tokens = self._find(text)
        if len(self._known) > CACHE:
            self._known = {}
        known = self._known
        new = list(set(tokens).difference(known))
        if new:
            mapped = [t.encode().decode("latin-1").translate(self._to) for t in new]
            for t, ids in zip(new, self._model.encode(mapped, out_type=int, num_threads=1), strict=True):
                known[t] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(known.__getitem__, tokens))

    def forget(self) -> None:
        """Drop the kept pre-tokens: a worker outlives its task, and later ones need the memory."""
        self._known = {}

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, memoryview(ids).cast("I")))


_CODECS: dict[tuple, ByteBpe] = {}


def _codec(pieces: list[bytes], pattern: str) -> ByteBpe:
    key = (len(pieces), hash(tuple(pieces)), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = ByteBpe(pieces, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode every whole text by the ranks in the file `vocabulary` and decode the ids again.

    Returns per row: the id column, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit
    integers), decoded_sha256 (of the decoded bytes), and with keep_ids also ids (array of int) and decoded
    (string). A null text counts as empty: no ids. Rows keep their number: repeated ids and texts are
    encoded each by itself. Other columns are ignored. A vocabulary's size doesn't grow with the data, so
    it goes to the workers whole; no row leaves its partition.
    """
    small_batches(docs.sparkSession)
    pieces = read_ranks(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                n, of_ids, of_bytes, ids, texts = [], [], [], [], []
                for text in pc.fill_null(batch.column(1), "").to_pylist():
                    packed = codec.encode(text)
                    back = codec.decode(packed)
                    n.append(len(packed) // 4)
                    of_ids.append(hashlib.sha256(packed).hexdigest())
                    of_bytes.append(hashlib.sha256(back).hexdigest())
                    if keep_ids:
                        ids.append(memoryview(packed).cast("I").tolist())
                        texts.append(back.decode())
                out = [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    out += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names)
        codec.forget()

    return docs.select(id_col, text_col).mapInArrow(lean(run), schema)
