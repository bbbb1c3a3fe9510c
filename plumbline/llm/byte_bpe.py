"""Byte-level BPE with a sentencepiece model made from a rank file.

Every byte is mapped to one printable character.  The model is serialised field by field: one
piece for each token (its mapped bytes), scored by its negative rank, BPE type, a normaliser
that changes nothing.  sentencepiece then merges the pair of best score, leftmost first, which
is the merge order of the ranks; piece ids are the ranks.  A text is split by the tokenizer's
pattern and each match is encoded by itself; a match that is itself a token is that token.
Decoding maps ids back to their bytes.

Null texts count as empty: no ids, no bytes.  Very long texts are encoded whole; rows are taken
a few at a time so that memory is bounded by the longest text.  Each row is encoded by itself,
so repeated rows give repeated results.  ``encode`` and ``decode`` keep the columns asked for
and read no others.  Ids outside the vocabulary raise ValueError; a null id list is empty.
"""

from __future__ import annotations

import base64
import struct
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens whose ids a worker remembers; the memory is emptied beyond it.
REMEMBERED = 50_000


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else from U+0100 up."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of rank."""
    with open(path, "rb") as f:
        pairs = [(int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip())]
    pairs.sort()
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks aren't 0 to n-1")
    return [t for _, t in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece i is token i, and one unknown piece after them."""
    of = byte_alphabet()
    out = []
    for rank, token in enumerate(tokens):
        piece = "".join(of[b] for b in token).encode()
        out.append(_field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))))
    out.append(_field(1, _field(1, "⁇".encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -1e9) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))  # BPE, size, unk_id
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([*out, _field(2, trainer), _field(3, normaliser)])


class ByteBPE:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        self.tokens, self.pattern = read_ranks(path), pattern
        self.map = {b: c for b, c in enumerate(byte_alphabet())}
        self.known: dict[str, list[int]] = {}

    # what only encoding needs is made when first used
    @cached_property
    def rank(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.tokens)}

    @cached_property
    def split(self):
        import regex

        return regex.compile(self.pattern).findall

    @cached_property
    def pieces(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))

    def _of(self, match: str) -> list[int]:
        raw = match.encode("utf-8")
        whole = self.rank.get(raw)
        # Latin-1 text has one character a byte, which translate() maps to the alphabet
        ids = [whole] if whole is not None else self.pieces.encode(raw.decode("latin-1").translate(self.map))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(match) <= 64:
            self.known[match] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, more = self.known.get, out.extend
        for m in self.split(text):
            ids = known(m)
            more(self._of(m) if ids is None else ids)
        return out

    def decode(self, ids) -> bytes:
        of, n = self.tokens, len(self.tokens)
        if len(ids) and not 0 <= min(ids) <= max(ids) < n:
            raise ValueError("an id is outside the vocabulary")
        return b"".join([of[i] for i in ids])


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One a Python worker."""
    return ByteBPE(path, pattern)


def public_vocabulary(name: str = VOCABULARY) -> tuple[str, str]:
    """Path and pattern of a public rank file; each worker resolves its own copy."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and ``ids`` array<int> of every whole text."""

    def run(batches):
        bpe = tokenizer(*public_vocabulary(vocabulary))
        for b in slices(batches, "_text", 1 << 20):
            ids = [bpe.encode(t) if t else [] for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "ids"])

    d = docs.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*(d.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return d.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns and ``decoded`` binary: the bytes that the ids stand for."""
    names = encoded.columns

    def run(batches):
        bpe = tokenizer(*public_vocabulary(vocabulary))
        for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            col = b.column(ids)
            flat = col.flatten().to_numpy(zero_copy_only=False)
            n = [0 if x is None else x for x in pa.compute.list_value_length(col).to_pylist()]
            out, at = [], 0
            for k in n:
                out.append(bpe.decode(flat[at : at + k].tolist()))
                at += k
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.binary())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns, ``ids`` of every whole text and ``decoded``, the bytes that those ids stand for: ``decode`` of
    ``encode`` in one pass, so that a task needs one Python worker and ids cross to Python and back once."""

    def run(batches):
        bpe = tokenizer(*public_vocabulary(vocabulary))
        for b in slices(batches, "_text", 1 << 20):
            ids = [bpe.encode(t) if t else [] for t in b.column("_text").to_pylist()]
            decoded = [bpe.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], names=[*keep, "ids", "decoded"])

    d = docs.select(*keep, F.col(text).alias("_text"))
    return d.mapInArrow(run, T.StructType([*(d.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, ids and decoded -> the counts and digests of the contract."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(round_trip(read(spark, sf_dir, "documents")))
