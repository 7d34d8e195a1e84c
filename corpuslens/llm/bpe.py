"""Byte-level BPE encoding and decoding with a sentencepiece model.

The model is written out directly from the rank file: every token becomes a
piece of byte symbols, one printable character per byte, with its negative
rank as score, and the normaliser is the identity.  Sentencepiece then merges
the adjacent pair of highest score, leftmost first, which is the merge of
lowest rank.  Each pre-token of the pattern is encoded by itself; decoding maps
ids back to the tokens' bytes."""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.shared import text_or_empty, worker_memo

#: Pre-tokens remembered per Python worker, and the longest that is.
REMEMBERED = 100_000
LONGEST = 64


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is
    a visible Latin-1 character, else the next one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(0x100 + hidden.index(b)) for b in range(256)}


def read_ranks(lines: bytes) -> list[bytes]:
    """Tokens by rank from the lines ``base64 rank`` of a rank file; ranks run
    from 0 without gaps."""
    held = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines.splitlines())}
    return [held[rank] for rank in range(len(held))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece r + 1 is the token of rank r."""
    # Fixed values of the model format: fields pieces 1 (piece 1, score 2, type
    # 3: NORMAL 1, UNKNOWN 2), trainer_spec 2 (model_type 3: BPE 2),
    # normalizer_spec 3 (name 1, add_dummy_prefix 3, remove_extra_whitespaces 4,
    # escape_whitespaces 5).
    symbols = byte_symbols()
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, "".join(map(symbols.__getitem__, token)).encode()) + _field(2, -float(rank)) + _field(3, 1)
               for rank, token in enumerate(tokens)]
    trainer = _field(3, 2)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([*(_field(1, p) for p in pieces), _field(2, trainer), _field(3, normaliser)])


class _Codec(dict):
    """Pre-token -> ids as little-endian unsigned 32-bit integers; remembers
    up to REMEMBERED short ones."""

    def __init__(self, lines: bytes, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(lines)
        self.whole = {token: rank for rank, token in enumerate(self.tokens)}
        self.symbols = {b: ord(s) for b, s in byte_symbols().items()}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.pattern = regex.compile(pattern)

    def __missing__(self, pre: str) -> bytes:
        raw = pre.encode()
        if raw in self.whole:
            ids = [self.whole[raw]]
        else:
            ids = [i - 1 for i in self.model.encode(raw.decode("latin-1").translate(self.symbols))]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(pre) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[pre] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


class Tokenizer:
    """Encodes and decodes columns.  ``path`` names the rank file, ``pattern``
    the regular expression that splits a text into pre-tokens.  The file (a
    vocabulary of fixed size) is read on the driver and broadcast."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            lines = f.read()
        held = spark.sparkContext.broadcast(lines)
        key = ("bpe", hash(lines), pattern)
        self._codec: Callable[[], _Codec] = lambda: worker_memo(key, lambda: _Codec(held.value, pattern))

    def encode(self, docs: DataFrame, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens") -> DataFrame:
        """``docs`` with the ids of the whole text (packed: little-endian
        unsigned 32-bit integers) and their number.  Null counts as empty; an
        empty text has no ids."""
        codec = self._codec

        @F.arrow_udf("binary")
        def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            one = codec()
            for batch in texts:
                yield pa.array((one.encode(t.as_py()) for t in batch), pa.binary())

        out = docs.withColumn(ids_col, encode(text_or_empty(text_col)))
        return out.withColumn(count_col, (F.octet_length(ids_col) / 4).cast("long"))

    def decode(self, docs: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
        """``docs`` with the bytes that the packed ids stand for; null ids
        count as none."""
        codec = self._codec

        @F.arrow_udf("binary")
        def decode(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
            one = codec()
            for batch in ids:
                yield pa.array((one.decode(x.as_py()) for x in batch), pa.binary())

        return docs.withColumn(bytes_col, decode(F.coalesce(F.col(ids_col), F.lit(b""))))

    def round_trip(self, docs: DataFrame, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens",
                   bytes_col: str = "decoded") -> DataFrame:
        """``encode`` and then ``decode`` of what it made, in one pass of the
        workers."""
        codec = self._codec

        @F.arrow_udf("struct<ids:binary,decoded:binary>")
        def both(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            one = codec()
            for batch in texts:
                ids = pa.array((one.encode(t.as_py()) for t in batch), pa.binary())
                decoded = pa.array((one.decode(x.as_py()) for x in ids), pa.binary())
                yield pa.StructArray.from_arrays([ids, decoded], names=["ids", "decoded"])

        out = docs.withColumn("__coded", both(text_or_empty(text_col)))
        return (out.withColumn(ids_col, F.col("__coded.ids")).withColumn(bytes_col, F.col("__coded.decoded"))
                .withColumn(count_col, (F.octet_length(ids_col) / 4).cast("long")).drop("__coded"))


def default_tokenizer(spark: SparkSession) -> Tokenizer:
    import public_tokenizers

    return Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def round_trip_digests(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes, one row per
    row of ``docs``; other columns are not read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return tokenizer.round_trip(rows).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
