"""Token ids of a public byte-level BPE vocabulary, by a sentencepiece model built from it.

The model proto is serialised here field by field: every vocabulary entry becomes a piece of byte-mapped
characters whose score is its negative rank, so the merge of best score is the merge of lowest rank; the
normaliser is the identity. The id of a piece is its rank; the free id behind the last rank holds the unknown
piece, which no text can reach, as all 256 bytes are pieces.

Texts are cut into pre-tokens by the vocabulary's pattern, mapped byte by byte, and encoded pre-token by
pre-token; a worker remembers the ids of short pre-tokens it has met, so the model runs once for each.

Defined results for odd input: null and empty texts give an empty list; lone surrogates cannot occur in Spark
strings; special tokens' strings are ordinary text; texts of any length are encoded whole; other columns are
ignored; repeated rows are encoded again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED = 400_000
REMEMBERED_LENGTH = 48

# Field numbers of the sentencepiece model proto and its enum values.
PIECES, TRAINER_SPEC, NORMALIZER_SPEC = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
UNKNOWN = 2
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID, UNK_SURFACE = 3, 4, 40, 41, 42, 43, 44
BPE = 2
NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 1, 3, 4, 5


def default_vocabulary() -> str:
    """The vocabulary file that comes with the tokenizer package; a path in /opt/tokenizers otherwise."""
    try:
        import public_tokenizers

        return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_characters() -> list[str]:
    """The visible character that stands for each byte: itself if printable, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _float(field: int, value: float) -> bytes:
    import struct

    return _varint(field << 3 | 5) + struct.pack("<f", value)


def read_ranks(vocabulary: str) -> list[bytes]:
    """The byte strings of a rank file, in order of rank."""
    with open(vocabulary, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks of ``tokens``."""
    chars = byte_characters()
    out = [_bytes(PIECES, _bytes(PIECE, "".join(chars[b] for b in t).encode()) + _float(SCORE, -float(rank))) for rank, t in enumerate(tokens)]
    out.append(_bytes(PIECES, _bytes(PIECE, b"<unk>") + _float(SCORE, 0.0) + _number(TYPE, UNKNOWN)))
    trainer = _number(MODEL_TYPE, BPE) + _number(VOCAB_SIZE, len(tokens) + 1) + _number(UNK_ID, len(tokens))
    trainer += _number(BOS_ID, -1) + _number(EOS_ID, -1) + _number(PAD_ID, -1)
    normaliser = _bytes(NAME, b"identity") + _number(ADD_DUMMY_PREFIX, 0) + _number(REMOVE_EXTRA, 0) + _number(ESCAPE, 0)
    return b"".join([*out, _bytes(TRAINER_SPEC, trainer), _bytes(NORMALIZER_SPEC, normaliser)])


class PieceEncoder:
    """Encodes and decodes texts with one vocabulary."""

    def __init__(self, vocabulary: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(vocabulary)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.split = regex.compile(pattern).findall
        self.mapped = dict(enumerate(byte_characters()))
        self.known: dict[str, list[int]] = {}

    def _learn(self, missing: list[str]) -> dict[str, list[int]]:
        shown = [m.encode("utf-8").decode("latin-1").translate(self.mapped) for m in missing]
        return dict(zip(missing, self.model.encode(shown, num_threads=1)))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        pre, known = self.split(text), self.known
        missing = [p for p in set(pre) if p not in known]
        rare: dict[str, list[int]] = {}
        if missing:
            fresh = self._learn(missing)
            if len(known) > REMEMBERED:
                known.clear()
                missing = [p for p in set(pre) if p not in fresh]
                fresh |= self._learn(missing) if missing else {}
            for p, ids in fresh.items():
                (known if len(p) <= REMEMBERED_LENGTH else rare)[p] = ids
        out: list[int] = []
        extend = out.extend
        if rare:
            for p in pre:
                extend(rare[p] if p in rare else known[p])
        else:
            for p in pre:
                extend(known[p])
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8")


@lru_cache(maxsize=2)
def encoder(vocabulary: str, pattern: str) -> PieceEncoder:
    return PieceEncoder(vocabulary, pattern)


def encode_corpus(documents: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row of ``documents``; ``vocabulary`` is readable under that path on every worker."""
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern).encode
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for text in batch.column(1):
                flat.extend(encode(text.as_py()))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")
