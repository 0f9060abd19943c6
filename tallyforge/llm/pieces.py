"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protocol buffer; it is read here field by field, and a tokenizer of the other library is built from
what it holds: the normaliser's rules, the marker for a space, the pieces with their scores, and byte fallback. Unigram
models keep their scores; for models of merges the ranks of all splits follow from the scores of what they make.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import AddedToken, Regex, Tokenizer, decoders, normalizers
from tokenizers.models import BPE, Unigram

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Kinds of pieces and of models in the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM_MODEL, BPE_MODEL = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        else:
            size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM_MODEL
    byte_fallback: bool = False
    unk: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False


def parse(data: bytes) -> Model:
    """Read a SentencePiece model file."""
    out = Model()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            if kind == UNKNOWN:
                out.unk = len(out.pieces)
            out.pieces.append((piece, score, kind))
        elif number == 2:
            trainer = dict(fields(value))
            out.kind = trainer.get(3, UNIGRAM_MODEL)
            out.byte_fallback = bool(trainer.get(35, 0))
            out.suffix = bool(trainer.get(24, 0))
        elif number == 3:
            rules = dict(fields(value))
            out.charsmap = rules.get(2, b"")
            out.dummy_prefix, out.squeeze, out.escape = (bool(rules.get(n, 1)) for n in (3, 4, 5))
    if out.kind not in (UNIGRAM_MODEL, BPE_MODEL) or out.suffix or not out.escape:
        raise ValueError("only unigram and merge models that mark a space before its word are supported")
    return out


def ranked_merges(model: Model) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, best score first; ties by the pieces' places."""
    place = {p: (-s, i) for i, (p, s, kind) in enumerate(model.pieces) if kind == NORMAL}
    found = []
    for piece, rank in place.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in place and right in place:
                found.append((rank, place[left], place[right], left, right))
    found.sort()
    return [(left, right) for *_, left, right in found]


def build(model: Model) -> Tokenizer:
    """A tokenizer that gives the ids that the model gives."""
    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    if len(vocab) != len(model.pieces):
        raise ValueError("two pieces of the model are alike")
    if model.kind == BPE_MODEL:
        core = BPE(vocab, ranked_merges(model), unk_token=model.pieces[model.unk][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = Unigram([(p, s) for p, s, _ in model.pieces], model.unk, model.byte_fallback)
    out = Tokenizer(core)
    rules: list = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        rules += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        rules.append(normalizers.Prepend(SPACE))
    out.normalizer = normalizers.Sequence([*rules, normalizers.Replace(" ", SPACE)])
    users = [AddedToken(p, normalized=True, special=False) for p, _, kind in model.pieces if kind == USER]
    if users:
        out.add_tokens(users)
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    # fused first: markers are then replaced once a text, not once a piece
    out.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(SPACE, " "), *strip])
    out.encode_special_tokens = True
    return out


class Codec:
    """Encodes and decodes batches, and holds them against the model's own library."""

    def __init__(self, data: bytes, threads: int = 2) -> None:
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), "true"
        self.model = parse(data)
        self.tokenizer = build(self.model)
        self.own = SentencePieceProcessor(model_proto=data)
        self.threads = threads
        # where no piece goes on past the start of a word, a text may be cut there
        self.cuts = self.model.dummy_prefix and not self.model.squeeze and not self.model.charsmap and not any(SPACE in p.lstrip(SPACE) for p, _, kind in self.model.pieces if kind in (NORMAL, USER))

    def parts(self, text: str, most: int = 1 << 13) -> list[str]:
        """A long text in parts that encode as the whole does: each later part loses the one space that the marker stands for."""
        if not self.cuts or len(text) <= most:
            return [text]
        out, start = [], 0
        while len(text) - start > most:
            found = re.compile(f"(?<=[^ {SPACE}]) (?=.)", re.S).search(text, start + most)
            if not found:
                break
            out.append(text[start : found.start()])
            start = found.end()
        return [*out, text[start:]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.parts(t) for t in texts]
        flat = [p for parts in cut for p in parts]
        ids = [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(flat, add_special_tokens=False)]
        ends = np.cumsum([len(parts) for parts in cut])
        return [ids[e - len(parts)] if len(parts) == 1 else np.concatenate(ids[e - len(parts) : e]) for e, parts in zip(ends, cut)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def reference(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=self.threads)

    def checked(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """Ids, whether the model's own library gives the same, and whether decoding them gives each text back."""
        ids = self.encode(texts)
        lists = [a.tolist() for a in ids]
        parity = [a == b for a, b in zip(lists, self.reference(texts))]
        same = [a == (t.replace(SPACE, " ") if SPACE in t else t) for a, t in zip(self.decode(lists), texts)]
        return ids, parity, same


_CODECS: dict[bytes, Codec] = {}


def codec(data: bytes, threads: int) -> Codec:
    """One codec per worker and model."""
    if data not in _CODECS:
        _CODECS[data] = Codec(data, threads)
    return _CODECS[data]


def _slices(sizes: list[int], most: int) -> Iterator[slice]:
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield slice(start, i)
            start, total = i, 0
        total += size
    yield slice(start, len(sizes))


def encode(docs: DataFrame, model: str = MODEL, threads: int = 2, batch_chars: int = 1 << 20) -> DataFrame:
    """doc_id, n_tokens, ids, parity (the model's own library gives the same ids) and round_trip (decoding gives the text
    back, markers as spaces) for every row of `docs`.

    The whole text is encoded, in calls of about `batch_chars` characters. Null and empty texts have no ids; both checks
    hold for them. A null doc_id is carried along, repeated rows are encoded each, an empty table gives no rows, other
    columns are ignored. The driver reads the model file and sends it to the executors (a vocabulary: under 5 MB).
    """
    with open(model, "rb") as file:
        data = file.read()
    if len(data) > 5_000_000:
        raise ValueError("the model file is larger than a vocabulary should be")
    sent = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value, threads)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at in _slices([len(t) for t in texts], batch_chars):
                part = texts[at]
                ids, parity, same = own.checked(part)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at.start, len(part)), pa.array([len(a) for a in ids], pa.int32()), lists, pa.array(parity), pa.array(same)], ["doc_id", "n_tokens", "ids", "parity", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens int, ids array<int>, parity boolean, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL, threads: int = 2) -> DataFrame:
    """doc_id and text of every row of `encoded` (doc_id, ids).

    Null ids give a null text, no ids an empty one. A null doc_id is carried along, repeated rows are decoded each, lists
    of any length are decoded whole, an empty table gives no rows, other columns are ignored.
    """
    with open(model, "rb") as file:
        sent = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value, threads)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            texts = own.decode([i or [] for i in ids])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if i is None else t for i, t in zip(ids, texts)], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
