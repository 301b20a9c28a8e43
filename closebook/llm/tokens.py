"""Token ids in packed binary blocks.

The file format is a table of blocks, written by Spark: ``shard`` and ``block`` give the order;
``payload`` holds the ids of whole documents, each in ``width`` bits, the fewest that hold the
vocabulary's largest id, most significant bit first; ``doc_ids`` and ``offsets`` tell where each
document begins, in ids, with one more offset for the end. ``offset * width`` is the bit to read
from, so any document, or any id of it, is read without the rest. Documents ascend from block to
block and from shard to shard.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from closebook.llm.words import slices
from closebook.session import small_batches, work_folder
from closebook.workers import lean, one_by_one

BLOCK_IDS = 65_536
CACHE_WORDS = 300_000  # words whose ids are remembered, some 200 bytes each
CACHE_BYTES = 64  # longer words are not remembered
BLOCKS = "shard int, block int, width int, n_ids long, doc_ids array<long>, offsets array<long>, payload binary"

# The tokenizer's own rules for texts of Latin-1 characters; other texts go to the tokenizer whole.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+".encode("latin-1"))
_LOWER = bytes(0x20 if chr(c) in _SPACE else ord(chr(c).lower()) for c in range(256))


def width_of(largest: int) -> int:
    return max(1, int(largest).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids of ``width`` bits each, one after the other."""
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(bits[:, 32 - width :].ravel()).tobytes()


def unpack(payload: bytes, width: int, begin: int, end: int) -> np.ndarray:
    """Ids from place ``begin`` up to ``end``, reading only their bytes."""
    first, last = begin * width // 8, -(-end * width // 8)
    data = np.frombuffer(payload, np.uint8)[first:last]
    if width in (8, 16, 32):
        return data.view(f">u{width // 8}").astype(np.uint32)
    skip = begin * width - first * 8
    bits = np.unpackbits(data)[skip : skip + (end - begin) * width].reshape(-1, width)
    full = np.zeros((len(bits), 32), np.uint8)
    full[:, 32 - width :] = bits
    return np.packbits(full, axis=1).view(">u4").ravel().astype(np.uint32)


class _Known(dict):
    """Ids of words, made at first sight. Short words are remembered, up to CACHE_WORDS."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: bytes) -> bytes:
        ids = self.make(word)
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Ids of texts under a BPE tokenizer file whose pieces never cross white space.

    The pieces of a text depend on the word between white space alone, and the ids of a piece on
    the piece alone, so both are encoded once and remembered, as Latin-1 bytes in one table: a piece
    is a word of one piece. A text with characters beyond Latin-1, with control characters that only
    some call white space, or with a special token's string, is encoded by the tokenizer as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        of_byte = self._byte_letters()
        self.letters = {c: "".join(of_byte[b] for b in chr(c).encode()) for c in range(256)}
        self.words = _Known(self._word)

    @staticmethod
    def _byte_letters() -> str:
        """The usual letters for bytes: printable ones stand for themselves, others follow 255."""
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = iter(range(256, 512))
        return "".join(chr(b if b in plain else next(rest)) for b in range(256))

    def _piece(self, piece: bytes) -> bytes:
        letters = piece.decode("latin-1")
        if not piece.isalpha():  # of bytes: a letter of ASCII stands for itself
            letters = letters.translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():
            return self._piece(word)
        pieces = _PIECE.findall(word)
        return self._piece(word) if len(pieces) == 1 else b"".join([self.words[p] for p in pieces])

    def _plain(self, text: str) -> bytes | None:
        """The text in Latin-1, if its words can be encoded one by one."""
        try:
            data = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        whole = len(data.translate(None, b"\x1c\x1d\x1e\x1f")) == len(data) and not any(s in text for s in self.special)
        return data if whole else None

    def encode(self, text: str) -> np.ndarray:
        data = self._plain(text)
        if data is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(b"".join(map(self.words.__getitem__, data.translate(_LOWER).split())), np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, so that its memory serves all tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _forget_encoders() -> None:
    _encoders.clear()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all texts, each with ``end_id`` after it, as blocks in ``path``.

    ``docs`` has doc_id (an integer) and text; other columns are left out. Null and empty texts
    have the end id alone. Documents are sorted by doc_id, nulls first; repeated ids by a hash of the text,
    and equal rows are written as often as they occur. A table without rows gives no blocks.
    A block holds whole documents, at least ``block_ids`` ids unless it is a shard's last.
    """
    width = width_of(max(_vocabulary(tokenizer) - 1, end_id))

    def encode(batches):
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        own = encoder(tokenizer)
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        sizes: list[int] = []

        def full():
            offsets = list(accumulate(sizes, initial=0))
            row = {"shard": shard, "block": block, "width": width, "n_ids": offsets[-1], "doc_ids": docs, "offsets": offsets, "payload": pack(np.concatenate(ids), width)}
            return pa.RecordBatch.from_pylist([row], _BLOCK)

        count = 0
        for batch, texts in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                own_ids = own.encode(text.decode())
                ids += [own_ids, np.array([end_id], np.uint32)]
                docs.append(doc)
                sizes.append(len(own_ids) + 1)
                count += sizes[-1]
                if count >= block_ids:
                    yield full()
                    ids, docs, sizes, count, block = [], [], [], 0, block + 1
        if docs:
            yield full()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").orderBy("doc_id", F.xxhash64("text"))
    with small_batches(docs.sparkSession):
        ordered.mapInArrow(lean(encode), BLOCKS).write.mode("overwrite").parquet(path)


_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("width", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])


def _vocabulary(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the blocks of ``path``.

    Starts count all ids before a document: the ids of earlier shards, then of earlier blocks,
    both summed from the blocks' counts without reading ids.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    per_shard = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard only
    bases = per_shard.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select("shard", "block", "n_ids").withColumn("local", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    places = places.join(bases, "shard").select("shard", "block", (F.col("base") + F.col("local")).alias("first"))

    def digest(batches):
        _forget_encoders()  # all ids are written: this worker's memory is for other tasks now
        for row in one_by_one(batches):
            offsets, width = row["offsets"], row["width"]
            ids = unpack(row["payload"], width, 0, offsets[-1])
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets, offsets[1:])]
            n = len(crc)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()),
                    pa.array(offsets[:-1], pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64()),
                ],
                ["doc_id", "shard", "block", "offset", "n_tokens", "ids_crc32"],
            )

    digests = blocks.select("shard", "block", "width", "doc_ids", "offsets", "payload").mapInArrow(lean(digest), "doc_id long, shard int, block int, offset long, n_tokens long, ids_crc32 long")
    return digests.join(places, ["shard", "block"]).select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def ids_of(spark, path: str, doc_id: int) -> list[int]:
    """Ids of one document, read from its block alone."""
    at = F.array_position("doc_ids", F.lit(doc_id))
    row = spark.read.schema(BLOCKS).parquet(path).filter(F.array_contains("doc_ids", doc_id)).select("*", at.alias("at")).first()
    if row is None:
        return []
    begin, end = row["offsets"][row["at"] - 1], row["offsets"][row["at"]]
    return unpack(row["payload"], row["width"], begin, end).tolist()


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the tokens of ``docs`` to a new folder of the work folder and read them back."""
    import uuid

    path = f"{work_folder(docs.sparkSession)}/closebook/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
