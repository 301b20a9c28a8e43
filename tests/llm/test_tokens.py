"""Packing round trips, encoding against the tokenizer itself, and files read back."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from closebook.llm import tokens
from closebook.llm.queries import tokenizer_path
from closebook.llm.tokens import Encoder, ids_of, pack, read_tokens, unpack, width_of, write_tokens


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 32), st.data())
def test_pack(width, data):
    ids = data.draw(st.lists(st.integers(0, (1 << width) - 1), max_size=60))
    packed = pack(np.array(ids, np.uint32), width)
    assert len(packed) == -(-len(ids) * width // 8)
    assert unpack(packed, width, 0, len(ids)).tolist() == ids
    low = data.draw(st.integers(0, len(ids)))
    high = data.draw(st.integers(low, len(ids)))
    assert unpack(packed, width, low, high).tolist() == ids[low:high]


def test_width():
    assert [width_of(n) for n in (0, 1, 2, 255, 256, 49407)] == [1, 1, 2, 8, 9, 16]


def test_encoder():
    own, whole = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    rnd = random.Random(3)
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}'S 12{chr(c)}x don't{chr(c)}'re" for c in range(256)]
    texts += ["", " \n", "<|endoftext|>a", "x <|startoftext|> y", "漢字 é😀", "é   İ ΑΣ", "a b\x1cc\x85d"]
    for _ in range(500):
        texts.append("".join(rnd.choice([chr(rnd.randrange(256)), chr(rnd.randrange(32, 127)), "ab", "é", " ", "'ll", "字"]) for _ in range(rnd.randrange(40))))
    for text in texts:
        assert own.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def text_hash(text):
    """What repeated ids are sorted by: Spark's 64-bit hash of the text, as a signed number; of null its seed."""
    return 42 if text is None else (xxhash.xxh64_intdigest(text.encode(), seed=42) + 2**63) % 2**64 - 2**63


@pytest.mark.parametrize("block_ids", [1, 50, 1 << 16])
def test_files(spark, tmp_path, block_ids):
    rnd = random.Random(6)
    rows = [(i * 3, " ".join(rnd.choice(["the", "Été", "x9", "字"]) for _ in range(rnd.choice([0, 1, 7, 200])))) for i in range(60)]
    rows += [(7, None), (8, ""), (9, "the"), (9, "the"), (None, "first of all")]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "'s' AS payload").repartition(5)
    write_tokens(docs, str(tmp_path / "t"), tokenizer_path(), end_id=1, block_ids=block_ids)
    got = sorted(map(tuple, read_tokens(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    whole, want, start = Tokenizer.from_file(tokenizer_path()), [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1]))):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    doc, text = next(r for r in rows if r[0] == 30)
    assert ids_of(spark, str(tmp_path / "t"), 30) == [*whole.encode(text, add_special_tokens=False).ids, 1]
    assert ids_of(spark, str(tmp_path / "t"), 31) == []


def test_encoder_is_freed_when_ids_are_read(spark, tmp_path, monkeypatch):
    """Workers go on to other tasks, so they must not hold the encoder's words and tokenizer any more."""

    def freed(batches):
        from closebook.llm import tokens as own

        assert not own._encoders
        yield from one_by_one(batches)

    docs = spark.range(50, numPartitions=1).selectExpr("id AS doc_id", "'some words' AS text")
    one_by_one = tokens.one_by_one
    monkeypatch.setattr(tokens, "one_by_one", freed)
    for _ in range(2):
        assert tokens.token_digests(docs, tokenizer_path()).count() == 50


def test_no_rows(spark, tmp_path):
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"), tokenizer_path())
    assert read_tokens(spark, str(tmp_path / "t")).collect() == []


def test_many_words_are_made_once():
    encoder = Encoder(tokenizer_path())
    texts = [" ".join(f"w{i}x{k}" for i in range(2000)) for k in range(100)]
    for text in texts:
        encoder.encode(text)

    def again(word):
        raise AssertionError(f"{word} was forgotten")

    encoder.words.make = again
    for text in texts:
        encoder.encode(text)


def test_remembered_words_are_bounded(monkeypatch):
    """Within a text too, words and pieces together, and words of any length."""
    monkeypatch.setattr(tokens, "CACHE_WORDS", 100)
    own, whole = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    text = " ".join([f"W{i}é, x{i}'s\xa0{i}." for i in range(500)] + ["longword" * 1000, "after\x85"])
    for _ in range(2):
        assert own.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids
        known = [table for table in vars(own).values() if isinstance(table, tokens._Known)]
        assert 0 < sum(map(len, known)) <= 100
        assert max(len(word) for table in known for word in table) <= 64


def test_workers_get_small_batches(spark, tmp_path, monkeypatch):
    def checked(run):
        def run_checked(batches):
            def small():
                for batch in batches:
                    assert batch.nbytes < 1_200_000, f"a batch of {batch.nbytes} bytes"
                    yield batch

            yield from run(small())

        return run_checked

    setting = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(4000, numPartitions=1).selectExpr("id AS doc_id", "repeat('a word ', 150) AS text")
    with monkeypatch.context() as patched:
        patched.setattr(tokens, "lean", checked)
        write_tokens(docs, str(tmp_path / "t"), tokenizer_path())
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == setting
    assert read_tokens(spark, str(tmp_path / "t")).agg({"n_tokens": "sum"}).first()[0] == 4000 * 301
