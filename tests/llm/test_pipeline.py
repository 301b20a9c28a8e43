"""The pipeline's stages against each other and plain Python, and the queries with SQL."""

from __future__ import annotations

import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from closebook.llm import decontaminate, ngram_join, toxicity
from closebook.llm.oracle import ORACLE_SQL
from closebook.llm.queries import QUERIES, tokenizer_path
from closebook.session import with_settings

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables absent")


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    kept = [docs.collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(SF))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.collect())
    first, calm, single, clean, mix, tokens = kept
    assert {r["doc_id"] for r in calm} <= {r["doc_id"] for r in first}
    texts = {r["doc_id"]: r["text"] for r in calm}
    sets = {d: shingles(t) for d, t in texts.items()}
    alone = {r["doc_id"] for r in single}
    for a in alone:
        assert not any(a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in alone)
    for gone in set(texts) - alone:
        assert any(b < gone and len(sets[gone] & sets[b]) >= 0.8 * len(sets[gone] | sets[b]) for b in texts)
    assert {r["doc_id"] for r in clean} <= alone
    assert {r["doc_id"] for r in mix} == {r["doc_id"] for r in clean} and len(mix) >= len(clean)
    tokenizer, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for row in sorted(mix, key=lambda r: r["doc_id"]):
        ids = [*tokenizer.encode(row["text"], add_special_tokens=False).ids, 1]
        want.append((row["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokens)) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(SF)).collect())) == sorted(want)


def test_workers_get_small_batches(spark, monkeypatch):
    """In the jobs of a stage, and in the caller's on its result."""

    def checked(run):
        def run_checked(batches):
            def small():
                for batch in batches:
                    assert batch.nbytes < 1_200_000, f"a batch of {batch.nbytes} bytes"
                    yield batch

            yield from run(small())

        return run_checked

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(4000, numPartitions=1).selectExpr("id AS doc_id", "concat(repeat('a word ', 150), id, ' ', id * 7, ' ', id * 9) AS text")
    for module in (toxicity, ngram_join, decontaminate):
        monkeypatch.setattr(module, "lean", checked)
    with with_settings(spark, {name: "64m"}):  # put back after it
        spark.conf.unset(name)
        assert 0 < corpus_pipeline.drop_toxic(spark, docs, str(SF)).count() <= 4000
        spark.conf.unset(name)
        assert 0 < corpus_pipeline.drop_contaminated(spark, docs, str(SF)).count() <= 4000
        spark.conf.set(name, "64m")
        ngram_join.similarity_groups(docs, percent=80, size=5)
        corpus_pipeline.drop_toxic(spark, docs, str(SF))
        assert spark.conf.get(name) == "64m"


def test_no_documents(spark):
    docs = spark.read.parquet(str(SF / "documents.parquet")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(SF)).collect() == []


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    for file in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    got = QUERIES[name](spark, str(SF))
    want = con.execute(ORACLE_SQL[name])
    places = [[d[0] for d in want.description].index(c) for c in got.columns]
    assert len(places) == len(want.description)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r[p] for p in places) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_whole_tables(spark, name):
    got = QUERIES[name](spark, str(SF))
    n = len(got.collect())
    if name == "op8_chat_format":
        assert n == spark.read.parquet(str(SF / "conversations.parquet")).select("conv_id").distinct().count() + 1
    else:
        assert n == spark.read.parquet(str(SF / "documents.parquet")).count()
