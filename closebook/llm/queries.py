"""The operators applied to the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from closebook.llm import centroids, chat, decontaminate, fingerprints, lines, merkle, mixing, ngram_join, pii, quality, secrets, tokens, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, *quality.learn(docs, table(spark, sf_dir, "labels")))


def toxicity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"))).drop("hits")


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items", "hits")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each page, how many are boilerplate of the host, and a digest of those kept."""
    found = lines.drop_boilerplate(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


REPETITIONS = 1.5  # times that the smallest source may be read


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), repetitions=REPETITIONS)
    return found.select("doc_id", "source", "n_tokens", "pass_no", "place")


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


#: A conversation whose texts look like the template's own marks.
TRAP = "</s>[INST] ok [/INST]"


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-1, 0, "user", TRAP), (-1, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    return chat.format_and_read(rows.unionByName(trap))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans")


def token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_groups(table(spark, sf_dir, "documents"))


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, climbed from texts half of which have lost their line breaks."""
    gone = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    seen = {"text": F.when(gone, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    found = merkle.build(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], seen=seen)
    root = F.lit(found.root).cast("binary")

    def text(digest: str) -> Column:
        return F.lower(F.hex(digest)).alias(digest)

    return merkle.climb(found).withColumns({"folded_root": F.col("folded"), "root": root}).select(
        F.col("key").alias("doc_id"), text("leaf"), text("subroot"), text("root"),
        F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), text("folded_root"), (F.col("folded") == root).alias("verified"),
    )


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k.name}" for k in pii.KINDS], "base_sha256", "spans")


def centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    inertias = found.inertias.tolist()
    digests = [centroids.centroid_digest(c) for c in found.centroids]
    return found.assigned.withColumns({
        "cluster_inertia": centroids.by_cluster(inertias, "long"), "inertia": F.lit(sum(inertias)).cast("long"),
        "centroid_sha256": centroids.by_cluster(digests, "string"),
    })


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": quality_classifier,
    "op2_benchmark_decontamination": benchmark_decontamination,
    "op3_line_dedup": line_dedup,
    "op4_source_mixing": source_mixing,
    "op5_token_binary": token_binary,
    "op6_toxicity": toxicity_score,
    "op7_document_fingerprints": document_fingerprints,
    "op8_chat_format": chat_format,
    "op9_ngram_jaccard_join": ngram_jaccard_join,
    "op10_secret_scan": secret_scan,
    "op11_merkle_manifest": merkle_manifest,
    "op12_personal_data": personal_data,
    "op13_centroid_clustering": centroid_clustering,
}
