"""Registered queries of this subpackage: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlapse.llm import centroid_clusters, decontaminate, html_text, language_id, near_dedup, packing, personal_data, quality_classifier, quality_rules, secrets, suffix_dedup, token_alignment, token_files
from transitlapse.llm.oracles import ORACLES  # noqa: F401  (registered with the queries)
from transitlapse.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_token_files(spark, sf_dir):
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file())
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op8_decontaminate(spark, sf_dir):
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query
def op9_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "context", "step_group")


@query
def op2_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), ["doc_id"])


@query
def op5_secret_scan(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
                        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
                        secrets.spans_text(F.col("spans")).alias("spans"))


@query
def op3_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    weights = quality_classifier.train(docs, quality_classifier.learnable(table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return quality_classifier.score(docs, weights, ["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"))


@query
def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(language_id.learnable(docs))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return language_id.predict(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op10_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"), ["page_id", "url"]).withColumn("n_chars", F.char_length("text").cast("bigint"))


@query
def op4_near_dedup(spark, sf_dir):
    return near_dedup.classes(table(spark, sf_dir, "documents"))


@query
def op1_suffix_dedup(spark, sf_dir):
    cleaned = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])
    return cleaned.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                          F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_centroid_clusters(spark, sf_dir):
    found = centroid_clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))
    members = found.members
    most = (1 << 63) - 1
    own = {r["cluster"]: int(r["own"]) for r in  # a sum for each centroid
           members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("own")).collect()}
    about = [(c, min(n, most), min(sum(own.values()), most), hashlib.sha256(",".join(map(str, found.centroids[c].tolist())).encode()).hexdigest())
             for c, n in own.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return members.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query
def op13_token_alignment(spark, sf_dir):
    found = token_alignment.align(table(spark, sf_dir, "documents"), tokenizer_file(), tokenizer_file("piece_bpe_32k.model"), ["doc_id"])
    return found.documents


@query
def op12_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = personal_data.find_personal(docs, personal_data.train(docs), ["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *map(number, personal_data.KINDS), F.sha2(written(base), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))
