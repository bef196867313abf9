"""The registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import clustering, decontaminate, jaccard, lines, lm, mixing, packing, pii, quality, resampling, topk, toxicity, url_filter
from tracewell.llm.common import is_remainder, table
from tracewell.llm.twins import SQL

__all__ = ["QUERIES", "SQL"]


#: Rules of the URL query: (verdict, rule).
URL_RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)


def op1_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("row.page_id", "host", "path", "rule", "verdict", "score")


def op2_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("row.doc_id", *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    edited = lines.dedup(docs)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return edited.select("row.doc_id", "n_words", "n_deleted", spans.alias("deleted"), "text")


def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    test = is_remainder("doc_id", 4, 2)
    model = quality.train(docs, table(spark, sf, "labels"), ~test)
    scored = quality.quality(docs.select("doc_id", "text"), model).select("row.doc_id", "score")
    return scored.select("doc_id", test.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf, "benchmark"))
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), "contaminated")


def op7_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    test = is_remainder("doc_id", 7, 2)
    scored = lm.score(docs, ~test).withColumn("doc_id", F.col("row.doc_id"))
    return scored.select("doc_id", test.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    test = is_remainder("doc_id", 5, 0)
    model = toxicity.train(docs, table(spark, sf, "labels"), ~test)
    scored = toxicity.toxicity(docs.select("doc_id", "text"), model).select("row.doc_id", "score")
    return scored.select("doc_id", test.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"), F.pmod(F.col("vec_id"), F.lit(50)) == 0)


def op10_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.join(table(spark, sf, "documents"))


def op11_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    vocabulary = packing.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),))
    packed = packing.pack(table(spark, sf, "documents"), vocabulary)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_clustering(spark: SparkSession, sf: str) -> DataFrame:
    rows, centroids = clustering.cluster(table(spark, sf, "embeddings"))
    sha = F.sha2(F.array_join("x", ",").cast("binary"), 256)
    known = centroids.select("cluster", F.col("inertia").alias("cluster_inertia"), F.col("total").alias("inertia"), sha.alias("centroid_sha256"))
    joined = rows.join(F.broadcast(known), "cluster")  # at most as many rows as clusters
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_resampling(spark: SparkSession, sf: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_pii": op2_pii,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_lm_score": op7_lm_score,
    "op8_toxicity": op8_toxicity,
    "op9_top_k": op9_top_k,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_packing": op11_packing,
    "op12_clustering": op12_clustering,
    "op13_resampling": op13_resampling,
}
