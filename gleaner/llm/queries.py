"""The registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import oracles


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.licenses import license_scan

    return license_scan(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.quality import held_out
    from gleaner.llm.toxicity import score_toxicity, train_toxicity

    docs, held = documents(spark, sf_dir), held_out(F.col("doc_id"), 3, 1)
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.mixing import mix_sources

    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "passes")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.decontamination import benchmark_matches

    return benchmark_matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.revisits import captures_of_pages, resolve_revisits

    found = resolve_revisits(captures_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    entries = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select("record_id", "canonical_url", "response_id", "outcome", F.array_join(entries, "; ").alias("headers"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.near_duplicates import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.quality import held_out, score_quality, train_quality

    docs, held = documents(spark, sf_dir), held_out(F.col("doc_id"), 5, 0)
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    return score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.personal_data import KINDS, find_personal_data, train

    found = find_personal_data(documents(spark, sf_dir), train())
    return found.select("doc_id", *[f"n_{kind}" for kind in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.exact_duplicates import exact_duplicates

    found = exact_duplicates(documents(spark, sf_dir), hash_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_hash")).alias("text_sha256"))


def op10_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.storage import Workspace
    from gleaner.llm.token_blocks import read_token_file, write_token_file

    folder = Workspace(spark, "tokens").path("ids")
    write_token_file(documents(spark, sf_dir), folder, tokenizer_path())
    return read_token_file(spark, folder)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.alignment import align_tokens

    return align_tokens(documents(spark, sf_dir), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.url_filter import RULES, filter_urls, page_links

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, page_links(pages), RULES)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.divergence import divergence

    return divergence(documents(spark, sf_dir))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_toxicity": op2_toxicity,
        "op3_source_mixing": op3_source_mixing,
        "op4_benchmark_decontamination": op4_benchmark_decontamination,
        "op5_warc_revisits": op5_warc_revisits,
        "op6_near_dedup": op6_near_dedup,
        "op7_quality": op7_quality,
        "op8_personal_data": op8_personal_data,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_token_blocks": op10_token_blocks,
        "op11_token_alignment": op11_token_alignment,
        "op12_url_filter": op12_url_filter,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
