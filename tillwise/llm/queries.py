"""The training-data operators as named queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm import chat, collocations, decontamination, dedup_exact, language, licenses, oracle, packing, prefix_trie, secrets, simhash, toxicity, url_filter, warc
from tillwise.sources.shared import Tables, shared_path, stage

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo a number; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learned from."""
    return table(spark, sf_dir, "labels").filter(_remainder("doc_id", 5) != 0)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, toxicity_labels(spark, sf_dir))
    scored = documents.select(
        "doc_id",
        (_remainder("doc_id", 5) == 0).alias("held_out"),
        toxicity.score(F.col("text"), model).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= toxicity.REJECTED).cast("int"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = dedup_exact.exact_duplicates(table(spark, sf_dir, "documents"))
    return decided.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates_digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "url_filter.*")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = stage(chat.whole_conversations(table(spark, sf_dir, "conversations")), "conversations")
    opening = chat.opening_pairs(talks).select(F.lit("opening").alias("kind"), "*")
    swapped = chat.swapped_reply_pairs(talks).select(F.lit("reply").alias("kind"), "*")
    return chat.preference_records(opening.unionByName(swapped))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents")).drop("text_hash")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(packing.pack(table(spark, sf_dir, "documents"), vocabulary_path()))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.contamination_digest(found)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = _remainder("doc_id", 3) == 1
    model = language.fit(documents.filter(~held_out))
    return documents.select("doc_id", held_out.alias("held_out"), language.predict(F.col("text"), model).alias("p")).select(
        "doc_id", "held_out", "p.*"
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    with Tables(spark) as tables:
        head = F.crc32(F.col("id").cast("string").cast("binary")) % 6
        ids, turns = prefix_trie.with_shared_openings(prefix_trie.ordered_turns(conversations), group=100, head=head, most=5)
        return tables.hand_over(prefix_trie.prefix_trie(ids, turns), "op11").select(
            F.col("id").alias("conv_id"),
            "depth",
            F.col("parent_id").alias("parent_conv_id"),
            F.col("n_members").alias("n_convs"),
            "n_children",
            "n_leaves",
            F.col("saved_chars").alias("saved_tokens"),
            "ends_sha256",
        )


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Tables(spark) as tables:
        archives = shared_path(spark, "archives")
        warc.write_archives(warc.archive_records(table(spark, sf_dir, "pages")), archives)
        records = stage(warc.read_records(spark, archives, keep_payload=False), "records")
        found = stage(warc.captures(records), "captures")
        return tables.hand_over(warc.resolved(found), "op12").select(
            F.col("page_id").cast("long").alias("page_id"),
            "payload_bytes",
            "payload_digest",
            F.col("kind").alias("record_type"),
            F.col("refers_to").cast("long").alias("refers_to"),
        )


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = collocations.phrase_counts(table(spark, sf_dir, "documents"))
    return collocations.top_collocations(collocations.collocations(counts), counts)


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_url_filters": op3_url_filters,
        "op4_chat_formatting": op4_chat_formatting,
        "op5_license_scans": op5_license_scans,
        "op6_secret_scans": op6_secret_scans,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op9_benchmark_decontamination": op9_benchmark_decontamination,
        "op10_language_id": op10_language_id,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_warc": op12_warc,
        "op13_phrase_collocations": op13_phrase_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
