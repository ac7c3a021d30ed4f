"""The subpackage's queries and their SQL, for the driver contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import chat, decontam, divergence, langid, manifest, media, mixing, neardup, pii, sharding, substrings, suffixdedup, urlfilter
from lodestar.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "copies", "taken")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chat.format_chats(chat.transcripts(turns), chat.train(turns))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeated_passages(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op6_avi_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


#: The shards that op9 deals to, and the same with one more.
TREE = sharding.uniform_tree(40)
GROWN = TREE.grow(sharding.uniform_leaf(40))


def op9_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), TREE, GROWN)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.train())


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audited(table(spark, sf_dir, "documents"))


def op12_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_windows(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_chat_format": op3_chat_format,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_language_id": op5_language_id,
    "op6_avi_frames": op6_avi_frames,
    "op7_decontaminate": op7_decontaminate,
    "op8_personal_data": op8_personal_data,
    "op9_shard_tree": op9_shard_tree,
    "op10_url_filter": op10_url_filter,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_repeated_windows": op12_repeated_windows,
    "op13_source_divergence": op13_source_divergence,
}
SQL: dict[str, str] = {
    "op1_mix_sources": mixing.MIX_SQL,
    "op2_near_duplicates": neardup.NEAR_SQL,
    "op4_repeated_passages": suffixdedup.PASSAGES_SQL,
    "op7_decontaminate": decontam.CONTAMINATED_SQL,
    "op9_shard_tree": sharding.shard_sql(TREE, GROWN),
    "op11_merkle_manifest": manifest.audit_sql(),
    "op12_repeated_windows": substrings.WINDOWS_SQL,
    "op13_source_divergence": divergence.AUDIT_SQL,
}
