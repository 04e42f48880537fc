"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprint, linededup, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_sample

    return quality_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import pages_by_warc

    return pages_by_warc(table(spark, sf_dir, "pages"))


def op6_related_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_related

    return pack_related(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), dropped="dropped")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents")).drop("state")


def op10_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import identifiers

    return identifiers(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_resampling": op1_quality_resampling,
    "op2_license_scan": op2_license_scan,
    "op3_minhash_near_duplicates": op3_minhash_near_duplicates,
    "op4_decontamination": op4_decontamination,
    "op5_warc": op5_warc,
    "op6_related_packing": op6_related_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_multiset_fingerprints": op9_multiset_fingerprints,
    "op10_bootstrapped_pii": op10_bootstrapped_pii,
}

SQL: dict[str, str] = {
    "op5_warc": warc.sql(),
    "op7_line_dedup": linededup.sql(),
    "op9_multiset_fingerprints": fingerprint.sql(),
}
