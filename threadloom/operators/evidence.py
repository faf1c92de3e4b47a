"""What the files of an archive say about its assets: copies, sources, dates and directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.ordered import lower_medians
from threadloom.session import materialize
from threadloom.operators.sound import sound_files


def media_evidence(files: DataFrame, links: DataFrame, assets: DataFrame) -> DataFrame:
    """Each file with the asset it is a copy of, if any."""
    return files.join(links.select("file_id", "asset_id"), "file_id", "left").join(assets.select("asset_id", F.col("size").alias("asset_size"), F.col("media_type").alias("asset_media_type"), F.col("sha256").alias("asset_sha256")), "asset_id", "left")


def any_of(test: Column) -> Column:
    """Whether a row passes; a null test doesn't."""
    return F.coalesce(F.bool_or(test), F.lit(False))


def evidence_by_asset_date(files: DataFrame) -> DataFrame:
    """Per asset and date: its copies of that date, their sources and directions. Empty assets are no evidence."""
    dated = sound_files(files).where("file_date is not null and size > 0")
    return dated.groupBy("asset_id", "file_date").agg(
        F.count("*").alias("copies"),
        F.sort_array(F.collect_set("source_id")).alias("sources"),
        any_of(F.col("is_sent")).alias("has_sent"),
        any_of(~F.col("is_sent")).alias("has_not_sent"),
        F.bool_or(F.col("is_sent").isNull()).alias("has_unknown"),
        F.min("media_type").alias("media_type"),
    )


def asset_facts(files: DataFrame) -> DataFrame:
    return sound_files(files).groupBy("asset_id").agg(F.count("*").alias("copies"), F.countDistinct("source_id").alias("sources"), F.bool_or(F.col("file_date").isNotNull()).alias("has_dated_copy"), F.max("size").alias("size"))


def source_facts(files: DataFrame) -> DataFrame:
    eligible = F.when(F.col("file_date").isNotNull() & (F.col("size") > 0), F.col("asset_id"))
    return sound_files(files).groupBy("source_id").agg(F.count("*").alias("files"), F.count("file_date").alias("dated_files"), F.countDistinct(eligible).alias("eligible_assets"))


def undated_pools(files: DataFrame) -> DataFrame:
    """One row: empty assets and their files, and assets with content but no dated copy."""
    empty = F.col("size") == 0
    return asset_facts(files).agg(
        F.coalesce(F.sum(F.when(empty, 1)), F.lit(0)).alias("zero_byte_assets"),
        F.coalesce(F.sum(F.when(empty, F.col("copies"))), F.lit(0)).alias("zero_byte_files"),
        F.coalesce(F.sum(F.when(~empty & ~F.col("has_dated_copy"), 1)), F.lit(0)).alias("no_date_assets"),
    )


def lower_median(value: str) -> Column:
    """For columns with few different values, which come together in one buffer; others have ``ordered.lower_medians``."""
    return F.expr(f"percentile_disc(0.5) within group (order by {value})")


def date_density(files: DataFrame) -> DataFrame:
    """One row: dates with eligible assets, and the least, lower median and most assets on one."""
    per_date = sound_files(files).where("file_date is not null and size > 0").groupBy("file_date").agg(F.countDistinct("asset_id").alias("n"))
    per_date = materialize(per_date, "density")
    ends = per_date.agg(F.count("*").alias("dates"), F.coalesce(F.min("n"), F.lit(0)).alias("least"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    middle = F.coalesce(F.col("lower_median"), F.lit(0)).cast("long").alias("lower_median")
    return ends.join(F.broadcast(lower_medians(per_date, [], "n", materialize)), F.lit(True), "left").select("dates", "least", middle, "most")


def content_assets(files: DataFrame) -> DataFrame:
    """Distinct contents of hashed files (file_id, source_id, path, sha256, size, media_type).

    The first copy by (source_id, path) settles an asset's type and size; a copy of another size is a failure, one of
    another type a conflict, and both stay without an asset. Hashes compare in any case.
    """
    keyed = files.where("sha256 is not null").withColumn("sha256", F.upper("sha256"))
    first = keyed.groupBy("sha256").agg(F.min(F.struct("source_id", "path", "file_id", "size", "media_type")).alias("first"))
    out = keyed.join(first, "sha256")
    state = F.when(F.col("size") != F.col("first.size"), "SizeMismatch").when(F.col("media_type") != F.col("first.media_type"), "TypeConflict").otherwise("Linked")
    return out.select("file_id", "sha256", F.col("first.file_id").alias("asset_file_id"), F.col("first.size").alias("asset_size"), F.col("first.media_type").alias("asset_media_type"), state.alias("state"))
