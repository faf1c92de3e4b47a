"""Census of file names: extensions, suffixes after the date marker, shapes and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.names import canonical_value, media_type, name_features, once, shape_signature, suffix, suffix_class

#: The classes of suffixes.
SUFFIX_CLASSES = ("Empty", "NonNumeric", "PurelyNumeric", "NumericPrefixWithTrailingDecoration")
#: Signatures that are told one by one.
TOP_SIGNATURES = 20


def with_suffix(files: DataFrame) -> DataFrame:
    """Dated files with a marker, with ``suffix``, ``suffix_class`` and leading ``digits``."""
    s = files.where("file_date is not null").select("*", once(suffix=suffix(F.col("name"), F.col("ext")))).where("suffix is not null")
    return s.select("*", once(suffix_class=suffix_class(F.col("suffix")), digits=F.regexp_extract("suffix", r"\A[0-9]*", 0)))


def suffix_classes(files: DataFrame) -> DataFrame:
    found = with_suffix(files).groupBy("suffix_class").agg(F.count("*").alias("files"), F.countDistinct("asset_id").alias("assets"))
    every = files.sparkSession.createDataFrame([(c,) for c in SUFFIX_CLASSES], "suffix_class string")
    return every.join(found, "suffix_class", "left").select("suffix_class", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("assets", F.lit(0)).alias("assets"))


def digit_widths(files: DataFrame) -> DataFrame:
    """Per number of digits: files, distinct digit strings, and the least and greatest string."""
    numeric = with_suffix(files).where("suffix_class = 'PurelyNumeric'")
    return numeric.groupBy(F.length("digits").cast("long").alias("width")).agg(F.count("*").alias("files"), F.countDistinct("digits").alias("strings"), F.min("digits").alias("least"), F.max("digits").alias("greatest"))


def dominant_width(files: DataFrame) -> DataFrame:
    """One row: the width with most files (the smallest of several), 0 if there is none."""
    top = digit_widths(files).agg(F.max(F.struct("files", (-F.col("width")).alias("w"))).alias("t"))
    return top.select(F.coalesce(-F.col("t.w"), F.lit(0)).alias("width"), F.coalesce("t.files", F.lit(0)).alias("files"))


def numeric_agreement(files: DataFrame) -> DataFrame:
    """Assets with several purely numeric suffixes, by whether those agree as strings, as numbers or not at all."""
    numeric = with_suffix(files).where("suffix_class = 'PurelyNumeric'")
    per = numeric.groupBy("asset_id").agg(F.count("*").alias("n"), F.countDistinct("digits").alias("strings"), F.countDistinct(canonical_value(F.col("digits"))).alias("numbers")).where("n > 1")
    kind = F.when(F.col("strings") == 1, "SameDigits").when(F.col("numbers") == 1, "SameValue").otherwise("Different")
    return per.groupBy(kind.alias("agreement")).agg(F.count("*").alias("assets"))


def name_counts(files: DataFrame) -> DataFrame:
    """How many assets have so many different names, with case and without."""
    per = files.groupBy("asset_id").agg(F.countDistinct("name").alias("names"), F.countDistinct(F.upper("name")).alias("names_any_case"))
    return per.groupBy("names", "names_any_case").agg(F.count("*").alias("assets"))


def top_signatures(files: DataFrame, top: int = TOP_SIGNATURES) -> DataFrame:
    """The commonest shapes of decorated suffixes and of undated names, and all others pooled as ``Other``."""
    dated = with_suffix(files).where("suffix_class in ('NonNumeric', 'NumericPrefixWithTrailingDecoration')").select(F.lit("suffix").alias("part"), shape_signature(F.col("suffix")).alias("signature"), "asset_id")
    undated = files.where("file_date is null").select(F.lit("name").alias("part"), shape_signature(F.regexp_replace("name", r"\.[^./\\]+$", "")).alias("signature"), "asset_id")
    rows = dated.union(undated).groupBy("part", "signature", "asset_id").agg(F.count("*").alias("n"))  # the shapes once, for both uses
    ranked = rows.groupBy("part", "signature").agg(F.sum("n").alias("files")).withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("files"), "signature")))
    named = rows.join(ranked.where(F.col("place") <= top).select("part", "signature", "place"), ["part", "signature"], "left")
    shown = F.when(F.col("place").isNull(), "Other").otherwise(F.col("signature"))
    return named.groupBy("part", F.coalesce("place", F.lit(top + 1)).alias("place"), shown.alias("signature")).agg(F.sum("n").alias("files"), F.countDistinct("asset_id").alias("assets"))


def undated_features(files: DataFrame) -> DataFrame:
    """(feature, files, assets) of undated files; ``none`` counts those with no feature at all."""
    features = name_features(F.col("name"))
    rows = files.where("file_date is null").select("asset_id", *[c.alias(k) for k, c in features.items()])
    nothing = ~F.greatest(*[F.col(k) for k in features])
    every = F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).alias("has")) for k in features], F.struct(F.lit("none").alias("feature"), nothing.alias("has")))
    parts = rows.select("asset_id", F.explode(every).alias("x")).select("asset_id", "x.*")
    return parts.groupBy("feature").agg(F.count(F.when(F.col("has"), 1)).alias("files"), F.countDistinct(F.when(F.col("has"), F.col("asset_id"))).alias("assets"))


def extension_census(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("ext", F.lit("<none>")).alias("ext")).agg(F.count("*").alias("files"), F.first(media_type(F.col("ext"))).alias("media_type"))


def discovery_summary(files: DataFrame) -> DataFrame:
    """One row of totals over an inventory."""
    return files.agg(
        F.count("*").alias("files"),
        *[F.count(F.when(F.col("media_type") == t, 1)).alias(t.lower()) for t in ("Image", "Video", "Audio", "Document", "Unknown")],
        F.count(F.when(F.col("is_sent"), 1)).alias("sent"),
        F.count(F.when(~F.col("is_sent"), 1)).alias("not_sent"),
        F.count(F.when(F.col("is_sent").isNull(), 1)).alias("direction_unknown"),
        F.count("file_date").alias("dated"),
        F.count(F.when(F.col("size") == 0, 1)).alias("empty"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"),
    )


def unknown_extensions(files: DataFrame) -> DataFrame:
    """(ext, files): extensions of no known type, the commonest first, then by name."""
    unknown = files.where(media_type(F.col("ext")) == "Unknown")
    return unknown.groupBy(F.coalesce("ext", F.lit("<none>")).alias("ext")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "ext")


def name_problems(files: DataFrame, sources: DataFrame) -> DataFrame:
    """One row over files with a ``recorded_ext``: without one, with another than the name's, dated without a marker, and of
    a source that ``sources`` doesn't have."""
    f = files.join(F.broadcast(sources.select("source_id", F.lit(True).alias("known"))), "source_id", "left")  # a row for each source
    return f.agg(
        F.count(F.when(F.col("recorded_ext").isNull(), 1)).alias("without_extension"),
        F.count(F.when(~F.col("recorded_ext").eqNullSafe(F.col("ext")), 1)).alias("extension_mismatch"),
        F.count(F.when(F.col("file_date").isNotNull() & suffix(F.col("name"), F.col("ext")).isNull(), 1)).alias("dated_without_marker"),
        F.count(F.when(F.col("known").isNull(), 1)).alias("unrecorded_source"),
    )
