"""Census of the scopes in which a file's sequence number could be unique.

Rows are dated files with a four-digit token. A key is the token with a date, a device group or a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.names import COUNT_BANDS, GAP_BANDS, TOKEN_BANDS, band, once, suffix, token
from threadloom.operators.evidence import lower_median
from threadloom.operators.summaries import count_summary, counted
from threadloom.operators.sound import sound_files

#: The levels. From the widest to the narrowest: what makes up the key of each level.
KEY_LEVELS = {"Token": [], "DateToken": ["file_date"], "DeviceGroupDateToken": ["group_id", "file_date"], "SourceDateToken": ["source_id", "file_date"]}
GROUP_LEVELS = {"Date": ["file_date"], "DeviceGroupDate": ["group_id", "file_date"], "SourceDate": ["source_id", "file_date"]}


def token_rows(files: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Dated files whose name has a token, with ``token`` and, given the map of sources, ``group_id``."""
    rows = sound_files(files).where("file_date is not null").select("*", once(_suffix=suffix(F.col("name"), F.col("ext")))).withColumn("token", token(F.col("_suffix"))).drop("_suffix").where("token is not null")
    return rows.join(F.broadcast(groups), "source_id") if groups is not None else rows  # a row for each source


def _at_levels(rows: DataFrame, levels: dict[str, list[str]], more: list[str]) -> DataFrame:
    """Each row once for each level, with the columns that the level doesn't have as null; one shuffle serves all."""
    names = ["file_date", "group_id", "source_id"]
    keys = [F.struct(F.lit(level).alias("level"), *[(F.col(n) if n in parts else F.lit(None).cast(rows.schema[n].dataType)).alias(n) for n in names]) for level, parts in levels.items()]
    return rows.select(*more, F.explode(F.array(*keys)).alias("k")).select("k.*", *more)


def key_records(rows: DataFrame) -> DataFrame:
    """Per level and key: files, distinct assets, distinct assets that aren't empty, and their files."""
    return _at_levels(rows, KEY_LEVELS, ["token", "asset_id", "size"]).groupBy("level", "file_date", "group_id", "source_id", "token").agg(
        F.count("*").alias("files"), F.countDistinct("asset_id").alias("assets"), F.countDistinct(F.when(F.col("size") > 0, F.col("asset_id"))).alias("full_assets"), F.count(F.when(F.col("size") > 0, 1)).alias("full_files")
    )


def ambiguity(rows: DataFrame) -> DataFrame:
    """Per level, with and without empty assets: how far keys with several assets leave the choice open."""
    keys = key_records(rows)
    both = keys.select("level", F.explode(F.array(F.struct(F.lit(True).alias("with_empty"), F.col("assets").alias("n"), F.col("files").alias("f")), F.struct(F.lit(False).alias("with_empty"), F.col("full_assets").alias("n"), F.col("full_files").alias("f")))).alias("x")).select("level", "x.*").where("n > 0")
    several = F.col("n") > 1
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return both.groupBy("level", "with_empty").agg(
        F.count("*").alias("keys"),
        zero(F.count(F.when(several, 1))).alias("multi_asset_keys"),
        zero(F.sum(F.when(several, F.col("f")))).alias("files_in_multi_asset_keys"),
        zero(F.max("n")).alias("most_assets"),
        zero(F.sum(F.when(several, F.expr("n * (n - 1) div 2")))).alias("asset_pairs"),
        zero(F.sum(F.when(several, F.col("n") - 1))).alias("excess"),
    )


def assets_in_collisions(rows: DataFrame) -> DataFrame:
    """(level, with_empty, assets): distinct assets that share a key of the level with another asset, with and without empty assets."""
    own = _at_levels(rows, KEY_LEVELS, ["token", "asset_id", "size"]).groupBy("level", "file_date", "group_id", "source_id", "token", "asset_id").agg(F.max("size").alias("size"))
    both = own.select("*", F.explode(F.when(F.col("size") > 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("with_empty"))
    key = ["level", "with_empty", "file_date", "group_id", "source_id", "token"]
    shared = both.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    same = [both[c].eqNullSafe(shared[c]) for c in key]
    test = same[0]
    for x in same[1:]:
        test = test & x
    return both.join(shared, test, "left_semi").groupBy("level", "with_empty").agg(F.countDistinct("asset_id").alias("assets"))


def group_records(rows: DataFrame) -> DataFrame:
    """Per level and group: files, distinct assets, tokens and names, the range of tokens and the gaps inside it."""
    g = _at_levels(rows, GROUP_LEVELS, ["token", "asset_id", "name"]).groupBy("level", "file_date", "group_id", "source_id")
    out = g.agg(F.count("*").alias("files"), F.countDistinct("asset_id").alias("assets"), F.countDistinct("token").alias("tokens"), F.countDistinct("name").alias("names"), F.min("token").alias("least"), F.max("token").alias("greatest"))
    return out.withColumn("missing_inside", F.col("greatest") - F.col("least") + 1 - F.col("tokens"))


def continuity(rows: DataFrame) -> DataFrame:
    """Per level and band of the number of distinct tokens: groups, where they begin, and the gaps inside them."""
    gap = band(F.col("missing_inside"), GAP_BANDS)
    return group_records(rows).groupBy("level", band(F.col("tokens"), COUNT_BANDS).alias("band")).agg(
        F.count("*").alias("groups"), counted(F.col("least") == 0).alias("from_zero"), counted(F.col("least") == 1).alias("from_one"), counted(F.col("least") > 1).alias("from_higher"),
        *[counted(gap == label).alias(f"gap {label}") for label, _ in GAP_BANDS],
        F.sum("tokens").alias("distinct_tokens"), F.sum("missing_inside").cast("long").alias("missing"), F.max("missing_inside").cast("long").alias("most_missing"),
        counted(F.col("greatest") + 1 == F.col("tokens")).alias("perfect_prefix"), counted((F.col("missing_inside") == 0) & (F.col("least") > 0)).alias("gapless_not_from_zero"),
    )


def observed_minima(rows: DataFrame) -> DataFrame:
    """Per level, band of distinct tokens and least token: groups."""
    return group_records(rows).groupBy("level", band(F.col("tokens"), COUNT_BANDS).alias("band"), "least").agg(F.count("*").alias("groups"))


def group_populations(rows: DataFrame) -> DataFrame:
    """Per level and part (null: all; else the group or source), and measure: the spread of files, assets, tokens and names of its groups."""
    part = F.when(F.col("level") == "DeviceGroupDate", F.col("group_id")).when(F.col("level") == "SourceDate", F.col("source_id"))
    parts = F.when(part.isNotNull(), F.array(F.lit(None).cast("long"), part.cast("long"))).otherwise(F.array(F.lit(None).cast("long")))
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("n")) for m in ("files", "assets", "tokens", "names")])).alias("x")
    flat = group_records(rows).select("level", F.explode(parts).alias("part"), "files", "assets", "tokens", "names").select("level", "part", values).select("level", "part", "x.*")
    return count_summary(flat, ["level", "part", "measure"], "n")


def joint_bands(rows: DataFrame) -> DataFrame:
    """Per level: groups by the bands of their assets and of their tokens together; empty cells are left out."""
    g = group_records(rows).where("level <> 'Date'")
    return g.groupBy("level", band(F.col("assets"), COUNT_BANDS).alias("assets_band"), band(F.col("tokens"), COUNT_BANDS).alias("tokens_band")).agg(F.count("*").alias("groups"))


def joint_tables(rows: DataFrame) -> DataFrame:
    """Per level and table: groups by the band of their distinct tokens and by another property; empty cells are left out."""
    perfect = F.when(F.col("greatest") + 1 == F.col("tokens"), "MaximumPlusOneEqualsDistinctCount").otherwise("Otherwise")
    other = {
        "MaximumToken": band(F.col("greatest"), TOKEN_BANDS), "InternalGapCount": band(F.col("missing_inside"), GAP_BANDS), "MaximumPlusOneEqualsDistinctCount": perfect,
        "DistinctMediaAssetCount": band(F.col("assets"), COUNT_BANDS), "PhysicalFileCount": band(F.col("files"), COUNT_BANDS),
    }
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("by"), v.alias("column")) for k, v in other.items()])).alias("x")
    g = group_records(rows).where("level <> 'Date'").select("level", band(F.col("tokens"), COUNT_BANDS).alias("row"), cells)
    return g.select("level", "row", "x.*").groupBy("level", "by", "row", "column").agg(F.count("*").alias("groups"))


def signed_difference(rows: DataFrame) -> DataFrame:
    return group_records(rows).groupBy("level", (F.col("assets") - F.col("tokens")).alias("difference")).agg(F.count("*").alias("groups"))


def largest_token_group(rows: DataFrame) -> DataFrame:
    """One row: the source and date with the greatest token; ties by more files, then date, then source."""
    g = group_records(rows).where("level = 'SourceDate'")
    return g.orderBy(F.desc("greatest"), F.desc("files"), "file_date", "source_id").limit(1).select("source_id", "file_date", "greatest", "files")


def token_curve(rows: DataFrame) -> DataFrame:
    """Per token: files, assets, dates, and combinations of date with group and source."""
    return rows.groupBy("token").agg(F.count("*").alias("files"), F.countDistinct("asset_id").alias("assets"), F.countDistinct("file_date").alias("dates"), F.countDistinct("group_id", "file_date").alias("group_dates"), F.countDistinct("source_id", "file_date").alias("source_dates"))


def token_curve_by_group(rows: DataFrame) -> DataFrame:
    """Per token and device group: files and dates."""
    return rows.groupBy("token", "group_id").agg(F.count("*").alias("files"), F.countDistinct("file_date").alias("dates"))


def curve_ascents(rows: DataFrame) -> DataFrame:
    """One row: how often the curve of dates rises from a token to the next, and the largest rise.

    The curve has 10,000 points at most, so its order is made in one task whatever the number of files.
    """
    rise = F.col("dates") - F.lag("dates").over(Window.orderBy("token"))
    return token_curve(rows).select(rise.alias("rise")).agg(F.count(F.when(F.col("rise") > 0, 1)).alias("ascents"), F.coalesce(F.max(F.when(F.col("rise") > 0, F.col("rise"))), F.lit(0)).alias("largest_rise"))


def token_reuse(rows: DataFrame) -> DataFrame:
    """Dates per token, pooled and by device group and source: population, least, lower median and most."""
    names = {"Pooled": [], "DeviceGroup": ["group_id"], "Source": ["source_id"]}
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), (F.col(p[0]) if p else F.lit(None)).cast("long").alias("part")) for k, p in names.items()])).alias("k")
    per = rows.select("token", "file_date", keys).select("k.*", "token", "file_date").groupBy("level", "part", "token").agg(F.countDistinct("file_date").alias("n"))
    return per.groupBy("level", "part").agg(F.count("*").alias("tokens"), F.min("n").alias("least"), lower_median("n").cast("long").alias("lower_median"), F.max("n").alias("most"))


def token_agreement(rows: DataFrame) -> DataFrame:
    """Per level (source and date, group and date, date, everywhere): assets with several files in one of its cells, those
    cells, and the cells of one token. An asset counts at each level that has such a cell."""
    cells = rows.groupBy("asset_id", "file_date", "group_id", "source_id").agg(F.count("*").alias("n"), F.min("token").alias("lo"), F.max("token").alias("hi"))

    def up(df: DataFrame, by: list[str], label: str) -> DataFrame:
        return df.groupBy(*by).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.lit(label).alias("level"))

    levels = [("WithinSourceDate", ["asset_id", "file_date", "group_id", "source_id"]), ("WithinDeviceGroupDate", ["asset_id", "file_date", "group_id"]), ("WithinDate", ["asset_id", "file_date"]), ("AcrossDates", ["asset_id"])]
    parts = [up(cells, by, label).where("n > 1").select("asset_id", "level", (F.col("lo") == F.col("hi")).alias("same")) for label, by in levels]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.union(p)
    return all_.groupBy("level").agg(F.countDistinct("asset_id").alias("assets"), F.count("*").alias("cells"), F.count(F.when(F.col("same"), 1)).alias("same_token_cells"))


def token_locality(rows: DataFrame) -> DataFrame:
    """One row: assets with several distinct tokens, each counted at the narrowest level in which two of them stand:
    one source and date, one device group and date, one date, or only different dates."""
    cells = rows.groupBy("asset_id", "file_date", "group_id", "source_id").agg(F.min("token").alias("lo"), F.max("token").alias("hi"))
    in_group = cells.groupBy("asset_id", "file_date", "group_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_or(F.col("lo") < F.col("hi")).alias("in_source"))
    in_date = in_group.groupBy("asset_id", "file_date").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_or("in_source").alias("in_source"), F.bool_or(F.col("lo") < F.col("hi")).alias("in_group"))
    assets = in_date.groupBy("asset_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_or("in_source").alias("in_source"), F.bool_or("in_group").alias("in_group"), F.bool_or(F.col("lo") < F.col("hi")).alias("in_date")).where("lo < hi")
    place = F.when(F.col("in_source"), "source").when(F.col("in_group"), "group").when(F.col("in_date"), "date").otherwise("dates")
    return assets.withColumn("place", place).agg(F.count("*").alias("assets"), *[counted(F.col("place") == p).alias(n) for p, n in (("source", "within_source_and_date"), ("group", "within_group_and_date"), ("date", "across_groups"), ("dates", "across_dates"))])


def source_pairs(rows: DataFrame) -> DataFrame:
    """Copies of one asset on one date in two sources: pairs of sources, and those that have one equal token.

    Pairs are counted, not made: of k sources with one token each, equal ones are grouped first.
    """
    per = rows.groupBy("asset_id", "file_date", "source_id").agg(F.min("token").alias("lo"), F.max("token").alias("hi"))
    single = per.groupBy("asset_id", "file_date", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("token")).agg(F.count("*").alias("k"))
    per_date = single.groupBy("asset_id", "file_date").agg(F.sum("k").alias("sources"), F.sum(F.when(F.col("token").isNotNull(), F.expr("k * (k - 1) div 2")).otherwise(0)).alias("agreeing"))
    return per_date.agg(F.coalesce(F.sum(F.expr("sources * (sources - 1) div 2")), F.lit(0)).alias("pairs"), F.coalesce(F.sum("agreeing"), F.lit(0)).alias("agreeing_pairs"))


def empty_assets(rows: DataFrame) -> DataFrame:
    """One row: files, assets and tokens of empty assets, and whether their tokens are all one (null below two files)."""
    e = rows.where("size = 0")
    return e.agg(F.count("*").alias("files"), F.countDistinct("asset_id").alias("assets"), F.countDistinct("token").alias("tokens"), F.when(F.count("*") >= 2, F.countDistinct("token") == 1).alias("same_token"))


def date_populations(files: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: dates with eligible media, with tokens, with both, and with only one."""
    media = sound_files(files).where("file_date is not null and size > 0").select("file_date", F.lit(1).alias("m"), F.lit(0).alias("t"))
    both = media.union(rows.select("file_date", F.lit(0).alias("m"), F.lit(1).alias("t"))).groupBy("file_date").agg(F.max("m").alias("m"), F.max("t").alias("t"))
    return both.agg(F.sum("m").cast("long").alias("media_dates"), F.sum("t").cast("long").alias("token_dates"), F.sum(F.col("m") * F.col("t")).cast("long").alias("both"), F.count(F.when(F.col("t") == 0, 1)).alias("media_only"), F.count(F.when(F.col("m") == 0, 1)).alias("token_only"))
