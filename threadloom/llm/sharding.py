"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Which rows of which input partition go to which shard is settled in two steps. First the *matrix* is drawn:
how many rows each partition sends to each shard. Under a uniform shuffle those counts follow the multivariate
hypergeometric law given both margins (rows of each partition, rows of each shard), so they are drawn from it
exactly, and the shards have exact sizes whatever is drawn. Then each partition permutes its rows locally, sends
consecutive runs of them to the shards, and each shard permutes what arrived.

The matrix is drawn by halving: the rows of all partitions are split between the left and the right half of the
partitions, then each half again. One level is one projection, so P partitions take log2(P) levels.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.storage import materialize

#: Rows that one task ranks at once in the last permutation.
BLOCK_ROWS = 1_000_000
#: Standard deviations to either side of the mode that a draw can reach; beyond them lies less than 2e-32.
REACH = 12


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on ``parts`` only."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _hypergeometric(draws: Column, good: Column, total: Column, u: Column) -> Column:
    """How many of ``draws`` rows taken from ``total`` are among its ``good`` ones, by inversion at ``u``.

    Weights run outwards from the mode by the ratio of neighbouring probabilities, so nothing overflows. The order
    in which an inversion goes through the counts is free: the mode first, then those above it, then those below it.
    """
    given = F.struct(draws.cast("double").alias("d"), good.cast("double").alias("g"), total.cast("double").alias("t"), u.alias("u"))

    def with_mode(x: Column) -> Column:
        d, g, t = x["d"], x["g"], x["t"]
        low, high = F.greatest(F.lit(0.0), d + g - t), F.least(d, g)
        mode = F.least(high, F.greatest(low, F.floor((d + 1) * (g + 1) / (t + 2)).cast("double")))
        share = g / F.greatest(t, F.lit(1.0))
        reach = F.ceil(F.sqrt(F.greatest(F.lit(1.0), d * share * (1 - share))) * REACH + 20)
        return F.struct(x["d"].alias("d"), x["g"].alias("g"), (t - g - d).alias("rest"), x["u"].alias("u"), mode.cast("long").alias("mode"), F.least(high.cast("long"), mode.cast("long") + reach).alias("last"), F.greatest(low.cast("long"), mode.cast("long") - reach).alias("first"))

    def walk(x: Column, up: bool, sum_: Column, goal: Column) -> Column:
        """Past the mode to one side: the running sum, and the first count at which it reaches ``goal``."""
        end, step = (x["last"], 1) if up else (x["first"], -1)
        counts = F.when(x["mode"] != end, F.sequence(x["mode"] + step, F.when(x["mode"] != end, end).otherwise(x["mode"] + step), F.lit(step).cast("long"))).otherwise(F.array().cast("array<long>"))
        start = F.struct(F.lit(1.0).alias("w"), sum_.alias("sum"), F.lit(None).cast("long").alias("n"), goal.alias("goal"))

        def move(s: Column, k: Column) -> Column:
            ratio = ((x["g"] - k + 1) * (x["d"] - k + 1)) / (k * (x["rest"] + k)) if up else ((k + 1) * (x["rest"] + k + 1)) / ((x["g"] - k) * (x["d"] - k))
            at = s["w"] * ratio
            return F.struct(at.alias("w"), (s["sum"] + at).alias("sum"), F.coalesce(s["n"], F.when(s["sum"] + at >= s["goal"], k)).alias("n"), s["goal"].alias("goal"))

        return F.aggregate(counts, start, move)

    def with_goal(x: Column) -> Column:
        above = _let(walk(x, True, F.lit(1.0), F.lit(float("inf"))), lambda s: s["sum"])
        whole = _let(above, lambda a: walk(x, False, a, F.lit(float("inf")))["sum"])
        return F.struct(x.alias("x"), (x["u"] * whole).alias("goal"))

    def found(y: Column) -> Column:
        def below(s: Column) -> Column:
            return F.when(s["n"].isNull(), F.coalesce(walk(y["x"], False, s["sum"], y["goal"])["n"], y["x"]["mode"])).otherwise(s["n"])

        return F.when(y["goal"] <= 1.0, y["x"]["mode"]).otherwise(_let(walk(y["x"], True, F.lit(1.0), y["goal"]), below))

    return _let(_let(_let(given, with_mode), with_goal), found)


def _half(margin: Column, rows: Column, total: Column, seed: int, *key: Column) -> Column:
    """Shares of the ``rows`` in the left half, shard by shard: a multivariate hypergeometric vector."""

    def take(state: Column, at: Column) -> Column:
        here = margin[at]
        n = _hypergeometric(state["rows"], here, state["total"], _uniform(F.lit(seed), at, *key))
        return F.struct((state["rows"] - n).alias("rows"), (state["total"] - here).alias("total"), F.concat(state["out"], F.array(n)).alias("out"))

    start = F.struct(rows.alias("rows"), total.alias("total"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(margin) - 1), start, take, lambda s: s["out"])


def communication_matrix(counts: DataFrame, n_partitions: int, n_rows: int, n_shards: int, seed: int) -> DataFrame:
    """(pid, sends array<long>): exact counts from each partition to each shard.

    ``counts`` has (pid int from 0, n long), one row for each partition that has rows; partitions without rows
    may be missing. The shards' sizes differ by one at most.
    """
    levels = max(0, ceil(log2(max(1, n_partitions))))
    width = 1 << levels
    margin = [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]
    spark = counts.sparkSession
    tree = spark.range(1).select(F.lit(0).alias("node"), F.lit(n_rows).cast("long").alias("total"), F.array(*[F.lit(m).cast("long") for m in margin]).alias("sends"))
    for level in range(levels):
        span = width >> (level + 1)
        left = counts.where((F.expr(f"pid div {span}") % 2) == 0).groupBy(F.expr(f"int(pid div {2 * span})").alias("node")).agg(F.sum("n").alias("rows"))
        split = tree.join(left, "node", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
        split = split.withColumn("first", _half(F.col("sends"), F.col("rows"), F.col("total"), seed, F.lit(level), F.col("node")))
        both = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("rows").alias("total"), F.col("first").alias("sends")),
            F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("total") - F.col("rows")).alias("total"), F.zip_with("sends", "first", lambda a, b: a - b).alias("sends")),
        )
        tree = split.select(F.explode(both).alias("x")).select("x.*").where("total > 0")
        if level % 4 == 3:  # a plan of twenty nested levels costs more to optimise than the draws themselves
            tree = materialize(tree, "matrix")
    return tree.select(F.col("node").alias("pid"), "sends")


def shuffle_into_shards(df: DataFrame, n_shards: int, seed: int = 17) -> DataFrame:
    """Append ``shard`` (int from 0) and ``slot`` (long, gapless from 0 in its shard) to every row of ``df``.

    Every assignment of rows to places is equally likely (up to the generator); shard sizes differ by one at most.
    Rows are told apart by place, not content: nulls, equal rows and hot keys spread like all others. An empty
    input gives no rows. Columns named like the two new ones are replaced.
    """
    own = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")
    # Local permutation: sorted by a random number, a row's place is its position in its partition.
    dealt = df.select(row).withColumn("_u", F.rand(seed)).sortWithinPartitions("_u").withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt.select("row", F.shiftright("_at", 33).cast("int").alias("pid"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("pos")), "dealt")
    counts = materialize(dealt.groupBy("pid").agg(F.count("*").alias("n")), "counts")
    n_rows, n_partitions = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("pid") + 1, F.lit(0))).first()
    matrix = communication_matrix(counts, n_partitions, n_rows, n_shards, seed)
    ends = F.transform(F.sequence(F.lit(1), F.size("sends")), lambda i: F.aggregate(F.slice("sends", 1, i), F.lit(0).cast("long"), lambda a, x: a + x))
    bounds = matrix.select("pid", ends.alias("ends"))
    sent = dealt.join(bounds, "pid").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("pos"))))
    # Second permutation: a random block of the shard, then a random order in the block.
    blocks = max(1, ceil(n_rows / n_shards / BLOCK_ROWS), ceil(256 / n_shards) if n_rows > 10_000 else 1)
    sent = sent.withColumn("u", _uniform(F.lit(seed + 1), F.col("pid"), F.col("pos"))).withColumn("block", F.floor(F.col("u") * blocks).cast("int")).select("row", "shard", "block", "u", "pid", "pos")
    sizes = sent.groupBy("shard", "block").agg(F.count("*").alias("n"))
    starts = sizes.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("u", "pid", "pos"))
    out = sent.withColumn("rank", rank).join(starts, ["shard", "block"])
    return out.select("row.*", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"))
