"""Joins, set operations, aggregation, reshaping, fills, deduplication, limits: plain DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATES = ("sum", "avg", "mean", "count", "min", "max", "first", "last")


# ---- joins -------------------------------------------------------------------------------------------------------


def join_tables(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "inner") -> DataFrame:
    """Equi-join with differing key names; only the left key stays."""
    l, r = left.alias("l"), right.alias("r")  # noqa: E741
    out = l.join(r, F.col(f"l.`{left_on}`") == F.col(f"r.`{right_on}`"), how)
    return out if how in ("left_semi", "left_anti", "semi", "anti") else out.drop(F.col(f"r.`{right_on}`"))


def _spread(df: DataFrame) -> DataFrame:
    """df over all shuffle partitions: for a join that makes many rows of each, in the few tasks of a small table."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))


def join_files(frames: Sequence[DataFrame], keys: Sequence[str], how: str = "inner", repeats: bool = False) -> DataFrame:
    """Left-deep join on common keys; other columns that clash get the suffix _file1, _file2, ...

    repeats says that keys stand in many rows of several files: rows are spread before each join after the first."""
    out = frames[0]
    for i, df in enumerate(frames[1:], 1):
        if repeats and i > 1:
            out = _spread(out)
        clash = {c: f"{c}_file{i}" for c in df.columns if c in out.columns and (how == "cross" or c not in keys)}
        df = df.withColumnsRenamed(clash)
        out = out.crossJoin(df) if how == "cross" else out.join(df, list(keys), how)
    return out


def join_on(left: DataFrame, right: DataFrame, on: str, how: str = "inner", left_name: str = "t1", right_name: str = "t2") -> DataFrame:
    """Any ON text over the aliases t1 and t2; equalities become hash or merge joins."""
    return left.alias(left_name).join(right.alias(right_name), F.expr(on), how)


def as_of_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: Sequence[str], values: Sequence[str], bucket_seconds: int = 30 * 86_400) -> DataFrame:
    """Each left row with the values of the latest right row of its group at or before its time.

    Both sides are dealt by group and time bucket, so one hot group spreads over its buckets; what is in force when a
    bucket begins comes from a second, tiny pass over each bucket's last right row.  Column names: values, and right_time.
    """
    keep = [F.struct(F.col(right_time).alias("t"), *(F.col(v).alias(v) for v in values)).alias("__right")]
    seconds = lambda c: F.expr(f"floor(unix_timestamp(CAST(`{c}` AS TIMESTAMP)) / {bucket_seconds})")
    l = left.withColumn("__bucket", seconds(left_time)).withColumn("__at", F.col(left_time).cast("timestamp")).withColumn("__mine", F.lit(1)).withColumn("__row", F.struct(*(F.col(f"`{c}`") for c in left.columns)))  # noqa: E741
    r = right.withColumn("__bucket", seconds(right_time)).withColumn("__at", F.col(right_time).cast("timestamp")).withColumn("__mine", F.lit(0)).select(*by, "__bucket", "__at", "__mine", *keep)
    both = l.select(*by, "__bucket", "__at", "__mine", "__row").unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by, "__bucket").orderBy("__at", "__mine").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__now", F.last("__right", ignorenulls=True).over(w)).filter("__mine = 1")
    ends = both.groupBy(*by, "__bucket").agg(F.max_by("__right", F.when(F.col("__right").isNotNull(), F.col("__at"))).alias("__end"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__held", F.last("__end", ignorenulls=True).over(before)).select(*by, "__bucket", "__held")
    carried = carried.withColumnsRenamed({c: f"__c{i}" for i, c in enumerate([*by, "__bucket"])})
    same = reduce(lambda x, y: x & y, (F.col(f"`{c}`").eqNullSafe(F.col(f"__c{i}")) for i, c in enumerate([*by, "__bucket"])))  # null is a group, too
    out = found.join(carried, same, "left").withColumn("__best", F.coalesce("__now", "__held"))
    return out.select("__row.*", *(F.col(f"__best.{v}").alias(v) for v in values), F.col("__best.t").alias(right_time))


def _blocks(df: DataFrame, keys: Sequence[str], bins: Column, side: str, size: int = 4096, piece: int = 128) -> DataFrame:
    """A row for each block of df: up to `size` rows of one bin that are neighbours by their keys, in pieces of up to `piece` rows, with the least and
    greatest keys of each.  Rows without a bin are left out.

    Blocks are cut from sorted ranges in which rows of equal keys are told apart by a hash, so that a hot key is many blocks."""
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("rows"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.xxhash64(*(F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t)).alias("mix"), bins.alias("bin"))
    names = [f"k{i}" for i in range(len(keys))]
    order = ["bin", *names, "mix"]
    cut = rows.filter("bin IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())  # a partition begins at a multiple of 2^33
    cut = cut.select("*", F.expr(f"at div {size}").alias("block"), F.expr(f"at div {piece}").alias("piece")).repartition("bin", "block")
    ends = {f"{f.__name__}{n}": f(n) for n in names for f in (F.min, F.max)}
    pieces = cut.groupBy("bin", "block", "piece").agg(F.collect_list("rows").alias("rows"), *(c.alias(n) for n, c in ends.items()))
    ends = {n: getattr(F, n[:3])(n) for n in ends}
    return pieces.groupBy("bin", "block").agg(F.collect_list(F.struct(*ends, "rows")).alias(side), *(c.alias(f"{side}{n}") for n, c in ends.items())).drop("block").withColumnRenamed("bin", f"{side}bin")


def _pairs_in_blocks(left: DataFrame, right: DataFrame, value: str, low: str, high: str, at: Column, touched: Column) -> DataFrame:
    """The inner range join of rows of which many share values and ranges: blocks meet in the bins and are spread, and rows meet in them."""
    met = _blocks(left, [value], at, "l").join(_blocks(right, [low, high], touched, "r").hint("merge"), F.expr("lbin = rbin AND lmaxk0 >= rmink0 AND lmink0 < rmaxk1")).select("l", "r")
    # Lambdas keep this step out of generated code, which holds all that comes of a row in memory: here a pair of pieces, not one of blocks.
    two = F.transform("l", lambda l: F.transform(F.filter("r", lambda r: (l["maxk0"] >= r["mink0"]) & (l["mink0"] < r["maxk1"])), lambda r: F.struct(l["rows"].alias("l"), r["rows"].alias("r"))))
    pieces = _spread(met).select(F.explode(F.flatten(two)).alias("two"))
    pairs = pieces.select(F.explode("two.l").alias("l"), "two.r").select("l", F.explode("r").alias("r"))
    return pairs.filter((F.col("l")[value] >= F.col("r")[low]) & (F.col("l")[value] < F.col("r")[high])).select("l.*", "r.*")


def range_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float, how: str = "inner", repeats: bool = False) -> DataFrame:
    """low <= value < high as an equi-join on bins of a width: each range is listed in the bins it touches, each value in one.

    repeats says that many rows share values and ranges (inner and left joins): blocks of neighbouring rows are shuffled and meet in the bins,
    once each, so that what is shuffled is small beside the pairs, and no task gets all pairs of a hot value."""
    at = F.floor(F.col(value) / width)
    touched = F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    if repeats:
        if how not in ("inner", "left"):
            raise ValueError(f"repeats goes with inner and left joins, not {how!r}")
        pairs = _pairs_in_blocks(left, right, value, low, high, at, touched)
        if how == "inner":
            return pairs
        v = left.select(F.col(value).alias("__value")).distinct()
        found = range_join(v, right.select(F.col(low).alias("__low"), F.col(high).alias("__high")).distinct(), "__value", "__low", "__high", width).select("__value").distinct()
        alone = left.join(found, F.col(value) == F.col("__value"), "left_anti")
        return pairs.union(alone.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema)))
    l, r = left.withColumn("__bin", at), right.withColumn("__bin", touched)  # noqa: E741
    on = (l["__bin"] == r["__bin"]) & (l[value] >= r[low]) & (l[value] < r[high])
    return l.join(r, on, how).drop(l["__bin"]).drop(r["__bin"])


# ---- sets ----------------------------------------------------------------------------------------------------------


def union_files(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows by column name; numbers widen.  The names must be the same."""
    for df in frames[1:]:
        if sorted(df.columns) != sorted(frames[0].columns):
            raise ValueError("the tables have different columns")
    return reduce(DataFrame.unionByName, frames)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


# ---- aggregation and shape -------------------------------------------------------------------------------------------


def _aggregate(function: str, column: str, order_by: str | None) -> Column:
    c = F.col(f"`{column}`")
    if function in ("first", "last"):
        if order_by is None:
            raise ValueError("first and last need order_by")
        return (F.min_by if function == "first" else F.max_by)(c, F.col(order_by))
    if function not in AGGREGATES:
        raise ValueError(f"unknown aggregate {function!r}; there are {', '.join(AGGREGATES)}")
    return {"mean": F.avg}.get(function, getattr(F, function))(c)


def aggregate(df: DataFrame, group_by: str | Sequence[str], aggregations: list[dict], order_by: str | None = None) -> DataFrame:
    """aggregations: {column, function, alias (default column_function)}; count skips nulls."""
    keys = [group_by] if isinstance(group_by, str) else list(group_by)
    return df.groupBy(*keys).agg(*(_aggregate(a["function"], a["column"], order_by).alias(a.get("alias") or f"{a['column']}_{a['function']}") for a in aggregations))


def pivot(df: DataFrame, values: str, index: str | Sequence[str], columns: str, function: str = "sum", known: Sequence | None = None) -> DataFrame:
    """A column for each value of `columns` (give known ones, which saves a pass); empty cells are null."""
    keys = [index] if isinstance(index, str) else list(index)
    return df.groupBy(*keys).pivot(columns, list(known) if known else None).agg(_aggregate(function, values, None))


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable_name: str = "variable", value_name: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), variable_name, value_name)


def value_counts(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """The most frequent values with counts and their percentage of all rows (ties by value)."""
    groups = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    total = groups.agg(F.sum("count").alias("total"))
    shown = groups.crossJoin(F.broadcast(total)).withColumn("pct", F.round(F.col("count") * 100.0 / F.col("total"), 1))  # one row
    return shown.select("value", "count", "pct").orderBy(F.desc("count"), F.asc_nulls_first("value")).limit(top)


# ---- nulls and duplicates --------------------------------------------------------------------------------------------


def fill_nulls(df: DataFrame, column: str, strategy: str = "literal", value=None, order_by: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """literal, forward, backward (need order_by; partition_by keeps groups apart), mean, median or mode (ties: the least)."""
    c = F.col(column)
    if strategy == "literal":
        return df.withColumn(column, F.coalesce(c, F.lit(value)))
    if strategy in ("forward", "backward"):
        if order_by is None:
            raise ValueError(f"{strategy} needs order_by")
        return _fill_ordered(df, column, strategy, order_by, list(partition_by))
    if strategy == "mean":
        one = df.agg(F.avg(c).alias("__fill"))
    elif strategy == "median":
        from brindle.operators.validate import exact_median

        one = exact_median(df.select(F.lit(column).alias("column"), c.cast("double").alias("v"))).select(F.col("median").alias("__fill"))
    elif strategy == "mode":  # values are counted first: one row a value meets in the end
        counts = df.filter(c.isNotNull()).groupBy(c.alias("v")).agg(F.count("*").alias("n"))
        one = counts.agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("__fill"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    one = one.agg(F.max("__fill").alias("__fill"))  # one row, also for an empty table
    return df.crossJoin(F.broadcast(one)).withColumn(column, F.coalesce(c, F.col("__fill"))).drop("__fill")


def _fill_ordered(df: DataFrame, column: str, strategy: str, order_by: str, by: list[str], chunk: int = 100_000) -> DataFrame:
    """Rows are ranked by group and order (nulls first) in ranges, and cut into chunks: each chunk of a group gets what its neighbour ends with, so
    one hot group spreads over its chunks."""
    from brindle.functions.lineage import ranked

    ahead = strategy == "forward"
    names = {c: f"__by{i}" for i, c in enumerate(by)}
    order = [F.col(f"`{c}`").alias(n) for c, n in names.items()]
    rows = ranked(df.select("*", *order, F.col(f"`{order_by}`").alias("__order")), [*names.values(), "__order"]).withColumn("__part", F.expr(f"rank div {chunk}"))
    groups = [*names.values(), "__part"]
    # Backward goes down the ranks: a frame that ends at its row is carried along, one that starts there is read again for each row.
    way = F.col if ahead else F.desc
    inside = rows.withColumn("__fill", F.last(column, ignorenulls=True).over(Window.partitionBy(*groups).orderBy(way("rank")).rowsBetween(Window.unboundedPreceding, 0)))
    edge = (F.max_by if ahead else F.min_by)(column, F.when(F.col(f"`{column}`").isNotNull(), F.col("rank")))
    past = Window.partitionBy(*names.values()).orderBy(way("__part")).rowsBetween(Window.unboundedPreceding, -1)
    edges = rows.groupBy(*groups).agg(edge.alias("__edge")).select(*groups, F.last("__edge", ignorenulls=True).over(past).alias("__edge"))  # a row a chunk and group
    edges = edges.filter("__edge IS NOT NULL").withColumnsRenamed({g: f"{g}_e" for g in groups})
    same = reduce(lambda x, y: x & y, (F.col(g).eqNullSafe(F.col(f"{g}_e")) for g in groups))
    out = inside.join(edges, same, "left").withColumn(column, F.coalesce("__fill", "__edge"))
    return out.select(*(F.col(f"`{c}`") for c in df.columns))


def drop_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(columns) if columns else None)


def unique(df: DataFrame, columns: Sequence[str] | None = None, keep: str = "first", order_by: str | None = None) -> DataFrame:
    """One row of each key: any; first or last by order_by; none keeps only keys that stand once."""
    keys = list(columns) if columns else df.columns
    if keep == "any" or keep in ("first", "last") and not columns:
        return df.dropDuplicates(keys)
    if keep == "none":
        every = F.struct(*(F.col(f"`{c}`") for c in df.columns))
        return df.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(every).alias("__row")).filter("__n = 1").select("__row.*")
    if keep not in ("first", "last"):
        raise ValueError(f"unknown keep {keep!r}")
    if order_by is None:
        raise ValueError("first and last need order_by")
    # An aggregate, not a window: copies of a hot key meet pre-aggregated.
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.groupBy(*keys).agg((F.min_by if keep == "first" else F.max_by)(row, F.col(order_by)).alias("__row")).select("__row.*")


# ---- order, limits, samples ---------------------------------------------------------------------------------------------


def sort(df: DataFrame, by: str | Sequence[str], descending: bool | Sequence[bool] = False) -> DataFrame:
    """Nulls come first in both directions."""
    keys = [by] if isinstance(by, str) else list(by)
    down = [descending] * len(keys) if isinstance(descending, bool) else list(descending)
    return df.orderBy(*(F.desc_nulls_first(k) if d else F.asc_nulls_first(k) for k, d in zip(keys, down, strict=True)))


def paginate(df: DataFrame, page: int, page_size: int, order_by: Sequence[str]) -> DataFrame:
    """Page 1 is the first."""
    return df.orderBy(*order_by).offset((page - 1) * page_size).limit(page_size)


def top_groups(df: DataFrame, group_by: str, measure: str, top: int = 20) -> DataFrame:
    return df.groupBy(group_by).agg(F.sum(measure).alias("total"), F.count("*").alias("count")).orderBy(F.desc("total"), group_by).limit(top)


def truncated(df: DataFrame, most: int = 200) -> DataFrame:
    """Text columns cut to `most` characters, the last three of which are dots."""
    cut = lambda c: F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(F.col(c)).alias(c)
    return df.select(*(cut(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes))


def preview(df: DataFrame, rows: int = 10, order_by: Sequence[str] = ()) -> DataFrame:
    """At most 100 rows with texts cut to 200 characters."""
    return truncated(df.orderBy(*order_by) if order_by else df).limit(min(rows, 100))
