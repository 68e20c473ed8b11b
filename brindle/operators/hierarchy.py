"""Hierarchies as edge tables: depth, roots, leaves and rollups, level by level.

Each level is one join and one pre-aggregated sum, kept in the shared folder, so neither the number of paths nor shared children matter.  Only
a table with cycles (or more than `depth` levels) is walked by paths, which stop where an element comes again; so is a path to the root."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.lineage import kept

MAX_DEPTH = 50
MONEY = T.DecimalType(28, 2)


def edges(df: DataFrame, parent: str, child: str) -> DataFrame:
    """(parent, child) as text; rows without a child go."""
    return df.select(F.trim(F.col(f"`{parent}`").cast("string")).alias("parent"), F.trim(F.col(f"`{child}`").cast("string")).alias("child")).filter("child IS NOT NULL")


def walk(edge: DataFrame, start: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(root, element, level, path): every path down from the start elements (one column), level 0 being the start; an element that is on
    its path already ends it, and depth bounds it."""
    spark = edge.sparkSession
    return spark.sql(
        f"""
        WITH RECURSIVE e AS (SELECT parent, child FROM {{edge}} WHERE parent <> child),
        w(root, element, level, path) AS (
            SELECT element, element, 0, array(element) FROM {{start}}
            UNION ALL
            SELECT w.root, e.child, w.level + 1, array_append(w.path, e.child) FROM w JOIN e ON e.parent = w.element
            WHERE NOT array_contains(w.path, e.child) AND w.level < {depth}
        )
        SELECT root, element, level, path FROM w
        """,
        edge=edge.filter("parent IS NOT NULL").distinct(),
        start=start.toDF("element").distinct(),
    )


def _levels(start: DataFrame, step, depth: int) -> tuple[list[DataFrame], bool]:
    """The tables start, step(start), step(step(start)), ... down to the last one with rows; and whether it came within depth."""
    out = [kept(start)]
    while len(out) <= depth + 1:
        after = kept(step(out[-1]))
        if not after.limit(1).count():
            return out, True
        out.append(after)
    return out, False


def pattern(df: DataFrame, parent: str, child: str) -> str:
    """contains_children if any row refers to itself (such rows mark leaves), else child_references_parent."""
    e = edges(df, parent, child)
    return "contains_children" if e.filter("parent = child").limit(1).count() else "child_references_parent"


def analyze(df: DataFrame, parent: str, child: str) -> DataFrame:
    """One row: hierarchy_pattern, self_referencing_rows, element_count, root_count, leaf_count, max_depth (levels below the roots)."""
    e = edges(df, parent, child)
    real = e.filter("parent <> child").distinct()
    parents, children = real.select(F.col("parent").alias("element")).distinct(), real.select(F.col("child").alias("element")).distinct()
    every = e.select(F.explode(F.array("parent", "child")).alias("element")).filter("element IS NOT NULL").distinct()
    roots = every.join(children, "element", "left_anti")
    leaves = every.join(parents, "element", "left_anti")
    real = kept(real)
    below = lambda top: real.join(top, real.parent == top.element).select(F.col("child").alias("element")).distinct()
    held, ended = _levels(roots, below, MAX_DEPTH)
    if ended:
        deepest = df.sparkSession.range(1).select(F.lit(len(held) - 1).alias("max_depth"))
    else:
        deepest = walk(real, roots).agg(F.coalesce(F.max("level"), F.lit(0)).alias("max_depth"))
    counted = lambda d, name: d.agg(F.count("*").alias(name))
    one = e.agg(F.count_if(F.col("parent") == F.col("child")).alias("self_referencing_rows"))
    for d in (counted(every, "element_count"), counted(roots, "root_count"), counted(leaves, "leaf_count"), deepest):
        one = one.crossJoin(d)  # one row each
    kind = F.when(F.col("self_referencing_rows") > 0, "contains_children").otherwise("child_references_parent")
    return one.select(kind.alias("hierarchy_pattern"), "*")


def level_counts(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """level, column, unique_values of level columns."""
    rows = F.array(*(F.struct(F.lit(i + 1).alias("level"), F.lit(c).alias("column"), F.col(f"c{i}").alias("unique_values")) for i, c in enumerate(levels)))
    return df.agg(*(F.count_distinct(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(levels))).select(F.explode(rows).alias("r")).select("r.*")


def path_to_root(df: DataFrame, parent: str, child: str, element: str, depth: int = 20) -> DataFrame:
    """(element, level): the element and what lies above it, of several parents the smallest."""
    up = edges(df, parent, child).filter("parent <> child").groupBy(F.col("child").alias("parent")).agg(F.min("parent").alias("child"))
    start = df.sparkSession.createDataFrame([(element,)], "element string")
    return walk(up, start, depth).select("element", "level")


def children(df: DataFrame, parent: str, child: str, element: str) -> DataFrame:
    return edges(df, parent, child).filter((F.col("parent") == element) & (F.col("child") != element)).select(F.col("child").alias("element")).distinct()


def descendants(df: DataFrame, parent: str, child: str, element: str, depth: int = 10) -> DataFrame:
    """(element, level): all that lies below, each at its least level."""
    real = kept(edges(df, parent, child).filter("parent <> child").distinct())
    seen = kept(df.sparkSession.createDataFrame([(element, 0)], "element string, level int"))
    for level in range(1, depth + 1):
        last = seen.filter(F.col("level") == level - 1)
        fresh = real.join(last, real.parent == last.element).select(F.col("child").alias("element")).distinct().join(seen.select("element"), "element", "left_anti")
        fresh = kept(fresh.withColumn("level", F.lit(level)))
        if not fresh.limit(1).count():
            break
        seen = seen.unionByName(fresh)
    return seen.filter("level > 0")


def rollup(df: DataFrame, parent: str, child: str, amounts: DataFrame, key: str, amount: str, depth: int = MAX_DEPTH) -> DataFrame:
    """element, direct_amount, total_amount (2 digits): an element's amount and those of all paths below it (one reached twice counts twice).

    With rows that refer to themselves, parents hold their children and only amounts of elements without children add up; otherwise each
    child has one parent, the smallest."""
    e = edges(df, parent, child)
    real = e.filter("parent <> child").distinct()
    own = amounts.groupBy(F.trim(F.col(f"`{key}`").cast("string")).alias("element")).agg(F.sum(F.col(f"`{amount}`").cast(T.DecimalType(18, 2))).alias("amount"))
    if pattern(df, parent, child) == "child_references_parent":
        real = real.groupBy("child").agg(F.min("parent").alias("parent")).select("parent", "child")
    else:
        own = own.join(real.select(F.col("parent").alias("element")).distinct(), "element", "left_anti")
    every = e.select(F.explode(F.array("parent", "child")).alias("element")).filter("element IS NOT NULL").distinct()
    real = kept(real)
    # The amounts of one level move up to the parents, and are summed there before they move on.
    up = lambda held: real.join(held, real.child == held.element).groupBy(F.col("parent").alias("element")).agg(F.sum("amount").cast(MONEY).alias("amount"))
    held, ended = _levels(every.join(own, "element").select("element", F.col("amount").cast(MONEY).alias("amount")), up, depth)
    if ended:
        total = reduce(DataFrame.unionByName, held).groupBy("element").agg(F.sum("amount").alias("total"))
    else:
        paths = walk(real, every, depth).groupBy("root", "element").agg(F.count("*").alias("times"))
        total = paths.join(own, "element").groupBy(F.col("root").alias("element")).agg(F.sum(F.col("amount") * F.col("times")).alias("total"))
    out = every.join(total, "element", "left").join(own, "element", "left")
    money = lambda c: F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 2)
    return out.select("element", money("amount").alias("direct_amount"), money("total").alias("total_amount"))


def breakdown(rolled: DataFrame, df: DataFrame, parent: str, child: str, element: str, depth: int = 10) -> dict:
    """One element's amounts as nested dictionaries (for reports: a bounded walk)."""
    e = {}
    for r in walk(edges(df, parent, child), df.sparkSession.createDataFrame([(element,)], "element string"), depth).collect():
        if len(r.path) > 1:
            e.setdefault(r.path[-2], set()).add(r.element)
    names = {element, *e, *(c for cs in e.values() for c in cs)}
    held = {r.element: r for r in rolled.filter(F.col("element").isin(*names)).collect()}
    grow = lambda n, seen: {"element": n, "total_amount": held[n].total_amount if n in held else 0.0, "children": [grow(c, {*seen, c}) for c in sorted(e.get(n, ())) if c not in seen]}
    return grow(element, {element})


#: Parts of names of level, parent and child columns.
LEVEL_NAMES, PARENT_NAMES, CHILD_NAMES = ("level", "lvl", "tier", "depth"), ("parent", "header"), ("child", "element", "id", "code", "key")


def detect_columns(df: DataFrame) -> dict:
    """Which columns make the hierarchy, by name; else the first two columns, if they share values."""
    low = {c: c.lower() for c in df.columns}
    has = lambda c, names: any(n in low[c] for n in names)
    levels = [c for c in df.columns if has(c, LEVEL_NAMES)]
    rest = [c for c in df.columns if c not in levels]
    parent = next((c for c in rest if has(c, PARENT_NAMES)), None)
    child = next((c for c in rest if c != parent and not has(c, PARENT_NAMES) and has(c, CHILD_NAMES)), None)
    if levels:
        return {"hierarchy_type": "level_based", "levels": levels}
    if parent and child:
        return {"hierarchy_type": "parent_child", "parent": parent, "child": child}
    if not parent and not child and len(df.columns) >= 2:
        a, b = df.columns[:2]
        text = lambda c: df.select(F.col(f"`{c}`").cast("string").alias("v"))
        if text(a).join(text(b).distinct(), "v", "left_semi").limit(1).count():
            return {"hierarchy_type": "parent_child", "parent": a, "child": b}
    return {"hierarchy_type": "none_detected"}
