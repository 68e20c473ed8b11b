"""Mixing sources to target weights with a time-varying curriculum.

A source has a target number of words and a schedule: its rate over training time t in 0..1 is
target * (1 + slope * (2t - 1)), whose integral, the cumulative demand, is D(t) = target * (t + slope * (t^2 - t)).
The source's documents, in a fixed hash order, lie end to end in words; the document that starts at word c is due at
t = D^-1(c), its training position.  All sources' documents are then range-sorted by position.

Targets fill up like water: the budget is shared by weight, a source stops at `cap` times its own words, and the excess
is shared again by weight among the rest.  A source whose target is e whole passes and r words more takes every
document e times, and the first r words once more; only one document a source is cut.

Word offsets are prefix sums in two levels (hash buckets of a source, then within a bucket), so a source that holds most rows is
spread over many tasks.

Null text: size 0.  A null source is a source of its own, last in order.  Size 0 takes nothing, and has no position.  Ties
(repeated rows) are ordered by id and size and are alike.  Empty table: empty result.  Columns of the input are kept; the
operator's own names start with __mix_.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the production mix.
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
CAP = 2.0
SLOPES = (0.5, -0.5)


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _targets(sizes: DataFrame, weights: Sequence[float], budget: float, cap: float, slopes: Sequence[float]) -> DataFrame:
    """sizes: (source, words), a row a source.  Adds target and slope."""
    w = " ".join(f"WHEN {i} THEN {x!r}D" for i, x in enumerate(weights))
    s = " ".join(f"WHEN {i} THEN {x!r}D" for i, x in enumerate(slopes))
    return sizes.sparkSession.sql(
        f"""
        WITH ranked AS (SELECT source, words, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rn FROM {{sizes}}),
        weighted AS (
            SELECT source, words, rn, CASE rn % {len(weights)} {w} END AS weight, CASE rn % {len(slopes)} {s} END AS slope,
                   {cap!r}D * words AS most, {budget!r}D * sum(words) OVER () AS budget FROM ranked
        ),
        filled AS (
            SELECT *, most / weight AS ratio,
                   (budget - ((sum(most) OVER w) - most)) / ((sum(weight) OVER ()) - ((sum(weight) OVER w) - weight)) AS level
            FROM weighted WINDOW w AS (ORDER BY most / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        ),
        first AS (SELECT min_by(level, struct(ratio, rn)) AS level, min(ratio) AS ratio FROM filled WHERE ratio > level)
        SELECT f.source, f.words, f.slope, CASE WHEN s.level IS NULL OR f.ratio < s.ratio THEN f.most ELSE f.weight * s.level END AS target
        FROM filled f LEFT JOIN first s ON true
        """,
        sizes=sizes,
    )


def curriculum_mix(
    docs: DataFrame,
    size_col: str,
    source_col: str = "source",
    id_col: str = "doc_id",
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    cap: float = CAP,
    slopes: Sequence[float] = SLOPES,
    rows_per_bucket: int = 4_000,
    each_copy: bool = False,
) -> DataFrame:
    """docs with __mix_source_size, __mix_target, __mix_taken and __mix_position, sorted by range of position.

    size_col must be a non-null long; weights and slopes repeat over the sources by code point.  A row a document, with the position
    of its first pass; or with each_copy a row for each pass that takes it (the cut one if at least half of it is taken), at its own position.
    """
    n = docs.select(source_col).count()
    digits = max(1, (n // rows_per_bucket).bit_length() // 4 + 1)
    # One key of source (null marked) and hash bucket, so that the window and the join use one shuffle.
    key = F.coalesce(F.md5(F.col(id_col).cast("string")), F.md5(F.col(size_col).cast("string")))  # rows without an id spread by size
    df = docs.withColumn("__mix_key", key).withColumn(
        "__mix_bucket",
        F.concat(F.coalesce(F.substring("__mix_key", 1, digits), F.lit("-")), F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))),
    )
    held = df.groupBy(F.col(source_col).alias("source"), F.col("__mix_bucket").alias("bucket")).agg(F.sum(size_col).alias("words"))
    targets = _targets(held.groupBy("source").agg(F.sum("words").alias("words")), weights, budget, cap, slopes)
    bases = docs.sparkSession.sql(
        """
        SELECT h.bucket AS __mix_bucket, t.words AS __mix_source_size, t.target AS __mix_target, t.slope AS __mix_slope,
               coalesce(sum(h.words) OVER (PARTITION BY h.source ORDER BY h.bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS __mix_base
        FROM {held} h JOIN {targets} t ON h.source <=> t.source
        """,
        held=held,
        targets=targets,
    )
    c = f"""(__mix_base + coalesce(sum(`{size_col}`) OVER (PARTITION BY __mix_bucket ORDER BY __mix_key, `{id_col}`, `{size_col}`
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))"""
    keep = [F.col(f"`{x}`") for x in docs.columns]
    out = df.join(bases, "__mix_bucket")
    out = out.withColumn("__mix_c", F.expr(c))
    passes = f"CASE WHEN __mix_source_size > 0 THEN CAST(floor(__mix_target / __mix_source_size) AS BIGINT) ELSE 0 END"
    out = out.withColumn("__mix_passes", F.expr(passes)).withColumn(
        "__mix_taken",
        F.expr(
            f"""__mix_passes * `{size_col}` + greatest(0L, least(`{size_col}`,
                CAST(floor(__mix_target) AS BIGINT) - __mix_passes * __mix_source_size - __mix_c))"""
        ),
    )
    if each_copy:
        last = f"(__mix_passes + CASE WHEN 2 * (__mix_taken - __mix_passes * `{size_col}`) >= `{size_col}` THEN 1 ELSE 0 END)"
        out = out.withColumn("__mix_copy", F.explode(F.expr(f"CASE WHEN `{size_col}` > 0 AND {last} > 0 THEN sequence(0L, {last} - 1) END")))
        out = out.withColumn("__mix_c", F.expr("__mix_c + __mix_copy * __mix_source_size"))
    u = "least(1D, __mix_c / __mix_target)"
    out = out.withColumn(
        "__mix_position",
        F.expr(f"CASE WHEN __mix_taken > 0 THEN 2 * {u} / ((1 - __mix_slope) + sqrt((1 - __mix_slope) * (1 - __mix_slope) + 4 * __mix_slope * {u})) END"),
    )
    out = out.select(*keep, "__mix_source_size", "__mix_target", "__mix_taken", "__mix_position", "__mix_key")
    # The hash breaks ties, so that documents that aren't taken spread over all the last partitions.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return out.repartitionByRange(parts, "__mix_position", "__mix_key").sortWithinPartitions("__mix_position", "__mix_key").drop("__mix_key")


def repeat_taken(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The documents as often as the mix takes them, with all their columns, each pass at its own position, in order of position.

    The one document of a source that the mix cuts stays whole if at least half of it is taken.
    """
    sized = docs.withColumn("__mix_size", word_count(text_col))
    mixed = curriculum_mix(sized, "__mix_size", source_col, id_col, each_copy=True)
    return mixed.select(*(F.col(f"`{c}`") for c in docs.columns))
