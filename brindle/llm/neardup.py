"""MinHash near-dedup with HyperMinHash sketches.

A document's set holds the hashes of its distinct shingles of five words (A-Z lower-cased); with fewer words, the whole
sequence is one.  Documents link if 100 * intersection >= 75 * union, checked on full sets.

1. Sketch: each of REGISTERS buckets keeps its smallest hash as a count of leading zeros and MANTISSA bits (an empty
   bucket borrows the register of a bucket that a fixed order of preference picks, which keeps the chance of agreement).
   Documents with one set become one class, which a row of it stands for.
2. Bands of BAND registers are hashed; classes that agree in a band share a bucket.  Two documents at the threshold meet in no
   bucket with chance 5e-6.
3. Each class is compared with the first class of each bucket it is in (a star, not all pairs): sizes must allow a link, and the
   collision-corrected Jaccard estimate of the two sketches must reach the threshold less LEEWAY (over five standard deviations).
4. The full sets of each class and the closest first class that it meets are compared; links give components.
5. A bucket that still holds several components is open, unless it is one pair that isn't close.  All classes of open buckets are joined by
   their rare shingles: of two sets that link, the rarest ones (a quarter of the larger, a seventh of the smaller) share one.  Pairs of
   different components that do are estimated as in 3 and their full sets compared.  Keys of more than POSTING rows give no pairs: the classes
   that they connect, a crowd of sets just about the threshold, are finished in blocks of queries (what lies outside the crowd's largest
   component) and members.  No link between classes of one bucket is lost, whatever its first class is like; what a passage has in common
   is frequent and no key, and a large group with one label costs nothing here.
6. Components by smallest label.

Null and empty texts: no shingles, linked with nothing.  Very long texts: whole.  Repeated rows and equal texts: one class; an id with
several texts is in a class for each.  Rows without an id are linked like others, but their id is never a component's: a component without
any id has a null one.  Empty table: empty result.  Only id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import chunks, cut, marked_by, mix64, release, small_batches, tidy, utf8, word_hashes
from brindle.llm.graph import components

WORDS = 5
REGISTERS, BAND, MANTISSA = 128, 4, 10
BANDS = REGISTERS // BAND
LEEWAY = 0.2
#: Rows of a key whose classes meet each other; queries and members of a crowd's block.
POSTING = 32
QUERIES, MEMBERS = 64, 128
#: Fixed value: the constant of the chance that two unrelated registers agree.
COLLISION = 0.169919487159739 / (1 << MANTISSA)
_U = np.uint64
_MUL = mix64(np.arange(11, 11 + WORDS, dtype=np.uint64)) | _U(1)
_ORDER = np.argsort(mix64(np.arange(REGISTERS * REGISTERS, dtype=np.uint64)).reshape(REGISTERS, REGISTERS), axis=1).argsort(axis=1)


def shingle_sets(texts: Sequence[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, at = word_hashes([t.lower() for t in texts])
    s = np.zeros(len(h), dtype=np.uint64)
    n = max(0, len(h) - WORDS + 1)
    for k in range(WORDS):
        s[:n] += mix64(h[k : k + n] + _U(k)) * _MUL[k]
    s = mix64(s)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= WORDS:
            x = np.sort(s[a : b - WORDS + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            out.append(mix64(np.array([int((mix64(h[a:b] + _U(7)) * _MUL[: b - a]).sum())], dtype=np.uint64) + _U(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def registers(sets: Sequence[np.ndarray]) -> np.ndarray:
    """(set, bucket) compressed minima as uint16."""
    out = np.zeros((len(sets), REGISTERS), dtype=np.uint16)
    if not len(sets):
        return out
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bucket = (flat >> _U(57)).astype(np.int64)
    spot = owner * REGISTERS + bucket
    first = np.concatenate([[True], spot[1:] != spot[:-1]]) if len(spot) else np.zeros(0, dtype=bool)
    part, zeros = np.frexp(((flat[first] & _U((1 << 57) - 1)) >> _U(4)).astype(np.float64))
    value = ((53 - zeros) << MANTISSA) + np.maximum(0, (part * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    filled = np.zeros(out.size, dtype=bool)
    out.reshape(-1)[spot[first]] = value
    filled[spot[first]] = True
    filled = filled.reshape(out.shape)
    for i in np.flatnonzero(~filled.all(axis=1) & filled.any(axis=1)):
        have, lack = np.flatnonzero(filled[i]), np.flatnonzero(~filled[i])
        out[i, lack] = out[i, have[np.argmin(_ORDER[np.ix_(lack, have)], axis=1)]]
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of registers (pair, bucket) for sets of n and m, corrected for chance agreement."""
    chance = COLLISION * 4 * n * m / np.maximum(1, (n + m) ** 2)
    return np.maximum(0, ((a == b).mean(axis=1) - chance) / (1 - chance))


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        raw = utf8(pdf["text"])
        for a, b in chunks(raw):
            sets = shingle_sets(raw[a:b])
            regs = registers(sets)
            yield pd.DataFrame(
                {
                    "id": pdf["id"].iloc[a:b].to_numpy(),
                    "tid": pdf["tid"].iloc[a:b].to_numpy(),
                    "n": [len(s) for s in sets],
                    "hi": [int(mix64(s ^ _U(0x51)).sum().astype(np.int64)) for s in sets],
                    "lo": [int(mix64(s ^ _U(0xA7)).sum().astype(np.int64)) for s in sets],
                    "regs": [r.tobytes() for r in regs],
                }
            )


def _thin(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and tid, a hash of the text: with the id it names a row's text."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _text_hash(text_col).alias("tid"))


def _text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _row_hash(id_col: str, tid_col: str):
    return F.xxhash64(id_col, tid_col)


def sketch_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tid, n (size of the set), hi and lo (a 128-bit hash of the set), regs; kept in the shared folder."""
    thin = _thin(docs, id_col, text_col)
    kind = thin.schema["id"].dataType.simpleString()
    return cut(thin.mapInPandas(tidy(_sketches), f"id {kind}, tid long, n long, hi long, lo long, regs binary"), "sketches")


def _classes(table: DataFrame) -> DataFrame:
    """A row for each distinct set: cls (a number, kept with the table), the smallest id (null if no row has one), how many rows have it,
    and id and text hash of the row that stands for it."""
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "tid"))
    out = table.filter("n > 0").groupBy("hi", "lo", "n").agg(first.alias("row"), F.count("*").alias("held"), F.min("regs").alias("regs"))
    out = out.select("hi", "lo", "n", F.col("row.id").alias("id"), F.col("row.tid").alias("tid"), "held", "regs")
    return cut(out.withColumn("cls", F.monotonically_increasing_id()), "classes")


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose sketches, less LEEWAY, do too; and the estimate."""

    def likely(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for na, nb, ra, rb in batches:
            a, b = (np.frombuffer(b"".join(r), dtype=np.uint16).reshape(-1, REGISTERS) for r in (ra, rb))
            yield pd.Series(estimate(a, b, na.to_numpy(), nb.to_numpy()), dtype="float64")

    for x in "ab":
        pairs = pairs.join(classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}")), x)
    sized = pairs.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    near = sized.withColumn("likeness", F.pandas_udf(likely, "double")("na", "nb", "ra", "rb")).filter(F.col("likeness") >= percent / 100 - LEEWAY)
    return cut(near.select("a", "b", "likeness"), "close")


def _full_sets(thin: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, n, shingles): the whole sets of the classes in wanted (cls, id, tid), from the texts of the rows that stand for them."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = utf8(pdf["text"])
            for a, b in chunks(raw):
                some = shingle_sets(raw[a:b])
                yield pd.DataFrame({"cls": pdf["cls"].iloc[a:b].to_numpy(), "n": [len(s) for s in some], "shingles": [s.view(np.int64) for s in some]})

    names = wanted.select("cls", F.col("id").alias("w_id"), F.col("tid").alias("w_tid"))
    count = wanted.count()
    # Only texts that may be wanted are shuffled.
    thin = marked_by(thin, _row_hash("id", "tid"), names, _row_hash("w_id", "w_tid"), count).filter("__maybe")
    made = thin.join(names, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("tid") == F.col("w_tid"))).select("cls", "text")
    made = cut(made.mapInPandas(tidy(sets), "cls long, n long, shingles array<bigint>"), "sets")
    # A class stands in several rows only where one id has one text several times.
    return made if made.count() == count else cut(made.dropDuplicates(["cls"]), "sets")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets link."""

    def same(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in batches:
            out = []
            for a, b in zip(xs, ys, strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                out.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pd.Series(out, dtype=bool)

    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    return cut(pairs.join(left, "a").join(right, "b").filter(F.pandas_udf(same, "boolean")("sa", "sb")).select("a", "b"), "links")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the label of their cls (itself, if no link has it yet)."""
    named = labels.select(F.col("node").alias("cls"), F.col("label").alias("__label"))
    return rows.join(named, "cls", "left").withColumn("label", F.coalesce("__label", "cls")).drop("__label")


def _bands(classes: DataFrame) -> DataFrame:
    """(key, cls) for each band."""
    wide = 2 * BAND
    return classes.withColumn("b", F.explode(F.expr(f"sequence(0, {BANDS - 1})"))).select(
        F.expr(f"xxhash64(b, substring(regs, b * {wide} + 1, {wide}))").alias("key"), "cls", F.col("hi").alias("rank")
    )


def _open_classes(met: DataFrame, close: DataFrame, labels: DataFrame) -> DataFrame:
    """The classes whose bucket holds others that they may still link with.

    A bucket's pair of two is settled if it isn't close; larger ones are settled only once one label holds all."""
    pairs = met.join(close.select("a", "b", F.lit(True).alias("near")), ["a", "b"], "left")
    rows = pairs.select("key", "size", "near", F.col("b").alias("cls")).unionByName(pairs.select("key", "size", F.lit(True).alias("near"), F.col("a").alias("cls")).distinct())
    rows = cut(_labelled(rows, labels).select("key", "cls", "label", F.expr("size > 2 OR near").alias("may")), "met")
    mixed = rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.every(F.coalesce("may", F.lit(False))).alias("may")).filter("x <> y AND may")
    return rows.join(mixed.select("key"), "key", "left_semi").select("cls").distinct()


def _rare_keys(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(s, cls, label, n, small, rows): the shingles of each class that a link can't spare, if classes of several labels have them.

    Shingles are ordered from rare to frequent.  If two sets link, the larger one's first n - ceil(t n) + 1 and the smaller one's first
    n - ceil(2 t / (1 + t) n) + 1 (small) shingles share one.  What a whole group has in common comes last and is no key."""
    rows = sets.select("cls", "n", F.explode("shingles").alias("s"))
    known = rows.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    order = Window.partitionBy("cls").orderBy("df", "s")
    # A shingle of one set only can't be shared: it takes a place among the first ones, but is no key.
    rows = rows.join(known, "s").withColumn("nth", F.row_number().over(order) + F.col("n") - F.count("*").over(Window.partitionBy("cls")))
    probe = f"n - CAST(ceil({percent} * n / 100D - 1e-9) AS BIGINT) + 1"
    least = f"n - CAST(ceil({2 * percent} * n / {100 + percent}D - 1e-9) AS BIGINT) + 1"
    keys = cut(_labelled(rows.filter(f"nth <= {probe}"), labels).select("s", "cls", "label", "n", F.expr(f"nth <= {least}").alias("small")), "keys")
    mixed = keys.groupBy("s").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("rows")).filter("x <> y").select("s", "rows")
    return cut(keys.join(mixed, "s"), "keys")


def _rare_pairs(keys: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different labels that share a key of at most POSTING rows: no class meets more than that many for a key."""
    keys = keys.filter(f"rows <= {POSTING}")
    small = keys.filter("small").select("s", F.col("cls").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"))
    large = keys.select("s", F.col("cls").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"))
    met = small.join(large, "s").filter(f"la <> lb AND (na < nb OR (na = nb AND a <> b)) AND 100 * na >= {percent} * nb")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _crowd_links(keys: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components of a crowd: classes that keys of more than POSTING rows connect.

    What lies outside a crowd's largest component is compared with all of it, exactly, in blocks of about QUERIES and MEMBERS that share no
    task; a block counts intersections with posting lists, and gives one link for each query and component."""
    hot = keys.filter(f"rows > {POSTING}")
    star = hot.groupBy("s").agg(F.min("cls").alias("a"))
    crowds = components(hot.join(star, "s").filter("cls <> a").select("a", F.col("cls").alias("b")).distinct())
    rows = _labelled(crowds.select(F.col("node").alias("cls"), F.col("label").alias("crowd")), labels)
    parts = rows.groupBy("crowd", "label").agg(F.count("*").alias("held"))
    sizes = parts.groupBy("crowd").agg(F.max_by("label", F.struct("held", "label")).alias("main"), F.max("held").alias("most"), F.sum("held").alias("size"))
    sizes = sizes.filter("most < size").select(
        "crowd", "main", F.expr(f"CAST(ceil((size - most) / {QUERIES}) AS INT)").alias("query_blocks"), F.expr(f"CAST(ceil(size / {MEMBERS}) AS INT)").alias("member_blocks")
    )
    rows = cut(rows.join(sizes, "crowd"), "crowd")
    block = lambda of, salt: F.expr(f"CAST(pmod(xxhash64(cls, {salt}), {of}) AS INT)")
    every = lambda of: F.explode(F.expr(f"sequence(0, {of} - 1)"))
    queries = rows.filter("label <> main").withColumn("q", block("query_blocks", 1)).withColumn("m", every("member_blocks")).withColumn("query", F.lit(True))
    members = rows.withColumn("m", block("member_blocks", 2)).withColumn("q", every("query_blocks")).withColumn("query", F.lit(False))
    dealt = queries.unionByName(members).join(sets, "cls").select("crowd", "q", "m", "query", "cls", "label", "shingles")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["query"]], pdf[~pdf["query"]]
        held = list(b["shingles"])
        sizes = np.array([len(x) for x in held], dtype=np.int64)
        words, ids, labels = (np.concatenate(held) if held else np.zeros(0, np.int64)), b["cls"].to_numpy(), b["label"].to_numpy()
        order = np.argsort(words, kind="stable")
        owner, words = np.repeat(np.arange(len(held)), sizes)[order], words[order]
        out: list[tuple] = []
        for one, label, s in zip(a["cls"], a["label"], a["shingles"], strict=True):
            low, high = np.searchsorted(words, s, "left"), np.searchsorted(words, s, "right")
            n = high - low
            spots = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(owner[spots], minlength=len(held))
            near = np.flatnonzero((100 * both >= percent * (len(s) + sizes - both)) & (labels != label))
            _, first = np.unique(labels[near], return_index=True)
            out += [(one, ids[i]) for i in near[first]]
        return pd.DataFrame(out, columns=["a", "b"])

    return cut(dealt.groupBy("crowd", "q", "m").applyInPandas(link, "a long, b long"), "links")


def _components(docs: DataFrame, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sketch table, and (cls, hi, lo, n, id, tid, held, label) of every class that has several rows or links."""
    small_batches(docs.sparkSession)
    table = sketch_table(docs, id_col, text_col)
    classes = _classes(table)
    bands = _bands(classes)
    buckets = bands.groupBy("key").agg(F.min(F.struct("rank", "cls"))["cls"].alias("a"), F.count("*").alias("size")).filter("size > 1")
    met = cut(bands.join(buckets, "key").filter("cls <> a").select("key", "size", "a", F.col("cls").alias("b")), "met")
    close = _close(met.select("a", "b").distinct(), classes, percent)
    # Full sets: of close classes, and of all in a bucket of several that its first doesn't settle.
    crowded = met.filter("size > 2").join(close.select("a", "b"), ["a", "b"], "left_anti").select("key").distinct()
    crowd = met.join(crowded, "key", "left_semi")
    wanted = reduce(DataFrame.union, [x.select(c) for x in (close, crowd) for c in "ab"]).distinct().withColumnRenamed("a", "cls")
    wanted = cut(classes.select("cls", "id", "tid").join(wanted, "cls", "left_semi"), "wanted")
    sets = _full_sets(_thin(docs, id_col, text_col), wanted)
    release(docs.sparkSession)

    best = close.groupBy("b").agg(F.max_by("a", F.struct("likeness", "a")).alias("a")).select("a", "b")
    links = _linked(best, sets, percent)
    labels = components(links)
    rest = cut(_open_classes(met, close, labels), "open")
    keys = _rare_keys(sets.join(rest, "cls", "left_semi"), labels, percent)
    links = links.unionByName(_linked(_close(_rare_pairs(keys, percent), classes, percent).select("a", "b"), sets, percent))
    labels = components(links)
    release(docs.sparkSession)
    if keys.filter(f"rows > {POSTING}").limit(1).count():
        labels = components(links.unionByName(_crowd_links(keys, labels, sets, percent)))
    linked = labels.select(F.col("node").alias("cls"), "label")
    named = classes.drop("regs").join(linked, "cls", "left").filter("label IS NOT NULL OR held > 1").withColumn("label", F.coalesce("label", "cls"))
    return table, cut(named, "named")


def near_components(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id that links lead to, null if no row there has an id) and kept of every row:
    its id is its component's, or neither it nor any row there has one."""
    table, named = _components(docs, percent, id_col, text_col)
    tops = named.groupBy("label").agg(F.min("id").alias("component_id"))
    of = named.join(tops, "label").select("hi", "lo", "n", "component_id", F.lit(True).alias("named"))
    component = F.when(F.col("named") & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("id"))
    return (
        table.select("id", "n", "hi", "lo")
        .join(of, ["hi", "lo", "n"], "left")
        .select("id", "n", component.alias("c"))
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.col("id").eqNullSafe(F.col("c")).alias("kept"))
    )


def keep_one(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, one of each component: the one of the smallest id (of those without an id, of the smallest
    text hash).  Rows equal in id and text are one document, but rows without words and without an id all stay."""
    table, named = _components(docs, percent, id_col, text_col)
    stays = named.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "tid")).alias("top"))
    of = named.join(stays, "label").select("hi", "lo", "n", F.col("top.id").alias("top_id"), F.col("top.tid").alias("top_tid"), F.lit(True).alias("named"))
    rows = table.filter("n > 0 OR id IS NOT NULL").select("id", "tid", "hi", "lo", "n").join(of, ["hi", "lo", "n"], "left")
    stay = F.col("named").isNull() | (F.col("n") == 0) | (F.col("id").eqNullSafe(F.col("top_id")) & (F.col("tid") == F.col("top_tid")))
    rows = rows.select("id", "tid", stay.alias("stay"))
    # Written first, so that its size is known when the join is planned: few ids are broadcast, and no text is shuffled.
    odd = cut(rows.groupBy("id", "tid").agg(F.first("stay").alias("stay"), F.count("*").alias("rows")).filter("rows > 1 OR NOT stay"), "gone")
    odd = odd.select(F.col("id").alias("__near_id"), F.col("tid").alias("__near_tid"), F.col("stay").alias("__near_stay"))
    marked = docs.withColumn("__near_hash", _text_hash(text_col))
    marked = marked_by(marked, _row_hash(id_col, "__near_hash"), odd, _row_hash("__near_id", "__near_tid"), odd.count())
    apart = marked.filter("NOT __maybe")  # these are no odd rows, and their texts aren't shuffled
    marked = marked.filter("__maybe").join(odd, F.col(id_col).eqNullSafe(F.col("__near_id")) & (F.col("__near_hash") == F.col("__near_tid")), "left")
    once = marked.filter("__near_tid IS NULL").unionByName(apart, allowMissingColumns=True)
    again = odd.filter("__near_stay").limit(1).count()
    if again:  # repeated rows of a document that stays: one of them
        once = once.unionByName(marked.filter("__near_stay").dropDuplicates(["__near_id", "__near_tid"]))
    return once.select(*(F.col(f"`{c}`") for c in docs.columns))
