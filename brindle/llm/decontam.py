"""Benchmark decontamination by spaced-seed hashing.

Fixed masks lie over word positions: a seed is a hash of the words under a mask's ones, whatever stands under its zeros, so
a substituted word spares the seeds that ignore its place.  Seeds of the benchmark items are joined with the seeds of all
documents; each hit aligns a document with an item, and the alignment is scored word by word around the hit (+1 for an equal word, -2
for a substituted one).  A document leaks an item if some segment of an alignment has enough equal words and a share of at least
MIN_SHARE; enough is MIN_MATCH or, if fewer, MIN_SHARE of the item's words, but MIN_ITEM at least.  The best such segment counts.  An item
under MIN_ITEM words is leaked by a document that holds it whole.  Only what a seed hits is scored: any two substitutions in
an item of 11 words or more are found, but few words between many substitutions can spare no seed.  Masks go by the item's length:
MASKS from LONG_ITEM words on, SHORT_MASK too below, and one as long as the item under MIN_ITEM.

Words: lower case, punctuation taken off, split at ASCII white space.  Only the first hit of a run of neighbouring hits is
scored.  The seeds are broadcast in blocks of at most BLOCK_WORDS word positions (pieces of items are dealt to blocks until the fullest one,
which is counted, fits); beyond one block documents are read once for each.  Only verified rows are shuffled.  DataFrame and SQL expressions only.

Null and empty texts: no words, no leak.  Repeated rows of an id: one result.  Rows with a null id are reported under null; drop_contaminated
keeps them.  Items with a null id, or several rows of one id, count like others.  Empty tables: empty result.  Other columns of the inputs are kept or unread, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cut

#: Fixed values of the production search.
MASKS = ("1110011", "110100101", "1011001011")
SHORT_MASK = "11111"
LONG_ITEM = 11
MIN_MATCH, MIN_SHARE, MIN_ITEM = 12, 0.75, 5
BLOCK_WORDS, PIECE = 500_000, 1_000
SPACES, MARKS = "\t\n\x0b\x0c\r", ".,;:!?\"'()[]{}«»„“”‚‘’¿¡"


def _words(text: str):
    plain = F.translate(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACES + MARKS, " " * len(SPACES))
    return F.array_remove(F.split(plain, " "), "")


def _seed(m: int, mask: str, at: str) -> str:
    """The hash of mask m over `words` at position `at`; null where it doesn't fit."""
    picks = ", ".join(f"get(words, {at} + {k})" for k, bit in enumerate(mask) if bit == "1")
    return f"if({at} >= 0 AND {at} + {len(mask)} <= n, xxhash64({m}, {picks}), null)"


def _applies(mask: str, n: str = "n") -> str:
    """Is this mask laid over items of n words?"""
    if mask in MASKS:
        return f"{n} >= {MIN_ITEM}"
    return f"{n} BETWEEN {MIN_ITEM} AND {LONG_ITEM - 1}" if mask == SHORT_MASK else f"{n} = {len(mask)}"


def _positions(df: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """Adds at and h: a row for every position and mask (explode_outer, so that no filter repeats the splitting)."""
    least = min(len(m) for m in masks)
    df = df.withColumn("at", F.explode_outer(F.expr(f"if(n >= {least}, sequence(0, n - {least}), null)")))
    return df.withColumn("h", F.explode_outer(F.expr("array(" + ", ".join(_seed(m, mask, "at") for m, mask in enumerate(masks)) + ")")))


def _item_seeds(pieces: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    rows = pieces.withColumn("at", F.explode(F.expr(f"sequence(piece * {PIECE}, least(n, (piece + 1) * {PIECE}) - 1)")))
    seed = lambda m, mask, at: f"if({_applies(mask)}, {_seed(m, mask, at)}, null)"
    return rows.select(
        "key",
        F.col("at").alias("j"),
        F.expr("inline(array(" + ", ".join(f"named_struct('m', {m}, 'h', {seed(m, mask, 'at')}, 'before', {seed(m, mask, '(at - 1)')})" for m, mask in enumerate(masks)) + "))"),
    ).filter("h IS NOT NULL")


#: The best segment of an alignment, and its equal words in total: a fold over the item's words that lie within the document.
_FOLD = """
aggregate(
    sequence(greatest(0, -shift), least(item_n, n - shift) - 1),
    named_struct('run', 0, 'from', 0, 'hit', 0, 'best', 0, 'first', 0, 'last', -1, 'equal', 0, 'total', 0),
    (s, k) -> transform(array(named_struct(
            'same', get(words, k + shift) = get(item_words, k), 'fresh', s.run <= 0)),
        x -> transform(array(named_struct(
                'run', if(x.fresh, 0, s.run) + if(x.same, 1, -2),
                'from', if(x.fresh, k, s.from),
                'hit', if(x.fresh, 0, s.hit) + if(x.same, 1, 0))),
            y -> named_struct('run', y.run, 'from', y.from, 'hit', y.hit,
                'best', greatest(s.best, y.run),
                'first', if(y.run > s.best, y.from, s.first),
                'last', if(y.run > s.best, k, s.last),
                'equal', if(y.run > s.best, y.hit, s.equal),
                'total', s.total + if(x.same, 1, 0)))[0])[0])
"""
#: Equal words that are enough.
_NEED = f"least(item_n, greatest({MIN_ITEM}, least({MIN_MATCH}, CAST(ceil({MIN_SHARE} * item_n) AS INT))))"
#: The best segment that has enough equal words and share, from the places e of all equal words: it starts and ends with a run of them.
_PART = f"""
transform(array(filter(sequence(greatest(0, -shift), least(item_n, n - shift) - 1), k -> get(words, k + shift) = get(item_words, k))),
    e -> array_max(flatten(transform(
        filter(sequence(0, size(e) - 1), p -> p = 0 OR get(e, p - 1) < get(e, p) - 1),
        p -> transform(
            filter(sequence(p, size(e) - 1), q -> (q = size(e) - 1 OR get(e, q + 1) > get(e, q) + 1)
                AND q - p + 1 >= {_NEED} AND q - p + 1 >= {MIN_SHARE} * (get(e, q) - get(e, p) + 1)),
            q -> named_struct('score', 3 * (q - p + 1) - 2 * (get(e, q) - get(e, p) + 1), 'before', -get(e, p), 'last', get(e, q), 'equal', q - p + 1))))))[0]
"""
#: The segment that counts, or null: mostly the best of all; else a part or a wider one is looked for, if there are enough equal words.
_SEGMENT = f"""
transform(array({_FOLD}), s -> CASE
    WHEN s.equal >= {_NEED} AND s.equal >= {MIN_SHARE} * (s.last - s.first + 1) THEN named_struct('score', s.best, 'before', -s.first, 'last', s.last, 'equal', s.equal)
    WHEN s.total >= {_NEED} THEN {_PART} END)[0]
"""


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that it leaks: n_matched words, share of the segment, coverage of the item, first_word in the document."""
    items = benchmark.select(F.col(item_col).alias("item"), _words(item_text_col).alias("words")).withColumn("n", F.size("words")).filter("n > 0")
    items = cut(items.withColumn("key", F.monotonically_increasing_id()), "items")
    short = [r[0] for r in items.filter(f"n < {LONG_ITEM}").select("n").distinct().collect()]  # at most LONG_ITEM rows
    masks = MASKS + ((SHORT_MASK,) if any(n >= MIN_ITEM for n in short) else ()) + tuple("1" * n for n in sorted(short) if n < MIN_ITEM)
    pieces = items.withColumn("piece", F.explode(F.expr(f"sequence(0, CAST((n - 1) div {PIECE} AS INT))")))
    found = [_leaks(docs, items, some, masks, id_col, text_col) for some in _blocks(pieces)]
    best = reduce(DataFrame.unionByName, found).groupBy("id", "item").agg(F.max(F.struct("equal", "share", "coverage", -F.col("start"))).alias("b"))
    return best.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        F.col("b.equal").cast("long").alias("n_matched"),
        F.col("b.share").alias("share"),
        F.col("b.coverage").alias("coverage"),
        (-F.col("b.col4")).cast("long").alias("first_word"),
    )


def _blocks(pieces: DataFrame) -> list[DataFrame]:
    """The pieces dealt by hash to as few blocks as hold at most BLOCK_WORDS positions each."""
    held = F.sum(F.expr(f"least(n - piece * {PIECE}, {PIECE})"))
    total = pieces.agg(held).first()[0] or 0
    n = max(1, -(-total // BLOCK_WORDS))
    while n > 1:
        block = F.expr(f"pmod(xxhash64(key, piece), {n})")
        if pieces.groupBy(block.alias("b")).agg(held.alias("held")).agg(F.max("held")).first()[0] <= max(BLOCK_WORDS, PIECE):
            return [pieces.filter(block == b) for b in range(n)]
        n += -(-n // 4)
    return [pieces]


def _leaks(docs: DataFrame, items: DataFrame, pieces: DataFrame, masks: tuple[str, ...], id_col: str, text_col: str) -> DataFrame:
    thin = docs.select(F.col(id_col).alias("id"), _words(text_col).alias("words")).withColumn("n", F.size("words"))
    # At most BLOCK_WORDS positions, a row for each mask.
    hits = _positions(thin, masks).join(F.broadcast(_item_seeds(pieces, masks)), "h")
    earlier = "CASE m " + " ".join(f"WHEN {m} THEN {_seed(m, mask, '(at - 1)')}" for m, mask in enumerate(masks)) + " END"
    hits = hits.filter(~F.coalesce(F.col("before") == F.expr(earlier), F.lit(False)))  # a run's first hit speaks for it
    texts = items.select("key", "item", F.col("words").alias("item_words"), F.col("n").alias("item_n"))  # broadcast by Spark where it is small
    scored = hits.withColumn("shift", F.col("at") - F.col("j")).join(texts, "key").withColumn("s", F.expr(_SEGMENT)).filter("s IS NOT NULL")
    return scored.select(
        "id",
        "item",
        F.col("s.equal").alias("equal"),
        (F.col("s.equal") / (F.col("s.last") + F.col("s.before") + 1)).alias("share"),
        (F.col("s.equal") / F.col("item_n")).alias("coverage"),
        (F.col("shift") - F.col("s.before")).alias("start"),
        "item_n",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that leak no item, with all their columns."""
    # Written first, so that its size is known when the join is planned: few ids are broadcast, and no text is shuffled.
    bad = cut(find_leaks(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("__leak_id")).distinct(), "leaks")
    return docs.join(bad, F.col(id_col) == F.col("__leak_id"), "left_anti")
