"""Awkward documents that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "one", "en", "a", 3),
    (4, "The quick brown fox jumps over the lazy dog. It runs away, and nobody sees it again today.", "en", "b", 90),
    (5, "the QUICK brown fox jumps over the lazy dog. it runs away, and nobody sees it again today.", "en", "b", 90),
    (6, "Zwölf Boxkämpfer jagen Viktor\u00a0quer\u2003über den großen Sylter Deich 🦊 \n\t\x0b.", "de", "", 60),
    (7, LONG, "en", "b", len(LONG)),
    (8, LONG + " tail", "en", "b", len(LONG) + 5),
    (9, "   \t\n ", "en", "c", 6),
    (None, "a row without an id stands here for once", "en", "c", 40),
    (4, "The quick brown fox jumps over the lazy dog. It runs away, and nobody sees it again today.", "en", "b", 90),
]


def frame(spark, rows=AWKWARD, extra=True):
    """Documents with more columns, whose names clash with what operators use inside and return."""
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for c in ("id", "n", "size", "key", "label", "words", "score", "shard", "kept", "spans", "part", "role", "h", "regs", "bucket"):
            df = df.selectExpr("*", f"'x' AS `{c}`")
    return df
