"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import common, decontam, fingerprint, mixing, neardup, quality, secrets, sharding, token_rollup, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.training_table())
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), model)


def op3_spaced_seed_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(secrets.scan_secrets(_table(spark, sf_dir, "documents")))


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    mixed = mixing.curriculum_mix(common.cut(docs, "mix"), "size")
    return mixed.select(
        "doc_id",
        "size",
        F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"),
        F.col("__mix_taken").alias("taken"),
        F.round("__mix_position", 6).alias("position"),
    )


def op7_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_components(_table(spark, sf_dir, "documents"))


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"))


def op2_iblt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_with_next(_table(spark, sf_dir, "documents"))


#: The vocabulary file that op9 counts with.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op9_token_rollup(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """All documents are inserted, by words as a count to be revised; every batch is sent twice and counts once.  Then all words' counts are
    revised, the documents of one language are deleted and inserted again, and the batches are folded: totals equal a fresh count."""
    counted = token_rollup.token_counts(_table(spark, sf_dir, "documents"), token_rollup.load_ranks(spark, vocabulary), "byte-bpe-50k-v1")
    counted = common.cut(counted.drop("doc_id"), "tokens")  # counted once: the batches read what was kept
    rough = F.when(F.col("tokenizer") == "words-v1", F.lit(0)).otherwise(F.col("tokens")).cast("long")
    german = counted.filter("lang = 'de'")
    rollup = token_rollup.TokenRollup(spark, common.scratch_path(spark, "rollup"))
    batches = (
        ("load", token_rollup.inserts(counted.withColumn("tokens", rough))),
        ("revise", token_rollup.revisions(counted.withColumn("rough", rough).filter("rough <> tokens"), "rough")),
        ("delete", token_rollup.deletes(german)),
        ("reload", token_rollup.inserts(german)),
    )
    for k, (name, changes) in enumerate(batches):
        for _ in range(2):
            rollup.commit(name, changes)
        if k == 1:
            rollup.compact()
    return rollup.totals()


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_iblt_fingerprint, op3_spaced_seed_decontam, op4_ordinal_quality, op5_secret_scan, op6_curriculum_mix, op7_hyperminhash_dedup, op8_feistel_shards, op9_token_rollup, op10_toxicity)
}



def _secrets_sql() -> str:
    """The matches of each rule as lists, their places one after the other, and the report's columns.

    RE2 folds letters beyond ASCII too, so letters that match in either case are spelled out as classes."""
    either = lambda p: re.sub(r"(?<![\\x\w\[])([a-z]+_?\??[a-z]*)", lambda m: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in m[0]), p)
    parts = []
    for k, r in enumerate(secrets.BASE_RULES + secrets.MORE_RULES):
        pattern = r.pattern
        if r.either_case:
            head, rest = pattern.split(")", 1)
            pattern = either(head) + ")" + rest
        text = pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, text, {k} AS k, '{r.kind}' AS kind, {r.min_length} AS least, {r.group} AS grp, '{text}' AS pattern, regexp_extract_all(text, '{text}') AS ms, regexp_extract_all(text, '{text}', {r.group}) AS gs FROM d")
    return f"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        m AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE len(ms) > 0),
        r(doc_id, k, kind, least, text, ms, gs, i, s, e) AS (
            SELECT doc_id, k, kind, least, text, ms, gs, 1, instr(text, ms[1]) - 1, instr(text, ms[1]) - 1 + length(ms[1]) FROM m
            UNION ALL
            SELECT doc_id, k, kind, least, text, ms, gs, i + 1, e + instr(substr(text, e + 1), ms[i + 1]) - 1, e + instr(substr(text, e + 1), ms[i + 1]) - 1 + length(ms[i + 1])
            FROM r WHERE i < len(ms)
        ),
        h AS (SELECT doc_id, k, s, e, kind || ':' || s || ':' || e AS line FROM r WHERE length(gs[i]) >= least),
        a AS (
            SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                   coalesce(string_agg(line, ',' ORDER BY s, k, e) FILTER (k < 3), '') AS base, coalesce(string_agg(line, ',' ORDER BY s, k, e), '') AS spans
            FROM h GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN a ON a.doc_id = d.doc_id
    """


ORACLES: dict[str, str] = {
    "op5_secret_scan": _secrets_sql(),
    "op7_hyperminhash_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(node, top) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.top FROM r JOIN e ON e.a = r.node),
        c AS (SELECT node, min(top) AS top FROM r GROUP BY node)
        SELECT c.node AS doc_id, coalesce(n.n, 0) AS n_shingles, c.top AS component_id, c.node = c.top AS kept FROM c LEFT JOIN n ON n.doc_id = c.node
    """,
    "op6_curriculum_mix": r"""
        WITH d AS (
            SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS k,
                   CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
            FROM documents
        ),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source),
        r AS (SELECT source, words, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rn FROM s),
        w AS (
            SELECT *, CAST(CASE rn % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
                   CAST(CASE rn % 2 WHEN 0 THEN 0.5 ELSE -0.5 END AS DOUBLE) AS slope,
                   CAST(2 AS DOUBLE) * words AS most, CAST(1.5 AS DOUBLE) * (SELECT CAST(sum(words) AS BIGINT) FROM s) AS budget
            FROM r
        ),
        f AS (
            SELECT a.*, a.most / a.weight AS ratio,
                   (a.budget - coalesce((SELECT sum(b.most) FROM w b WHERE (b.most / b.weight, b.rn) < (a.most / a.weight, a.rn)), 0))
                   / ((SELECT sum(weight) FROM w) - coalesce((SELECT sum(b.weight) FROM w b WHERE (b.most / b.weight, b.rn) < (a.most / a.weight, a.rn)), 0)) AS level
            FROM w a
        ),
        c AS (SELECT ratio, level FROM f WHERE ratio > level ORDER BY ratio, rn LIMIT 1),
        t AS (
            SELECT f.source, f.words, f.slope,
                   CASE WHEN (SELECT level FROM c) IS NULL OR f.ratio < (SELECT ratio FROM c) THEN f.most ELSE f.weight * (SELECT level FROM c) END AS target
            FROM f
        ),
        o AS (
            SELECT d.doc_id, d.size, d.source,
                   CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c
            FROM d
        ),
        j AS (
            SELECT o.*, t.words, t.target, t.slope,
                   CASE WHEN t.words > 0 THEN CAST(floor(t.target / t.words) AS BIGINT) ELSE 0 END AS passes
            FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source
        ),
        k AS (
            SELECT *, CAST(passes * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - passes * words - c)) AS BIGINT) AS taken
            FROM j
        )
        SELECT doc_id, size, words AS source_size, target, taken,
               round(CASE WHEN taken > 0 THEN 2 * (c / target) / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * (c / target))) END, 6) AS position
        FROM k
    """,
}
