"""Anonymisation as column expressions; only tokens and shuffles need a shuffle of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import rng
from brindle.functions.lineage import ranked
from brindle.functions.text import padded
from brindle.operators.pii import digits

STRATEGIES = ("mask", "hash", "synthetic", "generalize", "redact", "tokenize", "shuffle", "noise", "none")
#: The default strategy of each type.
DEFAULTS = {
    "ssn": "redact", "credit_card": "mask", "bank_account": "hash", "iban": "hash", "passport": "redact", "drivers_license": "redact", "medical_id": "hash",
    "national_id": "redact", "password": "redact", "biometric": "redact", "genetic": "redact", "email": "mask", "phone": "mask", "ip_address": "generalize",
    "street_address": "synthetic", "username": "hash", "first_name": "synthetic", "last_name": "synthetic", "full_name": "synthetic",
    "date_of_birth": "generalize", "age": "generalize", "gender": "shuffle", "salary": "noise", "zip_code": "generalize", "city": "shuffle",
    "state": "shuffle", "country": "shuffle", "ethnicity": "redact", "religion": "redact", "political": "redact",
}
#: Pools of invented names.
FIRST_NAMES = ("James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "William", "Elizabeth", "David", "Barbara", "Richard", "Susan", "Joseph", "Jessica", "Thomas", "Sarah", "Charles", "Karen", "Christopher", "Lisa", "Daniel", "Nancy", "Matthew", "Betty", "Anthony", "Margaret")
LAST_NAMES = ("Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis", "Rodriguez", "Martinez", "Hernandez", "Lopez", "Gonzalez", "Wilson", "Anderson", "Thomas", "Taylor", "Moore", "Jackson", "Martin")
STREET_TYPES = ("Street", "Avenue", "Boulevard", "Drive", "Lane", "Court", "Way")
CITIES = ("Springfield", "Franklin", "Greenville", "Bristol", "Clinton", "Madison", "Georgetown", "Salem", "Fairview", "Manchester", "Milton", "Newport")
EMAIL_DOMAINS = ("example.com", "mail.example.org", "test.example.net", "demo.example.io")
SALARY_BANDS = ((30_000, "<$30K"), (50_000, "$30K-$50K"), (75_000, "$50K-$75K"), (100_000, "$75K-$100K"), (150_000, "$100K-$150K"), (None, "$150K+"))


def mask(c: Column, kind: str | None = None) -> Column:
    """By type; else the middle of the text is starred (all of it up to four characters).  An e-mail's mask ends in .com."""
    s, d = c.cast("string"), digits(c.cast("string"))
    n = F.length(s)
    shown = F.greatest(F.lit(1), F.floor(n / 4)).cast("int")
    plain = F.when(n > 4, F.concat(F.substr(s, F.lit(1), shown), F.repeat(F.lit("*"), n - shown * 2), F.substr(s, n - shown + 1, shown))).otherwise(F.repeat(F.lit("*"), n))
    if kind == "email":
        local, domain = F.split(s, "@")[0], F.split(s, "@")[1]
        starred = F.concat(F.substring(local, 1, 1), F.lit("***@"), F.substring(domain, 1, 1), F.lit("***.com"))
        return F.when(F.size(F.split(s, "@")) == 2, starred).otherwise(plain)
    front = {"phone": "***-***-", "credit_card": "****-****-****-", "ssn": "***-**-"}.get(kind)
    if front:
        return F.when(F.length(d) >= 4, F.concat(F.lit(front), F.substring(d, -4, 4))).otherwise(plain)
    return plain


def hashed(c: Column, salt: str) -> Column:
    """The first 16 hexadecimal digits of SHA-256 of salt:value; equal values stay equal."""
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), c.cast("string")), 256), 1, 16)


def synthetic(c: Column, kind: str | None, key: Column, seed: int) -> Column:
    """Invented values drawn by the row's key; nulls stay."""
    pick = lambda stream, pool: rng.pick(seed, stream, key, list(pool))
    number = lambda stream, low, high: (rng.bits(seed, stream, key) % (high - low + 1) + low).cast("string")
    made = {
        "first_name": lambda: pick("first", FIRST_NAMES),
        "last_name": lambda: pick("last", LAST_NAMES),
        "full_name": lambda: F.concat_ws(" ", pick("first", FIRST_NAMES), pick("last", LAST_NAMES)),
        "email": lambda: F.concat(F.lit("user"), number("mail", 1000, 9999), F.lit("@"), pick("domain", EMAIL_DOMAINS)),
        "phone": lambda: F.concat(F.lit("555-"), number("mid", 100, 999), F.lit("-"), number("end", 1000, 9999)),
        "street_address": lambda: F.concat_ws(" ", number("house", 100, 9999), pick("street", FIRST_NAMES), pick("kind", STREET_TYPES)),
    }.get(kind, lambda: F.concat(F.lit("ANON_"), F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 12)))()
    return F.when(c.isNotNull(), made)


def generalize(c: Column, kind: str | None = None) -> Column:
    """Age and birth decade, first three digits of a ZIP code, /16 network, salary band; else the first three characters."""
    s = c.cast("string")
    decade = lambda n: (F.floor(n / 10) * 10).cast("int").cast("string")
    if kind == "age":
        n = c.try_cast("double")
        whole = F.floor(n)
        return F.when(n.isNotNull(), F.concat(decade(whole), F.lit("-"), (F.floor(whole / 10) * 10 + 9).cast("int").cast("string"))).otherwise(s)
    if kind == "date_of_birth":
        day = F.coalesce(*(F.try_to_timestamp(s, F.lit(f)) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy")), s.try_cast("timestamp"))
        return F.when(day.isNotNull(), F.concat(decade(F.year(day)), F.lit("s"))).when(c.isNotNull(), F.concat(F.substring(s, 1, 4), F.lit("-XX-XX")))
    if kind == "zip_code":
        z = F.substring(F.replace(s, F.lit("-"), F.lit("")), 1, 3)
        return F.when(F.length(z) >= 3, F.concat(z, F.lit("XX"))).when(c.isNotNull(), F.lit("XXXXX"))
    if kind == "ip_address":
        p = F.split(s, r"\.")
        return F.when(F.size(p) >= 2, F.concat(p[0], F.lit("."), F.get(p, F.lit(1)), F.lit(".0.0/16"))).when(c.isNotNull(), F.lit("0.0.0.0/0"))
    if kind == "salary":
        n, out = c.try_cast("double"), None
        for top, name in SALARY_BANDS[:-1]:
            out = F.when(n < top, name) if out is None else out.when(n < top, name)
        return F.when(n.isNotNull(), out.otherwise(SALARY_BANDS[-1][1])).otherwise(s)
    return F.substring(s, 1, 3)


def noise(c: Column, key: Column, seed: int, percent: float = 10.0) -> Column:
    """A number times 1 +- up to percent, drawn by the row's key; other values stay as they are."""
    n = c.try_cast("double")
    return n + n * F.lit(percent / 100) * (rng.uniform(seed, "noise", key) * 2 - 1)


def tokens(df: DataFrame, column: str, prefix: str = "TKN_") -> DataFrame:
    """(value, token): distinct values numbered densely by order, in ranges, so no task sees them all; the way back is the same table.

    Numbers have six digits at least."""
    values = df.select(F.col(f"`{column}`").cast("string").alias("value")).filter("value IS NOT NULL").distinct()
    return ranked(values, ["value"]).select("value", F.concat(F.lit(prefix), padded(F.col("rank") + 1, 6)).alias("token"))


def shuffled(df: DataFrame, column: str, key: str, seed: int) -> DataFrame:
    """Non-null values change places: the i-th row by key gets the i-th value by hash.  Ranks come from ranges, not one task."""
    have = df.filter(F.col(f"`{column}`").isNotNull())
    rows = ranked(have.select(F.col(key).alias("__k")), ["__k"]).withColumnRenamed("rank", "__r")
    values = ranked(have.select(F.col(f"`{column}`").alias("__v"), rng.order_key(seed, F.col(key)).alias("__h"), F.col(key).alias("__k2")), ["__h", "__k2"]).select("__v", F.col("rank").alias("__r"))
    new = rows.join(values, "__r").select("__k", "__v")
    return df.join(new, F.col(key) == F.col("__k"), "left").withColumn(column, F.col("__v")).drop("__k", "__v")


def anonymize(df: DataFrame, plan: dict[str, dict], key: str | None = None, seed: int = 42) -> tuple[DataFrame, dict[str, DataFrame]]:
    """plan: column -> {strategy, pii_type, percent}.  Synthetic, noise and shuffle draw by `key` (default: a hash of the row).
    Returns the table and the lookup tables of tokenised columns."""
    own_key = key is None
    if own_key:
        df, key = df.withColumn("__key", F.md5(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))), "__key"
    k, lookups = F.col(key), {}
    one = {}
    for column, p in plan.items():
        c, kind, how = F.col(f"`{column}`"), p.get("pii_type"), p.get("strategy") or DEFAULTS.get(p.get("pii_type"), "mask")
        if how not in STRATEGIES:
            raise ValueError(f"unknown strategy {how!r}")
        made = {
            "mask": lambda c=c, kind=kind: mask(c, kind),
            "hash": lambda c=c: hashed(c, str(seed)),
            "synthetic": lambda c=c, kind=kind, column=column: synthetic(c, kind, F.concat(F.lit(f"{column}:"), k.cast("string")), seed),
            "generalize": lambda c=c, kind=kind: generalize(c, kind),
            "redact": lambda: F.lit("[REDACTED]"),
            "noise": lambda c=c, p=p, column=column: noise(c, F.concat(F.lit(f"{column}:"), k.cast("string")), seed, p.get("percent", 10.0)),
        }.get(how)
        if made:
            one[column] = made()
        elif how == "tokenize":
            lookups[column] = tokens(df, column)
    for column, p in plan.items():
        if (p.get("strategy") or DEFAULTS.get(p.get("pii_type"))) == "shuffle":
            df = shuffled(df, column, key, seed)
    for column, table in lookups.items():
        df = df.join(table.select(F.col("value").alias("__value"), F.col("token").alias("__token")), F.col(f"`{column}`").cast("string") == F.col("__value"), "left").withColumn(column, F.col("__token")).drop("__value", "__token")
    df = df.withColumns(one)
    return (df.drop("__key") if own_key else df), lookups


def consistent_hash(c: Column, column: str, seed: int) -> Column:
    """Salted twice, so equal values of different columns differ."""
    return F.substring(F.sha2(F.concat(F.lit(f"{column}:"), F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")), 256)), 256), 1, 16)


def consistent_synthetic(c: Column, kind: str, seed: int) -> Column:
    """The same invented value for the same value, anywhere."""
    return synthetic(c, kind, c.cast("string"), seed)


def detokenize(df: DataFrame, column: str, lookup: DataFrame) -> DataFrame:
    return df.join(lookup.select(F.col("token").alias("__token"), F.col("value").alias("__value")), F.col(f"`{column}`") == F.col("__token"), "left").withColumn(column, F.col("__value")).drop("__token", "__value")


class TokenStore:
    """Tokens that stay the same over many tables: a Parquet table (column, value, token) for each version of the store.

    New values are numbered after the ones that are there; every version is written beside the last, which a job that dies leaves untouched."""

    SCHEMA = "column string, value string, token string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        top = self._hadoop(self.path)
        names = (s.getPath().getName() for s in self._fs.listStatus(top)) if self._fs.exists(top) else ()
        return sorted(n for n in names if self._fs.exists(self._hadoop(f"{self.path}/{n}/_SUCCESS")))

    def table(self) -> DataFrame:
        held = self._versions()
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/{held[-1]}") if held else self.spark.createDataFrame([], self.SCHEMA)

    def tokens(self, df: DataFrame, column: str, prefix: str = "TKN_") -> DataFrame:
        """df with the column's values replaced by their tokens; new values are kept."""
        held = self.table()
        mine = held.filter(F.col("column") == column)
        new = df.select(F.col(f"`{column}`").cast("string").alias("value")).filter("value IS NOT NULL").distinct().join(mine.select("value"), "value", "left_anti")
        last = mine.agg(F.max(F.regexp_extract("token", r"([0-9]+)$", 1).cast("long"))).first()[0] or 0
        named = tokens(new, "value", prefix).select(F.lit(column).alias("column"), "value", F.concat(F.lit(prefix), padded(F.regexp_extract("token", r"([0-9]+)$", 1).cast("long") + last, 6)).alias("token"))
        held.unionByName(named).write.parquet(f"{self.path}/{len(self._versions()):08d}")
        lookup = self.table().filter(F.col("column") == column).select(F.col("value").alias("__value"), F.col("token").alias("__token"))
        return df.join(lookup, F.col(f"`{column}`").cast("string") == F.col("__value"), "left").withColumn(column, F.col("__token")).drop("__value", "__token")

    def original(self, df: DataFrame, column: str) -> DataFrame:
        return detokenize(df, column, self.table().filter(F.col("column") == column))

    def load(self, lookup: DataFrame) -> None:
        """Take over a lookup table (column, value, token) as the next version."""
        lookup.select("column", "value", "token").write.parquet(f"{self.path}/{len(self._versions()):08d}")

    def stats(self) -> DataFrame:
        return self.table().groupBy("column").agg(F.count("*").alias("tokens"))

    def reset(self) -> None:
        self._fs.delete(self._hadoop(self.path), True)
