"""Personal data: a catalogue of types, detection by column name and content in one aggregate, risk, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.profile import stacked


@dataclass(frozen=True)
class PiiType:
    name: str
    sensitivity: str
    category: str
    names: tuple[str, ...]
    pattern: str | None = None
    validator: str | None = None


def _t(name: str, sensitivity: str, category: str, names: tuple[str, ...], pattern: str | None = None, validator: str | None = None) -> PiiType:
    return PiiType(name, sensitivity, category, names, pattern, validator)


#: Type, sensitivity, category, column names, pattern, validator.
CATALOGUE = (
    _t("ssn", "critical", "national_id", ("ssn", "social_security", "socialsecurity", "social_sec", "ssnum", "ss_number"), r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", "ssn"),
    _t("credit_card", "critical", "financial", ("credit_card", "creditcard", "card_number", "cardnumber", "cc_num", "ccnum", "pan"), r"\b(?:\d{4}[-\s]?){3}\d{4}\b|\b\d{15,16}\b", "luhn"),
    _t("bank_account", "critical", "financial", ("bank_account", "bankaccount", "account_number", "accountnumber", "acct_num", "routing_number"), r"\b\d{8,17}\b"),
    _t("iban", "critical", "financial", ("iban", "int_bank_account"), r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b", "iban"),
    _t("passport", "critical", "national_id", ("passport", "passport_number", "passportnum", "passport_no"), r"\b[A-Z]{1,2}\d{6,9}\b"),
    _t("drivers_license", "critical", "national_id", ("drivers_license", "driverslicense", "dl_number", "dlnum", "license_number", "driving_license"), r"\b[A-Z0-9]{5,15}\b"),
    _t("medical_id", "critical", "health", ("medical_id", "medicalid", "patient_id", "patientid", "mrn", "medical_record", "npi"), r"\b[A-Z0-9]{6,15}\b"),
    _t("national_id", "critical", "national_id", ("national_id", "nationalid", "national_insurance", "ni_number", "nino", "tax_id", "tin"), r"\b[A-Z0-9]{6,15}\b"),
    _t("email", "high", "contact", ("email", "email_address", "emailaddress", "e_mail", "mail", "contact_email"), r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", "email"),
    _t("phone", "high", "contact", ("phone", "phone_number", "phonenumber", "telephone", "tel", "mobile", "cell", "contact_phone", "fax"), r"\b(?:\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "phone"),
    _t("ip_address", "high", "online_identifier", ("ip", "ip_address", "ipaddress", "ip_addr", "client_ip", "user_ip"), r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    _t("street_address", "high", "location", ("address", "street_address", "streetaddress", "address1", "address_line", "mailing_address", "home_address"), r"\b\d+\s+[\w\s]+(?:street|st|avenue|ave|road|rd|drive|dr|lane|ln|way|court|ct|boulevard|blvd)\b"),
    _t("username", "high", "online_identifier", ("username", "user_name", "userid", "user_id", "login", "login_name", "screen_name", "handle")),
    _t("password", "critical", "security", ("password", "passwd", "pwd", "pass", "secret", "pin", "passcode")),
    _t("first_name", "medium", "personal", ("first_name", "firstname", "fname", "given_name", "givenname", "forename")),
    _t("last_name", "medium", "personal", ("last_name", "lastname", "lname", "surname", "family_name", "familyname")),
    _t("full_name", "medium", "personal", ("name", "full_name", "fullname", "customer_name", "employee_name", "contact_name", "person_name")),
    _t("date_of_birth", "medium", "personal", ("dob", "date_of_birth", "dateofbirth", "birth_date", "birthdate", "birthday"), r"\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})\b"),
    _t("age", "medium", "personal", ("age", "patient_age", "customer_age", "age_years"), r"\b(?:[1-9]|[1-9]\d|1[01]\d|120)\b"),
    _t("gender", "medium", "personal", ("gender", "sex", "gender_identity"), r"\b(?:male|female|m|f|man|woman|non-binary|other)\b"),
    _t("salary", "medium", "financial", ("salary", "wage", "compensation", "pay", "income", "annual_salary", "hourly_rate"), r"\b\d{4,8}(?:\.\d{2})?\b"),
    _t("zip_code", "low", "location", ("zip", "zip_code", "zipcode", "postal_code", "postalcode", "postcode"), r"\b\d{5}(?:-\d{4})?\b"),
    _t("city", "low", "location", ("city", "town", "municipality", "city_name")),
    _t("state", "low", "location", ("state", "province", "region", "state_code", "state_name")),
    _t("country", "low", "location", ("country", "country_code", "country_name", "nation")),
    _t("ethnicity", "high", "special_category", ("ethnicity", "race", "ethnic_origin", "racial_origin")),
    _t("religion", "high", "special_category", ("religion", "religious_affiliation", "faith", "belief")),
    _t("political", "high", "special_category", ("political_party", "political_affiliation", "political_view")),
    _t("biometric", "critical", "special_category", ("fingerprint", "face_id", "biometric", "iris_scan", "voice_print")),
    _t("genetic", "critical", "special_category", ("genetic", "dna", "genome", "genetic_marker")),
)
BY_NAME = {t.name: t for t in CATALOGUE}
#: Points of a column's sensitivity, and risk levels from a score on.
RISK_POINTS = {"critical": 40, "high": 25, "medium": 10, "low": 5}
RISK_LEVELS = (("critical", 80), ("high", 60), ("medium", 40), ("low", 20), ("minimal", 0))

# ---- validators --------------------------------------------------------------------------------------------------------


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def valid_ssn(c: Column) -> Column:
    d = digits(c)
    area = F.substring(d, 1, 3)
    return (F.length(d) == 9) & (area != "000") & (area != "666") & (area < "900") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def valid_card(c: Column) -> Column:
    d = digits(c)
    return (F.length(d) >= 13) & F.call_function("luhn_check", d)


def valid_iban(c: Column) -> Column:
    """15 to 34 letters and digits whose number, first four characters last and letters as 10 to 35, leaves 1 modulo 97."""
    s = F.upper(F.regexp_replace(c, r"\s", ""))
    moved = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda x: x != ""), F.lit(0), lambda acc, x: (acc * F.when(x.rlike("[0-9]"), 10).otherwise(100) + _code(x)) % 97)
    return s.rlike(r"^[A-Z0-9]{15,34}$") & (rest == 1)


def _code(x: Column) -> Column:
    return F.when(x.rlike("[0-9]"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)


def valid_email(c: Column) -> Column:
    return F.trim(c).rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")


def valid_phone(c: Column) -> Column:
    return F.length(digits(c)).between(7, 15)


VALIDATORS = {"ssn": valid_ssn, "luhn": valid_card, "iban": valid_iban, "email": valid_email, "phone": valid_phone}

# ---- detection -----------------------------------------------------------------------------------------------------------


def name_confidence(column: str) -> dict[str, float]:
    """Types that a column's name suggests: 0.9 for one of their names, 0.7 if either holds the other."""
    low = column.lower().replace("-", "_").replace(" ", "_")
    out = {}
    for t in CATALOGUE:
        hit = next((0.9 if low == n else 0.7 for n in t.names if low == n or n in low or low in n), None)
        if hit:
            out[t.name] = hit
    return out


def _content_confidence(rate: Column) -> Column:
    return F.when(rate >= 0.8, 0.95).when(rate >= 0.5, 0.8).when(rate >= 0.2, 0.6).when(rate >= 0.05, 0.4).otherwise(0.0)


def match_rates(df: DataFrame, columns: list[str] | None = None, validated: bool = False, types: list[str] | None = None) -> DataFrame:
    """column, pii_type, match_rate: the share of non-null values that hold the type's pattern (validated: and pass its check where the
    whole value is one match).  All columns and types (or those asked for) in one pass."""
    columns = columns or df.columns
    measures = {}
    for c in columns:
        v = F.col(f"`{c}`").cast("string")
        for t in CATALOGUE:
            if t.pattern and (types is None or t.name in types):
                hit = v.rlike(f"(?i){t.pattern}")
                if validated and t.validator:
                    hit = hit & F.coalesce(VALIDATORS[t.validator](v), F.lit(False))
                measures[f"{c}\x1f{t.name}"] = {"match_rate": F.coalesce(F.avg(hit.cast("double")), F.lit(0.0))}
    pair = F.split("pair", "\x1f")
    return stacked(df, measures, "pair").select(pair[0].alias("column"), pair[1].alias("pii_type"), "match_rate")


def detect_pii(df: DataFrame, threshold: float = 0.5, sample: int | None = None, seed: int = 42, validated: bool = False) -> DataFrame:
    """column, pii_type, name_conf, match_rate, content_conf, confidence, method, sensitivity, gdpr_category of what reaches the threshold.

    Of all rows, or of a sample drawn by a hash of the row.  Both signs: at most 0.98 of 0.4 * name + 0.6 * content; the name alone counts 0.7 of
    itself; content alone counts as it is."""
    if sample:
        df = df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))).limit(sample)
    named = [(c, t, v) for c in df.columns for t, v in name_confidence(c).items()]
    names = df.sparkSession.createDataFrame(named, "column string, pii_type string, name_conf double")
    found = match_rates(df, validated=validated).withColumn("content_conf", _content_confidence(F.col("match_rate")))
    kinds = df.sparkSession.createDataFrame([(t.name, t.sensitivity, t.category) for t in CATALOGUE], "pii_type string, sensitivity string, gdpr_category string")
    both = found.join(names, ["column", "pii_type"], "full").fillna(0.0, ["name_conf", "match_rate", "content_conf"])
    n, c = F.col("name_conf"), F.col("content_conf")
    confidence = F.when((n > 0) & (c > 0), F.least(F.lit(0.98), 0.4 * n + 0.6 * c)).when(n > 0, n * 0.7).otherwise(c)
    method = F.when((n > 0) & (c > 0), "both").when(n > 0, "column_name").otherwise("content")
    out = both.withColumn("confidence", F.round(confidence, 4)).withColumn("method", method).filter(F.col("confidence") >= threshold).join(F.broadcast(kinds), "pii_type")  # 30 rows
    return out.select("column", "pii_type", "name_conf", F.round("match_rate", 4).alias("match_rate"), "content_conf", "confidence", "method", "sensitivity", "gdpr_category")


def quick_scan(columns: list[str]) -> dict[str, dict[str, float]]:
    """Suspicions by name only."""
    return {c: s for c in columns if (s := name_confidence(c))}


def best_types(found: DataFrame) -> dict[str, str]:
    """The likeliest type of each column (ties: the first by name)."""
    best = found.groupBy("column").agg(F.min_by("pii_type", F.struct(-F.col("confidence"), "pii_type")).alias("t"))
    return {r["column"]: r["t"] for r in best.collect()}  # a row a column


def risk(found: DataFrame) -> dict:
    """Points of the columns' worst types, 100 at most, with the level and advice."""
    points = F.create_map(*(F.lit(x) for kv in RISK_POINTS.items() for x in kv))
    rows = found.groupBy("column").agg(F.max(points[F.col("sensitivity")]).alias("p")).collect()  # a row a column
    score = min(100, sum(r.p for r in rows))
    level = next(n for n, low in RISK_LEVELS if score >= low)
    advice = ["Anonymise critical columns before sharing"] if any(r.p == 40 for r in rows) else []
    advice += ["Restrict access to columns that identify people"] if any(r.p == 25 for r in rows) else []
    return {"risk_score": score, "risk_level": level, "columns": len(rows), "recommendations": advice or ["No action needed"]}
