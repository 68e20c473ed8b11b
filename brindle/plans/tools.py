"""The tools: names, parameters and callables over files, each answering with a small dictionary ({'success': ..., ...})."""

from __future__ import annotations

import inspect
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import anonymize, generate, hierarchy, mapping, pii, pipeline, profile, quality, relational, relationships, sql, subset, validate
from brindle.plans import specs
from brindle.sources import files, readers, reports, writers

CATEGORIES = {"01": "discovery", "02": "generation", "03": "editing", "04": "validation", "05": "export", "07": "help", "08": "mapping", "09": "privacy", "10": "subsetting"}


@dataclass
class Settings:
    """What the tools keep to, with overrides by keyword."""

    default_limit: int = 1000
    max_limit: int = 200_000
    preview_rows: int = 100
    max_chars: int = 500_000
    text_chars: int = 200
    seed: int = 42


@dataclass
class Tool:
    name: str
    call: Callable
    description: str
    required: list[str]
    optional: dict[str, object] = field(default_factory=dict)


TOOLS: dict[str, Tool] = {}


def tool(name: str):
    """Registers a method of Engine; its parameters without a default are required."""

    def add(f):
        params = list(inspect.signature(f).parameters.values())[1:]
        TOOLS[name] = Tool(name, f, (f.__doc__ or "").strip().split("\n")[0], [p.name for p in params if p.default is p.empty], {p.name: p.default for p in params if p.default is not p.empty})
        return f

    return add


def shown(v, chars: int = 200):
    """A value for an answer: rows as dictionaries, long texts cut, dates as text."""
    if isinstance(v, DataFrame):
        return [shown(r.asDict(True), chars) for r in v.collect()]
    if isinstance(v, dict):
        return {k: shown(x, chars) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [shown(x, chars) for x in v]
    if isinstance(v, str):
        return v if len(v) <= chars else v[: chars - 3] + "..."
    return v if v is None or isinstance(v, (int, float, bool)) else str(v)


def fitted(answer: dict, chars: int) -> dict:
    """The answer with its longest lists halved until its text is short enough."""
    while len(str(answer)) > chars:
        key = max((k for k, v in answer.items() if isinstance(v, list) and v), key=lambda k: len(str(answer[k])), default=None)
        if key is None:
            return answer
        answer = answer | {key: answer[key][: len(answer[key]) // 2], "truncated": True}
    return answer


class Engine:
    """Runs tools by name: unknown names, missing parameters and errors come back as {'success': False, 'error': ...}."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None):
        self.spark, self.settings, self.contexts = spark, settings or Settings(), readers.Contexts(spark)

    def run(self, name: str, /, **args) -> dict:
        t = TOOLS.get(name)
        if t is None:
            return {"success": False, "error": f"unknown tool {name}", "available": sorted(TOOLS)}
        missing = [p for p in t.required if p not in args]
        if missing:
            return {"success": False, "error": f"missing parameters: {', '.join(missing)}", "example": {p: f"<{p}>" for p in t.required}}
        try:
            return {"success": True, **fitted(shown(t.call(self, **args), self.settings.text_chars), self.settings.max_chars)}
        except Exception as e:  # the envelope is the tools' contract; the operators themselves raise
            return {"success": False, "error": str(e).split("\n")[0], "error_type": type(e).__name__}

    def read(self, path: str) -> DataFrame:
        return readers.read_table(self.spark, path)

    def write(self, df: DataFrame, path: str) -> str:
        """A new file or folder by extension, or over the source by way of a temporary one."""
        if os.path.exists(path):
            return writers.replace_source(df, path)
        return writers.write_csv(df, path) if path.endswith(".csv") else writers.write_parquet(df, path)

    def _made(self, df: DataFrame, output_path: str | None, rows: int = 10) -> dict:
        out = {"columns": df.columns, "preview": relational.preview(df, rows)}
        return out | {"output_path": self.write(df, output_path)} if output_path else out

    # ---- discovery ---------------------------------------------------------------------------------------------

    @tool("01_list_files")
    def list_files(self, directory: str, pattern: str = "*", recursive: bool = False):
        """Files of a directory."""
        found = readers.list_files(directory, pattern, recursive)
        return {"files": found, "count": len(found)}

    @tool("01_read_file_preview")
    def read_file_preview(self, file_path: str, rows: int = 10):
        """Columns and first rows of a file."""
        df = self.read(file_path)
        return {"columns": [{"name": n, "type": t} for n, t in df.dtypes], "rows": df.count(), "preview": relational.preview(df, rows)}

    @tool("01_analyze_file")
    def analyze_file(self, file_path: str, include_statistics: bool = True, include_patterns: bool = True):
        """Profile of all columns, with patterns of their values."""
        df = self.read(file_path)
        out = {"columns": profile.profile(df)} if include_statistics else {"columns": [{"column": n, "dtype": t} for n, t in df.dtypes]}
        return out | ({"patterns": profile.detect_patterns(df)} if include_patterns else {})

    @tool("01_detect_domain")
    def detect_domain(self, file_path: str):
        """The business domain that the column names speak of."""
        found = profile.detect_domain(self.read(file_path).columns)
        return {"primary_domain": found[0]["domain"] if found[0]["score"] else "unknown", "domains": found}

    @tool("01_find_relationships")
    def find_relationships(self, file_paths: list, threshold: float = 0.3):
        """Likely keys between files."""
        tables = {os.path.splitext(os.path.basename(p))[0]: self.read(p) for p in file_paths}
        return {"relationships": relationships.find_relationships(tables, threshold)}

    @tool("01_profile_column")
    def profile_column(self, file_path: str, column: str):
        """One column's profile, top values and patterns."""
        df = self.read(file_path).select(column)
        kind = profile.numeric_characteristics if profile.is_number(df.schema[0].dataType) else profile.string_characteristics
        return {"profile": profile.profile(df), "top_values": relational.value_counts(df, column), "patterns": profile.detect_patterns(df), "characteristics": kind(df, [column])}

    @tool("01_suggest_schema")
    def suggest_schema(self, file_path: str, target: str = "powerbi"):
        """Types, keys and advice for a table."""
        df = self.read(file_path)
        return {"schema": profile.infer_schema(df, target), "recommendations": profile.schema_recommendations(df)}

    # ---- generation ----------------------------------------------------------------------------------------------

    @tool("02_generate_dimension")
    def generate_dimension(self, dimension_type: str, row_count: int = 1000, columns: list | None = None, output_path: str | None = None):
        """A dimension by template or columns."""
        return self._made(generate.dimension(self.spark, columns or dimension_type, row_count, self.settings.seed), output_path)

    @tool("02_generate_fact")
    def generate_fact(self, fact_type: str, row_count: int = 10_000, dimensions: dict | None = None, date_range: list | None = None, output_path: str | None = None):
        """A fact by template; dimensions map key columns to sizes."""
        return self._made(generate.fact(self.spark, fact_type, row_count, dimensions, tuple(date_range) if date_range else None, self.settings.seed), output_path)

    @tool("02_generate_date_dimension")
    def generate_date_dimension(self, start_date: str, end_date: str, fiscal_year_start_month: int = 1, include_holidays: bool = False, output_path: str | None = None):
        """A date dimension."""
        return self._made(generate.date_dimension(self.spark, start_date, end_date, fiscal_year_start_month, include_holidays), output_path)

    @tool("02_generate_from_template")
    def generate_from_template(self, template_path: str, row_count: int = 1000, output_path: str | None = None):
        """A table from a YAML template, with its validations."""
        text = files.read_text(self.spark, template_path)
        df = generate.from_template(self.spark, text, row_count, self.settings.seed)
        checks = generate.template_checks(text)
        return self._made(df, output_path) | ({"validations": validate.check_rules(df, checks)} if checks else {})

    @tool("02_generate_star_schema")
    def generate_star_schema(self, domain: str, fact_rows: int = 100_000, dimension_rows: int = 1000, output_dir: str | None = None):
        """Dimensions and the fact of a domain."""
        return self._many(generate.star_schema(self.spark, domain, fact_rows, dimension_rows, seed=self.settings.seed), output_dir)

    def _many(self, tables: dict[str, DataFrame], output_dir: str | None) -> dict:
        return {"tables": {n: df.columns for n, df in tables.items()}} | ({"files": writers.write_many(tables, output_dir)} if output_dir else {})

    @tool("02_generate_time_series")
    def generate_time_series(self, pattern: str, start_date: str, end_date: str, base_value: float = 100.0, granularity: str = "day", extra_columns: list | None = None, output_path: str | None = None):
        """A time series by pattern."""
        return self._made(generate.time_series(self.spark, pattern, start_date, end_date, base_value, granularity, self.settings.seed, extra=extra_columns or []), output_path)

    @tool("02_list_time_patterns")
    def list_time_patterns(self, category: str | None = None):
        """Names of time patterns."""
        return {"patterns": generate.list_time_patterns(category)}

    @tool("02_generate_correlated_fact")
    def generate_correlated_fact(self, row_count: int, base_columns: list, correlations: list, output_path: str | None = None):
        """A fact whose columns depend on each other."""
        return self._made(generate.correlated_fact(self.spark, row_count, base_columns, correlations, self.settings.seed), output_path)

    @tool("02_list_correlation_patterns")
    def list_correlation_patterns(self):
        """Preset correlations."""
        return {"patterns": [{"name": n, "type": c["type"], "target": c["target"]} for n, c in specs.CORRELATIONS.items()]}

    @tool("02_generate_currency_dimension")
    def generate_currency_dimension(self, currencies: list | None = None, majors_only: bool = False, output_path: str | None = None):
        """Currencies."""
        return self._made(generate.currency_dimension(self.spark, currencies, majors_only), output_path)

    @tool("02_generate_exchange_rates")
    def generate_exchange_rates(self, base_currency: str, target_currencies: list, start_date: str, end_date: str, frequency: str = "weekday", output_path: str | None = None):
        """Exchange rates, a column a currency."""
        return self._made(generate.exchange_rates(self.spark, base_currency, target_currencies, start_date, end_date, frequency, self.settings.seed), output_path)

    @tool("02_generate_multicurrency_fact")
    def generate_multicurrency_fact(self, row_count: int, currencies: list, reporting_currency: str, start_date: str, end_date: str, output_path: str | None = None):
        """Transactions in several currencies, converted."""
        df = generate.multicurrency_fact(self.spark, row_count, currencies, reporting_currency, start_date, end_date, self.settings.seed)
        return self._made(df, output_path) | {"currency_breakdown": generate.currency_breakdown(df)}

    @tool("02_generate_industry_schema")
    def generate_industry_schema(self, industry: str, scale_factor: float = 1.0, output_dir: str | None = None):
        """The star schema of an industry."""
        return self._many(generate.industry_schema(self.spark, industry, scale_factor, seed=self.settings.seed), output_dir)

    @tool("02_list_industry_templates")
    def list_industry_templates(self):
        """Industries."""
        return {"industries": [{"name": n, "dimensions": [d for d in s if d != "facts"], "facts": list(s["facts"])} for n, s in specs.INDUSTRIES.items()]}

    # ---- editing -------------------------------------------------------------------------------------------------

    @tool("03_query_data")
    def query_data(self, file_path: str, query: str, output_path: str | None = None):
        """SQL over a file named data; an export has no limit."""
        df = sql.query(self.spark, self.read(file_path), query, None if output_path else self.settings.default_limit)
        return {"output_path": self.write(df, output_path)} if output_path else {"columns": df.columns, "rows": df}

    @tool("03_update_data")
    def update_data(self, file_path: str, set_values: dict, where_conditions: dict, output_path: str | None = None, expressions: list | None = None):
        """Set columns where others equal values."""
        df = self.read(file_path)
        return {"rows_updated": sql.affected(df, where_conditions), "output_path": self.write(sql.update(df, set_values, where_conditions, expressions or ()), output_path or file_path)}

    @tool("03_delete_data")
    def delete_data(self, file_path: str, where_conditions: dict, confirm: bool = False, output_path: str | None = None):
        """Delete rows where columns equal values; needs confirm."""
        if not confirm:
            raise ValueError("set confirm to delete")
        df = self.read(file_path)
        return {"rows_deleted": sql.affected(df, where_conditions), "output_path": self.write(sql.delete(df, where_conditions), output_path or file_path)}

    @tool("03_transform_data")
    def transform_data(self, file_path: str, transformations: list, output_path: str | None = None):
        """A list of steps."""
        df, log = pipeline.transform(self.read(file_path), transformations)
        return self._made(df, output_path) | {"steps": log}

    @tool("03_merge_files")
    def merge_files(self, file_paths: list, merge_type: str = "union", join_keys: list | None = None, output_path: str | None = None):
        """Union or join of several files."""
        frames = [self.read(p) for p in file_paths]
        return self._made(relational.union_files(frames) if merge_type == "union" else relational.join_files(frames, join_keys or []), output_path)

    # ---- validation and quality ---------------------------------------------------------------------------------

    @tool("04_validate_data")
    def validate_data(self, file_path: str, rules: list):
        """Rules on a file."""
        out = shown(validate.check_rules(self.read(file_path), rules))
        return {"results": out, "passed": all(r["passed"] for r in out)}

    @tool("04_check_referential_integrity")
    def check_referential_integrity(self, fact_path: str, dimension_paths: dict, keys: dict):
        """Fact keys in dimensions: dimension_paths name -> path, keys fact key -> name."""
        return {"results": validate.check_integrity(self.read(fact_path), {n: (self.read(p), None) for n, p in dimension_paths.items()}, keys)}

    @tool("04_validate_balance")
    def validate_balance(self, file_path: str, debit_column: str, credit_column: str, group_by: list | None = None, tolerance: float = 0.01):
        """Debits equal credits?"""
        df, by = self.read(file_path), group_by or []
        return {"summary": validate.balance_summary(df, debit_column, credit_column, by, tolerance), "imbalanced": validate.check_balance(df, debit_column, credit_column, by, tolerance).filter("NOT balanced").limit(100)}

    @tool("04_detect_anomalies")
    def detect_anomalies(self, file_path: str, columns: list | None = None, method: str = "zscore", threshold: float = 3.0):
        """Outliers of numeric columns."""
        return {"anomalies": validate.detect_anomalies(self.read(file_path), columns, method, threshold)}

    def _rules(self, rules_yaml: str | None) -> quality.Rules:
        return quality.Rules.from_yaml(files.read_text(self.spark, rules_yaml)) if rules_yaml else quality.Rules()

    @tool("04_score_data_quality")
    def score_data_quality(self, file_path: str, rules_yaml: str | None = None, reference_date: str | None = None):
        """Scores in six dimensions, grade and issues."""
        began, df, rules = time.time(), self.read(file_path), self._rules(rules_yaml)
        return quality.overall(quality.quality_scores(df, rules, reference_date)) | {"issues": quality.quality_issues(df, rules), "scan_duration_seconds": round(time.time() - began, 2)}

    @tool("04_compare_quality")
    def compare_quality(self, before_path: str, after_path: str, rules_yaml: str | None = None):
        """Two files' scores."""
        a, b = (quality.quality_scores(self.read(p), self._rules(rules_yaml)) for p in (before_path, after_path))
        x, y = quality.overall(a), quality.overall(b)
        return {"dimensions": quality.compare_quality(a, b), "before": x["overall_score"], "after": y["overall_score"], "verdict": quality.verdict(y["overall_score"] - x["overall_score"])}

    @tool("04_generate_quality_report")
    def generate_quality_report(self, file_path: str, output_path: str, format: str = "markdown", rules_yaml: str | None = None):
        """A report of scores and issues."""
        df, rules = self.read(file_path), self._rules(rules_yaml)
        scores = quality.quality_scores(df, rules)
        o = quality.overall(scores)
        text = reports.render("Data quality", {"file": file_path, "score": o["overall_score"], "grade": o["grade"]}, {"Dimensions": scores.collect(), "Issues": quality.quality_issues(df, rules).collect(), "Advice": [{"advice": a} for a in o["recommendations"]]}, format)
        return {"output_path": reports.save(text, output_path)}

    # ---- export --------------------------------------------------------------------------------------------------

    @tool("05_export_csv")
    def export_csv(self, file_path: str, output_path: str, delimiter: str = ",", include_header: bool = True, null_value: str = "", encoding: str = "UTF-8", single_file: bool = False):
        """A file as CSV."""
        return {"output_path": writers.write_csv(self.read(file_path), output_path, delimiter, include_header, null_value=null_value, encoding=encoding, single_file=single_file)}

    @tool("05_export_parquet")
    def export_parquet(self, file_path: str, output_path: str, compression: str = "snappy", single_file: bool = False):
        """A file as Parquet."""
        return {"output_path": writers.write_parquet(self.read(file_path), output_path, compression, single_file=single_file)}

    @tool("05_optimize_for_powerbi")
    def optimize_for_powerbi(self, file_path: str, output_path: str | None = None, keep_precision: bool = False):
        """Narrower types, and measures."""
        df, log = profile.narrowed(self.read(file_path), keep_precision=keep_precision)
        name = os.path.splitext(os.path.basename(file_path))[0]
        return self._made(df, output_path) | {"optimizations": log, "measures": profile.measure_texts(name, df.columns)}

    # ---- help ----------------------------------------------------------------------------------------------------

    @tool("07_list_tools")
    def list_tools(self, category: str | None = None):
        """All tools."""
        return {"tools": [{"name": n, "category": CATEGORIES[n[:2]], "description": t.description} for n, t in sorted(TOOLS.items()) if category in (None, CATEGORIES[n[:2]])]}

    @tool("07_get_tool_help")
    def get_tool_help(self, tool_name: str):
        """A tool's parameters."""
        t = TOOLS[tool_name]
        return {"name": t.name, "description": t.description, "required": t.required, "optional": {k: v for k, v in t.optional.items()}}

    @tool("07_get_domain_prompt")
    def get_domain_prompt(self, domain: str):
        """What to know and check in a domain."""
        d = profile.DOMAINS[domain]
        return {"domain": domain, "tables": d["tables"], "rules": [{"type": a, "description": b} for a, b in d["rules"]], "subtypes": d["subtypes"]}

    # ---- mapping -------------------------------------------------------------------------------------------------

    @tool("08_discover_mappings")
    def discover_mappings(self, file_paths: list, threshold: float = 0.7, source: str | None = None):
        """Columns whose values are found in other files."""
        tables = {os.path.splitext(os.path.basename(p))[0]: self.read(p) for p in file_paths}
        found = mapping.discover(tables, threshold, source, fuzzy=True)
        return {"mappings": found, "join_paths": mapping.suggest_join_paths(found), "hierarchies": {n: mapping.hierarchy_columns(df) for n, df in tables.items()}}

    @tool("08_define_mapping")
    def define_mapping(self, name: str, values: dict, store_path: str, description: str = ""):
        """Keep a mapping."""
        m = mapping.Mappings(store_path)
        m.define(name, values, description)
        return {"mappings": m.list()}

    @tool("08_validate_amounts")
    def validate_amounts(self, source_path: str, amount_column: str, group_column: str, rule: dict, mapping_path: str | None = None, source_column: str | None = None, target_column: str | None = None, tolerance: float = 0.01, fuzzy: float | None = 0.8):
        """Amounts by group against a rule."""
        m = mapping.last_mapping(self.read(mapping_path), source_column, target_column) if mapping_path else None
        groups = mapping.group_amounts(self.read(source_path), amount_column, group_column, m, fuzzy if m is not None else None)
        return {"groups": groups, "check": mapping.check_amounts(groups, rule, tolerance), "coverage": mapping.coverage(groups)}

    @tool("08_load_context")
    def load_context(self, files: list, context_name: str = "default"):
        """Several files under aliases."""
        return {"context": context_name, "tables": self.contexts.load(files, context_name).summary()}

    @tool("08_query_context")
    def query_context(self, query: str, context_name: str = "default", limit: int = 1000):
        """SQL over a context's aliases."""
        df = sql.run_sql(self.spark, query, self.contexts.get(context_name).tables)
        n = df.count()
        return {"total_rows": n, "columns": df.columns, "rows": df.limit(min(limit, self.settings.max_limit)), "limited": n > limit}

    def _hierarchy(self, df: DataFrame, parent: str | None, child: str | None) -> tuple[str, str]:
        if parent and child:
            return parent, child
        found = hierarchy.detect_columns(df)
        if found["hierarchy_type"] != "parent_child":
            raise ValueError("no parent and child columns found")
        return found["parent"], found["child"]

    @tool("08_analyze_hierarchy")
    def analyze_hierarchy(self, file_path: str, parent_column: str | None = None, child_column: str | None = None, level_columns: list | None = None):
        """Pattern, roots, leaves and depth."""
        df = self.read(file_path)
        if not parent_column and not level_columns:
            level_columns = hierarchy.detect_columns(df).get("levels")
        if level_columns:
            return {"hierarchy_type": "level_based", "levels": hierarchy.level_counts(df, level_columns)}
        return {"hierarchy_type": "parent_child", "analysis": hierarchy.analyze(df, *self._hierarchy(df, parent_column, child_column))}

    @tool("08_rollup_through_hierarchy")
    def rollup_through_hierarchy(self, hierarchy_path: str, amounts_path: str, key_column: str, amount_column: str, parent_column: str | None = None, child_column: str | None = None, element: str | None = None):
        """Amounts summed up the hierarchy."""
        h = self.read(hierarchy_path)
        p, c = self._hierarchy(h, parent_column, child_column)
        rolled = hierarchy.rollup(h, p, c, self.read(amounts_path), key_column, amount_column)
        if element:
            return {"breakdown": hierarchy.breakdown(rolled, h, p, c, element)}
        return {"totals": rolled.orderBy(F.desc("total_amount"), "element").limit(self.settings.default_limit)}

    # ---- privacy -------------------------------------------------------------------------------------------------

    @tool("09_detect_pii")
    def detect_pii(self, file_path: str, threshold: float = 0.5, sample_size: int | None = 1000):
        """Personal data by column (sample_size None: all rows)."""
        found = pii.detect_pii(self.read(file_path), threshold, sample_size, self.settings.seed)
        return {"columns": found.orderBy(F.desc("confidence"), "column")} | pii.risk(found)

    @tool("09_anonymize_file")
    def anonymize_file(self, file_path: str, output_path: str, strategies: dict | None = None, auto_detect: bool = True, key: str | None = None):
        """Anonymised copy: given strategies by column first, then defaults of detected types."""
        df = self.read(file_path)
        found = pii.best_types(pii.detect_pii(df)) if auto_detect else {}
        plan = {c: {"pii_type": t} for c, t in found.items()}
        for c, s in (strategies or {}).items():
            plan[c] = plan.get(c, {}) | ({"strategy": s} if isinstance(s, str) else s)
        out, lookups = anonymize.anonymize(df, plan, key, self.settings.seed)
        return {"output_path": self.write(out, output_path), "columns": plan, "tokenised": sorted(lookups)}

    @tool("09_generate_anonymization_report")
    def generate_anonymization_report(self, file_path: str, output_path: str, format: str = "markdown"):
        """A report of personal data and risk."""
        found = pii.detect_pii(self.read(file_path))
        r = pii.risk(found)
        rows = found.withColumn("default_strategy", F.create_map(*(F.lit(x) for kv in anonymize.DEFAULTS.items() for x in kv))[F.col("pii_type")])
        text = reports.render("Personal data", {"file": file_path, "risk": f"{r['risk_score']} ({r['risk_level']})"}, {"Columns": rows.collect(), "Advice": [{"advice": a} for a in r["recommendations"]]}, format)
        return {"output_path": reports.save(text, output_path)}

    # ---- subsets -------------------------------------------------------------------------------------------------

    @tool("10_create_subset")
    def create_subset(self, file_path: str, strategy: str, key_column: str, output_path: str | None = None, target_size: int | None = None, target_percent: float | None = None, stratify_columns: list | None = None, date_column: str | None = None, start_date: str | None = None, end_date: str | None = None):
        """random, stratified, equal, time_window, top_n or systematic."""
        df = self.read(file_path)
        n = subset.target_size(df.count(), target_size, target_percent)
        made = {
            "random": lambda: subset.random_subset(df, n, key_column, self.settings.seed),
            "stratified": lambda: subset.stratified_subset(df, n, stratify_columns, key_column, self.settings.seed),
            "equal": lambda: subset.stratified_subset(df, n, stratify_columns, key_column, self.settings.seed, equal=True),
            "time_window": lambda: subset.time_window(df, date_column, start_date, end_date),
            "top_n": lambda: subset.top_n(df, n, [key_column]),
            "systematic": lambda: subset.systematic_subset(df, n, [key_column]),
        }
        if strategy not in made:
            raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(made)}")
        return self._made(made[strategy](), output_path) | {"target_size": n}

    @tool("10_analyze_subset")
    def analyze_subset(self, source_path: str, subset_path: str, columns: list | None = None):
        """How alike a subset's distributions are to its source's."""
        compared = subset.compare_distributions(self.read(source_path), self.read(subset_path), columns)
        return subset.distribution_summary(compared) | {"details": compared}
