"""Sources: CSV, Parquet and Excel files as DataFrames, listings, and named contexts of several files."""

from __future__ import annotations

import io
import itertools
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from fnmatch import fnmatch
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.sources import files

READABLE = (".csv", ".parquet", ".xlsx")
LISTED = (*READABLE, ".xls", ".json", ".txt")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, parse_dates: bool = False, n_rows: int | None = None) -> DataFrame:
    """A file by its extension.  Dates in CSV files stay text unless parse_dates; n_rows limits what is read."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".parquet":
        df = spark.read.parquet(path)
    elif kind == ".csv":
        reader = spark.read.option("header", True)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
        if not schema and not parse_dates:
            dated = {f.name for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))}
            if dated:  # read again as text: a cast back would change how it was written
                kept = T.StructType([T.StructField(f.name, T.StringType() if f.name in dated else f.dataType) for f in df.schema])
                df = reader.schema(kept).csv(path)
    elif kind == ".xlsx":
        df = read_xlsx(spark, path)
    else:
        raise ValueError(f"can't read {kind or 'a file without extension'}: {path}")
    return df.limit(n_rows) if n_rows is not None else df


# ---- Excel: rows of the zipped XML ---------------------------------------------------------------

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_rows(data: bytes, sheet: int = 1) -> Iterator[list[str | None]]:
    """The cells of a sheet as text, row by row, padded to the first row's width."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{{{_NS['m']}}}t")) for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        width = 0
        with z.open(f"xl/worksheets/sheet{sheet}.xml") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{{{_NS['m']}}}row":
                    continue
                cells: dict[int, str | None] = {}
                for i, c in enumerate(row.findall("m:c", _NS)):
                    value = c.findtext("m:v", None, _NS)
                    if c.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    elif c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif c.get("t") == "b" and value is not None:
                        value = "true" if value == "1" else "false"
                    cells[_column_number(c.get("r")) if c.get("r") else i] = value
                width = width or max(cells, default=-1) + 1
                yield [cells.get(i) for i in range(width)]
                row.clear()


def read_xlsx(spark: SparkSession, path: str, batch: int = 10_000) -> DataFrame:
    """An .xlsx sheet from any store that Spark reads: the first row names the columns; a column whose cells are all whole numbers, numbers or
    booleans gets that type.  A sheet is one compressed stream of a million rows at most: one task reads it."""
    raw = spark.read.format("binaryFile").load(path).select("content")

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                yield pd.DataFrame({"names": [[h or f"column_{i + 1}" for i, h in enumerate(next(xlsx_rows(data), []))]]})

    names = raw.mapInPandas(head, "names array<string>").first().names
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                rows = xlsx_rows(data)
                next(rows, None)
                while some := list(itertools.islice(rows, batch)):
                    yield pd.DataFrame(some, columns=range(len(names)), dtype=object).set_axis(names, axis=1)

    df = raw.mapInPandas(cells, schema) if names else spark.createDataFrame([], schema)
    if not df.columns:
        return df
    kinds = ("long", "double", "boolean")
    bad = df.agg(*(F.sum((F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(k).isNull()).cast("int")).alias(f"{i}_{k}") for i, c in enumerate(df.columns) for k in kinds)).first()
    fits = lambda i: next((k for k in kinds if bad[f"{i}_{k}"] == 0), "string")
    return df.select(*(F.col(f"`{c}`").cast(fits(i)).alias(c) for i, c in enumerate(df.columns)))


def write_xlsx(df: DataFrame, path: str, most_rows: int = 1_048_575) -> None:
    """A small result as a sheet (a sheet holds at most 1,048,576 rows; more is an error)."""
    from xml.sax.saxutils import escape

    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError("too many rows for a sheet")
    cell = lambda v: "<c/>" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [df.columns, *rows])
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_NS["m"]}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS["m"]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
    files.write_bytes(df.sparkSession, path, data.getvalue())


# ---- listings and contexts ---------------------------------------------------------------------------------------------


def human_size(n: int) -> str:
    size = float(n)
    for unit in ("B", "KB", "MB", "GB"):
        if size < 1024:
            return f"{size:.1f} {unit}"
        size /= 1024
    return f"{size:.1f} TB"


def list_files(directory: str, pattern: str = "*", recursive: bool = False) -> list[dict]:
    """Files of a directory by name, with size and whether they can be read."""
    if not os.path.isdir(directory):
        raise FileNotFoundError(directory)
    tops = os.walk(directory) if recursive else [next(os.walk(directory))]
    found = sorted(os.path.join(d, f) for d, _, names in tops for f in names if fnmatch(f, pattern))
    return [
        {"name": os.path.basename(p), "path": p, "extension": (e := os.path.splitext(p)[1].lower()), "supported": e in LISTED, "readable": e in READABLE, "size_bytes": (s := os.path.getsize(p)), "size": human_size(s)}
        for p in found
    ]


def list_files_frame(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """The same for any store that Spark reads, without the files' content."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", F.col("length").alias("size_bytes"), "modificationTime", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*READABLE).alias("readable"))


def parquet_metadata(path: str) -> dict:
    """Rows, row groups, columns and their compression from a Parquet file's footer."""
    import pyarrow.parquet as pq

    m = pq.ParquetFile(path).metadata
    columns = [{"name": m.schema.column(i).path, "type": m.schema.column(i).physical_type, "compression": m.row_group(0).column(i).compression if m.num_row_groups else None} for i in range(m.num_columns)]
    return {"num_rows": m.num_rows, "num_row_groups": m.num_row_groups, "num_columns": m.num_columns, "created_by": m.created_by, "size_bytes": os.path.getsize(path), "columns": columns}


@dataclass
class Context:
    """Named tables with roles; SQL sees each under its alias."""

    name: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    roles: dict[str, str] = field(default_factory=dict)

    def by_role(self, role: str) -> dict[str, DataFrame]:
        return {a: self.tables[a] for a, r in self.roles.items() if r == role}

    def summary(self) -> list[dict]:
        return [{"alias": a, "role": self.roles[a], "rows": df.count(), "columns": df.columns} for a, df in self.tables.items()]


class Contexts:
    """A registry of contexts."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def load(self, files: list[dict], name: str = "default") -> Context:
        """files: {path, alias (default: the file's stem), role (default: data)}."""
        out = Context(name)
        for f in files:
            alias = f.get("alias") or os.path.splitext(os.path.basename(f["path"].rstrip("/")))[0]
            out.tables[alias], out.roles[alias] = read_table(self.spark, f["path"]), f.get("role") or "data"
        self.held[name] = out
        return out

    def get(self, name: str) -> Context:
        return self.held[name]

    def unload(self, name: str) -> bool:
        return self.held.pop(name, None) is not None

    def list(self) -> list[str]:
        return sorted(self.held)
