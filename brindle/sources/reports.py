"""Reports of small results as Markdown, HTML or JSON text."""

from __future__ import annotations

import json
from datetime import date, datetime
from html import escape

from pyspark.sql import SparkSession

from brindle.sources import files

FORMATS = ("markdown", "html", "json")


def _plain(v):
    if isinstance(v, (date, datetime)):
        return v.isoformat()
    return v.asDict() if hasattr(v, "asDict") else v


def _table(rows: list[dict], kind: str) -> str:
    if not rows:
        return "nothing" if kind == "markdown" else "<p>nothing</p>"
    heads = list(rows[0])
    if kind == "markdown":
        cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
        lines = ["| " + " | ".join(heads) + " |", "|" + " --- |" * len(heads)]
        return "\n".join(lines + ["| " + " | ".join(cell(r.get(h)) for h in heads) + " |" for r in rows])
    cell = lambda v: escape(str("" if v is None else v))
    return "<table><tr>" + "".join(f"<th>{escape(h)}</th>" for h in heads) + "</tr>" + "".join("<tr>" + "".join(f"<td>{cell(r.get(h))}</td>" for h in heads) + "</tr>" for r in rows) + "</table>"


def render(title: str, summary: dict, sections: dict[str, list], kind: str = "markdown") -> str:
    """A title, a few facts, and a table for each section (rows or dictionaries)."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; there are {', '.join(FORMATS)}")
    tables = {name: [{k: _plain(v) for k, v in _plain(r).items()} for r in rows] for name, rows in sections.items()}
    if kind == "json":
        return json.dumps({"title": title, "summary": summary, **tables}, default=str, indent=1)
    if kind == "markdown":
        return "\n\n".join([f"# {title}", "\n".join(f"- **{k}**: {v}" for k, v in summary.items()), *(f"## {n}\n\n{_table(r, kind)}" for n, r in tables.items())]) + "\n"
    facts = "".join(f"<li><b>{escape(str(k))}</b>: {escape(str(v))}</li>" for k, v in summary.items())
    body = "".join(f"<h2>{escape(n)}</h2>{_table(r, kind)}" for n, r in tables.items())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><ul>{facts}</ul>{body}</body></html>"


def save(text: str, path: str) -> str:
    """Write a report to any place that Spark reaches."""
    return files.write_text(SparkSession.active(), path, text)
