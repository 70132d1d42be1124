"""A validation report: one job for each section, rendered on the driver from small results.

The same facts are also a table (section, subject, metric, value) that can be written and compared by SQL.
"""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ranktide.errors import RankError
from ranktide.operators import accuracy, explain, fairness, outcomes, robust
from ranktide.operators.scorer import Model, score

SCHEMA_VERSION = "1.1"


def _cell(x: object) -> str:
    if x is None:
        return "-"
    text = f"{x:.4f}" if isinstance(x, float) else str(x)
    return " ".join(text.split()).replace("\\", "\\\\").replace("|", "\\|")


@dataclass
class Report:
    metadata: dict
    sections: dict[str, list[dict]] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return {"schema_version": SCHEMA_VERSION, "metadata": self.metadata, "sections": self.sections, "warnings": self.warnings}

    def to_json(self, **options) -> str:
        return json.dumps(self.to_dict(), default=str, **options)

    def to_markdown(self) -> str:
        out = [f"# Validation of {_cell(self.metadata['model'])}", "", f"Generated {_cell(self.metadata['generated_at'])}; {self.metadata['n']} rows."]
        for name, rows in self.sections.items():
            out += ["", f"## {name.replace('_', ' ').capitalize()}", ""]
            if rows:
                head = list(rows[0])
                out += ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
                out += ["| " + " | ".join(_cell(r[c]) for c in head) + " |" for r in rows]
        if self.warnings:
            out += ["", "## Warnings", "", *[f"- {_cell(w)}" for w in self.warnings]]
        return "\n".join(out) + "\n"

    def to_html(self) -> str:
        esc = lambda x: html.escape("-" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x), quote=True)
        out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{esc(self.metadata['model'])}</title></head><body><h1>{esc(self.metadata['model'])}</h1><p>{esc(self.metadata['generated_at'])}; {self.metadata['n']} rows</p>"]
        for name, rows in self.sections.items():
            out.append(f"<h2>{esc(name)}</h2><table>")
            if rows:
                out.append("<tr>" + "".join(f"<th>{esc(c)}</th>" for c in rows[0]) + "</tr>")
                out += ["<tr>" + "".join(f"<td>{esc(v)}</td>" for v in r.values()) + "</tr>" for r in rows]
            out.append("</table>")
        out += [f"<p>{esc(w)}</p>" for w in self.warnings]
        return "".join(out) + "</body></html>\n"

    def facts(self, spark: SparkSession) -> DataFrame:
        """section, subject, metric, value."""
        rows = []
        for name, items in self.sections.items():
            for r in items:
                keys = [str(v) for v in r.values() if isinstance(v, str)]
                rows += [(name, " / ".join(keys), k, float(v)) for k, v in r.items() if isinstance(v, (int, float)) and not isinstance(v, bool)]
        return spark.createDataFrame(rows, "section string, subject string, metric string, value double")


def settled(record: dict) -> dict:
    """The record with numbers to twelve digits: sums differ in the last ones with the order of rows."""
    return {k: float(f"{v:.12g}") if isinstance(v, float) else v for k, v in record.items()}


def build(df: DataFrame, y: str, model: Model, train: DataFrame | None = None, variables: Sequence[str] = (), group: str | None = None, protected: Sequence[str] = (), threshold: float | None = None, name: str = "model", generated_at: str | None = None, row_id: str = "row_id", level: float = 0.95, min_group_size: int = 50, n_resamples: int = 2000, seed: int = 0) -> Report:
    """Accuracy always; explainability with ``train``; robustness with ``variables``; fairness with ``group`` and ``protected``; outcomes only with a threshold.

    A section that can't be made gives a warning; any other error is raised.
    """
    d = score(df, model, "z").withColumn("y", df[y].cast("double")).cache()
    try:
        stamp = generated_at or datetime.now(timezone.utc).isoformat(timespec="seconds")
        out = Report({"model": name, "generated_at": stamp, "n": d.count(), "level": level, "seed": seed})

        def section(key: str, make: Callable[[], DataFrame]) -> None:
            try:
                out.sections[key] = [settled(r.asDict()) for r in make().collect()]
            except RankError as e:
                out.warnings.append(f"{key}: {e}")

        out.sections["accuracy"] = [settled(accuracy.report(d, (), "y", "z", level=level).first().asDict())]
        names = list(variables)
        if names and train is not None:
            section("explainability", lambda: explain.rge(train, df, model, names, row_id=row_id).orderBy("rge", ascending=False))
        elif names:
            out.warnings.append("explainability: no training rows were given")
        if names:
            section("robustness", lambda: robust.rgr_curve(df, model, names, row_id=row_id).orderBy("variable", "magnitude"))
        if group:
            section("parity_groups", lambda: fairness.parity_groups(d, group, "y", "z", min_group_size, level, row_id=row_id))
            for r in out.sections.get("parity_groups", []):
                if not r["included"]:
                    out.warnings.append(f"parity: group {r['group']} has {r['n']} rows, fewer than {min_group_size}, and is not compared")
            section("parity", lambda: fairness.parity(d, group, "y", "z", min_group_size, level, row_id=row_id, n_resamples=n_resamples, seed=seed, gap_interval=False))
            if threshold is None:
                out.warnings.append("outcomes: no threshold was given, so no selection rates are reported")
            else:
                section("outcomes", lambda: outcomes.gaps(outcomes.rates(d, group, "y", "z", threshold, min_group_size, level, row_id), level))
        if protected:
            section("leakage", lambda: fairness.proxy_leakage(d.select(row_id, "z", *protected, *[c for c in names if c not in protected]), list(protected), row_id=row_id, yhat="z").orderBy("variable"))
            if train is not None:
                section("dependence", lambda: explain.rgf(train, df, model, list(protected), row_id=row_id))
        return out
    finally:
        d.unpersist()
