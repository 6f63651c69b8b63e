"""Reports: one dict of plain values, and its text, Markdown, HTML and JSON forms."""

from __future__ import annotations

import html
import json

FORMATS = ["html", "markdown", "json"]
STYLE = "body{font:15px sans-serif;max-width:70em;margin:2em auto}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:.3em .6em}th{background:#eee}.callout{border-left:4px solid #c80;padding:.4em}.yes{background:#cfc}.no{background:#fcc}"


def _rows(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def bar(value: float, most: float, width: int = 20) -> str:
    return "#" * (int(width * value / most) if most else 0)


def _cell(v) -> str:
    return f"{v:.4g}" if isinstance(v, float) else "" if v is None else str(v)


class ReportingMixin:
    def generate_full_report(self, include_mi: bool = True, include_vif: bool = True) -> dict:
        """All analyses; what several of them need is computed once."""
        self.df.persist()
        try:
            report = {"task_info": self.get_task_info()}
            if self.task == "classification":
                report["distribution"] = _rows(self.analyze_class_distribution())
                report["imbalance"] = self.get_class_imbalance_info()
                report["class_wise_stats"] = _rows(self.analyze_class_wise_statistics())
            else:
                report["distribution"] = self.analyze_target_distribution()
                report["correlations"] = _rows(self.analyze_feature_correlations())
            report["relationships"] = _rows(self.analyze_feature_target_relationship())
            mi = self.analyze_mutual_information() if include_mi else None
            vif = self.calculate_vif() if include_vif else None
            report["mutual_information"] = _rows(mi) if mi is not None else []
            report["data_quality"] = self.analyze_data_quality()
            report["vif"] = _rows(vif) if vif is not None else []
            report["recommendations"] = self.generate_recommendations(report["data_quality"], mi, vif)
            return report
        finally:
            self.df.unpersist()

    def generate_summary_report(self) -> str:
        info = self.get_task_info()
        lines = ["SUMMARY", "=======", f"Target {info['target_column']} ({info['target_dtype']}): {self.task}, {info['unique_values']} values, {info['missing_percent']:.1f}% missing", ""]
        if self.task == "classification":
            rows = self._classes()
            most = max((r["count"] for r in rows), default=0)
            lines += [f"{r['class']!s:>20} {r['count']:>10} {bar(r['count'], most)}" for r in rows]
            lines.append(f"Balance: {self.get_class_imbalance_info()['severity']}")
        else:
            lines += [f"{k:>20} {_cell(v)}" for k, v in self.analyze_target_distribution().items()]
        return "\n".join(lines)

    def export_report(self, filepath: str, format: str = "html", **kw) -> None:  # noqa: A002
        if format not in FORMATS:
            raise ValueError(f"format is one of {FORMATS}")
        report = self.generate_full_report(**kw)
        text = {"json": _json, "markdown": _markdown, "html": _html}[format](report)
        with open(filepath, "w", encoding="utf-8") as f:
            f.write(text)


def _json(report: dict) -> str:
    return json.dumps(report, indent=2, default=str)


def _sections(report: dict):
    """(title, header, rows) of each part."""
    for key, part in report.items():
        part = part[:10] if key == "relationships" else [r for r in part if r["VIF"] > 10] if key == "vif" else part
        if isinstance(part, list) and part and isinstance(part[0], dict):
            yield key, list(part[0]), [[_cell(v) for v in r.values()] for r in part]
        elif isinstance(part, dict):
            yield key, ["", "value"], [[k, _cell(v)] for k, v in part.items()]
        elif part:
            yield key, None, [[str(x)] for x in part]


def _title(key: str) -> str:
    return key.replace("_", " ").capitalize()


def _markdown(report: dict) -> str:
    parts = list(_sections(report))
    out = ["# Target analysis", "", "## Table of contents", ""] + [f"- [{_title(k)}](#{k.replace('_', '-')})" for k, _, _ in parts]
    for key, header, rows in parts:
        out += ["", f"## {_title(key)}", "", *_callouts(key, report)]
        if header is None:
            out += [f"> **Note** {r[0]}" for r in rows]
        else:
            safe = lambda r: "| " + " | ".join(v.replace("|", "\\|") for v in r) + " |"
            out += [safe(header), "|" + "-|" * len(header), *map(safe, rows)]
    return "\n".join(out) + "\n"


def _callouts(key: str, report: dict) -> list[str]:
    """What stands out in a part."""
    part, out = report[key], []
    if key == "imbalance" and part["severity"] != "none":
        out.append(f"> **Warning** classes are unequal ({part['severity']})")
    if key == "data_quality":
        out += [f"> **Warning** {len(part[k])} {k.replace('_', ' ')}" for k in ("leakage_suspects", "constant_features") if part[k]]
    if key == "distribution" and isinstance(part, dict) and part.get("has_outliers"):
        out.append(f"> **Note** {part['outlier_count']} outliers")
    return [*out, ""] if out else []


def _badge(v: str) -> str:
    kind = {"True": "yes", "False": "no"}.get(v)
    return f"<span class='{kind}'>{kind}</span>" if kind else html.escape(v)


def _html(report: dict) -> str:
    parts = list(_sections(report))
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Target analysis</title><style>{STYLE}</style></head><body><h1>Target analysis</h1>"]
    out.append("<nav><ul>" + "".join(f"<li><a href='#{k}'>{html.escape(_title(k))}</a></li>" for k, _, _ in parts) + "</ul></nav>")
    for key, header, rows in parts:
        out.append(f"<details open id='{key}'><summary><b>{html.escape(_title(key))}</b></summary>")
        out += [f"<p class='callout'>{html.escape(c[2:].replace('**', ''))}</p>" for c in _callouts(key, report) if c]
        if header is None:
            out.append("<ul>" + "".join(f"<li>{html.escape(r[0])}</li>" for r in rows) + "</ul>")
        else:
            line = lambda r, tag, text: "<tr>" + "".join(f"<{tag}>{text(v)}</{tag}>" for v in r) + "</tr>"
            out.append("<table>" + line(header, "th", html.escape) + "".join(line(r, "td", _badge) for r in rows) + "</table>")
        out.append("</details>")
    return "".join(out) + "</body></html>\n"
