"""Report sinks: JSON, Markdown, HTML, XML and console text of an audit, and parquet tables.

A report is a summary: category scores, and an issue per rule and status, with
its pages counted and one of them named; the full lists stay in tables. Only
these rows come to the driver: two per rule at most.
"""

from __future__ import annotations

import json
from html import escape
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.plans.audit import AuditFrames, as_stored
from pagelattice.plans.messages import advice_for, message
from pagelattice.plans.rules import CATEGORIES

def grade(score: int, scale: str = "console") -> str:
    """A letter for a score: D begins at 50 on the console, at 60 in the XML report."""
    steps = ((90, "A"), (80, "B"), (70, "C"), (50 if scale == "console" else 60, "D"))
    return next((g for least, g in steps if score >= least), "F")


# The least score of each label, with its colour.
BANDS = ((90, "Excellent", "green"), (70, "Good", "yellow"), (50, "Needs Work", "orange"), (0, "Poor", "red"))


def band(score: int) -> tuple[str, str]:
    """(label, colour) of a score."""
    return next((label, colour) for least, label, colour in BANDS if score >= least)


def issues(frames: AuditFrames) -> DataFrame:
    """(audit_id, category_id, rule_id, status, pages, example) of what did not pass."""
    bad = frames.results.where("status <> 'P'").join(frames.parsed.select("audit_id", "page_id", "url"), ["audit_id", "page_id"])
    return bad.groupBy("audit_id", "category_id", "rule_id", "status").agg(
        F.count_distinct("page_id").alias("pages"), F.min("url").alias("example")
    )


def summary(frames: AuditFrames, audit_id: int) -> dict[str, Any]:
    """The report's rows of one audit."""
    this = F.col("audit_id") == audit_id
    categories = frames.categories.where(this).collect()  # a row per category
    found = issues(frames).where(this).orderBy("status", F.col("pages").desc(), "rule_id").collect()
    clean = frames.results.where(this).groupBy("rule_id").agg(F.bool_and(F.col("status") == "P").alias("clean")).where("clean").collect()
    overall = frames.overall.where(this).collect()
    order = list(CATEGORIES)
    return {
        "audit_id": audit_id,
        "overall_score": overall[0].overall_score if overall else 0,
        "categories": [
            {
                "id": c.category_id,
                "name": CATEGORIES[c.category_id][0],
                "score": c.score,
                "passed": c.passed,
                "warnings": c.warned,
                "failed": c.failed,
            }
            for c in sorted(categories, key=lambda c: order.index(c.category_id))
        ],
        "issues": [
            {
                "rule": i.rule_id,
                "category": i.category_id,
                "severity": "critical" if i.status == "F" else "warning",
                "message": message(i.rule_id, i.status),
                "pages": i.pages,
                "example": i.example,
                "fix": advice_for(i.rule_id),
            }
            for i in found
        ],
        "passed": sorted(r.rule_id for r in clean),
    }


def to_json(s: dict) -> str:
    return json.dumps(s, indent=2, ensure_ascii=False)


def _by_category(s: dict) -> list[tuple[dict, list[dict]]]:
    """Categories in report order, each with its issues, failures first."""
    return [
        (c, sorted((i for i in s["issues"] if i["category"] == c["id"]), key=lambda i: (i["severity"] != "critical", -i["pages"], i["rule"])))
        for c in s["categories"]
    ]


def to_markdown(s: dict) -> str:
    label, _ = band(s["overall_score"])
    out = [f"# Site audit {s['audit_id']}", "", f"Overall score: **{s['overall_score']}** ({grade(s['overall_score'])}, {label})", ""]
    out += ["| Category | Score | Passed | Warnings | Failed |", "|---|---|---|---|---|"]
    out += [f"| {c['name']} | {c['score']} | {c['passed']} | {c['warnings']} | {c['failed']} |" for c in s["categories"]]
    for c, found in _by_category(s):
        if found:
            out += ["", f"## {c['name']}", ""]
        out += [
            f"- **{i['severity']}** `{i['rule']}`: {i['message']} on {i['pages']} page(s), such as {i['example']}. {i['fix']}" for i in found
        ]
    out += ["", f"{len(s['passed'])} rules passed on every page."]
    return "\n".join(out) + "\n"


_STYLE = """body{font-family:sans-serif;max-width:70rem;margin:2rem auto;padding:0 1rem;color:#222}
.score{font-size:3rem;font-weight:bold}.green{color:#1a7f37}.yellow{color:#9a6700}.orange{color:#bc4c00}.red{color:#cf222e}
table{border-collapse:collapse;width:100%}td,th{padding:.3rem .8rem;border-bottom:1px solid #ddd;text-align:left}
.bar{background:#eee;width:10rem;height:.6rem}.bar div{background:currentColor;height:.6rem}
details{margin:.4rem 0}.critical summary{color:#cf222e}.warning summary{color:#9a6700}"""


def to_html(s: dict) -> str:
    label, colour = band(s["overall_score"])

    def row(c: dict) -> str:
        tint = band(c["score"])[1]
        return (
            f"<tr><td><a href='#{c['id']}'>{escape(c['name'])}</a></td><td class='{tint}'>{c['score']}</td>"
            f"<td class='{tint}'><div class='bar'><div style='width:{c['score']}%'></div></div></td>"
            f"<td>{c['passed']}</td><td>{c['warnings']}</td><td>{c['failed']}</td></tr>"
        )

    def issue(i: dict) -> str:
        return (
            f"<details class='{i['severity']}'><summary><code>{escape(i['rule'])}</code> {escape(i['message'])} on {i['pages']} page(s)</summary>"
            f"<p>Such as <a href='{escape(i['example'] or '', quote=True)}'>{escape(i['example'] or '')}</a></p><p>{escape(i['fix'])}</p></details>"
        )

    parts = "".join(
        f"<section id='{c['id']}'><h2>{escape(c['name'])}</h2>{''.join(map(issue, found)) or '<p>Nothing to report.</p>'}</section>"
        for c, found in _by_category(s)
    )
    return (
        "<!doctype html><html lang='en'><head><meta charset='utf-8'><meta name='viewport' content='width=device-width'><title>Site audit</title>"
        f"<style>{_STYLE}</style></head><body><h1>Site audit {s['audit_id']}</h1>"
        f"<p class='score {colour}'>{s['overall_score']} <small>{grade(s['overall_score'])}, {label}</small></p>"
        "<table><thead><tr><th>Category</th><th>Score</th><th></th><th>Passed</th><th>Warnings</th><th>Failed</th></tr></thead>"
        f"<tbody>{''.join(map(row, s['categories']))}</tbody></table>{parts}"
        f"<h2>Passed on every page</h2><p>{escape(', '.join(s['passed']))}</p></body></html>"
    )


def _short(text: str | None, size: int) -> str:
    text = text or ""
    return escape(text if len(text) <= size else text[: size - 1] + "…", quote=True)


def to_xml(s: dict) -> str:
    """The compact report for language models: critical issues first, then the rules that passed everywhere."""
    out = [f'<audit score="{s["overall_score"]}" grade="{grade(s["overall_score"], "xml")}">']
    out += [f'<category id="{c["id"]}" score="{c["score"]}"/>' for c in s["categories"]]
    for i in sorted(s["issues"], key=lambda i: i["severity"] != "critical"):
        out.append(
            f'<issue rule="{i["rule"]}" severity="{i["severity"]}" pages="{i["pages"]}" message="{_short(i["message"], 200)}" example="{_short(i["example"], 200)}">{_short(i["fix"], 200)}</issue>'
        )
    out.append(f"<passed>{' '.join(s['passed'])}</passed></audit>")
    return "\n".join(out)


def to_console(s: dict) -> str:
    out = [f"Overall {s['overall_score']} ({grade(s['overall_score'])})"]
    by: dict[str, list] = {}
    for i in s["issues"]:
        by.setdefault(i["category"], []).append(i)
    order = sorted(by, key=lambda k: (-sum(i["severity"] == "critical" for i in by[k]), -len(by[k])))
    for k in order:
        out.append(f"\n{CATEGORIES[k][0]}")
        out += [f"  {'x' if i['severity'] == 'critical' else '!'} {i['rule']}: {i['message']}, {i['pages']} page(s)" for i in by[k]]
    return "\n".join(out)


FORMATS = {"json": to_json, "markdown": to_markdown, "html": to_html, "xml": to_xml, "console": to_console}


def exit_code(score: int | None) -> int:
    """0 from 70 up, 1 below, 2 without a score."""
    return 2 if score is None else 0 if score >= 70 else 1


def save(frames: AuditFrames, folder: str, pages: DataFrame | None = None) -> None:
    """The audit's tables as parquet, results by audit; with the audited pages, in the columns of stored results."""
    results = frames.results if pages is None else as_stored(frames, pages)
    results.write.mode("overwrite").partitionBy("audit_id").parquet(f"{folder}/audit_results")
    frames.categories.write.mode("overwrite").parquet(f"{folder}/audit_categories")
    frames.overall.write.mode("overwrite").parquet(f"{folder}/audits")
    issues(frames).write.mode("overwrite").parquet(f"{folder}/issues")
