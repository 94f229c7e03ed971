"""Findings as text, Markdown or JSON. A report is as long as its rules, so it is collected."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def render(found: DataFrame, form: str = "text") -> str:
    rows = [r.asDict(recursive=True) for r in found.collect()]
    if form == "json":
        return json.dumps(rows, default=str, indent=2)
    if form == "markdown":
        head = list(rows[0]) if rows else ["rule"]
        lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
        return "\n".join(lines + ["| " + " | ".join(str(r[h]) for h in head) + " |" for r in rows])
    return "\n".join(f"P{r['severity']} {r['rule']}: {r['n']} ({r['first_seen']} .. {r['last_seen']}) on {', '.join(r['nodes'])}" for r in rows)
