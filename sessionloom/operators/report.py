"""Markdown reports from entity frames (SNK-17, SNK-18, REP-1 to REP-3): Spark counts and cuts, the driver formats a bounded page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import text as T

from . import relational as R


def _section(title: str, lines: list[str]) -> str:
    return f"## {title}\n\n" + ("\n".join(lines) if lines else "_None._") + "\n"


def project_report(project: str, decisions: DataFrame, mistakes: DataFrame, requirements: DataFrame, edits: DataFrame, limit: int = 50) -> str:
    """Counts, architecture by module, quality, most changed files, latest decisions, mistakes, and months of a project; each section has ``limit`` lines at most.

    A module's decisions and mistakes are those whose text names a file of it.
    """
    named = lambda df, c: df.select(F.explode(T.paths_in(c)).alias("file_path"), F.col(c).alias("text"), "timestamp")
    files_seen = edits.select("file_path").distinct()
    d_at, m_at = named(decisions, "decision_text"), named(mistakes, "what_went_wrong")
    modules = R.module_rollup(files_seen, d_at, m_at, edits=edits)
    top = R.cross_references(R.busiest_first(modules, limit), files_seen, d_at, m_at).collect()
    quality = R.documentation_stats(modules).first()
    months = R.monthly(decisions.withColumn("at", F.timestamp_millis("timestamp")), "at").orderBy("month").limit(limit).collect()
    grave = R.critical_mistakes(mistakes).collect() if "severity" in mistakes.columns else []
    n = {r["entity"]: r["n"] for r in R.counts(decisions=decisions, mistakes=mistakes, requirements=requirements, edits=edits).collect()}
    files = R.file_changes(edits, limit).collect()
    d = decisions.orderBy(F.desc("timestamp"), "id").limit(limit).select("decision_text", "rationale").collect()
    m = R.mistake_summary(mistakes).orderBy(F.desc("n"), "mistake_type").limit(limit).collect()
    r = requirements.orderBy(F.desc("timestamp"), "id").limit(limit).select("type", "description").collect()
    return "\n".join([
        f"# {project}\n",
        _section("Statistics", [f"- {k}: {v}" for k, v in n.items()]),
        _section("Architecture", [f"- {x['description']}" + (f"; first decision: {x['first_decision']}" if x["first_decision"] else "") for x in sorted(top, key=lambda x: (-(x["n_decisions"] + x["n_mistakes"]), x["module"]))]),
        _section("Quality", [f"- {quality['modules']} modules, mean complexity {quality['average_complexity']}", *(f"- {x['mistake_type']}: {x['what_went_wrong']}" for x in grave)]),
        _section("Decisions", [f"- {x['decision_text']}" + (f" ({x['rationale']})" if x["rationale"] else "") for x in d]),
        _section("Requirements", [f"- {x['type']}: {x['description']}" for x in r]),
        _section("Mistakes", [f"- {x['mistake_type']}: {x['n']}" + "".join(f"; {y}" for y in x["first_lessons"][:3]) for x in m]),
        _section("Timeline", [f"- {x['month']}: {x['n']} decisions" for x in months]),
        _section("Files", [f"- `{x['file_path']}`: {x['n_conversations']} conversations" for x in files]),
    ])


def context_page(memory: DataFrame, decisions: DataFrame, files: DataFrame, k: int = 5) -> str:
    """The top ``k`` lines of each section, to be put before a new session (SNK-18)."""
    rows = lambda df, by, c: [f"- {x[0]}" for x in df.orderBy(F.desc(by), c).limit(k).select(c).collect()]
    return "\n".join([_section("Memory", rows(memory, "updated_at", "value")), _section("Decisions", rows(decisions, "timestamp", "decision_text")), _section("Files", rows(files, "timestamp", "file_path"))])
