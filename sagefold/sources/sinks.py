"""Sinks: reports, rule files, bundles, handbooks.

What the files say is put together as DataFrame columns; the driver writes the
few documents of a report.  A file appears whole or not at all.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import report
from ..operators.evidence import metrics_line
from ..vocabulary import TIERS

MARKER = "<!-- generated by sagefold; edits are lost -->"
PREFIX = "rules-"
FORMATS = ["rules", "skill", "manual", "json"]


def write_file(path: str | Path, data: str | bytes) -> None:
    """Through a temporary file in the same folder, which then takes the name."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data.encode() if isinstance(data, str) else data)
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_json(path: str | Path, value) -> None:
    write_file(path, json.dumps(value, indent=2, ensure_ascii=False, default=str) + "\n")


def write_jsonl(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, by Spark's commit protocol."""
    df.write.mode("overwrite").json(path)


def append_page(folder: str | Path, number: int, rows: Iterable[dict]) -> int:
    """Write the next page and return its number; no rows write nothing and keep the number."""
    lines = [json.dumps(r, ensure_ascii=False, default=str) for r in rows]
    if not lines:
        return number
    write_file(Path(folder) / f"page-{number + 1:05d}.jsonl", "\n".join(lines) + "\n")
    return number + 1


class Invalid(ValueError):
    """A report breaks its constraints; the message has all of them."""


def write_report(rules: DataFrame, path: str | Path, facts: dict) -> None:
    """The report as one JSON document, once all constraints hold.  A report has some hundreds of rules."""
    problems = [f"{r['id']}: {r['problem']}" for r in report.violations(rules).orderBy("id", "problem").collect()]
    if not facts.get("repo") and not facts.get("repos"):
        problems.append("repo and repos are both empty")
    if problems:
        raise Invalid("\n".join(problems))
    ranked = rules.orderBy("rank") if "rank" in rules.columns else rules
    stats = {**facts.get("stats", {}), "by_tier": {r["tier"]: r["n"] for r in report.tally(rules).collect()}}
    listed = [json.loads(r[0]) for r in ranked.select(F.to_json(F.struct(*rules.columns))).collect()]
    write_json(path, {"schema_version": 1, **facts, "stats": stats, "rules": listed})


def should_write(changed: bool, dest: str | Path, formats: Iterable[str], repo: str | None) -> bool:
    """Unchanged rules leave files alone, but for exports that were never written."""
    return changed or missing(dest, formats, repo)


def _places(dest: str | Path, repo: str | None) -> dict[str, Path]:
    dest = Path(dest)
    return {"rules": dest / "rules", "skill": dest / "skills" / _skill(repo) / "SKILL.md", "manual": dest / "review-handbook.md", "json": dest / "rules.json"}


def _skill(repo: str | None) -> str:
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    return spark.range(1).select(X.skill_name(F.lit(repo or "").cast("string"))).first()[0]


def missing(dest: str | Path, formats: Iterable[str], repo: str | None) -> bool:
    places = _places(dest, repo)
    return any(not places[f].exists() for f in formats)


def remove_stale(folder: str | Path) -> list[str]:
    """Delete generated rule files: those with our prefix and our marker near their start."""
    gone = []
    for path in sorted(Path(folder).glob(f"{PREFIX}*.md")):
        with path.open("rb") as f:
            if MARKER.encode() in f.read(1024):
                path.unlink()
                gone.append(path.name)
    return gone


def parse_formats(text: str) -> list[str]:
    """Formats in their order, each once; ``all`` stands for the three rendered ones."""
    out: list[str] = []
    for name in (x.strip().lower() for x in text.split(",")):
        if name and name != "all" and name not in FORMATS:
            raise ValueError(f"unknown format {name!r}")
        out += FORMATS[:3] if name == "all" else [name] if name else []
    return list(dict.fromkeys(out))


def item_text() -> Column:
    """A rule as a Markdown item."""
    when = F.when(X.trim_ws(F.coalesce("applies_when", F.lit(""))) != "", F.concat(F.lit("\n  *Applies:* "), X.one_line(F.col("applies_when")))).otherwise("")
    return F.concat(F.lit("- **"), X.one_line(F.col("title")), F.lit("** ("), "tier", F.lit("): "), X.one_line(F.coalesce("rule", "title")), when, F.lit("\n  "), metrics_line(), F.lit("\n"))


def rule_documents(exported: DataFrame, label: str) -> DataFrame:
    """(file, text) of the rule files of a report."""
    files = report.rule_files(exported).withColumn("id", F.explode("ids"))
    lines = files.join(exported.select("id", "rank", item_text().alias("item")), "id")
    heading = F.when(F.size("paths") > 0, F.concat(F.lit("# Review rules for "), X.code_list(F.col("paths")), F.lit(f" in {label}\n\n"))).otherwise(F.concat(F.lit("# "), X.title_case(F.replace(F.col("category"), F.lit("-"), F.lit(" "))), F.lit(f": review rules for {label}\n\n")))
    globs = F.when(F.size("paths") > 0, F.concat(F.lit("paths:\n"), F.array_join(F.transform("paths", lambda p: F.concat(F.lit("  - "), X.quoted(p), F.lit("\n"))), ""))).otherwise("")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]), "")
    grouped = lines.groupBy("file", "paths", "category").agg(body.alias("body"))
    return grouped.select("file", F.concat(F.lit("---\n"), globs, F.lit(f"---\n{MARKER}\n\n"), heading, "body").alias("text"))


def handbook(exported: DataFrame, label: str) -> DataFrame:
    """One row: the handbook, with a table of tiers, contents and rules by tier and category."""
    rows = exported.select("rank", "tier", "category", item_text().alias("item"))
    group = rows.groupBy("tier", "category").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]), "").alias("items"))
    text = F.concat(F.lit("### "), X.title_case(F.replace(F.col("category"), F.lit("-"), F.lit(" "))), F.lit("\n\n"), "items", F.lit("\n"))
    tiers = group.groupBy("tier").agg(F.min("rank").alias("rank"), F.sum("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x["t"]), "").alias("body"))
    name = X.title_case(F.col("tier"))
    line = F.concat(F.lit("- ["), name, F.lit("](#"), X.anchor(name), F.lit("): "), F.col("n").cast("string"))
    gather = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", c.alias("t")))), lambda x: x["t"]), "\n")
    return tiers.agg(F.concat(F.lit(f"{MARKER}\n\n# Review handbook of {label}\n\n"), gather(line), F.lit("\n\n"), gather(F.concat(F.lit("## "), name, F.lit("\n\n"), "body"))).alias("text"))


def export(rules: DataFrame, dest: str | Path, formats: Iterable[str], repo: str | None, label: str, lowest: str = "consider", facts: dict | None = None) -> list[str]:
    """Write the formats of a validated report; the files that were written.

    ``rules``: with ``paths`` and metrics.  The JSON copy keeps the whole report's statistics.
    """
    exported = report.export_rules(rules.filter("tier <> 'rejected'") if lowest != TIERS[-1] else rules, lowest).persist()
    places, written = _places(dest, repo), []

    def put(path: Path, text: str) -> None:
        write_file(path, text)
        written.append(str(path))

    for kind in formats:
        if kind == "rules":
            places[kind].mkdir(parents=True, exist_ok=True)
            remove_stale(places[kind])
            for r in rule_documents(exported, label).orderBy("file").collect():
                put(places[kind] / r["file"], r["text"])
        elif kind == "skill":
            main = "\n".join(r["item"] for r in exported.orderBy("rank").select(item_text().alias("item")).collect())
            put(places[kind], f"---\nname: {places[kind].parent.name}\ndescription: Review rules of {label}\n---\n{MARKER}\n\n{main}")
        elif kind == "manual":
            put(places[kind], "".join(r["text"] for r in handbook(exported, label).collect()))
        else:
            write_json(places[kind], {**(facts or {}), "rules": [json.loads(r[0]) for r in exported.orderBy("rank").select(F.to_json(F.struct(*rules.columns))).collect()]})
            written.append(str(places[kind]))
    exported.unpersist()
    return written
