"""Requests to a model: rows of (id, system, prompt, schema), named by their content."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..schemas import EXTRACT_OUT, FOLD_OUT, MERGE_OUT, SCORE_OUT
from . import evidence as EV
from .packing import fixed_groups
from .synth import SCORE_GROUP, render_item

SYSTEM = {
    "extract": "You read code reviews. List the lasting rules that reviewers asked for, each with the references of the comments that show it and a short quote of each. Leave out what concerns one change only.",
    "merge": "You get rules found in different reviews, one a line. Put those that ask for the same thing together and word each group once. Name every line as member, opponent or discarded.",
    "fold": "You get the rules of a team and new findings, one a line. Say which rule each finding supports or opposes. Word new rules for what fits none, and discard what is no rule.",
    "score": "You grade rules by the measures beside them: golden for what holds without exception, conditional for what holds under a condition that you name, consider for weak ones, rejected for what reviewers do not stand by.",
}
SHAPES = {"extract": EXTRACT_OUT, "merge": MERGE_OUT, "fold": FOLD_OUT, "score": SCORE_OUT}


def json_schema(ddl: str) -> str:
    """The JSON schema of an answer, from its columns."""

    def of(kind: T.DataType) -> dict:
        if isinstance(kind, T.ArrayType):
            return {"type": "array", "items": of(kind.elementType)}
        if isinstance(kind, T.StructType):
            return {"type": "object", "properties": {f.name: of(f.dataType) for f in kind.fields}, "required": kind.names, "additionalProperties": False}
        return {"type": "number" if isinstance(kind, T.DoubleType) else "string"}

    return json.dumps(of(T.StructType.fromDDL(ddl)))


def request(kind: str, prefix: Column, prompt: Column) -> list[Column]:
    return [X.request_id(prefix, prompt).alias("id"), F.lit(SYSTEM[kind]).alias("system"), prompt.alias("prompt"), F.lit(json_schema(SHAPES[kind])).alias("schema")]


def extract(chunks: DataFrame) -> DataFrame:
    """A request for each chunk (id, text)."""
    return chunks.select(*request("extract", F.col("id"), F.concat(F.lit("<reviews>\n"), F.col("text"), F.lit("</reviews>\n\nList the rules."))))


def _lines(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: render_item(i + 1, x)), "")


def merge(groups: DataFrame) -> DataFrame:
    """(category, bin, items, and the request) of (category, bin, items)."""
    prompt = F.concat(F.lit("Category: "), F.col("category"), F.lit("\n\n<rules>\n"), _lines(F.col("items")), F.lit("</rules>\n\nPut them together."))
    return groups.select("category", "bin", "items", *request("merge", F.concat_ws("-", F.lit("merge"), "category", F.col("bin").cast("string")), prompt))


def existing_line(no: Column) -> Column:
    """A rule's line among those into which findings are folded."""
    when = F.when(F.coalesce("applies_when", F.lit("")) != "", F.concat(F.lit(" | when: "), X.one_line(F.col("applies_when")))).otherwise("")
    return F.concat(F.lit("[R"), no.cast("string"), F.lit("] ("), F.coalesce("kind", F.lit("")), F.lit(") "), X.one_line(F.col("title")), F.lit(": "), X.one_line(F.col("statement")), when, F.lit("\n"))


def fold(groups: DataFrame) -> DataFrame:
    """The same of (category, bin, items, n_rules, existing)."""
    prompt = F.concat(F.lit("Category: "), F.col("category"), F.lit("\n\n<rules>\n"), F.col("existing"), F.lit("</rules>\n\n<findings>\n"), _lines(F.col("items")), F.lit("</findings>\n\nFold them in."))
    return groups.select("category", "bin", "items", "n_rules", *request("fold", F.concat_ws("-", F.lit("fold"), "category", F.col("bin").cast("string")), prompt))


def score(drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drafts with request and no, requests) for the selected of ``drafts`` (category, rule_id, title, statement, selected, metrics...)."""
    place = F.row_number().over(Window.partitionBy("category", "selected").orderBy("rule_id"))
    placed = drafts.withColumn("_place", place).withColumn("no", F.when(F.col("selected"), (F.col("_place") - 1) % SCORE_GROUP + 1).cast("int")).withColumn("_group", fixed_groups(F.col("_place"), SCORE_GROUP))
    line = F.concat(F.lit("[r"), F.col("no").cast("string"), F.lit("] "), X.one_line(F.col("title")), F.lit(": "), X.one_line(F.col("statement")), F.lit(" | "), EV.metrics_line(), F.lit("\n"))
    listed = placed.filter("selected").groupBy("category", "_group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", line.alias("line")))), lambda x: x["line"]), "").alias("lines"))
    prompt = F.concat(F.lit("Category: "), F.col("category"), F.lit("\n\n<rules>\n"), F.col("lines"), F.lit("</rules>\n\nGrade each."))
    asked = listed.select("category", "_group", *request("score", F.concat_ws("-", F.lit("score"), "category", F.col("_group").cast("string")), prompt))
    met = placed.join(asked.select("category", "_group", F.col("id").alias("request")), ["category", "_group"], "left")
    return met.withColumn("request", F.when(F.col("selected"), F.col("request"))).drop("_place", "_group"), asked.drop("category", "_group")
