"""Runs: what changed is extracted, folded into the rules, and only what moved is graded anew.

The state is Parquet below one folder, written in the order in which a later run
needs it:

* ``chunks``, ``refs``, ``requests``, ``prs`` of a generation, in folders of its
  number; they count once its row in ``generations`` seals them, and a run that
  stopped before that writes them again;
* ``results``: answers, which only grow;
* ``candidates`` of a generation, before its row says ``extracted``;
* ``rules`` in versions; the row in ``folds`` that names a version comes last.

A run without changed pull requests and without open work asks nothing and
writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..workspace import stored
from . import completer as C
from . import digest, ledger, prompts, synth
from . import evidence as EV

GENERATION = "gen int, status string, attempts int, chunks int"
ORDER = {"submitted": 0, "extracted": 1}
RULE = (
    "category string, rule_id string, kind string, title string, statement string, rationale string, applies_when string, bad_example string, good_example string, "
    "paths array<string>, languages array<string>, members array<string>, opposing array<string>, tier string, confidence double, tier_reason string, signature string"
)
REF = "ref string, pr long, url string, author string, role string, date timestamp, body string, thumbs_up int"
CITED = "array<struct<pr:bigint,ref:string,url:string,author:string,role:string,date:timestamp,quote:string,outcome:string,thumbs_up:int>>"
CANDIDATE = f"id string, title string, statement string, rationale string, applies_when string, category string, kind string, paths array<string>, languages array<string>, bad_example string, good_example string, evidence {CITED}"

#: What answers requests (id, system, prompt, schema) with rows (id, text, error...).
Ask = Callable[[DataFrame], DataFrame]


class State:
    """The tables of one repository's rules."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def append(self, rows: list[tuple], name: str, schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def put(self, df: DataFrame, name: str, gen: int) -> None:
        """A generation's table, in place of one that was never sealed."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/gen={gen}")

    def generations(self) -> DataFrame:
        """The last row of each generation."""
        rank = F.struct(F.when(F.col("status") == "extracted", 1).otherwise(0).alias("s"), "attempts")
        return self.read("generations", GENERATION).groupBy("gen").agg(F.max_by(F.struct("status", "attempts", "chunks"), rank).alias("x")).select("gen", "x.*")

    def sealed(self, name: str, schema: str) -> DataFrame:
        """A table of all sealed generations, with ``gen``."""
        return self.read(name, f"{schema}, gen int").join(F.broadcast(self.generations().select("gen")), "gen", "left_semi")

    def folds(self) -> DataFrame:
        return self.read("folds", "version int, gens array<int>")

    def rules(self) -> DataFrame:
        """The rules of the newest version that was written to its end."""
        last = self.folds().agg(F.max("version")).first()[0]
        return self.spark.createDataFrame([], RULE) if last is None else self.spark.read.schema(RULE).parquet(f"{self.root}/rules/version={last}")


def open_generation(state: State, units: DataFrame, refs: DataFrame, tokens: int = digest.CHUNK_TOKENS) -> int | None:
    """The number of a new, sealed generation of the units whose content no generation has; None without any.

    ``units`` and ``refs`` as ``digest.units`` gives them.
    """
    changed = stored(ledger.dirty(units, state.sealed("prs", "pr long, hash string"), ["pr"]), "dirty")
    if changed.isEmpty():
        return None
    gen = (state.generations().agg(F.max("gen")).first()[0] or 0) + 1
    chunks = stored(digest.chunks(changed, tokens, f"g{gen:04d}-"), "chunks")
    state.put(chunks, "chunks", gen)
    state.put(refs.join(changed.select("pr"), "pr", "left_semi").select([c.split()[0] for c in REF.split(", ")]), "refs", gen)
    state.put(prompts.extract(chunks), "requests", gen)
    state.put(changed.select(F.col("pr").cast("long"), "hash"), "prs", gen)
    state.append([(gen, "submitted", 0, chunks.count())], "generations", GENERATION)
    return gen


def advance(state: State, ask: Ask) -> list[int]:
    """Ask for what sent generations lack; the numbers of those that are extracted now.  Refused requests are asked again by later runs, up to the last attempt."""
    done = []
    for g in state.generations().filter("status = 'submitted'").orderBy("gen").collect():
        mine = state.sealed("requests", "id string, system string, prompt string, schema string").filter(F.col("gen") == g["gen"])
        results = stored(ask(mine.drop("gen")), "results")
        one = state.spark.createDataFrame([(g["gen"], g["status"], g["attempts"])], "gen int, status string, attempts int")
        after = ledger.generation_status(one, mine.select("gen", "id"), results).first()["next_status"]
        if after == "extracted":
            kept, _ = synth.parse(mine.select("id"), results, state.sealed("refs", REF).filter(F.col("gen") == g["gen"]).drop("gen"))
            bare = F.transform("evidence", lambda e: e.dropFields("pos")).cast(CITED)
            state.put(kept.withColumn("evidence", bare).select([f.split()[0] for f in CANDIDATE.split(", ")]), "candidates", g["gen"])
            done.append(g["gen"])
        state.append([(g["gen"], after, g["attempts"] + 1, g["chunks"])], "generations", GENERATION)
    return done


def candidates(state: State) -> DataFrame:
    """Candidates with the evidence that still counts: that of each pull request's newest extracted generation."""
    extracted = state.generations().filter("status = 'extracted'").select("gen")
    every = state.sealed("candidates", CANDIDATE).join(F.broadcast(extracted), "gen", "left_semi")
    newest = state.sealed("prs", "pr long, hash string").join(F.broadcast(extracted), "gen", "left_semi")
    cited = every.select("gen", "id", F.posexplode("evidence").alias("_p", "e")).withColumn("pr", F.col("e.pr"))
    current = ledger.current_evidence(cited, newest, ["pr"]).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "e"))), lambda x: x["e"]).alias("evidence"))
    return every.drop("evidence").join(current, "id")


def _item() -> Column:
    own = {"members": F.array("id"), "opposing": F.array().cast("array<string>")}
    names = [*synth.TEXTS, *synth.LISTS, *own]
    return F.struct(*(own.get(c, F.col(c)).alias(c) for c in names))


def _answered(ask: Ask, build: Callable[[DataFrame], DataFrame], keep: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Groups to groups with the model's ``output``; a request without a good answer stops the fold, which a later run repeats."""

    def run(groups: DataFrame) -> DataFrame:
        asked = stored(build(groups), "asked")
        requests = asked.select("id", "system", "prompt", "schema")
        results = stored(ask(requests), "answers")
        lost = ledger.failures(requests, results).count()
        if lost:
            raise RuntimeError(f"{lost} requests failed; run again to repeat them")
        return asked.join(results.select("id", F.col("text").alias("output")), "id").select(*keep, "output")

    return run


def fold_pending(state: State, ask: Ask, now: Column, tokens: int = synth.GROUP_TOKENS) -> bool:
    """Fold extracted generations that no version has; whether there were any."""
    folded = state.folds().select(F.explode("gens").alias("gen"))
    gens = sorted(r["gen"] for r in state.generations().filter("status = 'extracted'").join(folded, "gen", "left_anti").collect())
    if not gens:
        return False
    current = stored(candidates(state), "candidates")
    new = current.filter(F.col("gen").isin(gens)).select("category", F.row_number().over(EV.Window.partitionBy("category").orderBy("id")).cast("long").alias("pos"), _item().alias("item"))
    old = state.rules()
    numbered = old.withColumn("no", F.row_number().over(EV.Window.partitionBy("category").orderBy("rule_id")))
    known = current.select("id")
    asked = numbered.select("category", "no", "rule_id", "members", "opposing", prompts.existing_line(F.col("no")).alias("line"))
    kept, made = synth.fold_into(asked, stored(new, "items"), _answered(ask, prompts.fold, ["category", "bin", "items", "n_rules"]), _answered(ask, prompts.merge, ["category", "bin", "items"]), known, tokens)
    texts = ["kind", "title", "statement", "rationale", "applies_when", "bad_example", "good_example", "paths", "languages"]
    stay = kept.drop("no").join(old.select("rule_id", *texts, "tier", "confidence", "tier_reason"), "rule_id")
    fresh = made.select("category", "item.*").withColumn("rule_id", F.concat_ws("-", "category", X.short_hash(F.array_join("members", ",")))).withColumns({"assigned": F.lit(True), "tier": F.lit("consider"), "confidence": F.lit(0.3), "tier_reason": F.lit("")})
    both = stored(stay.unionByName(fresh.select(stay.columns)), "rules")
    evidence = stored(EV.dedupe(EV.attach(both, current).withColumn("repo", F.lit("")), ["member_pos", "pos"]), "evidence")
    measured = EV.metrics(evidence, now)
    after = EV.signature(evidence)
    moved = synth.touched(old.select("rule_id", "signature"), after.join(both.select("rule_id", "assigned"), "rule_id")).withColumnRenamed("touched", "selected")
    # the measures have a number of opposing comments under the same name
    drafts = stored(both.withColumnRenamed("opposing", "opposing_ids").join(measured, "rule_id").join(after, "rule_id").join(moved, "rule_id"), "drafts")
    placed, requests = prompts.score(drafts)
    requests = stored(requests, "grades")
    answers = _answered(ask, lambda x: x, ["id"])(requests).select(F.col("id").alias("request"), F.col("output").alias("text"))
    scored = synth.apply_scores(placed, answers)
    version = (state.folds().agg(F.max("version")).first()[0] or 0) + 1
    columns = [f.split()[0] for f in RULE.split(", ")]
    scored.withColumn("opposing", F.col("opposing_ids")).select(columns).write.mode("overwrite").parquet(f"{state.root}/rules/version={version}")
    state.append([(version, gens)], "folds", "version int, gens array<int>")
    return True


def run(state: State, units: DataFrame, refs: DataFrame, ask: Ask, now: Column, tokens: int = digest.CHUNK_TOKENS) -> dict:
    """One run over the newest versions; what it did."""
    opened = open_generation(state, units, refs, tokens)
    extracted = advance(state, ask)
    return {"opened": opened, "extracted": extracted, "folded": fold_pending(state, ask, now)}


def asking(state: State, completer: C.Completer, model: str = "offline") -> Ask:
    """Requests answered one by one, with answers kept in the state."""
    return lambda requests: C.run_sync(requests, completer, f"{state.root}/results", model)


def asking_batches(state: State, batcher: C.Batcher, model: str = "offline", **limits) -> Ask:
    return lambda requests: C.run_batch(requests, batcher, f"{state.root}/results", model, **limits)
