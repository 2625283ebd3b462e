"""Model output as an untrusted table: parsed, checked, repaired and applied."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..schemas import EXTRACT_OUT, SCORE_OUT
from ..vocabulary import CATEGORIES, KINDS, OUTCOMES, TIERS
from ..workspace import ship, stored
from .evidence import apply_floors, clamp
from .packing import greedy_bins

GROUP_TOKENS, FOLD_LEAST, SCORE_GROUP = 120_000, 20_000, 150
LEVELS, STOP_SHARE = 5, 0.85
UNGRADED = ("consider", 0.3, "The scorer returned no grade for this rule.")


# ---- extraction -------------------------------------------------------------


def _parsed(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(request, chunk, ok, i, c): each candidate of each good result; one row with a null candidate for others."""
    met = requests.select(F.col("id").alias("request")).join(results.select(F.col("id").alias("request"), "text", "error"), "request", "left")
    output = F.from_json("text", EXTRACT_OUT)["candidates"]
    ok = F.col("text").isNotNull() & (F.coalesce("error", F.lit("")) == "") & output.isNotNull()
    rows = met.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("candidates", F.when(F.col("ok"), output))
    return rows.select("request", X.chunk_of(F.col("request")).alias("chunk"), "ok", F.posexplode_outer("candidates").alias("i", "c"))


def parse(requests: DataFrame, results: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates with their evidence, statistics).

    ``refs``: (ref, pr, url, author, role, date, body, thumbs_up) of the generation.
    Unknown references are dropped, quotes that are not in the comment give way to
    its beginning, unknown values to defaults, candidates without evidence go.
    """
    each = _parsed(requests, results)
    named = each.filter("c is not null").select(
        F.concat_ws(".", "chunk", (F.col("i") + 1).cast("string")).alias("id"),
        "chunk",
        *(X.trim_ws(F.coalesce(f"c.{c}", F.lit(""))).alias(c) for c in ("title", "statement", "rationale", "applies_when")),
        X.one_of(F.col("c.category"), CATEGORIES, "process").alias("category"),
        X.one_of(F.col("c.kind"), KINDS, "do").alias("kind"),
        X.non_empty(F.col("c.paths")).alias("paths"),
        X.non_empty(F.col("c.languages")).alias("languages"),
        F.coalesce("c.bad_example", F.lit("")).alias("bad_example"),
        F.coalesce("c.good_example", F.lit("")).alias("good_example"),
        F.col("c.evidence").alias("cited"),
    )
    cited = named.select("id", F.posexplode("cited").alias("pos", "e")).select("id", "pos", F.btrim(X.trim_ws(F.coalesce("e.ref", F.lit(""))), F.lit("[]")).alias("ref"), X.trim_ws(F.coalesce("e.quote", F.lit(""))).alias("quote"), F.col("e.outcome").alias("outcome"))
    met = cited.join(refs, "ref", "left")
    first = Window.partitionBy("id", "ref").orderBy("pos")
    known = met.filter("pr is not null").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    found = X.contains_quote(F.col("body"), F.col("quote"))
    fixed = known.withColumn("replaced", ~found).withColumn("quote", F.when(found, F.col("quote")).otherwise(X.clip(F.col("body"), X.QUOTE_CHARS))).withColumn("outcome", X.one_of(F.col("outcome"), OUTCOMES, "unclear"))
    evidence = fixed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "pr", "ref", "url", "author", "role", "date", "quote", "outcome", "thumbs_up"))).alias("evidence"), F.count_if("replaced").alias("replaced"))
    every = named.drop("cited").join(evidence, "id", "left")
    kept = every.filter("evidence is not null and statement <> ''").drop("replaced")
    asked = each.groupBy("request").agg(F.bool_or("ok").alias("ok"))
    one = lambda df, *c: df.agg(*c).withColumn("_j", F.lit(1))
    total = one(asked, F.count(F.lit(1)).alias("requests"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))
    complete = every.withColumn("_k", F.expr("evidence is not null and statement <> ''"))
    total = total.join(one(complete, F.count_if("_k").alias("candidates"), F.count_if(~F.col("_k")).alias("dropped"), F.coalesce(F.sum("replaced"), F.lit(0)).alias("quotes_replaced")), "_j")
    total = total.join(one(met, F.count_if(F.col("pr").isNull()).alias("unknown_refs")), "_j").drop("_j")
    return kept, total


#: Words within a quote by which texts are looked up, and quotes at most that have too few of them.
KEY_WORDS, MOST_SHORT = 4, 10_000


def quoted(documents: DataFrame, quotes: DataFrame, id_col: str, quote_id: str) -> DataFrame:
    """(id, quote id) of the texts that hold a quote, as ``contains_quote`` has it.

    A containment has no equal keys.  A quote's first and last word may be parts
    of longer ones in the text, those between them stand there as they are: the
    first four of them are a key, by which texts are looked up; the containment
    is checked on those.  Texts do not travel with their keys.  Quotes with fewer
    words within are looked for in every text; they must be few.
    """
    tidy = X.normalize(F.btrim(F.col("quote"), F.lit(X.QUOTE_EDGES)))
    q = quotes.select(quote_id, "quote", tidy.alias("_tidy")).filter(F.col("_tidy") != "").withColumn("_w", F.split("_tidy", " "))
    long = q.filter(F.size("_w") >= KEY_WORDS + 2).withColumn("_key", F.xxhash64(F.array_join(F.slice("_w", 2, KEY_WORDS), " ")))
    texts = documents.filter("text is not null").select(id_col, "text")
    words = texts.select(id_col, F.split(X.normalize(F.col("text")), " ").alias("_w")).filter(F.size("_w") >= KEY_WORDS)
    each = F.transform(F.sequence(F.lit(1), F.size("_w") - KEY_WORDS + 1), lambda k: F.xxhash64(F.array_join(F.slice("_w", k, F.lit(KEY_WORDS)), " ")))
    keys = words.select(id_col, F.explode(F.array_distinct(each)).alias("_key"))
    candidates = keys.join(long.select(quote_id, "_key"), "_key").select(id_col, quote_id).distinct()
    met = candidates.join(texts, id_col).join(long.select(quote_id, "quote"), quote_id).filter(X.contains_quote(F.col("text"), F.col("quote"))).select(id_col, quote_id)
    short = q.filter(F.size("_w") < KEY_WORDS + 2).select(quote_id, "_tidy")
    few = short.limit(MOST_SHORT + 1).collect()
    if len(few) > MOST_SHORT:
        raise ValueError(f"more than {MOST_SHORT} quotes of fewer than {KEY_WORDS + 2} words")
    if few:
        kind = short.schema[quote_id].dataType.simpleString()
        listed = F.array(*(F.struct(F.lit(r[0]).cast(kind).alias("i"), F.lit(r[1]).alias("t")) for r in few))
        body = texts.withColumn("_n", X.normalize(F.col("text")))
        found = body.select(id_col, F.explode(F.filter(listed, lambda x: F.contains(F.col("_n"), x["t"]))).alias("x")).select(id_col, F.col("x.i").alias(quote_id))
        met = met.unionByName(found)
    return met.distinct()


# ---- applying merges and folds ------------------------------------------------


def _local(prefix: str, value, n: int) -> int | None:
    found = re.match(rf"{prefix}\s*([+-]?\d+)", str(value or "").strip().strip("[]"))
    return int(found[1]) - 1 if found and 1 <= int(found[1]) <= n else None


#: Texts and lists of an item that a model's rule gives anew, by the model's names.
TEXTS = {"kind": "kind", "title": "title", "statement": "rule", "rationale": "rationale", "applies_when": "applies_when", "bad_example": "bad_example", "good_example": "good_example"}
LISTS = ("paths", "languages")
ITEM = f"struct<{','.join(f'{c}:string' for c in TEXTS)},{','.join(f'{c}:array<string>' for c in LISTS)},members:array<string>,opposing:array<string>>"


class Ownership:
    """Which of a group's items are taken; claims change it in the order in which they come."""

    def __init__(self, n: int, taken: set[int]):
        self.n, self.taken = n, taken

    def named(self, ids) -> list[int]:
        """The items that a model's ids name, as often as they do."""
        return [k for k in (_local("i", x, self.n) for x in ids or []) if k is not None]

    def claim(self, rule: dict) -> tuple[list[int], list[int]]:
        """(members, opponents) of a rule: nothing for one whose members all belong to others."""
        members = sorted(set(self.named(rule.get("members"))) - self.taken)
        against = [k for k in self.named(rule.get("opposing")) if k not in members] if members else []
        self.taken.update(members, against)
        return members, against

    def discard(self, ids) -> int:
        gone = set(self.named(ids)) - self.taken
        self.taken |= gone
        return len(gone)


def _merged(rule: dict, members: list[dict], against: list[dict]) -> dict:
    """A model's rule as an item, with all that stood behind its members and opponents."""
    texts = {own: str(rule.get(theirs) or "") for own, theirs in TEXTS.items()}
    lists = {c: [str(x) for x in rule.get(c) or []] for c in LISTS}
    support, opposing = (dict.fromkeys(chain.from_iterable(m[c] for m in members)) for c in ("members", "opposing"))
    opposing.update(dict.fromkeys(chain.from_iterable(x["members"] for x in against)))
    return {**texts, "applies_when": texts["applies_when"].strip(), **lists, "members": list(support), "opposing": list(opposing)}


def claim(items: list[dict], output: dict, used: list[bool]) -> tuple[list[dict], int, int]:
    """(new items, discarded, unassigned): one group's items after the model's rules.

    An item belongs to the first rule that claims it; a rule without members left
    is skipped, its opposing claims too; opposing claims do not look at earlier
    ones; what nothing claims stays as it is.  The order of claims matters, so this
    goes through a group in order; a group is one request, of bounded size.
    """
    state = Ownership(len(items), {k for k, u in enumerate(used) if u})
    rulings = [(rule, *state.claim(rule)) for rule in output.get("rules") or []]
    discarded = state.discard(output.get("discarded"))
    made = [_merged(rule, [items[k] for k in members], [items[k] for k in against]) for rule, members, against in rulings if members]
    used[:] = [k in state.taken for k in range(len(items))]
    left = [x for x, u in zip(items, used, strict=True) if not u]
    return made + left, discarded, len(left)


def _per_row(df: DataFrame, keep: list[str], take: list[str], schema: str, work: Callable[..., tuple]) -> DataFrame:
    """A Python function over rows, each of which is a request of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_type

    ship(df.sparkSession)
    add = T.StructType.fromDDL(schema)
    types = [to_arrow_type(f.dataType) for f in add.fields]
    source = df.select(*dict.fromkeys([*keep, *take]))

    def run(batches):
        for b in batches:
            made = [work(*row) for row in zip(*(b.column(c).to_pylist() for c in take), strict=True)]
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *columns], names=[*keep, *add.names])

    return source.mapInArrow(run, T.StructType([*(source.schema[c] for c in keep), *add.fields]))


def _json(text) -> dict:
    try:
        out = json.loads(text)
    except (TypeError, ValueError):
        return {}
    return out if isinstance(out, dict) else {}


def apply_merge(groups: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., items, discarded, unassigned) of (keep..., items array<ITEM>, output JSON)."""
    return _per_row(groups, keep, ["items", "output"], f"items array<{ITEM}>, discarded int, unassigned int", lambda items, output: claim(items or [], _json(output), [False] * len(items or [])))


def fold(items: list[dict], n_rules: int, output: dict) -> tuple[list[dict], list[dict], int, int, int]:
    """(assignments, new items, assigned, discarded, unassigned); an item's first valid assignment counts."""
    used, given = [False] * len(items), []
    for a in output.get("assignments") or []:
        k, r = _local("i", a.get("candidate"), len(items)), _local("R", a.get("rule"), n_rules)
        if k is None or used[k] or r is None:
            continue
        used[k] = True
        given.append({"rule": r + 1, "opposing": a.get("relation") == "opposing", "ids": items[k]["members"]})
    new, discarded, unassigned = claim(items, {"rules": output.get("new_rules"), "discarded": output.get("discarded")}, used)
    return given, new, len(given), discarded, unassigned


def apply_fold(groups: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., given, created, assigned, discarded, unassigned) of (keep..., items, n_rules, output)."""
    given = "array<struct<rule:int,opposing:boolean,ids:array<string>>>"
    return _per_row(groups, keep, ["items", "n_rules", "output"], f"given {given}, created array<{ITEM}>, assigned int, discarded int, unassigned int", lambda items, n, output: fold(items or [], n or 0, _json(output)))


def folded_rules(rules: DataFrame, applied: DataFrame, known_ids: DataFrame) -> DataFrame:
    """Rules with their new members, without candidates that vanished; ``assigned`` marks those that got one.

    ``rules``: (category, no, rule_id, members, opposing); ``applied``: of ``apply_fold`` by category and group.
    Rules without members left are dropped.
    """
    group = F.col("bin") if "bin" in applied.columns else F.lit(0)
    got = applied.select("category", group.alias("_b"), F.posexplode("given").alias("_i", "g")).select("category", F.col("g.rule").alias("no"), F.col("g.opposing").alias("against"), F.col("g.ids").alias("ids"), F.struct("_b", "_i").alias("_p"))
    lists = got.groupBy("category", "no").agg(*(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("_p", "ids")))), lambda x: x["ids"])).alias(c) for c, cond in (("more", ~F.col("against")), ("more_against", F.col("against")))))
    none = F.array().cast("array<string>")
    met = rules.join(lists, ["category", "no"], "left")
    side = lambda own, new, name: met.select("rule_id", F.posexplode(F.array_distinct(F.concat(own, F.coalesce(new, none)))).alias("_p", "id")).join(known_ids, "id", "left_semi").groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "id"))), lambda x: x["id"]).alias(name))
    members, opposing = side(F.col("members"), F.col("more"), "members"), side(F.col("opposing"), F.col("more_against"), "opposing")
    flags = met.select("category", "no", "rule_id", F.col("more").isNotNull().alias("assigned"))
    return flags.join(members, "rule_id").join(opposing, "rule_id", "left").withColumn("opposing", F.coalesce("opposing", none))


def touched(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rule_id, touched): new, assigned, or with another signature than before.

    ``before``: (rule_id, signature); ``after``: (rule_id, signature, assigned).
    """
    met = after.join(before.select("rule_id", F.col("signature").alias("_old")), "rule_id", "left")
    return met.select("rule_id", (F.col("_old").isNull() | F.coalesce("assigned", F.lit(False)) | (F.col("_old") != F.col("signature"))).alias("touched"))


def consolidate(items: DataFrame, complete: Callable[[DataFrame], DataFrame], tokens: int = GROUP_TOKENS) -> DataFrame:
    """Merge (category, pos, item) level by level until one group is left, or most items remain.

    ``complete`` turns (category, bin, items) into (category, bin, items, output); its
    answers are stored, so that a plan that runs again asks nothing again.  Each
    level is written as a table and read from there.
    """
    for _ in range(LEVELS):
        sized = items.withColumn("tokens", X.est_tokens(render_item()))
        packed = greedy_bins(sized, ["category"], ["pos"], {"tokens": tokens})
        grouped = stored(packed.groupBy("category", "bin").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("items")), "groups")
        alone = grouped.filter(F.size("items") == 1).select("category", "bin", "items")
        merged = apply_merge(complete(grouped.filter(F.size("items") > 1)), ["category", "bin"]).select("category", "bin", "items")
        made = alone.unionByName(merged).select("category", "bin", F.posexplode("items").alias("k", "item"))
        items = stored(made.select("category", (F.col("bin") * (1 << 20) + F.col("k")).alias("pos"), "item"), "level")
        facts = grouped.groupBy("category").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.size("items")).alias("before")).agg(F.max("groups").alias("groups"), F.sum("before").alias("before")).first()
        if (facts["groups"] or 0) <= 1 or items.count() >= STOP_SHARE * facts["before"]:
            break
    return items


def render_item(n: Column | None = None, item: Column | None = None) -> Column:
    """One line of a prompt for an item, the column ``item`` unless given."""
    item = F.col("item") if item is None else item
    i = lambda c: item[c]
    when = F.when(F.coalesce(i("applies_when"), F.lit("")) != "", F.concat(F.lit("when: "), X.one_line(i("applies_when"))))
    head = F.concat(F.lit("[i"), (n if n is not None else F.lit(0)).cast("string"), F.lit("] ("), F.coalesce(i("kind"), F.lit("")), F.lit(") "), X.one_line(F.coalesce(i("title"), F.lit(""))), F.lit(": "), X.one_line(F.coalesce(i("statement"), F.lit(""))))
    return F.concat(F.concat_ws(" | ", head, when, F.concat(F.lit("refs: "), F.size(i("members")).cast("string"))), F.lit("\n"))


def fold_into(rules: DataFrame, items: DataFrame, ask_fold: Callable[[DataFrame], DataFrame], ask_merge: Callable[[DataFrame], DataFrame], known_ids: DataFrame, tokens: int = GROUP_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(rules with their new members, new items): findings go to existing rules by category, the rest become rules.

    ``rules``: (category, no, rule_id, members, opposing, line); ``items``: (category,
    pos, item).  A group of findings has what the existing rules leave of
    ``tokens``, FOLD_LEAST at least.  Categories without rules are merged.  Rules
    whose candidates are all gone are dropped.
    """
    listed = rules.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "").alias("existing"), F.count(F.lit(1)).cast("int").alias("n_rules"))
    listed = stored(listed.withColumn("most", F.greatest(F.lit(tokens) - X.est_tokens(F.col("existing")), F.lit(FOLD_LEAST))), "existing")
    sized = items.join(listed.select("category", "most"), "category").withColumn("tokens", X.est_tokens(render_item()))
    packed = greedy_bins(sized, ["category"], ["pos"], {"tokens": "most"})
    grouped = packed.groupBy("category", "bin").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("items"))
    groups = stored(grouped.join(listed.drop("most"), "category"), "fold-groups")
    applied = stored(apply_fold(ask_fold(groups), ["category", "bin"]), "folded")
    made = applied.select("category", (F.col("bin") * (1 << 20)).alias("_b"), F.posexplode("created").alias("k", "item")).select("category", (F.col("_b") + F.col("k")).alias("pos"), "item")
    bare = items.join(listed.select("category"), "category", "left_anti").select("category", "pos", "item")
    made = made.unionByName(consolidate(bare, ask_merge, tokens)) if not bare.isEmpty() else made
    return folded_rules(rules, applied, known_ids), made


# ---- scoring --------------------------------------------------------------------


def apply_scores(drafts: DataFrame, outputs: DataFrame) -> DataFrame:
    """Drafts with the grades they were given, defaults for those without, and evidence floors for all.

    ``drafts``: (rule_id, request, no, applies_when, tier, confidence, tier_reason, selected, metrics...);
    ``outputs``: (request, text).  The last score of a rule counts, and its last condition that is not blank.
    """
    listed = outputs.select("request", F.posexplode(F.from_json("text", SCORE_OUT)["scores"]).alias("pos", "s"))
    bare = F.btrim(F.coalesce("s.id", F.lit("")), F.lit("[] "))
    scored = listed.withColumn("no", F.regexp_extract(bare, r"^r\s*([+-]?\d+)", 1).try_cast("int")).filter("no is not null")
    condition = X.trim_ws(F.coalesce("s.applies_when", F.lit("")))
    last = scored.groupBy("request", "no").agg(F.max_by("s", "pos").alias("s"), F.max_by(condition, F.when(condition != "", F.col("pos"))).alias("_when"), F.count_if(condition != "").alias("_n"))
    met = drafts.join(last, ["request", "no"], "left")
    graded = F.col("s").isNotNull()
    use = F.col("selected") & graded
    met = met.withColumn("tier", F.when(use, F.col("s.tier")).otherwise(F.col("tier"))).withColumn("confidence", F.when(use, clamp(F.col("s.confidence"))).otherwise(F.col("confidence"))).withColumn("tier_reason", F.when(use, X.trim_ws(F.coalesce("s.tier_reason", F.lit("")))).otherwise(F.col("tier_reason"))).withColumn("applies_when", F.when(use & (F.coalesce("_n", F.lit(0)) > 0), F.col("_when")).otherwise(F.col("applies_when")))
    lost = F.col("selected") & (~graded | ~F.coalesce(F.col("tier").isin(TIERS), F.lit(False)))
    met = met.withColumn("_lost", lost)
    for c, v in zip(("tier", "confidence", "tier_reason"), UNGRADED, strict=True):
        met = met.withColumn(c, F.when(F.col("_lost"), F.lit(v)).otherwise(F.col(c)))
    tier, note = apply_floors(F.col("tier"), F.col("applies_when"))
    met = met.withColumn("_tier", tier).withColumn("_note", note)
    lowered = F.col("_note") != ""
    met = met.withColumn("confidence", F.when(lowered, F.least("confidence", F.lit(0.7))).otherwise(F.col("confidence"))).withColumn("tier_reason", F.when(lowered, X.trim_ws(F.concat_ws(" ", "tier_reason", "_note"))).otherwise(F.col("tier_reason"))).withColumn("tier", F.col("_tier"))
    return met.drop("s", "_when", "_n", "_lost", "_tier", "_note")
