"""Evidence analytics: the facts behind each rule, and the tier they allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..vocabulary import TIERS

RECENT = "INTERVAL 365 DAYS"


def evidence_key(url: Column, repo: Column, ref: Column) -> Column:
    """A comment's identity: its address, else repository and reference."""
    return F.when(F.coalesce(url, F.lit("")) != "", url).otherwise(F.concat_ws("#", F.coalesce(repo, F.lit("")), ref))


def dedupe(evidence: DataFrame, order: list[str]) -> DataFrame:
    """The first row, by ``order``, of each comment on each side of a rule."""
    first = Window.partitionBy("rule_id", "side", evidence_key(F.col("url"), F.col("repo"), F.col("ref"))).orderBy(*order)
    return evidence.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def attach(rules: DataFrame, candidates: DataFrame) -> DataFrame:
    """Evidence rows of rules: their members' evidence supports them, their opposing candidates' opposes.

    ``rules``: (rule_id, members, opposing); ``candidates``: (id, evidence array).
    The result has ``member_pos`` and ``pos``, the order for ``dedupe``.
    """
    sides = [rules.select("rule_id", F.lit(side).alias("side"), F.posexplode(ids).alias("member_pos", "cand_id")) for side, ids in (("support", "members"), ("opposing", "opposing"))]
    bridge = sides[0].unionByName(sides[1])
    met = bridge.join(candidates.select(F.col("id").alias("cand_id"), "evidence"), "cand_id")
    return met.select("rule_id", "side", "member_pos", F.posexplode("evidence").alias("pos", "e")).select("rule_id", "side", "member_pos", "pos", "e.*")


def metrics(evidence: DataFrame, now: Column) -> DataFrame:
    """The eleven measures of each rule with support, in one aggregation.

    ``evidence`` is deduplicated: (rule_id, side, pr, repo, author, role, date,
    outcome, thumbs_up, url, ref).
    """
    support, opposing = F.col("side") == "support", F.col("side") == "opposing"
    repo = F.coalesce("repo", F.lit(""))
    author = F.lower("author")
    own = F.col("role") == "pr-author"
    hits = lambda c: F.count(F.when(support & c, 1))
    reviewers = F.count_distinct(F.when(support & ~own, author))
    everyone = F.count_distinct(F.when(support, author))
    recent = hits(F.col("date").isNotNull() & (now - F.col("date") <= F.expr(RECENT)))
    out = evidence.groupBy("rule_id").agg(
        F.count_distinct(F.when(support, F.concat_ws("#", repo, F.col("pr").cast("string")))).alias("distinct_prs"),
        F.count_distinct(F.when(support & (repo != ""), repo)).alias("distinct_repos"),
        F.when(reviewers > 0, reviewers).otherwise(everyone).alias("distinct_reviewers"),
        F.coalesce(F.bool_or(F.when(support, (F.col("role") == "maintainer") & (F.col("outcome") != "disputed"))), F.lit(False)).alias("maintainer_endorsed"),
        *(hits(F.col("outcome") == o).alias(o) for o in ("accepted", "disputed", "ignored")),
        F.coalesce(F.sum(F.when(support, F.col("thumbs_up"))), F.lit(0)).cast("long").alias("thumbs_up"),
        F.min(F.when(support, F.col("date"))).alias("first_seen"),
        F.max(F.when(support, F.col("date"))).alias("last_seen"),
        F.coalesce(recent / F.nullif(hits(F.lit(True)), F.lit(0)), F.lit(0.0)).alias("recent_share"),
        F.count_distinct(F.when(opposing, evidence_key(F.col("url"), repo, F.col("ref")))).alias("opposing"),
        hits(F.lit(True)).alias("n_support"),
    )
    return out.filter("n_support > 0").drop("n_support")


def contested(disputed: Column, opposing: Column, accepted: Column) -> Column:
    against = disputed + opposing
    return (against > 0) & (against * 3 >= accepted)


def apply_floors(tier: Column, applies_when: Column, m: dict[str, Column] | None = None) -> tuple[Column, Column]:
    """(tier, note): the tier that the evidence can support, and why it is lower."""
    m = m or {c: F.col(c) for c in ("distinct_prs", "distinct_reviewers", "maintainer_endorsed", "disputed", "opposing", "accepted")}
    blank = X.trim_ws(F.coalesce(applies_when, F.lit(""))) == ""
    golden = tier == "golden"
    few = golden & (m["distinct_prs"] < 3)
    alone = golden & (m["distinct_reviewers"] < 2) & ~m["maintainer_endorsed"]
    disputed = golden & contested(m["disputed"], m["opposing"], m["accepted"])
    one = F.when(few | alone | disputed, "conditional").otherwise(tier)
    bare = (one == "conditional") & blank
    two = F.when(bare, "consider").otherwise(one)
    single = two.isin("golden", "conditional") & (m["distinct_prs"] <= 1) & ~m["maintainer_endorsed"]
    final = F.when(single, "consider").otherwise(two)
    why = F.concat_ws(
        "; ",
        F.when(few, F.concat(F.lit("only "), m["distinct_prs"].cast("string"), F.lit(" PR(s)"))),
        F.when(alone, "a single non-maintainer reviewer"),
        F.when(disputed, "contested"),
        F.when((tier == "conditional") & bare, "no applies_when condition"),
        F.when(single, "single PR without maintainer support"),
    )
    note = F.when(final == tier, "").otherwise(F.concat(F.lit("Downgraded from "), tier, F.lit(" by evidence floor: "), why, F.lit(".")))
    return final, note


def repo_floor(tier: Column, applies_when: Column, repos: Column) -> tuple[Column, Column, Column]:
    """(tier, applies_when, note) of a combined set: what one repository alone shows holds for that one."""
    lowered = (tier == "golden") & (F.size(repos) <= 1)
    blank = X.trim_ws(F.coalesce(applies_when, F.lit(""))) == ""
    condition = F.when(lowered & blank & (F.size(repos) == 1), F.concat(F.lit("In "), F.try_element_at(repos, F.lit(1)))).otherwise(applies_when)
    return F.when(lowered, "conditional").otherwise(tier), condition, F.when(lowered, "Downgraded from golden: seen in a single repository.").otherwise("")


def clamp(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0))))


def strength() -> Column:
    """A comment's weight as evidence."""
    outcome = F.when(F.col("outcome") == "accepted", 3).when(F.col("outcome") == "unclear", 1).otherwise(0)
    return F.when(F.col("role") == "maintainer", 4).otherwise(0) + outcome + F.least("thumbs_up", F.lit(3))


def top(evidence: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The ``n`` strongest supporting comments of each rule, with their rank; ``order`` breaks ties."""
    ranked = Window.partitionBy("rule_id").orderBy(F.desc("strength"), F.desc_nulls_last("date"), *order)
    return evidence.filter("side = 'support'").withColumn("strength", strength()).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= n)


def repos_of(evidence: DataFrame) -> DataFrame:
    return evidence.filter("side = 'support' and repo <> ''").groupBy("rule_id").agg(F.sort_array(F.collect_set("repo")).alias("repos"))


def signature(evidence: DataFrame) -> DataFrame:
    """(rule_id, signature): what scoring depends on; unchanged ones need no new score."""
    key = F.concat_ws("|", F.coalesce("url", F.lit("")), "outcome", "role")
    opposing = F.count_distinct(F.when(F.col("side") == "opposing", evidence_key(F.col("url"), F.col("repo"), F.col("ref"))))
    listed = F.array_join(F.sort_array(F.collect_list(F.when(F.col("side") == "support", key))), ",")
    return evidence.groupBy("rule_id").agg(F.concat(listed, F.lit("#opp="), opposing.cast("string")).alias("signature"))


def metrics_line() -> Column:
    """The measures in words."""
    against = F.col("disputed") + F.col("opposing")
    first, last = X.month(F.col("first_seen")), X.month(F.col("last_seen"))
    return F.concat_ws(
        " · ",
        X.plural(F.col("distinct_prs"), "PR"),
        X.plural(F.col("distinct_reviewers"), "reviewer"),
        F.when(F.col("distinct_repos") > 1, X.plural(F.col("distinct_repos"), "repo")),
        F.when(F.col("maintainer_endorsed"), "maintainer-endorsed"),
        F.when(F.col("accepted") > 0, F.concat(F.col("accepted").cast("string"), F.lit(" accepted"))),
        F.when(against > 0, F.concat(against.cast("string"), F.lit(" pushback"))),
        F.when(F.col("first_seen").isNotNull(), F.when(first == last, F.concat(F.lit("seen "), first)).otherwise(F.concat(F.lit("seen "), first, F.lit(" to "), last))),
    )


def tier_order(c: Column) -> Column:
    return X.rank_in(c, TIERS)
