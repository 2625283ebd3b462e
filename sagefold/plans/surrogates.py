"""Stand-ins for review data, built from the test tables.

The tables hold no pull requests, so each operator runs on a view of them whose
columns play the roles of real ones.  ``oracle`` has the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as EV
from ..vocabulary import CATEGORIES

NOW = "TIMESTAMP '2001-11-05 00:00:00'"
EVIDENCE_ORDER = ["pr", "author", "role", "date", "outcome", "thumbs_up", "repo"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Line items as comments on rules: (rule_id, part, side, pr, ref, url, author, role, date, outcome, thumbs_up, repo), each comment once."""
    t = lambda n: table(spark, d, n)
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    place = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "s_name", "r_name")
    df = li.join(t("orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    priority, line = F.col("o_orderpriority"), F.col("l_linenumber").cast("string")
    rows = df.select(
        F.concat_ws("-", F.col("l_partkey").cast("string"), line).alias("rule_id"),
        F.col("l_partkey").alias("part"),
        F.when(F.col("l_discount") >= 0.10, "opposing").otherwise("support").alias("side"),
        F.col("l_orderkey").alias("pr"),
        F.concat_ws(".", F.col("l_orderkey").cast("string"), line).alias("ref"),
        F.concat(F.lit("https://x/"), F.col("l_orderkey").cast("string"), F.lit("#"), line).alias("url"),
        F.when(F.col("l_linenumber") % 2 == 1, F.upper("s_name")).otherwise(F.col("s_name")).alias("author"),
        F.when(priority == "1-URGENT", "maintainer").when(priority == "4-NOT SPECIFIED", "pr-author").when(priority == "5-LOW", "bot").otherwise("contributor").alias("role"),
        F.col("l_shipdate").cast("timestamp").alias("date"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.06), "disputed").when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), "ignored").when(F.col("l_returnflag") == "A", "unclear").otherwise("accepted").alias("outcome"),
        (F.col("l_quantity").cast("int") % 6).alias("thumbs_up"),
        F.col("r_name").alias("repo"),
    )
    return EV.dedupe(rows, EVIDENCE_ORDER)


def rules(spark: SparkSession, d: str) -> DataFrame:
    """Parts with their metrics as graded rules: (rule_id, part, title, category, kind, tier, applies_when, confidence, metrics...)."""
    ev = evidence(spark, d)
    m = EV.metrics(ev, F.expr(NOW)).withColumn("part", F.regexp_extract("rule_id", "^([0-9]+)-", 1).cast("long"))
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    k = F.col("part") % 5
    return m.join(p, F.col("part") == F.col("p_partkey")).select(
        "rule_id",
        "part",
        F.col("p_name").alias("title"),
        F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("p_size") % 12 + 1).cast("int")).alias("category"),
        F.when(F.col("part") % 2 == 0, "do").otherwise("dont").alias("kind"),
        F.when(k == 0, "conditional").when(k == 1, "consider").when(k == 2, "rejected").otherwise("golden").alias("tier"),
        F.when(F.col("part") % 3 == 0, "").otherwise("it applies").alias("applies_when"),
        (F.pmod(F.col("part") * 7, F.lit(100)) / 100.0).alias("confidence"),
        *[c for c in m.columns if c not in ("rule_id", "part")],
    )


def graded(spark: SparkSession, d: str) -> DataFrame:
    """``rules`` after evidence floors: tier, confidence and the note."""
    r = rules(spark, d)
    tier, note = EV.apply_floors(F.col("tier"), F.col("applies_when"))
    r = r.withColumn("original", F.col("tier")).withColumn("_tier", tier).withColumn("note", note)
    return r.withColumn("tier", F.col("_tier")).withColumn("confidence", F.when(F.col("note") != "", F.least(F.lit(0.7), "confidence")).otherwise(F.col("confidence"))).drop("_tier")


def feed(spark: SparkSession, d: str) -> DataFrame:
    """Orders as fetched pull requests, some of them twice: (pr, state, updated_at, read_order, total)."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("pr"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), F.col("o_totalprice").alias("total"))
    first = o.withColumn("read_order", F.lit(1))
    later = o.filter("pr % 7 = 0").select("pr", F.lit("L").alias("state"), (F.col("updated_at") + F.expr("INTERVAL 1 DAY")).alias("updated_at"), "total", F.lit(2).alias("read_order"))
    same = o.filter("pr % 11 = 0 and pr % 7 <> 0").select("pr", F.lit("S").alias("state"), "updated_at", "total", F.lit(3).alias("read_order"))
    return first.unionByName(later).unionByName(same)


def generations(spark: SparkSession, d: str) -> DataFrame:
    """Events as extractions: (gen, pr, hash, value), a generation each three days, one row for each pull request in it."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    day = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lit(0)) / (86400 * 3)).cast("long")
    rows = e.select(day.alias("gen"), F.col("user_id").alias("pr"), "event_id", "event_type", "value")
    return rows.groupBy("gen", "pr").agg(F.max_by("event_type", "event_id").alias("kind"), F.count(F.lit(1)).alias("n")).select("gen", "pr", F.substring(F.sha2("kind", 256), 1, 16).alias("hash"), "n")


def talk(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as comments, classified: user is the author, assistant a maintainer, system a bot."""
    c = table(spark, d, "conversations")
    who = F.col("role")
    from ..operators import digest as D

    rows = c.select(
        F.col("conv_id").alias("pr"), F.lit("user").alias("pr_author"), F.lit(0).alias("section"), F.lit(0).alias("thread_idx"), F.col("turn").cast("int").alias("idx"), F.lit("https://x").alias("url"), F.col("text").alias("raw_body"),
        F.lit(None).cast("timestamp").alias("date"), who.alias("login"), F.when(who == "system", "Bot").otherwise("User").alias("kind"), F.when(who == "assistant", "MEMBER").otherwise("NONE").alias("association"), F.lit(0).alias("thumbs_up"),
        F.lit("a/b/c.py").alias("path"), F.lit(1).alias("line"), F.lit("").alias("hunk"), (F.col("conv_id") % 2 == 0).alias("resolved"), (F.col("conv_id") % 3 == 0).alias("outdated"), F.lit(None).cast("string").alias("review_state"),
    )
    return D.classify(rows)


#: Texts for the cleaning and noise paths, which the tables do not exercise.
BODIES = [
    "LGTM", "done", "Done.", "fixed, thanks!", "Good catch, fixed", "+1", "Thank you so much!!", "ok, will do", "small thing: compare kinds of failures here", "done, though is a log line missing now?",
    "A case for empty input is missing", "", "   ", "👍", "🎉🎉", "/retest", "/lgtm\n/approve", "/v2/orders has no version yet", "Could a lock do this?", "/assign @bob\n\n/hold",
    "<!-- template -->\r\nkeep this\r\n> quoted\n\n\n\nand that  \t\n", "a <!-- b\nc --> d", "  > only quoted", "line\n\n\n\n\nline", "xé", "1", "---",
    "See [this](x) and that", "\n\n  padded  \n\n", "thanks a lot ok", "okay okay", "fixed the leak in the pool",
]

#: Repository names in their accepted forms and others.
REPOS = [
    "owner/name", "https://host.example/owner/name", "https://host.example/owner/name.git", "host.example/owner/name/pull/12", "git@host.example:owner/name.git", "HTTPS://Host.Example/Owner/Name/",
    "", "name", "https://host.example/owner", "owner/na me", "git@host.example", "own.er/na_me-1", "a.b/c", "owner//name", "ssh://git@host.example/owner/name",
]
