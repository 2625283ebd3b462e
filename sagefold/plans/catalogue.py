"""The queries, one for each family of operators, over the surrogate views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import cost, digest, ledger, packing, report, synth
from ..operators import evidence as EV
from ..vocabulary import TIERS
from . import surrogates as S

Q = DataFrame
METRICS = ["distinct_prs", "distinct_repos", "distinct_reviewers", "maintainer_endorsed", "accepted", "disputed", "ignored", "thumbs_up", "first_seen", "last_seen", "recent_share", "opposing"]


def evidence_metrics(spark: SparkSession, d: str) -> Q:
    return EV.metrics(S.evidence(spark, d), F.expr(S.NOW)).select("rule_id", *METRICS)


def tier_floors(spark: SparkSession, d: str) -> Q:
    return S.graded(spark, d).select("rule_id", "original", "tier", "confidence", "note")


def repo_floor_combined(spark: SparkSession, d: str) -> Q:
    repos = EV.repos_of(S.evidence(spark, d))
    met = S.rules(spark, d).filter("tier <> 'rejected'").join(repos, "rule_id")
    tier, when, note = EV.repo_floor(F.col("tier"), F.col("applies_when"), F.col("repos"))
    return met.select("rule_id", tier.alias("tier"), when.alias("applies_when"), note.alias("note"), F.array_join("repos", ",").alias("repos"))


def top_evidence(spark: SparkSession, d: str) -> Q:
    return EV.top(S.evidence(spark, d), 5, ["url"]).select("rule_id", "rank", "strength", "url", "date")


def finalize_rules(spark: SparkSession, d: str) -> Q:
    return report.finalize(S.graded(spark, d), position="rule_id").select("rank", "id", "rule_id", "tier", "confidence", "distinct_prs")


def tier_tally(spark: SparkSession, d: str) -> Q:
    return report.tally(S.graded(spark, d))


def report_violations(spark: SparkSession, d: str) -> Q:
    k = F.col("part")
    found = F.array(F.struct(F.when(k % 31 == 0, "").otherwise("https://x").alias("url"), F.when(k % 37 == 0, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("pr"), F.col("rule_id").alias("ref")))
    broken = S.graded(spark, d).select(
        F.when(k % 41 == 0, "same").otherwise(F.col("rule_id")).alias("id"),
        F.when(k % 13 == 0, " ").otherwise(F.col("title")).alias("title"),
        F.lit("rule").alias("rule"),
        F.when(k % 17 == 0, "other").otherwise(F.col("category")).alias("category"),
        "kind",
        F.when(k % 19 == 0, "best").otherwise(F.col("tier")).alias("tier"),
        (F.col("confidence") + F.when(k % 23 == 0, 1.5).otherwise(0.0)).alias("confidence"),
        F.when(k % 29 == 0, "").otherwise(F.col("applies_when")).alias("applies_when"),
        F.when(k % 43 == 0, F.array().cast("array<struct<url:string,pr:bigint,ref:string>>")).otherwise(found).alias("evidence"),
    )
    return report.violations(broken).groupBy("id", "problem").agg(F.count(F.lit(1)).alias("n"))


def _exported(spark: SparkSession, d: str) -> Q:
    named = S.graded(spark, d).withColumn("id", F.col("rule_id"))
    k = F.col("part")
    globs = F.when(k % 4 == 0, F.array(F.lit("src/*.py"), F.concat(F.lit("lib/"), (k % 5).cast("string")))).when(k % 4 == 1, F.array(F.lit("docs/"), F.lit("docs/"))).otherwise(F.array().cast("array<string>"))
    return report.export_rules(named.withColumn("paths", globs))


def export_filter_sort(spark: SparkSession, d: str) -> Q:
    return _exported(spark, d).select("rank", "id", "tier", "category")


def export_sections(spark: SparkSession, d: str) -> Q:
    x = _exported(spark, d)
    own = report.sections(x).select(F.concat_ws("/", "tier", "category").alias("name"), F.array_join("ids", ",").alias("ids"))
    files = report.rule_files(x).select(F.col("file").alias("name"), F.array_join("ids", ",").alias("ids"))
    return own.unionByName(files)


def rule_signature(spark: SparkSession, d: str) -> Q:
    return EV.signature(S.evidence(spark, d))


def latest_pr_versions(spark: SparkSession, d: str) -> Q:
    return digest.latest(S.feed(spark, d), ["pr"], "updated_at").select("pr", "state", "updated_at", "read_order")


def incremental_refresh(spark: SparkSession, d: str) -> Q:
    """What a refresh reads again and anew after one up to the end of 1997, with the mark before and after."""
    feed = S.feed(spark, d)
    seen = feed.filter("updated_at < TIMESTAMP '1998-01-01 00:00:00'")
    before = ledger.watermark(seen).withColumnRenamed("watermark", "before")
    after = ledger.watermark(feed).withColumnRenamed("watermark", "after")
    met = ledger.refresh(feed.join(F.broadcast(before.join(after))), F.col("before"))
    return met.select("pr", "state", "updated_at", "read_order", "before", "after")


def dirty_units(spark: SparkSession, d: str) -> Q:
    """Documents, a third of which the ledger has and a sixth with other content."""
    docs = S.table(spark, d, "documents")
    body = F.coalesce("text", F.lit(""))
    units = docs.select(F.col("doc_id").alias("pr"), F.col("source").alias("repo"), X.short_hash(F.concat(F.col("doc_id").cast("string"), F.lit("\n"), body)).alias("hash"))
    known = docs.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("pr"), F.col("source").alias("repo"), X.short_hash(F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, F.concat(body, F.lit("!"))).otherwise(body))).alias("hash"))
    return ledger.dirty(units, known, ["pr", "repo"])


def latest_generation_evidence(spark: SparkSession, d: str) -> Q:
    g = S.generations(spark, d)
    return ledger.current_evidence(g, g, ["pr"]).select("gen", "pr", "hash", "n")


def unfolded_candidates(spark: SparkSession, d: str) -> Q:
    g = S.generations(spark, d)
    return ledger.unfolded(g, g.filter("gen % 2 = 0")).groupBy("gen").agg(F.count(F.lit(1)).alias("n"))


def _bodies(spark: SparkSession) -> Q:
    return spark.createDataFrame([(-k - 1, b) for k, b in enumerate(S.BODIES)], "id long, body string")


def _texts(spark: SparkSession, d: str) -> Q:
    return S.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("body")).unionByName(_bodies(spark))


def clean_body(spark: SparkSession, d: str) -> Q:
    return _texts(spark, d).select("id", X.clean_body(F.col("body")).alias("body"))


def noise_filter(spark: SparkSession, d: str) -> Q:
    c = _texts(spark, d).select("id", X.clean_body(F.col("body")).alias("body"))
    return c.select("id", X.is_ack(F.col("body")).alias("ack"), X.is_command_block(F.col("body")).alias("commands"), X.is_noise(F.col("body")).alias("noise"))


def role_classification(spark: SparkSession, d: str) -> Q:
    """Customers as accounts, orders as pull requests."""
    c = S.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, F.lit("Stale")).when(F.col("c_custkey") % 10 == 0, F.concat("c_name", F.lit("-bot"))).otherwise(F.col("c_name")).alias("login"), "c_mktsegment")
    o = S.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    met = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    kind = F.when(F.col("c_mktsegment") == "MACHINERY", "Bot").otherwise("User")
    association = F.when(F.col("c_mktsegment") == "BUILDING", "OWNER").when(F.col("c_mktsegment") == "AUTOMOBILE", "MEMBER").otherwise("NONE")
    author = F.when(F.col("o_orderkey") % 6 == 0, F.upper("login")).otherwise("someone")
    state = X.pr_state(F.col("o_orderstatus") == "F", F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CLOSED"))
    return met.select("o_orderkey", X.role(F.col("login"), kind, association, author).alias("role"), state.alias("state"))


def thread_outcomes(spark: SparkSession, d: str) -> Q:
    t = S.talk(spark, d)
    facts = t.groupBy("pr").agg(F.bool_or("resolved").alias("r"), F.bool_or("outdated").alias("o"), F.bool_or("ack").alias("a"), F.count_if("kept").alias("comments"))
    return facts.filter("comments > 0").select("pr", X.thread_outcome(F.col("r"), F.col("o"), F.col("a") | (F.col("pr") % 5 == 0)).alias("outcome"), "comments")


def comment_refs(spark: SparkSession, d: str) -> Q:
    numbered = digest.number_refs(S.talk(spark, d))
    return numbered.join(digest.external(numbered), "pr", "left_semi").select("pr", "idx", "ref", "role")


def digest_stats(spark: SparkSession, d: str) -> Q:
    t = S.talk(spark, d)
    return digest.stats(t.select("pr").distinct(), t)


def path_areas(spark: SparkSession, d: str) -> Q:
    """Nations' names as folders of parts."""
    p = S.table(spark, d, "part").select("p_partkey", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("b"), F.replace("p_type", F.lit(" "), F.lit("/")).alias("t"))
    files = F.array(F.concat_ws("/", "b", "t", F.lit("x.go")), F.lit("README"), F.concat_ws("/", "b", F.lit("y.go")), F.concat_ws("/", "t", F.lit("z.go")), F.concat_ws("/", "b", "t", F.lit("w.go")))
    return p.select("p_partkey", F.array_join(X.areas(files), ",").alias("areas"))


def token_estimate(spark: SparkSession, d: str) -> Q:
    b = F.coalesce("text", F.lit(""))
    return S.table(spark, d, "documents").select("doc_id", X.est_tokens(b).alias("tokens"), F.length(X.truncate(b, X.BODY_CHARS)).alias("body_chars"), F.md5(X.truncate(b, X.BODY_CHARS)).alias("body_md5"), F.md5(X.clip(b, X.QUOTE_CHARS)).alias("quote_md5"))


def _sized(spark: SparkSession, d: str) -> Q:
    return S.table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("repo"), X.est_tokens(F.coalesce("text", F.lit(""))).cast("long").alias("tokens"))


def pack_chunks(spark: SparkSession, d: str) -> Q:
    binned = packing.greedy_bins(_sized(spark, d), ["repo"], ["doc_id"], {"tokens": 4000})
    return binned.groupBy("repo", "bin").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("parts"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def split_parts(spark: SparkSession, d: str) -> Q:
    """Conversations as pull requests whose turns are blocks."""
    c = S.table(spark, d, "conversations").select(F.col("conv_id").alias("pr"), F.col("turn").cast("long").alias("turn"), X.est_tokens(F.coalesce("text", F.lit(""))).cast("long").alias("tokens"))
    return packing.greedy_bins(c, ["pr"], ["turn"], {"tokens": 60}, "part").select("pr", "turn", "tokens", "part")


def group_items(spark: SparkSession, d: str) -> Q:
    """Bins by two limits at once, and groups of a fixed number."""
    p = S.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("category"), F.octet_length("p_name").cast("long").alias("size"), F.lit(1).cast("long").alias("one"))
    binned = packing.greedy_bins(p, ["category"], ["k"], {"one": 7, "size": 120})
    pos = F.row_number().over(Window.partitionBy("category").orderBy("k"))
    return binned.withColumn("fixed", packing.fixed_groups(pos, 150)).select("k", "category", "bin", "fixed")


def request_ids(spark: SparkSession, d: str) -> Q:
    p = S.table(spark, d, "part")
    chunk = F.concat(F.lit("g0001-chunk-"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"))
    rid = X.request_id(chunk, F.col("p_name"))
    return p.select("p_partkey", rid.alias("request"), X.chunk_of(rid).alias("chunk"), X.chunk_of(F.col("p_brand")).alias("bare"))


def _requests(spark: SparkSession, d: str) -> tuple[Q, Q, Q]:
    r = S.table(spark, d, "orders").select(X.request_id(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.col("o_orderpriority")).alias("id"), F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 50).alias("gen"))
    results = r.filter("k % 3 <> 0").select("id", F.when(F.col("k") % 5 == 0, "timeout").otherwise("").alias("error"))
    return r, results, r.filter("k % 7 = 0").select("id")


def unsent_requests(spark: SparkSession, d: str) -> Q:
    r, results, flying = _requests(spark, d)
    todo = ledger.unsent(r, results, flying).select("id", F.lit("unsent").alias("state"))
    return todo.unionByName(ledger.failures(r, results).select("id", F.col("error").alias("state")))


def _extraction(spark: SparkSession, d: str) -> tuple[Q, Q, Q]:
    """Orders as requests; their lines as comments, cited well and badly."""
    ev = S.evidence(spark, d)
    refs = ev.withColumn("_n", F.row_number().over(Window.partitionBy("ref").orderBy("rule_id", *S.EVIDENCE_ORDER))).filter("_n = 1")
    body = F.concat(F.lit("Please  keep "), F.col("author"), F.lit(" in\n"), F.col("repo"), F.lit(" as it is"))
    refs = refs.select("ref", "pr", "url", "author", "role", "date", body.alias("body"), "thumbs_up")
    cite = F.struct(
        F.when(F.col("pr") % 10 == 3, F.concat(F.lit("?"), F.col("ref"))).otherwise(F.concat(F.lit(" ["), F.col("ref"), F.lit("] "))).alias("ref"),
        F.when(F.col("pr") % 4 == 1, "invented words").otherwise(F.concat(F.lit('"KEEP '), F.col("author"), F.lit(' in"'))).alias("quote"),
        F.when(F.col("pr") % 6 == 0, "great").otherwise("accepted").alias("outcome"),
    )
    listed = refs.groupBy("pr").agg(F.transform(F.array_sort(F.collect_list(F.struct("ref", cite.alias("c")))), lambda x: x["c"]).alias("evidence"))
    candidate = F.struct(
        F.concat(F.lit(" title "), F.col("pr").cast("string")).alias("title"),
        F.when(F.col("pr") % 9 == 0, "  ").otherwise("statement").alias("statement"),
        F.when(F.col("pr") % 2 == 0, "style").otherwise("colour").alias("category"),
        F.lit("prefer").alias("kind"),
        F.array(F.lit(" a/ "), F.lit("")).alias("paths"),
        F.concat("evidence", F.slice("evidence", 1, 1)).alias("evidence"),
    )
    rid = F.concat(F.lit("c"), F.col("pr").cast("string"), F.lit("-0123456789"))
    requests = listed.select(rid.alias("id"), "pr", candidate.alias("c"))
    text = F.when(F.col("pr") % 13 == 0, "{not json").otherwise(F.to_json(F.struct(F.array("c").alias("candidates"))))
    results = requests.filter("pr % 17 <> 0").select("id", text.alias("text"), F.when(F.col("pr") % 19 == 0, "refused").otherwise("").alias("error"))
    return requests.select("id"), results, refs


def extract_parse(spark: SparkSession, d: str) -> Q:
    kept, total = synth.parse(*_extraction(spark, d))
    rows = kept.select("id", "title", "category", "kind", F.array_join("paths", ",").alias("paths"), F.explode("evidence").alias("e")).select("id", "title", "category", "kind", "paths", F.col("e.ref").alias("ref"), F.col("e.quote").alias("quote"), F.col("e.outcome").alias("outcome"))
    facts = [c for c in total.columns]
    one = total.select(F.explode(F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in facts))).alias("x"))
    none = F.lit(None).cast("string")
    return rows.unionByName(one.select(F.concat(F.lit("#"), F.col("x.k")).alias("id"), F.col("x.v").cast("string").alias("title"), *(none.alias(c) for c in ("category", "kind", "paths", "ref", "quote", "outcome"))))


def quote_verification(spark: SparkSession, d: str) -> Q:
    """Benchmark passages as quotes of documents."""
    quotes = S.table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    documents = S.table(spark, d, "documents").select("doc_id", "text")
    return synth.quoted(documents, quotes, "doc_id", "item_id")


def _merge_groups(spark: SparkSession, d: str) -> Q:
    """Brands as groups: the parts are items, rule j takes those with p_size % 4 = j and, in vain, those of the rule before."""
    p = S.table(spark, d, "part").select("p_brand", "p_partkey", "p_size", "p_name")
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    p = p.withColumn("n", n).withColumn("i", F.concat(F.lit("[i"), n.cast("string"), F.lit("]")))
    none = F.array().cast("array<string>")
    item = F.struct(
        F.lit("do").alias("kind"), F.col("p_name").alias("title"), F.lit("s").alias("statement"), F.lit("own reason").alias("rationale"), F.lit("").alias("applies_when"), F.lit("").alias("bad_example"), F.lit("").alias("good_example"),
        none.alias("paths"), none.alias("languages"), F.array(F.concat(F.lit("c"), F.col("p_partkey").cast("string"))).alias("members"), none.alias("opposing"),
    )
    ids = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("n", "i")))), lambda x: x["i"])
    rules = [F.struct(F.lit(f"rule {j}").alias("title"), F.lit("do").alias("kind"), F.lit("text").alias("rule"), F.lit(f"reason {j}").alias("rationale"), F.lit("worse").alias("bad_example"), F.lit("better").alias("good_example"), F.array(F.lit(f"src/{j}/"), F.lit("lib/")).alias("paths"), F.array(F.lit("go")).alias("languages"), ids((F.col("p_size") % 8 == j) | (F.col("p_size") % 8 == j - 1)).alias("members"), ids(F.col("p_size") % 8 == 6 + j).alias("opposing")) for j in range(2)]
    lost = F.array(F.concat(F.lit("i"), F.max("n").cast("string"), F.lit("x")), F.lit("i0"), F.lit("nothing"))
    return p.groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("item")))), lambda x: x["item"]).alias("items"), F.to_json(F.struct(F.array(*rules).alias("rules"), lost.alias("discarded"))).alias("output"))


def merge_apply(spark: SparkSession, d: str) -> Q:
    applied = synth.apply_merge(_merge_groups(spark, d), ["p_brand"])
    e = applied.select("p_brand", "discarded", "unassigned", F.posexplode("items").alias("pos", "x"))
    return e.select("p_brand", F.col("x.title").alias("title"), F.size("x.members").alias("n_members"), F.array_join(F.array_sort("x.members"), ",").alias("members"), F.array_join(F.array_sort("x.opposing"), ",").alias("opposing"), F.col("x.rationale").alias("rationale"), F.concat_ws("/", "x.bad_example", "x.good_example").alias("examples"), F.array_join("x.paths", ",").alias("paths"), F.array_join("x.languages", ",").alias("languages"), "discarded", "unassigned")


def fold_apply(spark: SparkSession, d: str) -> Q:
    """Brands as groups: each part may go to rule p_size % 5, where rules 1 to 3 exist; first valid assignment counts."""
    g = _merge_groups(spark, d).select("p_brand", "items")
    p = S.table(spark, d, "part").select("p_brand", "p_partkey", "p_size").withColumn("n", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    a = lambda rule: F.struct(F.concat(F.lit("i"), F.col("n").cast("string")).alias("candidate"), rule.alias("rule"), F.when(F.col("p_size") % 6 == 0, "opposing").otherwise("supporting").alias("relation"))
    both = F.array(a(F.concat(F.lit("R"), (F.col("p_size") % 5).cast("string"))), a(F.lit("[R2]")))
    out = p.groupBy("p_brand").agg(F.to_json(F.struct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", both.alias("b")))), lambda x: x["b"])).alias("assignments"))).alias("output"))
    applied = synth.apply_fold(g.join(out, "p_brand").withColumn("n_rules", F.lit(3)), ["p_brand"])
    given = applied.select("p_brand", F.explode("given").alias("g")).select("p_brand", F.col("g.rule").cast("int").alias("rule"), F.col("g.opposing").alias("opposing"), F.explode("g.ids").alias("id"))
    return given


def score_apply(spark: SparkSession, d: str) -> Q:
    """Rules graded through model output: numbers in groups of 150, some graded twice, some not at all."""
    r = S.rules(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("category").orderBy("rule_id")))
    r = r.withColumn("request", F.concat_ws("-", "category", packing.fixed_groups(F.col("pos"), synth.SCORE_GROUP).cast("string"))).withColumn("no", ((F.col("pos") - 1) % synth.SCORE_GROUP + 1).cast("int"))
    s = lambda tier, confidence, when: F.struct(F.concat(F.lit("[r"), F.col("no").cast("string"), F.lit("]")).alias("id"), tier.alias("tier"), confidence.alias("confidence"), F.lit(" because ").alias("tier_reason"), when.alias("applies_when"))
    first = s(F.lit("golden"), F.lit(1.4), F.lit("in one case"))
    second = s(F.when(F.col("part") % 7 == 0, F.lit("best")).otherwise(F.col("tier")), F.col("confidence"), F.lit(" "))
    scores = F.when(F.col("part") % 6 == 0, F.array(first)).when(F.col("part") % 11 == 0, F.array().cast("array<struct<id:string,tier:string,confidence:double,tier_reason:string,applies_when:string>>")).otherwise(F.array(first, second))
    outputs = r.groupBy("request").agg(F.to_json(F.struct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", scores.alias("s")))), lambda x: x["s"])).alias("scores"))).alias("text"))
    drafts = r.withColumn("selected", F.col("part") % 10 != 9).withColumn("tier_reason", F.lit("old"))
    return synth.apply_scores(drafts, outputs).select("rule_id", "tier", "confidence", "applies_when", "tier_reason")


PRICES = [("large", 4.0, 20.0), ("small", 1.0, 5.0)]


def cost_estimate(spark: SparkSession, d: str) -> Q:
    docs = S.table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("repo"), F.when(F.col("doc_id") % 5 == 0, "unknown").when(F.col("doc_id") % 2 == 0, "large").otherwise("small").alias("model"), F.coalesce("text", F.lit("")).alias("text"))
    prices = spark.createDataFrame(PRICES, "model string, input_price double, output_price double")
    each = cost.estimate(docs, prices, ["repo"], ratio=1.25)
    every = cost.total(each, ["model"]).withColumn("repo", F.lit("*"))
    columns = ["repo", "model", "requests", "input_tokens", "output_tokens", "known_price"]
    money = [F.round(c, 6).alias(c) for c in ("extract_usd", "synth_usd", "total_usd")]
    return cost.allowed(each.unionByName(every.select(each.columns)), 0.5).select(*columns, *money, "approved")


def generation_status(spark: SparkSession, d: str) -> Q:
    r, results, _ = _requests(spark, d)
    gens = r.select("gen").distinct().select("gen", F.when(F.col("gen") % 4 == 0, "open").when(F.col("gen") % 4 == 1, "extracted").otherwise("submitted").alias("status"), (F.col("gen") % 3).alias("attempts"))
    return ledger.generation_status(gens, r.select("gen", "id"), results)


def repo_url_parse(spark: SparkSession, d: str) -> Q:
    some = spark.createDataFrame([(-k - 1, u) for k, u in enumerate(S.REPOS)], "id long, url string")
    every = S.table(spark, d, "pages").select(F.col("page_id").alias("id"), "url").unionByName(some)
    p = X.parse_repo(F.col("url"))
    return every.withColumn("p", p).select("id", F.col("p.host").alias("host"), F.col("p.owner").alias("owner"), F.col("p.name").alias("name"), F.lower(F.concat_ws("/", "p.host", "p.owner", "p.name")).alias("key"))


def render_lines(spark: SparkSession, d: str) -> Q:
    ev = S.evidence(spark, d).withColumn("body", F.concat(F.lit("a <pr x></Thread> "), F.col("author")))
    lines = ev.select("rule_id", "side", "url", digest.comment_line().alias("line"))
    m = S.rules(spark, d).select("rule_id", F.lit("rule").alias("side"), F.col("title").alias("url"), EV.metrics_line().alias("line"))
    return lines.unionByName(m)


def prompt_pr_counts(spark: SparkSession, d: str) -> Q:
    """Distinct numbers of pull requests behind an item, repositories apart or not."""
    ev = S.evidence(spark, d).filter("side = 'support'")
    return ev.groupBy((F.col("part") % 97).alias("item")).agg(F.count_distinct("pr").alias("prs"), F.count_distinct("repo", "pr").alias("repo_prs"))


def combined_stats(spark: SparkSession, d: str) -> Q:
    ev = S.evidence(spark, d)
    by = ev.groupBy("repo").agg(F.count_distinct("pr").alias("prs"), F.count_if(F.col("side") == "support").alias("support"), F.count_if(F.col("side") == "opposing").alias("opposing"))
    return by.unionByName(by.agg(*(F.sum(c).alias(c) for c in ("prs", "support", "opposing"))).withColumn("repo", F.lit("*")).select(by.columns))


def scalar_helpers(spark: SparkSession, d: str) -> Q:
    """Slugs, names, fences, quotes and ranks of parts' names."""
    p = S.table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" `"), F.col("p_type"), F.lit("``")).alias("s"), "p_brand", "p_retailprice")
    n = (F.col("p_partkey") * 7919) % 3_000_000
    return p.select("p_partkey", X.slug(F.col("s")).alias("slug"), X.skill_name(F.concat_ws("/", "p_brand", "s")).alias("skill"), X.fence(F.lit("go"), F.col("s")).alias("fence"), X.anchor(F.col("s")).alias("anchor"), X.blockquote(F.replace("s", F.lit(" "), F.lit("\n"))).alias("quote"), X.human(n).alias("human"), X.rank_in(F.when(F.col("p_partkey") % 3 == 0, "golden").otherwise(F.col("p_brand")), TIERS).alias("rank"), X.local_id(F.concat(F.lit(" [i"), (F.col("p_partkey") % 40).cast("string"), F.lit("x]")), "i", F.lit(30)).alias("local"))


def flagship(spark: SparkSession, d: str) -> Q:
    """Scored rules in their final order, each with its strongest evidence."""
    best = EV.top(S.evidence(spark, d), 5, ["url"]).groupBy("rule_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"]), " ").alias("evidence"))
    final = report.finalize(S.graded(spark, d), position="rule_id")
    return final.join(best, "rule_id", "left").select("rank", "id", "tier", "confidence", "category", "distinct_prs", "note", "evidence")


ALL = [
    evidence_metrics, tier_floors, repo_floor_combined, top_evidence, finalize_rules, tier_tally, report_violations, export_filter_sort, export_sections, rule_signature, latest_pr_versions, incremental_refresh,
    dirty_units, latest_generation_evidence, unfolded_candidates, clean_body, noise_filter, role_classification, thread_outcomes, comment_refs, digest_stats, path_areas, token_estimate, pack_chunks, split_parts,
    group_items, request_ids, unsent_requests, extract_parse, quote_verification, merge_apply, fold_apply, score_apply, cost_estimate, generation_status, repo_url_parse, render_lines, prompt_pr_counts,
    combined_stats, scalar_helpers, flagship,
]


def queries() -> dict:
    return {f.__name__: f for f in ALL}
