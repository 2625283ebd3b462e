import datetime as dt
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sagefold.operators import completer, cost, digest, evidence, ledger, packing, report, synth
from sagefold.schemas import EVIDENCE, RAW_PR

NOW = dt.datetime(2026, 1, 1)


def ev(side, pr, author, role, outcome, age, **more):
    row = {"rule_id": "r", "side": side, "pos": 0, "pr": pr, "ref": f"{pr}.1", "url": f"https://x/{pr}/{author}", "author": author, "role": role, "date": NOW - dt.timedelta(days=age), "quote": "", "outcome": outcome, "thumbs_up": 0, "repo": ""}
    return {**row, **more}


def frame(spark, rows, schema=EVIDENCE):
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def test_metrics_scenario(spark):
    rows = [
        ev("support", 1, "alice", "maintainer", "accepted", 10), ev("support", 2, "Alice", "maintainer", "accepted", 400), ev("support", 3, "bob", "contributor", "disputed", 20), ev("support", 3, "carl", "pr-author", "ignored", 20),
        ev("opposing", 9, "dan", "contributor", "accepted", 1), ev("opposing", 9, "dan", "contributor", "accepted", 1),
    ]
    m = evidence.metrics(evidence.dedupe(frame(spark, rows), ["pr"]), F.lit(NOW)).first()
    assert (m["distinct_prs"], m["distinct_reviewers"], m["maintainer_endorsed"], m["accepted"], m["disputed"], m["ignored"], m["opposing"], m["recent_share"]) == (3, 2, True, 2, 1, 1, 1, 0.75)


def test_metrics_only_author_and_no_dates(spark):
    rows = [ev("support", 1, "Me", "pr-author", "unclear", 1, date=None), ev("opposing", 1, "you", "contributor", "accepted", 1, rule_id="other")]
    out = evidence.metrics(frame(spark, rows), F.lit(NOW)).collect()
    assert len(out) == 1 and (out[0]["distinct_reviewers"], out[0]["recent_share"], out[0]["first_seen"]) == (1, 0.0, None)


@pytest.mark.parametrize(
    ("tier", "when", "m", "want"),
    [
        ("golden", "", (5, 3, True, 6, 0), "golden"), ("golden", "x", (2, 2, False, 2, 0), "conditional"), ("golden", "", (2, 2, False, 2, 0), "consider"), ("golden", "", (4, 3, True, 3, 1), "consider"),
        ("golden", "", (6, 3, True, 6, 1), "golden"), ("conditional", " ", (5, 3, True, 6, 0), "consider"), ("conditional", "x", (1, 1, False, 0, 0), "consider"), ("conditional", "x", (1, 1, True, 0, 0), "conditional"),
        ("consider", "", (0, 0, False, 0, 0), "consider"), ("rejected", "", (5, 3, True, 6, 0), "rejected"),
    ],
)
def test_floors(spark, tier, when, m, want):
    df = spark.createDataFrame([(tier, when, *m, 0)], "tier string, w string, distinct_prs int, distinct_reviewers int, maintainer_endorsed boolean, accepted int, disputed int, opposing int")
    t, note = evidence.apply_floors(F.col("tier"), F.col("w"))
    row = df.select(t.alias("t"), note.alias("note")).first()
    assert row["t"] == want and bool(row["note"]) == (want != tier)


def test_repo_floor(spark):
    df = spark.createDataFrame([("golden", "", ["o/r"]), ("golden", "x", ["o/r"]), ("golden", "", ["a", "b"]), ("consider", "", ["a"])], "t string, w string, r array<string>")
    got = [tuple(r)[:2] for r in df.select(*evidence.repo_floor(F.col("t"), F.col("w"), F.col("r"))).collect()]
    assert got == [("conditional", "In o/r"), ("conditional", "x"), ("golden", ""), ("consider", "")]


def test_ids_stay_unique(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["A", "A", "A 2", "a", "A 3", "!!"])], "pos int, title string").withColumns({"tier": F.lit("golden"), "confidence": F.lit(0.5), "distinct_prs": F.lit(3)})
    out = {r["pos"]: r["id"] for r in report.finalize(df).collect()}
    assert out[0] == "a" and out[2] == "a-2" and out[5] == "rule" and len(set(out.values())) == 6


def test_finalize_order(spark):
    df = spark.createDataFrame([("consider", 0.9, 9), ("golden", 0.5, 1), ("golden", 0.5, 4), ("rejected", 1.0, 9), ("golden", 0.7, 1)], "tier string, confidence double, distinct_prs int").withColumn("pos", F.monotonically_increasing_id()).withColumn("title", F.lit("t"))
    out = [(r["tier"], r["confidence"], r["distinct_prs"]) for r in report.finalize(df).orderBy("rank").collect()]
    assert out == [("golden", 0.7, 1), ("golden", 0.5, 4), ("golden", 0.5, 1), ("consider", 0.9, 9)]
    assert report.finalize(df, keep_rejected=True).count() == 5


def test_violations_of_a_valid_report(spark):
    rows = [("a", "t", "r", "style", "do", "golden", 0.5, "", [("u", 1, "1.1")])]
    schema = "id string, title string, rule string, category string, kind string, tier string, confidence double, applies_when string, evidence array<struct<url:string,pr:bigint,ref:string>>"
    assert report.violations(spark.createDataFrame(rows, schema)).count() == 0
    assert report.violations(spark.createDataFrame(rows * 2, schema)).count() == 1
    assert report.violations(spark.createDataFrame([(None,) * 8 + ([],)], schema)).count() == 7


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=40), st.integers(1, 12))
def test_bins_are_greedy(spark, sizes, limit):
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "k int, s long")
    got = [r["bin"] for r in packing.greedy_bins(df, [], ["k"], {"s": limit}).orderBy("k").collect()]
    want, number, filled = [], 1, 0
    for s in sizes:
        if filled and filled + s > limit:
            number, filled = number + 1, 0
        filled += s
        want.append(number)
    assert got == want


COMMENT = {"id": "", "createdAt": NOW, "diffHunk": "", "thumbsUp": 0, "thumbsDown": 0}


def comment(login, body, association="NONE", kind="User", **more):
    return {**COMMENT, "url": f"https://x/{login}", "body": body, "author": {"login": login, "__typename": kind}, "authorAssociation": association, **more}


def pr(number, updated, **more):
    base = {"number": number, "title": f"PR {number}", "body": "<!-- x -->about", "url": "u", "state": "OPEN", "merged": True, "createdAt": NOW, "updatedAt": updated, "mergedAt": None, "author": {"login": "dev", "__typename": "User"}, "authorAssociation": "NONE", "labels": ["bug"], "files": [], "filesTotal": 0, "reviews": [], "threads": [], "comments": []}
    return {**base, **more}


def raw(spark, prs):
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL(RAW_PR)

    def row(t, v):
        if v is None:
            return None
        if isinstance(t, T.StructType):
            return tuple(row(f.dataType, v.get(f.name)) for f in t.fields)
        if isinstance(t, T.ArrayType):
            return [row(t.elementType, x) for x in v]
        return v

    return spark.createDataFrame([row(schema, p) for p in prs], schema).withColumn("read_order", F.monotonically_increasing_id())


@pytest.fixture(scope="module")
def scenario(spark):
    thread = {"id": "t", "path": "lib/cache/a.go", "line": 7, "isResolved": True, "isOutdated": False, "commentsTotal": 2, "comments": [comment("rev", "Use a <pr> context here", "MEMBER", diffHunk="\n".join(f"l{k}" for k in range(20)), thumbsUp=2), comment("dev", "Done."), comment("DEV", "but why not x?")]}
    quiet = {**thread, "path": "b", "comments": [comment("rev", "LGTM")]}
    main = pr(431, NOW, files=["lib/cache/a.go", "cmd/app/main.go", "README"], threads=[thread, quiet], reviews=[{**comment("rev", "", "OWNER"), "state": "APPROVED", "submittedAt": NOW}, {**comment("rev", "never", "OWNER"), "state": "PENDING", "submittedAt": NOW}], comments=[comment("ci", "coverage 80", kind="Bot"), comment("guest", "What about y?")])
    stale = pr(431, NOW - dt.timedelta(hours=1), comments=[comment("guest", "old text")])
    lonely = pr(900, NOW, comments=[comment("dev", "talking to myself")])
    return raw(spark, [stale, main, lonely])


def test_digest_scenario(scenario):
    prs = digest.latest(scenario, ["number"])
    units, comments = digest.units(prs)
    u = units.collect()
    assert [x["pr"] for x in u] == [431] and u[0]["areas"] == ["lib/cache", "cmd/app", "/"] and u[0]["state"] == "merged" and u[0]["description"] == "about"
    assert [r["ref"] for r in comments.orderBy("seq").collect()] == ["431.1", "431.2", "431.3"]
    assert 'outcome="resolved,author-acknowledged"' in u[0]["blocks"][0] and "‹pr> context" in u[0]["blocks"][0] and "l19" in u[0]["blocks"][0] and "l7\n" not in u[0]["blocks"][0]
    assert "@rev 2026-01-01 +2:" in u[0]["blocks"][0] and len(u[0]["blocks"]) == 2
    s = digest.stats(prs, digest.classify(digest.comments(prs))).first().asDict()
    assert s == {"prs_in": 2, "prs_kept": 1, "threads": 1, "comments": 4, "dropped_noise": 3, "dropped_bots": 1}
    with_bots, _ = digest.units(prs, include_bots=True)
    assert len(with_bots.first()["blocks"]) == 3


def test_hash_follows_content_only(scenario):
    prs = digest.latest(scenario, ["number"])
    later = prs.withColumn("updatedAt", F.col("updatedAt") + F.expr("INTERVAL 1 DAY")).withColumn("merged", F.lit(False))
    relabelled = prs.withColumn("labels", F.array(F.lit("other")))
    hashes = [digest.units(x)[0].first()["hash"] for x in (prs, later, relabelled)]
    assert hashes[0] == hashes[1] != hashes[2] and len(hashes[0]) == 16


def test_parts_and_chunks(spark):
    threads = lambda n: [{"id": str(k), "path": f"p{k}", "line": 1, "isResolved": False, "isOutdated": False, "commentsTotal": 1, "comments": [comment("rev", "words " * 200)]} for k in range(n)]
    prs = raw(spark, [pr(k, NOW - dt.timedelta(minutes=k), threads=threads(25 if k == 3 else 5)) for k in range(1, 16)])
    units, _ = digest.units(prs)
    parts = digest.parts(units, 4000)
    assert parts.filter("tokens > 4000").count() == 0
    split = parts.filter("pr = 3").orderBy("part").collect()
    assert len(split) >= 2 and all("title: PR 3" in r["text"] and f'part="{r["part"]}/{len(split)}"' in r["text"] for r in split)
    chunks = digest.chunks(units, 4000, "g0001-").orderBy("id").collect()
    assert [c["id"] for c in chunks][:2] == ["g0001-chunk-00001", "g0001-chunk-00002"] and all(c["est_tokens"] <= 4000 for c in chunks)
    assert list(dict.fromkeys(p for c in chunks for p in c["prs"])) == list(range(1, 16))


def test_parse_scenario(spark):
    requests = spark.createDataFrame([("c1-aaaaaaaaaa",), ("c2-bbbbbbbbbb",)], "id string")
    cited = [{"ref": "7.1", "quote": "use  a\ncontext", "outcome": "accepted"}, {"ref": " [7.2] ", "quote": "made up", "outcome": "best"}, {"ref": "7.1", "quote": "", "outcome": ""}, {"ref": "9.9", "quote": "", "outcome": ""}]
    out = {"candidates": [{"title": " T ", "statement": "S", "category": "colour", "kind": "do", "paths": [" a ", ""], "evidence": cited}, {"title": "U", "statement": "S", "evidence": [{"ref": "8.8"}]}]}
    results = spark.createDataFrame([("c1-aaaaaaaaaa", json.dumps(out), ""), ("c2-bbbbbbbbbb", None, "refused")], "id string, text string, error string")
    refs = spark.createDataFrame([("7.1", 7, "u1", "a", "maintainer", NOW, "Please use a context", 0), ("7.2", 7, "u2", "b", "contributor", NOW, "other  words", 1)], "ref string, pr long, url string, author string, role string, date timestamp, body string, thumbs_up int")
    kept, total = synth.parse(requests, results, refs)
    row = kept.first()
    assert (row["id"], row["title"], row["category"], row["paths"]) == ("c1.1", "T", "process", ["a"])
    assert [(e["ref"], e["quote"], e["outcome"]) for e in row["evidence"]] == [("7.1", "use  a\ncontext", "accepted"), ("7.2", "other words", "unclear")]
    assert total.first().asDict() == {"requests": 2, "succeeded": 1, "failed": 1, "candidates": 1, "dropped": 1, "quotes_replaced": 1, "unknown_refs": 2}


def items(n):
    return [{**dict.fromkeys(synth.TEXTS, ""), "kind": "do", "title": f"t{k}", "statement": "s", "rationale": "why", "paths": [], "languages": ["go"], "members": [f"c{k}"], "opposing": []} for k in range(1, n + 1)]


def test_claims():
    out, gone, left = synth.claim(items(6), {"rules": [{"title": "A", "members": ["i1", "[i2]", "i9"], "opposing": ["i3", "i1"]}, {"title": "B", "members": ["i2"], "opposing": ["i4"]}, {"title": "C", "members": ["i5"], "opposing": ["i3"]}], "discarded": ["i6", "i1"]}, [False] * 6)
    assert [(x["title"], x["members"], x["opposing"]) for x in out] == [("A", ["c1", "c2"], ["c3"]), ("C", ["c5"], ["c3"]), ("t4", ["c4"], [])]
    assert (gone, left) == (1, 1)


def test_merged_rules_keep_what_the_model_says():
    rule = {"title": "T", "kind": "avoid", "rule": "R", "rationale": "because", "applies_when": " in loops ", "bad_example": "x", "good_example": "y", "paths": ["a/"], "languages": ["go", "c"], "members": ["i1"]}
    out, _, _ = synth.claim(items(2), {"rules": [rule]}, [False] * 2)
    want = {"title": "T", "kind": "avoid", "statement": "R", "rationale": "because", "applies_when": "in loops", "bad_example": "x", "good_example": "y", "paths": ["a/"], "languages": ["go", "c"], "members": ["c1"], "opposing": []}
    assert out == [want, items(2)[1]] and list(out[0]) == [f.split(":")[0] for f in synth.ITEM.removeprefix("struct<").removesuffix(">").split(",")]


def test_quotes_of_any_length(spark):
    """Against containment in every text: long quotes, short ones, ends within longer words."""
    rng = random.Random(9)
    vocabulary = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40))) for _ in range(60)] + [None, "", '"quoted  Alpha\nbeta"']
    quotes = [t[a : a + rng.randrange(1, 60)] for t in texts[:40] if t for a in [rng.randrange(len(t))]] + ["", ' "ALPHA  beta". ', "nowhere to be found in any of the texts", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "d int, text string")
    asked = spark.createDataFrame(list(enumerate(quotes)), "q int, quote string")
    got = sorted(tuple(r) for r in synth.quoted(docs, asked, "d", "q").select("d", "q").collect())
    plain = lambda x: " ".join(x.lower().split())
    want = sorted((i, k) for i, t in enumerate(texts) if t is not None for k, q in enumerate(quotes) if q is not None and (x := plain(q.strip("\"'.… "))) and x in plain(t))
    assert got == want and len(want) > 100


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 9)), st.lists(st.integers(0, 9))), max_size=5), st.lists(st.integers(0, 9)))
def test_nothing_is_forgotten(listed, dropped):
    """Each item is a member or an opponent of a rule, discarded, or still there."""
    model = {"rules": [{"title": "r", "members": [f"i{k}" for k in m], "opposing": [f"i{k}" for k in o]} for m, o in listed], "discarded": [f"i{k}" for k in dropped]}
    used = [False] * 8
    out, gone, left = synth.claim(items(8), model, used)
    seen = {x for i in out for x in i["members"] + i["opposing"]}
    assert len(seen) + gone == 8 and left == used.count(False)
    members = [x for i in out for x in i["members"]]
    assert len(members) == len(set(members))


def test_fold_takes_the_first_valid_assignment():
    model = {"assignments": [{"candidate": "i1", "rule": "R9"}, {"candidate": "i1", "rule": "R2", "relation": "opposing"}, {"candidate": "i1", "rule": "R1"}, {"candidate": "x", "rule": "R1"}, {"candidate": "[i2]", "rule": "[R1]"}], "new_rules": [{"title": "N", "members": ["i1", "i3"]}]}
    given_, new, assigned, gone, left = synth.fold(items(4), 2, model)
    assert given_ == [{"rule": 2, "opposing": True, "ids": ["c1"]}, {"rule": 1, "opposing": False, "ids": ["c2"]}]
    assert [(x["title"], x["members"]) for x in new] == [("N", ["c3"]), ("t4", ["c4"])] and (assigned, gone, left) == (2, 0, 1)


def test_folded_rules(spark):
    rules = spark.createDataFrame([("style", 1, "a", ["c1", "gone"], []), ("style", 2, "b", ["gone"], ["c2"])], "category string, no int, rule_id string, members array<string>, opposing array<string>")
    groups = spark.createDataFrame([("style", json.dumps({"assignments": [{"candidate": "i1", "rule": "R1"}]}))], "category string, output string").withColumn("items", F.from_json(F.lit(json.dumps(items(1))), f"array<{synth.ITEM}>")).withColumn("n_rules", F.lit(2))
    known = spark.createDataFrame([("c1",), ("c2",)], "id string")
    out = synth.folded_rules(rules, synth.apply_fold(groups, ["category"]), known).collect()
    assert [(r["rule_id"], r["members"], r["assigned"]) for r in out] == [("a", ["c1"], True)]


def test_touched(spark):
    before = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("c", "s1")], "rule_id string, signature string")
    after = spark.createDataFrame([("a", "s1", True), ("b", "s1", False), ("c", "s2", False), ("d", "s", False)], "rule_id string, signature string, assigned boolean")
    assert {r[0]: r[1] for r in synth.touched(before, after).collect()} == {"a": True, "b": False, "c": True, "d": True}


def test_consolidate_levels(spark):
    rows = [("style", k, {**items(k)[-1], "statement": "words " * 100}) for k in range(1, 9)]
    df = spark.createDataFrame([(c, p, tuple(i.values())) for c, p, i in rows], f"category string, pos long, item {synth.ITEM}")
    calls = []

    def complete(groups):
        calls.append(groups.count())
        pairs = F.to_json(F.struct(F.array(F.struct(F.lit("m").alias("title"), F.transform(F.sequence(F.lit(1), F.size("items")), lambda k: F.concat(F.lit("i"), k.cast("string"))).alias("members"))).alias("rules")))
        return groups.withColumn("output", pairs)

    out = synth.consolidate(df, complete, tokens=500).collect()
    assert len(calls) >= 2 and len(out) == 1 and sorted(out[0]["item"]["members"]) == [f"c{k}" for k in range(1, 9)]


def test_estimate(spark):
    requests = spark.createDataFrame([("m", "x" * 299_997)], "model string, text string")
    prices = spark.createDataFrame([("m", 4.0, 20.0)], "model string, input_price double, output_price double")
    e = cost.estimate(requests, prices, []).first()
    assert (e["input_tokens"], e["output_tokens"]) == (100_000, 5000) and e["extract_usd"] == pytest.approx(0.25) and e["synth_usd"] == pytest.approx(0.075)
    assert cost.allowed(cost.estimate(requests, prices.limit(0), []), 9).first()["approved"] is False


def test_results_are_kept(spark, tmp_path):
    path, fake = str(tmp_path / "results"), completer.Offline()
    requests = spark.createDataFrame([(completer.request_id("c", p), "s", p, "") for p in ("one", "two")], "id string, system string, prompt string, schema string")
    assert completer.run_sync(requests, fake, path).count() == 2 and fake.calls == 2
    assert completer.run_sync(requests, fake, path).count() == 2 and fake.calls == 2

    class Broken(completer.Offline):
        def complete(self, request):
            raise RuntimeError("down")

    more = spark.createDataFrame([("x-1", "s", "p", "")], requests.schema)
    assert completer.run_sync(more, Broken(), path).first()["error"] == "down"
    assert completer.run_sync(more, fake, path).first()["error"] == ""
    assert completer.batches([("a", 100 << 20), ("b", 60 << 20), ("c", 1)]) == [["a"], ["b", "c"]]


def test_generation_rules(spark):
    g = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (1, 2, "c")], "gen int, pr int, hash string")
    assert sorted((r["pr"], r["gen"]) for r in ledger.latest_generation(g, ["pr"]).collect()) == [(1, 2), (2, 1)]
    units = spark.createDataFrame([(1, "b"), (2, "new"), (3, "x")], "pr int, hash string")
    assert sorted(r["pr"] for r in ledger.dirty(units, g, ["pr"]).collect()) == [2, 3]


def test_top_evidence_is_strongest_first(spark):
    rng = random.Random(1)
    rows = [ev("support", k, f"a{k}", rng.choice(["maintainer", "contributor"]), rng.choice(["accepted", "unclear", "ignored"]), k, thumbs_up=rng.randint(0, 6)) for k in range(12)]
    out = evidence.top(frame(spark, rows), 5, ["url"]).orderBy("rank").collect()
    assert len(out) == 5 and [r["strength"] for r in out] == sorted((r["strength"] for r in out), reverse=True)
