import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagefold.llm import bloom, jaccard, mixing, queries, toxicity, urls

from . import brute
from .conftest import frame, words


@pytest.fixture(scope="module")
def near(spark, medium):
    """Documents with copies, near copies, a passage that many share, and odd rows."""
    rng = random.Random(3)
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").limit(250).collect()]
    passage = words(rng, 60)
    k = 10_000
    for _ in range(60):
        rows.append((k := k + 1, words(rng, 40) + " " + passage + " " + words(rng, 40)))
    base = words(rng, 200).split()
    for n in range(300):
        edited = list(base)
        for _ in range(n % 6):
            edited[rng.randrange(200)] = f"edit{rng.randrange(10**6)}"
        rows.append((k := k + 1, " ".join(edited)))
    rows += [(k + 1, None), (k + 2, ""), (k + 3, " \n"), (k + 4, "one two"), (k + 5, "one  two"), (k + 6, "one"), (k + 7, words(rng, 30_000))]
    return rows


def test_jaccard_against_all_pairs(spark, near, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 64)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 100)  # so that the large group is cut into blocks
    out = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.link(frame(spark, [(i, t, None, None) for i, t in near])).collect()}
    want = brute.classes(near)
    assert out.keys() == want.keys()
    assert sum(out[k][0] == want[k][0] for k in want) >= 0.995 * len(want)
    assert sum(v[1] for v in out.values()) >= 0.99 * sum(v[1] for v in want.values())
    assert all(out[k][1] <= want[k][1] for k in want)


def test_jaccard_odd_rows(spark, odd, empty):
    out = jaccard.link(odd)
    assert out.count() == odd.count()
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[0]["class_id"] == by[1]["class_id"] == by[2]["class_id"] == 0
    assert by[7]["class_id"] == by[8]["class_id"] == 7 and by[3]["class_size"] == 3
    kept = jaccard.keep_one(odd, out)
    assert kept.filter("doc_id = 3").count() == 1 and kept.filter("doc_id in (0, 1, 2)").count() == 1
    assert jaccard.link(empty).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["root"] for r in jaccard.components(df).collect()} == {**{k: 0 for k in range(1, 41)}, 101: 100, 102: 100}


def test_recall_rises_with_runs():
    assert jaccard.survival(0.8, 1) == pytest.approx(0.84) and jaccard.survival(1.0, 5) == 1
    assert jaccard.runs_for(0.99) <= 6 < jaccard.runs_for(0.9999)


def test_jaccard_recall_at_the_last_level(spark, monkeypatch):
    """Pairs just over the threshold that only part at the last level, as in large groups."""
    monkeypatch.setattr(jaccard, "LEAF", 1)
    rng = random.Random(8)
    rows = []
    for k in range(2000):
        text = words(rng, 104).split()
        n = 9 + k % 3  # of 100 shingles n differ: similarities of 0.80 to 0.83
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text[:-n] + words(rng, n).split()))]
    out = jaccard.link(frame(spark, [(i, t, None, None) for i, t in rows])).filter("n_links > 0").count()
    assert out >= 0.985 * len(rows)


def urls_wanted(rows):
    out = []
    for i, u in rows:
        host, path = brute.url(u)
        plain = re.sub(r"\.+\Z", "", re.sub(r":[0-9]*\Z", "", host.rpartition("@")[2]))
        fits = [(1, len(h + q), h + q, a) for h, q, a in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(q)]
        fits += [(0, len(h + q), h + q, "block") for h, q in queries.URL_LIST if (plain == h or plain.endswith("." + h)) and re.sub("/+", "/", path or "/").startswith(q)]
        best = max(fits, default=None)
        out.append((i, host, path, best[2] if best and best[0] else None, best[3] if best else "allow"))
    return sorted(out, key=str)


def test_urls(spark, tmp_path):
    some = ["http://www.example.com/en/x?y", "https://A.B.Example.COM/en/", "http://example.net/es/1#z", "ftp://x.net/fr", "no scheme", None, "", "://", "http://com/", "http://com", "x://y://com/", "http://notexample.com/en/", "http://user@a.com:80/p", "http://ADULT-X.example.net/de/", "http://spam-farm.example.org", "http://İ.com/", "a\n://b.net/es/", "http://me@spam-farm.example.net:8080/a//b", "http://x.CASINO-win.example.org./", "http://free-bets.example.com.evil.net/de/", "http://notadult-x.example.net/", "http://h.com/" + "a/" * 20_000]
    rows = list(enumerate(some)) + [(0, some[0]), (None, some[2])]
    path = str(tmp_path)
    spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, html string, host string").write.parquet(f"{path}/pages.parquet")
    got = [tuple(r) for r in queries.op8_url_filter(spark, path).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got, key=str) == urls_wanted(rows)


def test_bloom_passes_all_listed_and_few_others(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("key"))
    blocks = bloom.block_count(3000)
    probe = spark.range(30_000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("key"))
    passed = bloom.passing(probe, F.col("key"), bloom.build(keys, F.col("key"), blocks), blocks)
    n = passed.count()
    assert 3000 <= n < 3000 + 0.03 * 27_000
    assert passed.filter(F.substring("key", 2, 9).cast("long") < 3000).count() == 3000
    assert bloom.block_count(10**12) == bloom.MOST_BLOCKS


def test_url_filter_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, action string, priority int, canonical boolean")
    assert urls.judge(pages, none).first()["action"] is None


def test_url_filter_with_a_long_list(spark):
    """50,000 listed URLs with paths, against sets; no pages give no rows."""
    rng = random.Random(7)
    listed = {(f"h{rng.randrange(40_000)}.org", rng.choice(["", "/a/", "/b/c"])) for _ in range(50_000)}
    rules = spark.createDataFrame([(h, p, "block", 0, True) for h, p in listed], "host string, path string, action string, priority int, canonical boolean")
    rows = [(k, f"http://{rng.choice(['', 'www.', 'u@'])}h{rng.randrange(60_000)}.org{rng.choice(['', ':80'])}{rng.choice(['', '/', '//a//x', '/b/c', '/z'])}") for k in range(4000)]
    got = {r["page_id"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).filter("action = 'block'").collect()}
    want = set()
    for k, u in rows:
        host, path = brute.url(u)
        host, path = host.rpartition("@")[2].split(":")[0].removeprefix("www."), re.sub("/+", "/", path or "/")
        if any((host, p) in listed and path.startswith(p) for p in ("", "/a/", "/b/c")):
            want.add(k)
    assert got == want and 0 < len(want) < 4000
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_targets():
    assert mixing.targets({"b": 100, "a": 100, None: 100}) == pytest.approx({"a": 50, "b": 100, None: 150})
    got = mixing.targets({"a": 1000, "b": 10, "c": 10})
    assert got == pytest.approx({"a": 960, "b": 30, "c": 30})
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def mix_holds(rows, tolerance):
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r)
    for (size, target), some in by.items():
        assert sum(r["size"] for r in some) == size
        assert abs(sum(r["taken"] for r in some) - target) <= max(3, tolerance * size)


def test_mix(spark, medium, odd, empty):
    out = queries.op4_mix_sources(spark, medium)
    mix_holds(out.collect(), 0.004)
    assert sorted(map(str, out.collect())) == sorted(map(str, queries.op4_mix_sources(spark, medium).collect()))
    odd_out = mixing.mix(odd).collect()
    assert len(odd_out) == odd.count()
    mix_holds(odd_out, 0.01)
    assert mixing.mix(empty).count() == 0 and mixing.repeats(empty).count() == 0


def test_schedule_spreads_sources(spark):
    """In each stretch of the schedule every source has about its share."""
    sizes = spark.createDataFrame([(s, n) for s, n in (("a", 300_000), ("b", 100_000), ("c", 600_000))], "source string, size long")
    plan = mixing.plan(sizes)
    rows = mixing.schedule(spark, plan).orderBy("slot").collect()
    share = {r["no"]: r["slots"] for r in plan.collect()}
    total = sum(share.values())
    for at in range(0, len(rows) - 500, 500):
        for no, n in share.items():
            assert abs(sum(r["no"] == no for r in rows[at : at + 500]) - 500 * n / total) < 4
    for no in share:
        assert [r["rank"] for r in rows if r["no"] == no] == list(range(sum(r["no"] == no for r in rows)))


def test_repeats(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    times = {r["doc_id"]: r["times"] for r in mixing.repeats(docs).collect()}
    rows = {r["doc_id"]: r for r in queries.op4_mix_sources(spark, medium).collect()}
    assert max(times.values()) <= 3
    taken = sum(times.get(k, 1) * r["size"] for k, r in rows.items())
    assert abs(taken - sum(r["size"] for r in rows.values())) < 0.1 * taken


def test_mix_asks_little_of_the_driver(spark, medium):
    """Each broadcast, and each job's stages, take megabytes of the driver at once: sources are no jobs of Python rows, the last plan is a short one."""
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    sources = mixing.plan(spark.createDataFrame([("a", 300), (None, 100)], "source string, size long"))
    for df, most in ((sources, 0), (mixing.schedule(spark, sources), 1), (mixing.repeats(docs), 4), (mixing.mix(docs), 6)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ExistingRDD" not in plan and plan.count("BroadcastExchange") <= most


def test_mix_broadcasts_by_rows(spark, medium, monkeypatch):
    """Tables beyond the number of rows are joined by a shuffle, with the same result."""
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    want = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    out = mixing.mix(docs)
    assert out._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") >= 2
    assert sorted(map(str, out.collect())) == want


def test_toxicity_held_out(spark, medium):
    out = {r["doc_id"]: r for r in queries.op10_toxicity(spark, medium).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    held = [(out[k]["score"], out[k]["predicted"], y) for k, y in labels.items() if out[k]["held_out"]]
    assert sum(p == y for _, p, y in held) / len(held) > 0.9
    clean = [p for _, p, y in held if y == 0]
    assert sum(clean) <= 0.02 * len(clean)
    assert all(0 <= s <= 1 for s, _, _ in held)


def test_toxicity_ignores_held_out_labels(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").limit(200)
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.learnable(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = (toxicity.fit(docs, x, toxicity.learnable()).classifier for x in (labels, turned))
    assert a == b


def test_label_model_recovers_rates(spark):
    """Rates from votes and poor labels, with two voters that copy each other."""
    rng = np.random.default_rng(0)
    n, a, b = 60_000, np.array([0.5, 0.4, 0.3, 0.45, 0.35]), np.array([0.02, 0.05, 0.01, 0.03, 0.02])
    y = rng.random(n) < 0.2
    votes = rng.random((n, 5)) < np.where(y[:, None], a, b)
    votes[:, 4] = np.where(rng.random(n) < 0.9, votes[:, 3], votes[:, 4])
    masks, counts = np.unique(votes @ (1 << np.arange(5)), return_counts=True)
    table = spark.createDataFrame([(int(m), int(c)) for m, c in zip(masks, counts, strict=True)], "mask long, n long")
    model = toxicity.fit_labels(table, 5, (0.2, a * 0.9, b * 1.2))
    assert model.correlation[3, 4] > 0.3 and model.weight[3] < 0.8 < model.weight[0]
    right = (a * 0.2 / (a * 0.2 + b * 0.8))[:3]
    assert np.abs(model.a[:3] - a[:3]).max() < 0.1 and np.abs(model.accuracies()[:3] - right).max() < 0.12
    q = model.posterior(votes.astype(float))
    assert q[y].mean() > q[~y].mean() + 0.4


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels, toxicity.learnable())
    assert model.voters.n >= 3
    assert toxicity.score(odd, model.classifier, ["doc_id"]).count() == odd.count()
    model = toxicity.fit(empty, labels.limit(0), toxicity.learnable())
    assert toxicity.score(empty, model.classifier, ["doc_id"]).count() == 0
