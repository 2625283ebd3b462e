import json

import pytest
from pyspark.sql import functions as F

from sagefold import cli
from sagefold.sources import paged, raw, sinks
from sagefold.streaming import refresh

from . import fake_remote
from .test_operators import scenario  # noqa: F401


def test_pages_shrink_and_stop_early():
    pager = paged.Pager(fake_remote.transport)
    got = list(paged.rows(pager, since=fake_remote.NODES[20]["updatedAt"]))
    assert [n["number"] for n in got] == list(range(100, 79, -1)) and [c["id"] for c in got[0]["comments"]["nodes"]] == [0, 1, 2]
    assert pager.sizes[:3] == [25, 12, 6] and max(pager.sizes[3:]) <= 24
    assert len(list(paged.rows(paged.Pager(fake_remote.transport), limit=7))) == 7


def test_quota_and_passing_errors():
    waits, calls = [], []

    def transport(v):
        calls.append(v)
        if len(calls) == 1:
            raise paged.Limited(3)
        if len(calls) == 2:
            raise ConnectionError
        return {"nodes": [], "pageInfo": {"hasNextPage": False, "endCursor": None}}

    assert paged.Pager(transport, wait=waits.append).page() == ([], False) and waits == [3, 2.0]
    with pytest.raises(ConnectionError):
        paged.Pager(lambda v: (_ for _ in ()).throw(ConnectionError()), wait=waits.append).page()


def test_data_source(spark):
    spark.dataSource.register(paged.PagedSource)
    df = spark.read.format("paged").option("transport", "tests.fake_remote:transport").option("limit", 12).load()
    assert [r["number"] for r in df.collect()] == list(range(100, 88, -1))


def test_wire_form(spark):
    from sagefold.schemas import WIRE_PR

    node = {"number": 1, "labels": {"nodes": [{"name": "bug"}]}, "files": {"totalCount": 2, "nodes": [{"path": "a"}]}, "reviewThreads": {"nodes": [{"id": "t", "line": None, "comments": {"totalCount": 1, "nodes": [{"body": "x", "thumbsUp": {"totalCount": 3}}]}}]}}
    row = raw.from_wire(spark.createDataFrame([(json.dumps(node),)], "j string").select(F.from_json("j", WIRE_PR).alias("x")).select("x.*")).first()
    assert row["labels"] == ["bug"] and row["files"] == ["a"] and row["filesTotal"] == 2 and row["threads"][0]["line"] == 0 and row["threads"][0]["comments"][0]["thumbsUp"] == 3


def test_lists_and_documents(spark, tmp_path):
    (tmp_path / "repos").write_text("a/b # one\n\n# none\nA/B\nhttps://h.example/c/d\n")
    assert [r["key"] for r in raw.read_repos(spark, str(tmp_path / "repos")).collect()] == ["github.com/a/b", "h.example/c/d"]
    assert raw.read_json(spark, str(tmp_path / "none.json"), "a int") is None
    sinks.write_json(tmp_path / "x" / "y" / "fetch_state.json", {"a": 1})
    assert raw.read_json(spark, str(tmp_path / "x/y/fetch_state.json"), "a int").first()["a"] == 1
    assert [tuple(r) for r in raw.discover(spark, str(tmp_path)).collect()] == [("x", "y")]


def pages(folder, rows, at=0):
    return sinks.append_page(folder, at, [json.loads(r) for r in rows.drop("read_order").select(F.to_json(F.struct("*"))).toPandas().iloc[:, 0]])


def test_pages_and_digest_command(spark, scenario, tmp_path):  # noqa: F811
    assert pages(tmp_path / "raw", scenario) == 1 and sinks.append_page(tmp_path / "raw", 1, []) == 1
    assert raw.load_pages(spark, str(tmp_path / "raw")).count() == 3
    cli.main(["digest", str(tmp_path / "raw"), str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out/chunks")).first()["prs"] == [431]
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["digest", "a", "b", "--chunk-tokens", "10"])


def test_stream_goes_on(spark, scenario, tmp_path):  # noqa: F811
    places = [str(tmp_path / x) for x in ("raw", "store", "check")]
    pages(tmp_path / "raw", scenario)
    refresh.refresh(spark, *places)
    assert spark.read.parquet(f"{places[1]}/*").count() == 3
    refresh.refresh(spark, *places)
    assert spark.read.parquet(f"{places[1]}/*").count() == 3
    later = scenario.filter("number = 900").withColumn("updatedAt", F.col("updatedAt") + F.expr("INTERVAL 1 DAY"))
    old = scenario.filter("number = 900").withColumn("updatedAt", F.col("updatedAt") - F.expr("INTERVAL 9 DAYS"))
    pages(tmp_path / "raw", later.unionByName(old), 1)
    refresh.refresh(spark, *places)
    assert spark.read.parquet(f"{places[1]}/*").count() == 4 and refresh.newest(spark, places[1], ["number"]).count() == 2
    assert refresh.option_key(a=1, b=2) == refresh.option_key(b=2, a=1) != refresh.option_key(a=1)


RULE = "id string, title string, rule string, category string, kind string, tier string, confidence double, applies_when string, paths array<string>, evidence array<struct<url:string,pr:bigint,ref:string>>"


@pytest.fixture(scope="module")
def rules(spark):
    rows = [("a", "Title A", "Do a", "style", "do", "golden", 0.9, "", [], [("u", 1, "1.1")]), ("b", "Title B", "Do b", "api-design", "do", "conditional", 0.8, "in b", ["x/*.py", "y"], [("u", 2, "2.1")]), ("c", "Title C", "Do c", "style", "do", "consider", 0.3, "", [], [("u", 3, "3.1")])]
    m = {"distinct_prs": 2, "distinct_repos": 1, "distinct_reviewers": 1, "accepted": 1, "disputed": 0, "ignored": 0, "opposing": 0, "thumbs_up": 0}
    df = spark.createDataFrame(rows, RULE).withColumns({k: F.lit(v) for k, v in m.items()})
    return df.withColumns({"maintainer_endorsed": F.lit(True), "first_seen": F.lit("2026-01-01").cast("timestamp"), "last_seen": F.lit("2026-03-01").cast("timestamp")})


def test_exports(spark, rules, tmp_path):
    assert sinks.should_write(False, tmp_path, ["rules", "json"], "o/r")
    files = sinks.export(rules, tmp_path, sinks.FORMATS, "o/r", "o/r", "conditional")
    names = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file())
    assert names == ["review-handbook.md", "rules.json", "rules/rules-scoped-x-py-y.md", "rules/rules-style.md", "skills/o-r-review-rules/SKILL.md"] and len(files) == 5
    text = (tmp_path / "rules/rules-style.md").read_text()
    assert "Title A" in text and "Title C" not in text and "2 PRs · 1 reviewer · maintainer-endorsed · 1 accepted · seen 2026-01 to 2026-03" in text
    assert not sinks.should_write(False, tmp_path, sinks.FORMATS, "o/r")
    (tmp_path / "rules/rules-own.md").write_text("mine")
    sinks.export(rules.filter("id = 'b'"), tmp_path, ["rules"], "o/r", "o/r")
    assert sorted(p.name for p in (tmp_path / "rules").iterdir()) == ["rules-own.md", "rules-scoped-x-py-y.md"]
    assert "- [Golden](#golden): 1" in (tmp_path / "review-handbook.md").read_text()


def test_reports_are_checked(rules, tmp_path):
    sinks.write_report(rules, tmp_path / "r.json", {"repo": "o/r", "stats": {}})
    out = json.loads((tmp_path / "r.json").read_text())
    assert len(out["rules"]) == 3 and out["stats"]["by_tier"] == {"golden": 1, "conditional": 1, "consider": 1, "rejected": 0}
    with pytest.raises(sinks.Invalid, match="bad tier"):
        sinks.write_report(rules.withColumn("tier", F.lit("best")), tmp_path / "s.json", {"repo": "o/r"})
    assert not (tmp_path / "s.json").exists()


def test_formats():
    assert sinks.parse_formats("json, all,rules") == ["json", "rules", "skill", "manual"]
    with pytest.raises(ValueError):
        sinks.parse_formats("pdf")
