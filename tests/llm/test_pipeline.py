"""The pipeline's stages, each on its own input, against brute force."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from sagefold.llm import mixing, queries
from sagefold.llm.common import hand_back, local_table, materialise

from . import brute
from .conftest import frame


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = queries.table(spark, small, "documents")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(materialise(stage(spark, out[-1], small), f"test-{name.split()[0]}"))
    return out


def test_columns_and_names(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "n-gram Jaccard join", "PII", "mixing sources", "SentencePiece"]
    assert all(s.columns == P.COLUMNS for s in stages[1:-1]) and P.ORACLE_SQL is None


def test_toxic_documents_go(spark, small, stages):
    kept = {r["doc_id"] for r in stages[1].select("doc_id").collect()}
    scored = {r["doc_id"]: r["predicted"] for r in queries.op10_toxicity(spark, small).collect()}
    assert kept == {k for k, p in scored.items() if p == 0} and len(kept) > 0.8 * len(scored)
    assert stages[1].filter(F.col("text").rlike("(?i)\\b(idiot|moron|scum)\\b.*\\b(loser|stupid|trash|pathetic)\\b")).count() == 0


def test_one_of_each_class_stays(stages):
    before = [(r[0], r[1]) for r in stages[1].select("doc_id", "text").collect()]
    want = {c for c, _ in brute.classes(before).values()}
    assert {r[0] for r in stages[2].select("doc_id").collect()} == want


def test_no_personal_data_stays(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    rows = stages[3].collect()
    assert len(rows) == len(before) and all(brute.personal(r["text"]) == [] for r in rows)
    for r in rows:
        if not brute.personal(before[r["doc_id"]] or ""):
            assert r["text"] == before[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])


def test_sources_come_near_their_targets(stages):
    size = lambda df: {r["source"]: r["n"] for r in df.groupBy("source").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))).alias("n")).collect()}
    before, after = size(stages[3]), size(stages[4])
    longest = stages[3].select(F.max(F.size(F.split("text", " ")))).first()[0]
    for source, target in mixing.targets(before).items():
        assert abs(after.get(source, 0) - target) <= 2 * longest
    times = stages[4].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert times <= 3


def test_pieces_round_trip(stages):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    want = sorted((r["doc_id"], len(ids := library.encode(r["text"])), brute.sha(",".join(map(str, ids)))) for r in stages[4].collect())
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in stages[5].collect()) == want


def test_odd_and_empty_tables(spark, small, odd, empty):
    for docs in (odd, empty):
        now = docs
        for name, stage in P.STAGES:
            now = materialise(stage(spark, now, small), "odd-" + name.split()[0])
        assert now.count() >= (1 if docs is odd else 0)
    assert frame(spark, []).count() == 0


def test_stages_begin_with_memory_handed_back(spark, small, monkeypatch):
    assert hand_back(spark) in (True, False)  # JVMs without the command keep it
    began = []
    monkeypatch.setattr(P, "hand_back", lambda s: began.append(s))
    for _, stage in P.STAGES:
        stage(spark, queries.table(spark, small, "documents"), small)
    assert began == [spark] * len(P.STAGES)


def test_local_tables(spark):
    rows = [("a", 1, None), (None, 2, 0.5)]
    made = local_table(spark, rows, "s string, n long, x double")
    assert [tuple(r) for r in made.collect()] == rows and made.dtypes == [("s", "string"), ("n", "bigint"), ("x", "double")]
    assert "LocalTableScan" in made._jdf.queryExecution().executedPlan().toString()
    assert local_table(spark, [], "s string").collect() == []
