import json
import re

import pytest
from pyspark.sql import functions as F

from sagefold.operators import completer, engine

UNITS = "pr long, state string, author string, updated_at timestamp, header string, blocks array<string>, hash string"


class Model(completer.Offline):
    """Answers by what a prompt holds; counts the kinds of requests."""

    def __init__(self):
        super().__init__(self.say)
        self.kinds = []

    def say(self, request):
        kind = next(k for k, s in engine.prompts.SYSTEM.items() if s == request["system"])
        self.kinds.append(kind)
        prompt = request["prompt"]
        if kind == "extract":
            found = re.findall(r"\[(\d+\.\d+)\] wants (\w+)", prompt)
            return {"candidates": [{"title": f"use {w}", "statement": f"always use {w}", "rationale": "r", "category": "style", "kind": "do", "paths": ["a/"], "evidence": [{"ref": ref, "quote": f"wants {w}", "outcome": "accepted"}]} for ref, w in found]}
        lines = re.findall(r"\[i(\d+)\] \(\w*\) use (\w+)", prompt)
        if kind == "merge":
            words = dict.fromkeys(w for _, w in lines)
            return {"rules": [{"title": f"use {w}", "rule": "merged", "rationale": "why", "kind": "do", "paths": ["a/"], "members": [f"i{n}" for n, x in lines if x == w]} for w in words]}
        if kind == "fold":
            rules = {w: n for n, w in re.findall(r"\[R(\d+)\] \(\w*\) use (\w+)", prompt)}
            return {"assignments": [{"candidate": f"i{n}", "rule": f"R{rules[w]}", "relation": "supporting"} for n, w in lines if w in rules], "new_rules": []}
        return {"scores": [{"id": f"r{n}", "tier": "conditional", "confidence": 0.8, "tier_reason": "t", "applies_when": "always"} for n in re.findall(r"\[r(\d+)\]", prompt)]}


def feed(spark, prs):
    """(units, refs) of {pr: (hash, [word...])}."""
    units, refs = [], []
    for pr, (content, words) in prs.items():
        units.append((pr, "merged", "dev", None, "", [f"[{pr}.{k}] wants {w}\n" for k, w in enumerate(words, 1)], content))
        refs += [(f"{pr}.{k}", pr, f"https://x/{pr}/{k}", f"rev{pr}", "maintainer", None, f"wants {w}", 0) for k, w in enumerate(words, 1)]
    return spark.createDataFrame(units, UNITS).withColumn("updated_at", F.current_timestamp()), spark.createDataFrame(refs, engine.REF)


@pytest.mark.parametrize("batched", [False, True])
def test_runs(spark, tmp_path, batched):
    model, state = Model(), engine.State(spark, str(tmp_path / "state"))

    class Later:
        """A batch is done when it is asked for the second time."""

        def __init__(self):
            self.sent, self.polls = {}, {}

        def submit(self, requests):
            name = f"b{len(self.sent)}"
            self.sent[name] = requests
            return name

        def done(self, batch):
            self.polls[batch] = self.polls.get(batch, 0) + 1
            return self.polls[batch] > 1

        def collect(self, batch):
            return [{"id": r["id"], **model.complete(r)} for r in self.sent[batch]]

    ask = engine.asking_batches(state, Later(), wait=0.01) if batched else engine.asking(state, model)
    now = F.current_timestamp()
    first = {1: ("a", ["slices", "locks"]), 2: ("b", ["slices"])}
    assert engine.run(state, *feed(spark, first), ask, now) == {"opened": 1, "extracted": [1], "folded": True}
    rules = {r["title"]: r for r in state.rules().collect()}
    assert set(rules) == {"use slices", "use locks"} and len(rules["use slices"]["members"]) == 2 and rules["use slices"]["rationale"] == "why" and rules["use slices"]["paths"] == ["a/"]
    assert model.kinds == ["extract", "merge", "score"]
    # nothing changed: nothing is asked and no version is written
    assert engine.run(state, *feed(spark, first), ask, now) == {"opened": None, "extracted": [], "folded": False}
    assert len(model.kinds) == 3 and state.folds().count() == 1
    # one pull request changes its mind, one is new: only these are read, and only what moved is graded
    model.kinds.clear()
    second = {1: ("a2", ["slices"]), 2: ("b", ["slices"]), 3: ("c", ["slices", "pools"])}
    assert engine.run(state, *feed(spark, second), ask, now)["opened"] == 2
    assert model.kinds == ["extract", "fold", "score"]
    rules = {r["title"]: r for r in state.rules().collect()}
    # the evidence for locks is gone with the new version of the first one
    assert set(rules) == {"use slices", "use pools"} and len(rules["use slices"]["members"]) == 3


def test_a_failed_request_is_asked_again(spark, tmp_path):
    state, model = engine.State(spark, str(tmp_path / "state")), Model()

    class Down(completer.Offline):
        def complete(self, request):
            raise RuntimeError("down")

    prs = feed(spark, {1: ("a", ["slices"])})
    now = F.current_timestamp()
    assert engine.run(state, *prs, engine.asking(state, Down()), now) == {"opened": 1, "extracted": [], "folded": False}
    assert engine.run(state, *prs, engine.asking(state, model), now) == {"opened": None, "extracted": [1], "folded": True}


def test_an_unsealed_generation_does_not_count(spark, tmp_path):
    state, model = engine.State(spark, str(tmp_path / "state")), Model()
    state.put(spark.createDataFrame([(1, "a")], "pr long, hash string"), "prs", 1)  # a run that stopped before its seal
    done = engine.run(state, *feed(spark, {1: ("a", ["slices"])}), engine.asking(state, model), F.current_timestamp())
    assert done["opened"] == 1 and state.rules().count() == 1


def test_schemas_and_budget():
    schema = json.loads(engine.prompts.json_schema(engine.prompts.SHAPES["score"]))
    assert schema["properties"]["scores"]["items"]["properties"]["confidence"] == {"type": "number"}
