import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import categorise, steps
from ledgerlake.plans.steps import SAMPLES

ROW = "description string, merchant string, category string, channel string, amount double, account string, kind string"
COLUMNS = [F.col] * 7


def decided(spark, rows, listed):
    df = spark.createDataFrame([(*r, 9) for r in rows], ROW + ", step_category int").drop("step_category")
    out = steps.decide(df, listed, *[F.col(c) for c in ("description", "merchant", "category", "channel", "amount", "account", "kind")])
    return [(r.step, r.step_category) for r in out.collect()]


def test_every_step_of_the_starter_file_is_met_by_a_sample(spark):
    listed = steps.read_steps()
    assert len({s["name"] for s in listed}) == len(listed)
    got = decided(spark, [(*r[:4], None if r[4] is None else float(r[4]), *r[5:]) for r in SAMPLES], listed)
    assert {s["name"] for s in listed} == {step for step, _ in got if step}
    assert got[-1] == (None, "other")


def test_order_words_and_conditions(spark):
    listed = [
        {"name": "a", "category": "A", "words": ["tea"], "whole": True},
        {"name": "b", "category": "B", "words": ["tea"], "also": ["ice"], "amount": "in"},
        {"name": "c", "category": "C", "words": ["tea"], "without": ["team"], "in": ["description"]},
        {"name": "d", "category": "D", "words": ["team"]},
    ]
    row = lambda d, m=None, a=1.0: (d, m, None, None, a, None, None)
    rows = [row("TEA time"), row("steam", "ice"), row("steal"), row("team"), row(None, "steal"), row("teas", "ice", -1.0), row("teas", "ice", None), row("x" * 3_000_000 + " tea")]
    assert decided(spark, rows, listed) == [("a", "A"), ("b", "B"), ("c", "C"), ("d", "D"), (None, "other"), ("c", "C"), ("c", "C"), ("a", "A")]
    assert decided(spark, rows[:1], []) == [(None, "other")]


def test_files_are_checked(tmp_path):
    path = tmp_path / "steps.toml"
    path.write_text('[[step]]\nname = "x"\ncategory = "y"\nwords = ["z"]\namount = "sideways"\n')
    with pytest.raises(ValueError, match="not a step"):
        steps.read_steps(str(path))


def test_rules_in_several_passes_equal_one(spark, monkeypatch):
    rules = categorise.rules_frame(spark, [(w, c, p, s) for w, c, p, s in [("shop", "a", 1, 2), ("shop", "b", 5, 2), ("op one", "c", 1, 2), ("one", "d", 9, 1), ("zzz", "e", 1, 3), ("", "f", 9, 1)]])
    texts = spark.createDataFrame([("shop",), ("shop one",), ("zzz shop",), ("none of it",), ("",), (None,)], "text string")
    one = {tuple(r) for r in steps.best_rules(texts, rules).collect()}
    monkeypatch.setattr(steps, "AUTOMATON_WORDS", 2)
    assert one == {("shop", "b"), ("shop one", "d"), ("zzz shop", "b"), ("none of it", "d")}
    assert {tuple(r) for r in steps.best_rules(texts, rules).collect()} == one
