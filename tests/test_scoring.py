from pyspark.sql import functions as F

from plinth.functions import scoring as S
from plinth.operators import exams


def test_judge_replies(spark):
    df = spark.createDataFrame([(1, 'x {"correctness": 1, "evidence_support": 1, "reasoning_quality": 1, "hallucination": 0, "format_validity": 1} y'), (2, '{"final_score": 0.5}'), (3, "no"), (4, '{"final_score": 0.9, "verdict": "incorrect"}'), (5, None)], "i int, c string")
    got = {r["i"]: (round(r["s"]["final_score"], 6), r["s"]["verdict"]) for r in df.select("i", S.judge_reply(F.col("c")).alias("s")).collect()}
    assert got == {1: (1.0, "correct"), 2: (0.5, "partially_correct"), 3: (0.0, "invalid"), 4: (0.9, "incorrect"), 5: (0.0, "invalid")}


def test_actions(spark):
    df = spark.createDataFrame([(1, "Thought\nAction: [search] [carbon fibre]"), (2, "action: look at it"), (3, "none"), (4, "Action: [stop] now"), (5, None)], "i int, c string")
    got = {r["i"]: tuple(r["a"]) for r in df.select("i", S.action(F.col("c")).alias("a")).collect()}
    assert got == {1: ("search", "carbon fibre"), 2: ("look", "at it"), 3: (None, None), 4: ("stop", "now"), 5: (None, None)}


def test_evidence(spark):
    df = spark.createDataFrame([(1, '["a", "b"]'), (2, '[{"text": "nested"}, "flat"]'), (3, ""), (4, "[]"), (5, None), (6, '"plain"'), (7, "bare words")], "i int, c string")
    got = {r["i"]: r["x"] for r in df.select("i", S.flat_evidence(F.col("c")).alias("x")).collect()}
    assert got == {1: "a\nb", 2: "nested\nflat", 3: "", 4: "", 5: "", 6: "plain", 7: "bare words"}


def test_strict_and_lenient(spark):
    df = spark.createDataFrame([("答案：B", "B", True), ("a  B", "A b", False), ("x\ny has stiff core and dry fibre", "stiff core\ndry fibre", False), (None, "a", False)], "p string, g string, c boolean")
    opts = F.when(F.col("c"), F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    s = [r[0] for r in df.select(S.strict_score(F.col("p"), F.col("g"), F.lit("short"), opts)).collect()]
    assert [x["strict_correct"] for x in s] == [True, True, False, False]
    assert [r[0] for r in df.select(S.lenient_score(F.col("p"), F.col("g"), F.col("c"))).collect()] == [True, True, True, False]


def test_exam_survivors(spark):
    rows = [("a", 1, "q", "A:x"), ("b", 2, "q", "A:x"), ("c", 3, "q", "B:completely other"), ("d", 4, "r", ""), ("e", 5, None, None)]
    got = {r["id"]: (r["status"], r["n"]) for r in exams.survivors(spark.createDataFrame(rows, "id string, o int, t string, p string"), "id", "o", "t", "p").collect()}
    assert got == {"c": ("unique_after_dedup", 3), "d": ("unique", 1), "e": ("unique", 1)}
