from pyspark.sql import functions as F

from plinth.functions import answers as A
from plinth.functions import text as T
from plinth.operators import chunking


def one(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.select(expr(F.col("c")).alias("x"), "i").orderBy("i").collect()]


def test_language(spark):
    assert one(spark, ["碳纤维复合材料", "carbon fibre composite", "123 ...", "", None], T.detect_language) == ["zh", "en", "unknown", "unknown", None]


def test_noise(spark):
    got = one(spark, ["", "abc", "表格内容 ─── │┃┏┓ 数据 一二三四五", "碳纤维    材料     应用 一二三四五六七八", "aaaaaaa and more text here"], T.noise_issues)
    assert got == [["empty_page"], ["empty_page"], ["box_drawing", "garbled_unicode"], ["irregular_spacing", "char_repetition"], ["char_repetition"]]


def test_headers(spark):
    assert one(spark, ["第3页", "Page 42", "第5章 碳纤维生产工艺", "碳纤维", "12"], T.is_header_footer) == [True, True, True, False, False]


def test_chunk_types(spark):
    got = one(spark, ["普通的文字没有任何符号只是一句话而已", "E = 230 GPa σ = 5.2 ± 0.1 μm ∑ x", "短", "│a│b│\n┌──┬──┐\n表 3 x  y  z  w"], T.chunk_type)
    assert got[0] == "body" and got[1] == "formula" and got[2] == "empty" and got[3] in ("table", "table_uncertain")


def test_slugs_and_hash(spark):
    assert one(spark, ["Carbon Fiber!", "???", None], T.slug) == ["carbon_fiber", "kw", None]
    assert one(spark, ["  A  b\n"], T.normalize_text) == ["a b"]
    assert one(spark, ["abc"], T.content_hash) == ["ba7816bf8f01cfea"]


def test_choice_letters(spark):
    assert one(spark, ["b", "答案是C。", "A. x", "carbon", "无", ""], A.choice_letter) == ["B", "C", "A", "C", "无", ""]


def test_truth(spark):
    assert one(spark, ["True", "不正确", "错误的", "maybe"], A.true_or_false) == ["正确", "正确", "错误", "maybe"]
    assert one(spark, ["不正确"], lambda c: A.true_or_false(c, strict=False)) == ["错误"]


def test_numbers(spark):
    assert one(spark, ["3.5", "about 2e3 Pa", "12 MPa or so", "none"], A.number_in) == [3.5, 2000.0, 12.0, None]


def test_f1(spark):
    df = spark.createDataFrame([("a b c", "a b d"), ("", "x"), (None, None)], "p string, g string")
    assert [round(r[0], 6) for r in df.select(A.token_f1(F.col("p"), F.col("g"))).collect()] == [round(2 / 3, 6), 0.0, 0.0]


def test_metrics_branches(spark):
    rows = [("exam_single_choice", "q", [("A", "x"), ("B", "y")], "答案是B", "B"), ("exam_true_false", "q", [], "对", "正确"), ("exam_calculation", "q", [], "10.1 MPa", "10"), ("qa", "q", [], "a b", "a c")]
    df = spark.createDataFrame(rows, "task string, question string, options array<struct<key:string,text:string>>, p string, g string")
    got = df.select(A.metrics(F.col("task"), F.col("question"), F.col("options"), F.col("p"), F.col("g")).alias("m")).select("m.*").collect()
    assert [r["is_correct"] for r in got] == [True, True, True, None]
    assert got[2]["numeric_score"] == 1.0 and got[2]["exact_match"] is None
    assert got[3]["exact_match"] is False and got[3]["f1"] == 0.5


def test_chunker_always_moves():
    text = "碳纤维技术。" * 500
    got = chunking.cuts(text, 500, 60)
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(b - a <= 500 for a, b in got)
    assert all(y[0] > x[0] and y[0] <= x[1] for x, y in zip(got, got[1:], strict=False))
    assert chunking.cuts("", 10, 2) == [] and len(chunking.cuts("a b c d e f g h", 4, 4)) > 1
