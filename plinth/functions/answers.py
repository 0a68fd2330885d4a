"""Answers, numbers and JSON in text, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinth.functions.text import strip

# Fixed values.
TRUE_WORDS = ["true", "correct", "对", "正确", "是", "√", "✓"]
FALSE_WORDS = ["false", "incorrect", "错", "错误", "否", "×", "✗"]
NO_ANSWER = ["我不知道", "无法回答", "抱歉", "sorry", "I don't know"]


def _group(c: Column, pattern: str, n: int) -> Column:
    """The group, or null where the pattern does not match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, n))


def normalize_answer(c: Column) -> Column:
    return F.coalesce(strip(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def choice_letter(c: Column) -> Column:
    """The option letter that a response names: itself, after 答案, at the start, else the first letter A to H of any word."""
    s = strip(c)
    return F.coalesce(F.when(s.rlike("^[A-Ha-h]$"), F.upper(s)), _group(s, r"答案[是为：:]\s*([A-H])", 1), _group(s, r"(?U)^([A-H])[.、．)\s]", 1), F.upper(_group(s, "([A-Ha-h])", 1)), s)


def true_or_false(c: Column, strict: bool = True) -> Column:
    """正确 or 错误; with ``strict`` (as published) 不正确 counts as 正确, because that word is looked for first."""
    s = F.lower(strip(c))
    positive, negative = s.contains("正确"), s.contains("错误")
    if not strict:
        positive, negative = positive & ~s.contains("不正确"), negative | s.contains("不正确")
    return F.when(s.isin(TRUE_WORDS), "正确").when(s.isin(FALSE_WORDS), "错误").when(positive, "正确").when(negative, "错误").otherwise(s)


def number_in(c: Column) -> Column:
    """The number an answer states: all of it, in scientific notation, before a unit, or the first; null if none."""
    s = strip(c)
    read = lambda x: x.try_cast("double")
    return F.coalesce(F.when(s.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), read(s)), read(_group(s, r"([-+]?\d*\.?\d+[eE][-+]?\d+)", 1)), read(_group(s, r"([-+]?\d*\.?\d+)\s*[a-zA-Z%°]", 1)), read(_group(s, r"([-+]?\d+\.?\d*)", 1)))


def within(predicted: Column, gold: Column, tolerance: float = 0.05) -> Column:
    return F.when(gold == 0, F.abs(predicted) < 0.001).otherwise(F.try_divide(F.abs(predicted - gold), F.abs(gold)) < tolerance)


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(normalize_answer(c)), " "), lambda w: w != ""))


def token_f1(predicted: Column, gold: Column) -> Column:
    """F1 of the two sets of words; 0 if either is empty or they share none."""
    a, b = words(predicted), words(gold)
    n = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(F.try_divide(2 * n, F.size(a) + F.size(b)), F.lit(0.0))


def keyword_recall(predicted: Column, gold: Column) -> Column:
    """Share of the gold answer's words that the prediction has; null if it has none."""
    a, b = words(predicted), words(gold)
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(b))


def metrics(task: Column, question: Column, options: Column, predicted: Column, gold: Column) -> Column:
    """(is_correct, exact_match, f1, numeric_score); only those that the item's branch sets are not null."""
    p, g = F.coalesce(predicted, F.lit("")), F.coalesce(gold, F.lit(""))
    q = F.coalesce(question, F.lit(""))
    choice = F.coalesce(F.size(options) >= 2, F.lit(False))
    binary = (F.coalesce(task, F.lit("")) == "exam_true_false") | q.contains("判断") | q.contains("是否")
    numeric = (F.coalesce(task, F.lit("")) == "exam_calculation") | q.contains("计算")
    same_letter, same_truth = choice_letter(p) == choice_letter(g), true_or_false(p) == true_or_false(g)
    close = F.coalesce(within(number_in(p), number_in(g)), F.lit(False))
    exact = normalize_answer(p) == normalize_answer(g)
    both = number_in(p).isNotNull() & number_in(g).isNotNull()
    none = F.lit(None)
    return F.struct(
        F.when(choice, same_letter).when(binary, same_truth).when(numeric, close).when(exact, F.lit(True)).alias("is_correct"),
        F.when(choice, same_letter).when(binary, same_truth).when(numeric, none.cast("boolean")).otherwise(exact).alias("exact_match"),
        F.when(choice | binary | numeric, none.cast("double")).otherwise(token_f1(p, g)).alias("f1"),
        F.when(~choice & ~binary & numeric & both, F.when(close, 1.0).otherwise(0.0)).alias("numeric_score"),
    )


def error_kind(task: Column, error: Column, response: Column) -> Column:
    """Category of a wrong answer, first rule that holds. ``rate`` also hits words that contain it, as published."""
    e = F.lower(error)
    t = F.coalesce(task, F.lit(""))
    return (
        F.when(e.contains("multimodal") | e.contains("image"), "multimodal_input_failure").when(e.contains("format") | e.contains("parse"), "format_error").when(e.contains("timeout") | e.contains("rate"), "refusal_or_empty_answer")
        .when(F.coalesce(F.length(strip(response)), F.lit(0)) < 2, "refusal_or_empty_answer").when(t == "exam_calculation", "calculation_error").when(t.isin("visual_qa", "defect_diagnosis", "diagram_reasoning"), "visual_perception_error")
        .when(t == "chart_reading", "chart_reading_error").when(t == "ocr_reasoning", "ocr_reasoning_error").when(t == "agent_task", "agent_planning_failure").when(t.isin("exam_single_choice", "exam_multiple_choice"), "option_parsing_error").otherwise("reasoning_error")
    )


def json_part(c: Column, bracket: str = "{") -> Column:
    """Text from the first opening to the last closing bracket; null if there is none."""
    return _group(c, r"(?s)(\{.*\})" if bracket == "{" else r"(?s)(\[.*\])", 1)


def parsed(c: Column, schema: str, bracket: str = "{") -> Column:
    """The JSON in a text as a struct, null where it cannot be read."""
    return F.from_json(json_part(c, bracket), schema, {"mode": "PERMISSIVE"})


def needs_judge(task: Column, exact: Column, options: Column, open_tasks: list[str]) -> Column:
    return F.coalesce(task.isin(open_tasks), F.lit(False)) | (~F.coalesce(exact, F.lit(True)) & (F.coalesce(F.size(options), F.lit(0)) <= 0))


def judged_correct(verdict: Column, score: Column) -> Column:
    return F.coalesce((verdict == "correct") | ((verdict == "partial") & (score >= 0.6)), F.lit(False))


def answer_form(options: Column, answer: Column) -> Column:
    """multiple_choice, true_false, text_answer or no_answer."""
    return F.when(F.coalesce(F.size(options), F.lit(0)) > 0, "multiple_choice").when(F.lower(answer).isin("true", "false", "对", "错", "正确", "错误"), "true_false").when(F.coalesce(F.length(strip(answer)), F.lit(0)) > 0, "text_answer").otherwise("no_answer")
