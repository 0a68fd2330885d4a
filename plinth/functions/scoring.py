"""Lenient scores of answers, replies of judges, actions, context costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinth.functions.text import estimate_tokens, strip

# Fixed values.
MARKERS = ["答案：", "答案:", "Answer:", "answer:", "选项：", "选项:"]
JUDGE_WEIGHTS = {"correctness": 0.4, "semantic_equivalence": 0.2, "evidence_support": 0.2, "reasoning_quality": 0.1, "format_validity": 0.05}
AGENTS = 5


def _first_letter(c: Column) -> Column:
    u = F.upper(c)
    return F.when(u.rlike("[A-H]"), F.regexp_extract(u, "([A-H])", 1))


def _folded(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " ")


def _words(c: Column, least: int = 1) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)([\w一-鿿]{%d,})" % least), 1))


def strict_score(predicted: Column, gold: Column, form: Column, options: Column) -> Column:
    """(letter_correct, normalized_correct, keyword_recall, strict_correct). Empty or null texts score nothing."""
    p, g = F.coalesce(predicted, F.lit("")), F.coalesce(gold, F.lit(""))
    some = (p != "") & (g != "")
    choice = (form == "multiple_choice_letter") | F.coalesce(F.size(options) >= 2, F.lit(False))
    letter = some & choice & F.coalesce(_first_letter(p) == _first_letter(g), F.lit(False))
    same = some & (_folded(p) == _folded(g))
    a, b = _words(p), _words(g)
    recall = F.when(some, F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(b)), F.lit(0.0))).otherwise(0.0)
    strict = letter | same | (some & (form == "open_ended") & (F.round(recall, 4) > 0.5))
    return F.struct(letter.alias("letter_correct"), same.alias("normalized_correct"), F.round(recall, 4).alias("keyword_recall"), strict.alias("strict_correct"))


def lenient_score(predicted: Column, gold: Column, choice: Column, recall_over: float = 0.4) -> Column:
    """Whether an answer counts: its letter after the last marker, most lines of a gold list, enough keywords, equal texts, or a short gold text within it."""
    p, g = F.coalesce(predicted, F.lit("")), F.coalesce(gold, F.lit(""))
    marked = p
    for m in reversed(MARKERS):
        marked = F.when(p.contains(m), F.substring(F.substring_index(p, m, -1), 1, 20)).otherwise(marked)
    letter = choice & F.coalesce(_first_letter(marked) == _first_letter(g), F.lit(False))
    lines = F.filter(F.transform(F.split(g, "\n"), strip), lambda x: F.length(x) > 2)
    listed = g.contains("\n") & F.coalesce(F.try_divide(F.size(F.filter(lines, lambda x: p.contains(x))).cast("double"), F.size(lines)) > 0.5, F.lit(False))
    a, b = _words(F.substring(p, 1, 500), 2), _words(F.substring(g, 1, 300), 2)
    words = F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(b)) > recall_over, F.lit(False))
    inside = (F.length(g) < 50) & p.contains(strip(g))
    return (p != "") & (g != "") & (letter | listed | words | (_folded(p) == _folded(g)) | inside)


def judge_reply(c: Column) -> Column:
    """(final_score, verdict) of a judge's JSON reply: the score from its parts where it is 0, the verdict from the score where it is missing; ``invalid`` if nothing can be read."""
    fields = [*JUDGE_WEIGHTS, "hallucination", "final_score"]
    j = F.from_json(F.when(c.rlike(r"(?s)\{.*\}"), F.regexp_extract(c, r"(?s)(\{.*\})", 1)), ", ".join(f"{f} double" for f in fields) + ", verdict string, _corrupt_record string")
    ok = j.isNotNull() & j["_corrupt_record"].isNull()
    get = lambda f, d=0.0: F.coalesce(j[f], F.lit(d))
    semantic = F.coalesce(j["semantic_equivalence"], get("evidence_support"))
    parts = get("correctness") * 0.4 + semantic * 0.2 + get("evidence_support") * 0.2 + get("reasoning_quality") * 0.1 + (1 - get("hallucination")) * 0.05 + get("format_validity") * 0.05
    score = F.when(~ok, 0.0).when(get("final_score") == 0, parts).otherwise(get("final_score"))
    verdict = F.when(~ok, "invalid").when(F.coalesce(j["verdict"], F.lit("")) != "", j["verdict"]).when(score >= 0.75, "correct").when(score >= 0.45, "partially_correct").otherwise("incorrect")
    return F.struct(score.alias("final_score"), verdict.alias("verdict"))


def action(c: Column) -> Column:
    """(tool, argument) of the first line ``Action: [tool] [argument]`` or ``Action: tool argument``; nulls without one."""
    line = F.get(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: F.lower(x).startswith("action:")), 0)
    body = strip(F.substring(line, 8, 1_000_000))
    bracket = body.rlike(r"^\[[^\]]*\]")
    rest = strip(F.regexp_replace(body, r"^\[[^\]]*\]", ""))
    tool = F.when(bracket, strip(F.regexp_extract(body, r"^\[([^\]]*)\]", 1))).when(body != "", F.regexp_extract(body, r"^(\S+)", 1))
    argument = F.when(bracket, F.when(rest.rlike(r"^\[[^\]]*\]"), strip(F.regexp_extract(rest, r"^\[([^\]]*)\]", 1))).otherwise(rest)).when(body != "", strip(F.regexp_replace(body, r"^\S+", "")))
    return F.struct(tool.alias("tool"), argument.alias("argument"))


def context_costs(full: Column) -> Column:
    """(system, context_tokens, saving) for six ways of passing on a context of ``full`` text."""
    n = estimate_tokens(full).cast("bigint")
    half, third, selected = F.floor(n / 2), F.floor(n / 3), F.floor(n * 0.37)
    saving = lambda x: F.coalesce(1 - F.try_divide(x.cast("double"), n), F.lit(0.0))
    rows = [("direct", F.lit(0).cast("bigint"), F.lit(1.0)), ("react", n, F.lit(0.0)), ("plan_execute", half, F.when(n > 0, saving(half)).otherwise(0.0)), ("broadcast", n * AGENTS, F.lit(0.0)), ("static", third, F.when(n > 0, saving(third)).otherwise(0.0)), ("selected", selected, F.when(n > 0, saving(selected)).otherwise(0.0))]
    return F.array(*[F.struct(F.lit(s).alias("system"), t.cast("bigint").alias("context_tokens"), v.cast("double").alias("saving")) for s, t, v in rows])


def flat_evidence(c: Column) -> Column:
    """Evidence of any JSON shape as one text: a string itself, an array's strings and its objects' text or content, one a line; other values as JSON."""
    v = F.try_parse_json(c)
    items = F.from_json(F.when(c.rlike(r"^\s*\["), c), "array<string>")
    text = lambda x: F.coalesce(F.get_json_object(x, "$.text"), F.get_json_object(x, "$.content"), x)
    plain = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.when(c.isNull() | (F.trim(c) == "") | (F.trim(c) == "null"), "").when(items.isNotNull(), F.array_join(F.transform(items, text), "\n")).otherwise(F.coalesce(plain, c))
