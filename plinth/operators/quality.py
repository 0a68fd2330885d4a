"""Rule-based quality of samples: issues and penalties as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinth.functions.answers import NO_ANSWER
from plinth.functions.text import DOMAIN_TERMS, contains_any, strip


def overlap_words(c: Column, most: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.substring(c, 1, most), F.lit(r"(?U)([\w一-鿿]+)"), 1))


def issues(instruction: Column, output: Column, evidence: Column, extra: list[tuple[Column, str, float]] = ()) -> tuple[Column, Column]:
    """(issues, score): names of the triggered rules in order, and 1 less their penalties within 0 and 1. Nulls count as empty."""
    i, o = F.coalesce(instruction, F.lit("")), F.coalesce(output, F.lit(""))
    e = F.array_join(F.slice(F.coalesce(evidence, F.array().cast("array<string>")), 1, 3), " ")
    words = overlap_words(o, 200)
    low = (F.coalesce(F.size(evidence), F.lit(0)) > 0) & (F.size(F.array_intersect(words, overlap_words(e, 500))) < 2) & (F.size(words) > 5)
    noise = (o != "") & (F.length(F.regexp_replace(o, r"(?U)[^\w\s]", "")) < F.length(o) * 0.3)
    rules = [
        (F.length(strip(i)) < 5, "empty_or_short_instruction", 0.5), (F.length(strip(o)) < 2, "empty_output", 0.5), (F.length(o) > 5000, "output_too_long", 0.2),
        *[(o.contains(m), f"no_answer: {m}", 0.3) for m in NO_ANSWER], (noise, "output_mostly_noise", 0.4),
        (~contains_any(F.concat(i, o), DOMAIN_TERMS), "no_domain_relevance", 0.3), (low, "low_evidence_support", 0.2), *extra,
    ]
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n, _ in rules]))
    lost = sum((F.when(c, p).otherwise(0.0) for c, _, p in rules), F.lit(0.0))
    return names, F.greatest(F.lit(0.0), 1 - lost)


def first_reason(*rules: tuple[Column, str]) -> Column:
    """Name of the first rule that holds, null if none does."""
    out = F.when(rules[0][0], rules[0][1])
    for c, n in rules[1:]:
        out = out.when(c, n)
    return out
