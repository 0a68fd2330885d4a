"""Records for training: unions of pools and message formats. Nulls count as empty text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def request(instruction: Column, extra: Column) -> Column:
    return F.concat(_text(instruction), F.when(_text(extra) != "", F.concat(F.lit("\n\n"), extra)).otherwise(""))


def _pairs(system: Column, user: Column, answer: Column, names: tuple[str, str], roles: tuple[str, str, str]) -> Column:
    one = lambda role, c: F.struct(F.lit(role).alias(names[0]), c.alias(names[1]))
    return F.array_compact(F.array(F.when(_text(system) != "", one(roles[0], system)), one(roles[1], user), one(roles[2], _text(answer))))


def chat(system: Column, instruction: Column, extra: Column, output: Column) -> Column:
    """Array of (role, content); the system message only where there is one."""
    return _pairs(system, request(instruction, extra), output, ("role", "content"), ("system", "user", "assistant"))


def turns(system: Column, instruction: Column, extra: Column, output: Column) -> Column:
    """Array of (from, value)."""
    return _pairs(system, request(instruction, extra), output, ("from", "value"), ("system", "human", "gpt"))


def instruction(instruction: Column, extra: Column, output: Column) -> Column:
    return F.struct(_text(instruction).alias("instruction"), _text(extra).alias("input"), _text(output).alias("output"))
