"""Rows to prompts to replies to rows, with a pluggable client.

A client has ``reply(prompt) -> str``. One client is made per task, so connections, retries and rate limits
live on the executor; the offline client answers from the prompt alone and calls nothing.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Client(Protocol):
    def reply(self, prompt: str) -> str: ...


class OfflineClient:
    """Replies with the sentences of the prompt as a JSON list of claims."""

    def reply(self, prompt: str) -> str:
        sentences = [s for s in prompt.replace("。", "。\n").replace(". ", ".\n").split("\n") if s.strip()]
        return json.dumps([{"claim": s.strip(), "kind": "fact"} for s in sentences], ensure_ascii=False)


class Retrying:
    """Tries a client again with growing pauses; the last error is raised."""

    def __init__(self, client: Client, tries: int = 3, pause: float = 0.5):
        self.client, self.tries, self.pause = client, tries, pause

    def reply(self, prompt: str) -> str:
        for k in range(self.tries):
            try:
                return self.client.reply(prompt)
            except Exception:
                if k + 1 == self.tries:
                    raise
                time.sleep(self.pause * 2**k)
        return ""


def replies(df: DataFrame, key: str, make: Callable[[], Client], prompt: str = "prompt") -> DataFrame:
    """(key, reply, error): errors are data, not failures of the task. Null prompts get no call and a null reply."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for f in frames:
            out = []
            for k, p in zip(f["key"], f["prompt"], strict=True):
                try:
                    out.append((k, None if p is None else client.reply(p), None))
                except Exception as e:  # noqa: BLE001
                    out.append((k, None, str(e)[:500]))
            yield pd.DataFrame(out, columns=["key", "reply", "error"])

    src = df.select(F.col(key).alias("key"), F.col(prompt).alias("prompt"))
    return src.mapInPandas(run, f"key {dict(src.dtypes)['key']}, reply string, error string").withColumnRenamed("key", key)


def extract_one(df: DataFrame, key: str, make: Callable[[], Client], schema: str) -> DataFrame:
    """(key, *fields, parsed): the JSON object in the reply; fields are null and ``parsed`` false where there is none."""
    r = replies(df, key, make)
    s = F.from_json(F.when(F.col("reply").rlike(r"(?s)\{.*\}"), F.regexp_extract("reply", r"(?s)(\{.*\})", 1)), schema)
    return r.withColumn("j", s).select(key, "j.*", F.col("j").isNotNull().alias("parsed"))


def extract_many(df: DataFrame, key: str, make: Callable[[], Client], schema: str) -> DataFrame:
    """(key, place, *fields, parsed): one row per object of the JSON array in the reply, or one fallback row."""
    r = replies(df, key, make)
    a = F.from_json(F.when(F.col("reply").rlike(r"(?s)\[.*\]"), F.regexp_extract("reply", r"(?s)(\[.*\])", 1)), f"array<struct<{', '.join(':'.join(x.split()) for x in schema.split(','))}>>")
    return r.withColumn("a", a).select(key, F.posexplode_outer("a").alias("place", "j")).select(key, "place", "j.*", F.col("j").isNotNull().alias("parsed"))
