"""Problem 2: evaluation texts in training text.

Spaced seeds: a window's hash ignores the token positions where its mask has a 0, so a seed also hits where single tokens
were substituted. Test texts give hashes at every stride-th position, chosen so that each passage of the least length holds one;
corpus windows, all of them, pass a bounded Bloom filter of the test hashes, and what is left is joined by hash. For more test hashes than the
filter takes, bare windows (hash, text, position) are joined first, and only those that meet one are looked up in their texts.
Both sides carry the tokens around their seed, as far as a passage through it can matter, so overlaps are
verified in the join's rows: the longest exact run, and the window of the least length with the most matching tokens.

Equal texts of one side are one class, so a text that recurs any number of times is scanned and compared once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm import filters, tokens
from plinth.llm.registry import query
from plinth.runtime import Stage, ship, table


@dataclass(frozen=True)
class Kind:
    """Passages of ``least`` tokens or more count; masks of one span, 1 for a position that counts."""

    name: str
    least: int
    masks: tuple[str, ...]

    @property
    def span(self) -> int:
        return len(self.masks[0])

    @property
    def stride(self) -> int:
        return self.least - self.span + 1

    @property
    def reach(self) -> int:
        """Tokens to each side of a seed that a passage of the least length through it may need."""
        return self.least


KINDS = (Kind("en", 12, ("1101110111", "1110101111")), Kind("zh", 24, ("1110110111011011", "1101111010111011")))


def seeds(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of the window at each position of ``h`` that has room for the mask."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    r = np.random.default_rng(1000 + salt).integers(1, 1 << 63, len(mask), dtype=np.uint64) | np.uint64(1)
    out = np.full(n, np.uint64(salt), np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            out += h[j : j + n] * r[j]
    return tokens.mix(out)


FOUND = "seed bigint, rec bigint, kind int, context binary, at int"


def binary(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The stretches from ``lo`` to ``hi`` of ``words`` as one binary value each."""
    n = hi - lo
    offsets = np.concatenate([[0], np.cumsum(n)])
    flat = words[np.repeat(lo, n) + np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], n)]
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((offsets * 4).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


def scan(batch: pa.RecordBatch, choose) -> Iterator[pa.RecordBatch]:
    """Rows of FOUND for (rec, text[, kind or positions]); ``choose(kind index, seeds, position in text, row)`` says which windows stay."""
    recs, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
    only = batch.column(2).to_numpy(zero_copy_only=False) if batch.num_columns > 2 and pa.types.is_integer(batch.column(2).type) else None
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < 1_000_000 or end == at):
            size += len(texts[end] or "")
            end += 1
        doc, _, h = tokens.sequence(tokens.chars(texts[at:end]))
        bounds = np.searchsorted(doc, np.arange(end - at + 1))
        h32 = h.astype(np.uint32)
        place = np.arange(len(h)) - bounds[doc] if len(h) else np.zeros(0, np.int64)
        for ki, kind in enumerate(KINDS):
            fits = np.flatnonzero(place + kind.span <= (bounds[doc + 1] - bounds[doc])) if len(h) else np.zeros(0, np.int64)
            if only is not None:
                fits = fits[only[at + doc[fits]] == ki]
            for mi, mask in enumerate(kind.masks) if len(fits) else ():
                s = seeds(h, mask, 2 * ki + mi)[fits]
                keep = np.flatnonzero(choose(ki, s, place[fits], at + doc[fits]))
                i = fits[keep]
                lo, hi = np.maximum(bounds[doc[i]], i - kind.reach), np.minimum(bounds[doc[i] + 1], i + kind.span + kind.reach)
                yield pa.RecordBatch.from_arrays([pa.array(s[keep].view(np.int64)), pa.array(recs[at + doc[i]]), pa.array(np.full(len(i), ki, np.int32)), binary(h32, lo, hi), pa.array((i - lo).astype(np.int32))], ["seed", "rec", "kind", "context", "at"])
        at = end


def test_seeds(items: DataFrame) -> DataFrame:
    """Seeds of the test texts (rec, text, kind): every stride-th window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from scan(b, lambda k, s, place, row: place % KINDS[k].stride == 0)

    return items.select("rec", "text", "kind").mapInArrow(run, FOUND)


def corpus_seeds(corpus: DataFrame, probe: DataFrame, n: int, most: int) -> DataFrame:
    """Seeds of the windows of the corpus (rec, text) that test seeds may equal."""
    held = filters.build(probe.select("seed"), n, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from scan(b, lambda k, s, place, row: filters.contains(held[0].value, held[1], s))

    if held is not None:
        return corpus.select("rec", "text").mapInArrow(run, FOUND)

    def bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spots: list[np.ndarray] = []

            def note(k, s, place, row):
                spots.append(place)
                return np.ones(len(s), bool)

            for got, place in zip(scan(b, note), spots, strict=False):
                yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), pa.array(place.astype(np.int32))], ["seed", "rec", "place"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where = [set(p) for p in b.column(2).to_pylist()]
            yield from scan(b, lambda k, s, place, row: np.fromiter((p in where[r] for p, r in zip(place.tolist(), row.tolist(), strict=True)), bool, len(s)))

    met = corpus.select("rec", "text").mapInArrow(bare, "seed bigint, rec bigint, place int").join(probe.select("seed").distinct(), "seed", "left_semi")
    return corpus.join(met.groupBy("rec").agg(F.collect_set("place").alias("places")), "rec").select("rec", "text", "places").mapInArrow(again, FOUND)  # places of one text


def aligned(context: pa.Array, at: np.ndarray, kind: Kind) -> np.ndarray:
    """The contexts as rows of one width with their seeds in the same column; 0 where a text does not reach."""
    n = np.array([len(x) // 4 for x in context.to_pylist()], np.int64)
    flat = np.frombuffer(b"".join(context.to_pylist()), np.uint32)
    out = np.zeros((len(n), 2 * kind.reach + kind.span), np.uint32)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(kind.reach - at, n)] = flat
    return out


def overlap_of(x: np.ndarray, y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(longest exact run, most matching tokens in ``least`` consecutive ones) of aligned contexts."""
    same = (x == y) & (x != 0)
    run = np.zeros(len(same), np.int32)
    best = run.copy()
    for c in range(same.shape[1]):
        run = np.where(same[:, c], run + 1, 0)
        best = np.maximum(best, run)
    total = np.concatenate([np.zeros((len(same), 1), np.int32), np.cumsum(same, axis=1, dtype=np.int32)], axis=1)
    return best.astype(np.int32), (total[:, least:] - total[:, :-least]).max(axis=1).astype(np.int32)


def overlaps(test: DataFrame, corpus: DataFrame, stage: Stage, most: int = filters.MAX_BITS) -> DataFrame:
    """(test_id, corpus_id, kind, run, same): longest exact run and best tolerant window of each pair that shares a seed.

    ``test``: id, text, kind (index into KINDS); ``corpus``: id, text. Null and empty texts have no seeds; repeated rows of
    an id count once. An exact run is complete up to the least length and the reach beyond it; ``same`` is the most matching tokens in as many
    consecutive aligned ones as the least length has. ``most``: as of ``filters``.
    """
    ship(test.sparkSession)
    test = stage.keep(test.filter("id is not null and text is not null").withColumn("rec", F.xxhash64("text", "kind")).select("rec", "id", "text", "kind"), "items")
    corpus = corpus.filter("id is not null and text is not null").withColumn("rec", F.xxhash64("text"))
    member = stage.keep(corpus.select("rec", "id").distinct(), "member")
    probe = stage.keep(test_seeds(test.dropDuplicates(["rec"])).distinct(), "test")
    hits = corpus_seeds(corpus.select("rec", "text"), probe, probe.count(), most)
    joined = hits.withColumnsRenamed({"rec": "c", "context": "c2", "at": "at2"}).join(probe.withColumnRenamed("rec", "t"), ["seed", "kind"]).select("t", "c", "kind", "context", "at", "c2", "at2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = b.column(2).to_numpy()
            for ki, kind in enumerate(KINDS):
                mine = b.filter(pa.array(kinds == ki))
                if len(mine):
                    best, same = overlap_of(aligned(mine.column(3), mine.column(4).to_numpy(), kind), aligned(mine.column(5), mine.column(6).to_numpy(), kind), kind.least)
                    yield pa.RecordBatch.from_arrays([*mine.columns[:3], pa.array(best), pa.array(same)], ["t", "c", "kind", "run", "same"])

    # a window of the corpus that meets many copies of the test text's wording comes with each; pairs of classes are made one before ids are joined
    pairs = joined.mapInArrow(run, "t bigint, c bigint, kind int, run int, same int").groupBy("t", "c", "kind").agg(F.max("run").alias("run"), F.max("same").alias("same"))
    named = pairs.join(test.select(F.col("rec").alias("t"), F.col("id").alias("test_id")).distinct(), "t").join(member.select(F.col("rec").alias("c"), F.col("id").alias("corpus_id")), "c")
    return named.groupBy("test_id", "corpus_id", "kind").agg(F.max("run").alias("run"), F.max("same").alias("same"))


def test_texts(spark, d: str) -> DataFrame:
    """(id, text, kind): question and gold answer of each evaluated item, without the prompts' shared wording and options.

    The question is the item's; where an evaluated item is not in benchmark_item, it is what stands in its prompt
    between the wording that ends in a heading and the first option.
    """
    items = table(spark, d, "benchmark_item").select("benchmark_id", "question", "answer")
    ran = table(spark, d, "evaluation_result").select("benchmark_id", "prompt", "gold_answer")
    body = F.regexp_replace(F.regexp_replace("prompt", r"(?s)^.*?\n\n[^\n:：]{0,20}[:：]\s*", ""), r"(?s)\n[A-H][.、] .*$", "")
    rows = items.select("benchmark_id", F.explode(F.array("question", "answer")).alias("text"), F.col("question").alias("q"))
    gold = ran.select("benchmark_id", F.col("gold_answer").alias("text"), body.alias("q")).distinct()
    asked = ran.join(items, "benchmark_id", "left_anti").select("benchmark_id", body.alias("text"), body.alias("q"))
    every = rows.unionByName(gold).unionByName(asked).filter("text is not null")
    # an item is Chinese if its question is
    chinese = F.regexp_count(F.coalesce("q", "text"), F.lit("[㐀-鿿]")) * 4 > F.length(F.coalesce("q", "text"))
    return every.select(F.col("benchmark_id").alias("id"), "text", F.when(chinese, 1).otherwise(0).alias("kind")).distinct()


def leaks(spark, d: str) -> DataFrame:
    corpus = table(spark, d, "cleaned_chunk").select(F.col("chunk_id").alias("id"), F.col("cleaned_text").alias("text"))
    return overlaps(test_texts(spark, d), corpus, Stage(spark, "p2"))


@query("p2_found")
def p2_found(spark, d):
    least = F.element_at(F.array(*[F.lit(k.least) for k in KINDS]), F.col("kind") + 1)
    return leaks(spark, d).filter(F.col("run") >= least).select(F.col("test_id").alias("benchmark_id"), F.col("corpus_id").alias("chunk_id")).distinct()


#: Share of a window of the least length that must match in a tolerant overlap: 10 of 12 tokens, 20 of 24.
TOLERANT = 5 / 6


@query("p2_overlaps")
def p2_overlaps(spark, d):
    """Overlaps with substitutions: pairs with at least TOLERANT of the tokens alike in one aligned window of the least length."""
    least = F.element_at(F.array(*[F.lit(k.least) for k in KINDS]), F.col("kind") + 1)
    return leaks(spark, d).filter(F.col("same") >= TOLERANT * least).select(F.col("test_id").alias("benchmark_id"), F.col("corpus_id").alias("chunk_id"), "run", "same", (F.col("run") >= least).alias("exact"))
