"""Problem 7: same or near-same records across splits.

The texts, concatenated, have a suffix at every token. A suffix's rank among all is that of its first m tokens, then of its first 2m, 4m and
so on to its end, hashes that prefix doubling gives within the text's row. Ordered by these ranks and partitioned by ranges of them, the
suffixes form an array in which those with a common prefix of m tokens or more stand together, the longer its common
prefix the closer. Suffixes whose first m tokens occur on one side only have no such partner and leave before the order is made
(two Bloom filters, or a join of the hashes where these would be too full).

Each held-out suffix is compared with its neighbours from train, above and below, also beyond the range's edge. Their common prefixes are
shared spans, which are merged per text to the share of it that train covers; texts that are neighbours are candidate pairs. Only neighbours
meet, so a passage that a third of all texts begin with costs no more than its length.

A pair need not have a long common span (reordered items, a word replaced in every few, one of many copies), so the exact set
join of held-out and train texts, which goes by their rare tokens, gives all pairs that its bounds do not exclude, too. Either
way a pair is only a candidate until its token sets are compared. Records with equal token sets are one class on each side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm import filters, sets, tokens
from plinth.llm.registry import query
from plinth.llm.splits import plain, split_name
from plinth.runtime import Stage, ship, table

#: m, the least common prefix in tokens: of suffixes that begin with a word, with a CJK character.
LEAST = (8, 16)
SUFFIX = "ranks array<bigint>, rec bigint, at int, m int, size int"


def joined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    """Hash of the tokens of ``a`` followed by those of ``b`` ``shift`` places later; the last ``shift`` places wrap and are not to be used."""
    return tokens.mix(a * np.uint64(0x9E3779B97F4A7C15) + np.roll(b, -shift) + np.uint64(shift))


def first_rank(h: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of the first LEAST tokens of each suffix, by doubling."""
    out, width = {}, 1
    while width < max(LEAST):
        h = joined(h, h, width)
        width *= 2
        out[width] = h
    return {m: out[m] for m in LEAST}


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list]]:
    """(recs, texts) of at most some million characters at once; a text that comes again in the partition is left out."""
    seen: set[int] = set()
    for b in batches:
        recs, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
        fresh = []
        for i, r in enumerate(recs.tolist()):
            if r not in seen:
                seen.add(r)
                fresh.append(i)
        if len(seen) > 500_000:
            seen.clear()
        at = 0
        while at < len(fresh):
            end, size = at, 0
            while end < len(fresh) and (size < 2_000_000 or end == at):
                size += len(texts[fresh[end]] or "")
                end += 1
            mine = fresh[at:end]
            yield recs[mine], [texts[i] for i in mine]
            at = end


def begin(texts: list) -> tuple[np.ndarray, ...]:
    """(text, its first suffix, its length, hash, m, rank) of each suffix of texts; rank is that of the first m tokens, suffixes shorter than m have m = 0."""
    doc, at, h = tokens.sequence(c := tokens.chars(texts))
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    left = bounds[doc + 1] - np.arange(len(doc))
    r = first_rank(h)
    cjk = c.cls[at] == 2
    m = np.where(cjk, LEAST[1], LEAST[0])
    return doc, bounds[doc], np.diff(bounds)[doc], h, np.where(left >= m, m, 0), np.where(cjk, r[LEAST[1]], r[LEAST[0]])


def first_ranks(texts: DataFrame) -> DataFrame:
    """(h) of every suffix of texts (rec, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ts in slices(batches):
            *_, m, rank = begin(ts)
            yield pa.RecordBatch.from_arrays([pa.array(rank[m > 0].view(np.int64))], ["h"])

    return texts.select("rec", "text").mapInArrow(run, "h bigint")


def suffixes(texts: DataFrame, held: tuple | None) -> DataFrame:
    """Rows of SUFFIX of the suffixes of texts (rec, text) whose first rank the filter ``held``, if there is one, lets through; m: tokens of the first rank, size: tokens of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for recs, ts in slices(batches):
            doc, first, size, h, m, rank = begin(ts)
            keep = m > 0
            if held is not None:
                keep[keep] = filters.contains(held[0].value, held[1], rank[keep])
            i = np.flatnonzero(keep)
            # the first 2m, 4m, ... tokens, as far as the text goes
            left = (size - (np.arange(len(doc)) - first))[i]
            levels = np.floor(np.log2(np.maximum(left, 1) / m[i])).astype(np.int64) + 1
            offsets = np.concatenate([[0], np.cumsum(levels)])
            flat = np.zeros(int(offsets[-1]), np.uint64)
            flat[offsets[:-1]] = rank[i]
            width, r = 1, h
            while len(i) and width * 2 <= left.max():
                r = joined(r, r, width)
                width *= 2
                k = np.flatnonzero((width > m[i]) & (width <= left))
                flat[offsets[k] + np.log2(width // m[i][k]).astype(np.int64)] = r[i[k]]
            ranks = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([ranks, pa.array(recs[doc[i]]), pa.array((np.arange(len(doc)) - first)[i].astype(np.int32)), pa.array(m[i].astype(np.int32)), pa.array(size[i].astype(np.int32))], ["ranks", "rec", "at", "m", "size"])

    return texts.select("rec", "text").mapInArrow(run, SUFFIX)


def partnered(stage: Stage, texts: DataFrame, about: int, most: int) -> DataFrame:
    """SUFFIX and kind of the suffixes of held-out (kind 0) and train (kind 1) texts whose first m tokens occur on both sides, or nearly only these; ``about``: how many suffixes are held out."""
    held, train = texts.filter("kind = 0"), texts.filter("kind = 1")
    bloom = filters.build(first_ranks(held), about, most)
    if bloom is None:
        first = F.col("ranks")[0] == F.col("h")
        x = suffixes(held, None).join(first_ranks(train).distinct(), first, "left_semi")
        y = suffixes(train, None).join(first_ranks(held).distinct(), first, "left_semi")
    else:
        stage.hold(bloom[0])
        y = stage.keep(suffixes(train, bloom), "train")
        both = filters.build(y.select(F.col("ranks")[0].alias("h")), about, most)
        stage.hold(both[0])
        x = suffixes(held, both)
    return x.withColumn("kind", F.lit(0)).unionByName(y.withColumn("kind", F.lit(1)))


NEAR = "rec bigint, at int, size int, m int, side int, p int, partner bigint, k int, ranks array<bigint>"


def levels(ranks: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(number of ranks, ranks as a matrix) of each suffix."""
    offsets = ranks.offsets.to_numpy()
    n = np.diff(offsets)
    out = np.zeros((len(n), max(1, int(n.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)] = ranks.values.to_numpy()[offsets[0] : offsets[-1]]
    return n, out


def compare(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """For the ordered suffixes (SUFFIX, kind) of one range: each held-out one's neighbours from train above and below it (side 0 and 1) with the number k of ranks in common, if there is any.

    A held-out suffix whose neighbour lies beyond the range's edge comes with its ranks and k null; the range's outermost suffixes of train (side 2 and 3) come, too.
    """
    held: pa.RecordBatch | None = None
    first = last = None

    def rows(b: pa.RecordBatch, i: np.ndarray, side: np.ndarray, partner=None, k=None, ranks: bool = False) -> pa.RecordBatch:
        t, idx = len(i), pa.array(i)
        of = lambda c: b.column(c).take(idx)
        null = lambda kind: pa.nulls(t, kind)
        return pa.RecordBatch.from_arrays([of("rec"), of("at"), of("size"), of("m"), pa.array(side.astype(np.int32)), pa.array(np.full(t, part, np.int32)), null(pa.int64()) if partner is None else pa.array(partner), null(pa.int32()) if k is None else pa.array(k.astype(np.int32)), of("ranks").cast(pa.list_(pa.int64())) if ranks else null(pa.list_(pa.int64()))], [c.split()[0] for c in NEAR.split(", ")])

    def settle(b: pa.RecordBatch, final: bool) -> Iterator[pa.RecordBatch]:
        """Answers for all but what follows the last suffix of train, which is kept for the next batch unless ``final``."""
        nonlocal held, first, last
        train = b.column("kind").to_numpy() == 1
        at = np.flatnonzero(train)
        n, ranks = levels(b.column("ranks").cast(pa.list_(pa.int64())))
        rec = b.column("rec").to_numpy()
        if len(at):
            first = first if first is not None else b.slice(int(at[0]), 1)
            last = b.slice(int(at[-1]), 1)
        stop = len(b) if final else int(at[-1]) if len(at) else 0
        # a leading suffix of train that an earlier batch has answered for is only a neighbour
        i = np.flatnonzero(~train[:stop])
        up = np.maximum.accumulate(np.where(train, np.arange(len(b)), -1))[i]
        down = np.minimum.accumulate(np.where(train, np.arange(len(b)), len(b))[::-1])[::-1][i]
        for side, j in ((0, up), (1, down)):
            there = (j >= 0) & (j < len(b))
            x, y = i[there], j[there]
            common = np.zeros(len(x), np.int64)
            alike = np.ones(len(x), bool)
            for c in range(ranks.shape[1]):
                alike &= (n[x] > c) & (n[y] > c) & (ranks[x, c] == ranks[y, c])
                common += alike
            hit = common > 0
            yield rows(b, x[hit], np.full(int(hit.sum()), side), rec[y[hit]], common[hit])
            beyond = i[~there]
            if len(beyond):
                yield rows(b, beyond, np.full(len(beyond), side), ranks=True)
        held = b.slice(stop) if stop < len(b) else None

    for b in batches:
        b = pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(b.columns, (pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["ranks", "rec", "at", "m", "size", "kind"])
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        if len(b):
            yield from settle(b, False)
    if held is not None:
        yield from settle(held, True)
    for side, edge in ((2, first), (3, last)):
        if edge is not None:
            yield rows(edge, np.zeros(1, np.int64), np.array([side]), edge.column("rec").to_numpy(), ranks=True)


def common_prefixes(stage: Stage, texts: DataFrame, about: int, most: int = filters.MAX_BITS) -> DataFrame:
    """(rec, at, size, partner, n): held-out text ``rec`` of ``size`` tokens has from its token ``at`` a prefix of at least n tokens in common with train's text ``partner`` (less than 2n with any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from compare(batches, TaskContext.get().partitionId())

    order = ["ranks", "rec", "at"]
    rows = stage.keep(partnered(stage, texts, about, most), "partnered")
    stage.release()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    met = stage.keep(ranged.mapInArrow(run, NEAR), "met")
    for name in ("partnered", "train"):
        stage.drop(name)
    # neighbours beyond an edge: the outermost suffixes of the ranges before and after, one row per range and side
    edge = met.filter("side > 1").groupBy("p").agg(F.max(F.when(F.col("side") == 2, F.struct("ranks", "partner"))).alias("low"), F.max(F.when(F.col("side") == 3, F.struct("ranks", "partner"))).alias("high"))
    edge = met.select("p").distinct().join(edge, "p", "left")
    before = [Window.partitionBy().orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("p"), F.desc("p"))]
    edge = edge.select("p", F.last("high", True).over(before[0]).alias("above"), F.last("low", True).over(before[1]).alias("below"))
    edge = edge.select("p", F.posexplode(F.array("above", "below")).alias("side", "t"))
    # equal ranks are those of the common prefixes of m, 2m, 4m, ... tokens
    k = F.size(F.filter(F.zip_with("ranks", "t.ranks", lambda a, b: a.eqNullSafe(b)), lambda x: x))
    far = met.filter("side < 2 and k is null").drop("k", "partner").join(edge.filter("t is not null"), ["p", "side"]).withColumn("k", k).filter("k > 0").select("rec", "at", "size", F.col("t.partner").alias("partner"), "m", "k")
    near = met.filter("side < 2 and k is not null").select("rec", "at", "size", "partner", "m", "k").unionByName(far)
    return near.select("rec", "at", "size", "partner", F.expr("m * shiftleft(1, k - 1)").alias("n"))


def merged_spans(prefixes: DataFrame) -> DataFrame:
    """(rec, size, start, stop): stretches of tokens of each held-out text that train has, without gaps or overlaps.

    Every suffix within a shared passage that has m tokens left of it stands in the order, so the union of the prefixes is the passage.
    """
    one = prefixes.groupBy("rec", "at").agg(F.max("size").alias("size"), F.max(F.col("at") + F.col("n")).alias("stop"))
    by_text = Window.partitionBy("rec").orderBy("at")  # a group is one text's positions
    fresh = F.when(F.col("at") <= F.max("stop").over(by_text.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    parts = one.withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(by_text))
    return parts.groupBy("rec", "part").agg(F.max("size").alias("size"), F.min("at").alias("start"), F.max("stop").alias("stop")).drop("part")


def by_sets(stage: Stage, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b), a < b, of the held-out and train classes (kind, sig, toks) that no bound of the exact set join excludes: no similar pair is missing.

    The last bit of ``sig`` is the side; two sides of one list are compared, never a side with itself.
    """
    every = classes.withColumn("kind", F.lit(0))
    counts = sets.count_tokens(every)
    sides = [sets.list_lengths(every.filter(f"sig & 1 = {k}"), counts, num, den) for k in (0, 1)]
    # an entry whose list has none of the other side is left out
    for b in (counts, *sides):
        stage.hold(b)
    entries = [sets.postings(every.filter(f"sig & 1 = {k}"), counts, num, den, sides[0], sides[1]) for k in (0, 1)]
    return sets.candidates(entries[0].unionByName(entries[1]), num, den, across=True)


def prepare(stage: Stage, records: DataFrame, most: int = filters.MAX_BITS) -> dict[str, DataFrame]:
    """Staged tables of the records: ``member`` (id, rec, kind), ``classes`` (sig, toks), ``known`` (rec, kind, sig, n) and ``prefixes``."""
    ship(records.sparkSession)
    rows = records.filter("id is not null and split is not null and text is not null").withColumn("rec", F.xxhash64("text")).withColumn("kind", (F.col("split") == "train").cast("int"))
    member = stage.keep(rows.select("id", "rec", "kind").distinct(), "member")
    # equal sets of one side are one class; the last bit of its key is the side
    classes = stage.keep(sets.tokenise(rows.select("kind", F.col("rec").cast("string").alias("id"), "text")), "sets").withColumn("sig", F.expr("(sig & -2L) | kind"))
    known = stage.keep(classes.groupBy("kind", F.col("id").cast("bigint").alias("rec"), "sig").agg(F.first(F.expr("length(toks) div 4")).alias("n")), "known")
    about = known.filter("kind = 0").agg(F.sum("n")).first()[0] or 0
    return {"member": member, "classes": classes, "known": known, "prefixes": common_prefixes(stage, rows.select("kind", "rec", "text"), about, most)}


def crossing(stage: Stage, records: DataFrame, num: int = 3, den: int = 4, most: int = filters.MAX_BITS) -> DataFrame:
    """(held_id, train_id) of all pairs whose token sets have ``num`` / ``den`` of their union in common.

    ``records``: id, text, split; null splits and other values than train, validation and test take no part. Texts
    without tokens are similar to none. Repeated rows of a record count once. ``most``: as of ``filters``.
    """
    return similar_across(stage, prepare(stage, records, most), num, den)


def similar_across(stage: Stage, t: dict[str, DataFrame], num: int, den: int) -> DataFrame:
    """Pairs of ``crossing`` from its prepared tables."""
    known = t["known"]
    x, y = (known.filter(f"kind = {k}").select(F.col("rec").alias(r), F.col("sig").alias(s), F.col("n").alias(n)) for k, r, s, n in ((0, "rec", "x", "nx"), (1, "partner", "y", "ny")))
    # neighbours in the suffix order whose sets may be similar by their sizes
    spans = t["prefixes"].select("rec", "partner").distinct().join(x, "rec").join(y, "partner").filter(f"{den} * least(nx, ny) >= {num} * greatest(nx, ny)")
    spans = spans.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    near = stage.keep(spans.unionByName(by_sets(stage, t["classes"], num, den)).distinct(), "near")
    stage.release()
    stage.free()
    links = stage.keep(sets.verify(near, t["classes"], num, den), "links")
    for name in ("near", "sets"):
        stage.drop(name)
    ids = t["member"].join(known, ["rec", "kind"]).select("id", "sig").distinct()
    ways = links.select(F.when(F.expr("a & 1 = 0"), F.col("a")).otherwise(F.col("b")).alias("x"), F.when(F.expr("a & 1 = 0"), F.col("b")).otherwise(F.col("a")).alias("y"))
    met = ways.join(ids.select(F.col("sig").alias("x"), F.col("id").alias("held_id")), "x").join(ids.select(F.col("sig").alias("y"), F.col("id").alias("train_id")), "y")
    return met.select("held_id", "train_id").filter("held_id <> train_id").distinct()


def sft_records(spark, d: str) -> DataFrame:
    return table(spark, d, "sft_sample").select(F.col("sample_id").alias("id"), F.concat_ws(" ", "instruction", "output").alias("text"), split_name(F.col("split")).alias("split"))


@query("p7_found")
def p7_found(spark, d):
    pairs = crossing(Stage(spark, "p7"), sft_records(spark, d))
    return pairs.select(F.least("held_id", "train_id").alias("sample_id_a"), F.greatest("held_id", "train_id").alias("sample_id_b")).distinct()


def record_coverage(stage: Stage, t: dict[str, DataFrame]) -> DataFrame:
    """(held_id, coverage, longest): share of each held-out record's tokens in spans that train has, too, and its longest such span; records without one are not listed."""
    by_text = merged_spans(t["prefixes"]).groupBy("rec").agg((F.sum(F.col("stop") - F.col("start")) / F.max("size")).alias("coverage"), F.max(F.col("stop") - F.col("start")).alias("longest"))
    return t["member"].filter("kind = 0").join(by_text, "rec").groupBy(F.col("id").alias("held_id")).agg(F.max("coverage").alias("coverage"), F.max("longest").alias("longest"))


@query("p7_coverage")
def p7_coverage(spark, d):
    """(held_id, coverage, longest) of every held-out record that shares a span with train."""
    stage = Stage(spark, "p7c")
    return record_coverage(stage, prepare(stage, sft_records(spark, d)))


@query("p7_report")
def p7_report(spark, d):
    """Per split and source of the held-out record: records, those that overlap train, pairs, records that share a span with train, and the mean share that spans cover."""
    stage = Stage(spark, "p7r")
    t = prepare(stage, sft_records(spark, d))
    sft = table(spark, d, "sft_sample").select(F.col("sample_id").alias("held_id"), split_name(F.col("split")).alias("split"), F.translate(plain(F.col("source_type")), "-", "_").alias("source_type")).filter("split <> 'train'").dropDuplicates(["held_id"])
    pairs = similar_across(stage, t, 3, 4).groupBy("held_id").agg(F.count(F.lit(1)).alias("pairs"))
    rows = sft.join(pairs, "held_id", "left").join(record_coverage(stage, t), "held_id", "left")
    return rows.groupBy("split", "source_type").agg(F.count(F.lit(1)).alias("records"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.count("coverage").alias("sharing"), F.avg(F.coalesce("coverage", F.lit(0.0))).alias("mean_coverage"))
