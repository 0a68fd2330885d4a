"""Problem 4: near-duplicate records by an exact set-similarity join with set-relation skipping.

Each text becomes its set of distinct tokens. Tokens are ordered by falling rarity (counts of all documents in
a sketch of fixed size); two sets of Jaccard similarity t or more share a token among their first few, so only these are indexed.

* Skipping by position: the index list of a token is kept in blocks of one size range and sorted by position. For
  two blocks sizes and positions bound the overlap, so whole blocks and the tails of blocks are skipped.
* Relations of sets: equal sets have the same answers, which are computed once for their class, however many the
  records. Within a list, sets of one size block are compared by 128-bit sketches of their tokens, whose differing bits bound the
  symmetric difference from below; and in the final check the known difference of two sets derives or excludes the answers of
  the second from those of the first by the triangle inequality, before any tokens are compared.

Lists longer than a limit are cut into parts, and each pair of parts is a task's work of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm import tokens
from plinth.llm.registry import query
from plinth.runtime import Stage, ship, table

#: Cells of the sketch of token counts: eight a set, between these powers of two (4 to 16 MB are broadcast); entries of an index list that are one part.
LEAST_CELLS, MOST_CELLS, PART = 20, 22, 16_384
#: Characters of text tokenised at once.
SLICE = 2_000_000


def token_sets(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, sets): for slices of the texts, per text its distinct 32-bit tokens, ascending."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < SLICE or end == at):
            size += len(texts[end] or "")
            end += 1
        doc, h = tokens.shingle_set(tokens.chars(texts[at:end]))
        key = np.unique((doc.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32)))
        bounds = np.searchsorted(key, np.arange(end - at + 1, dtype=np.uint64) << np.uint64(32))
        h32 = key.astype(np.uint32)
        yield at, [h32[bounds[i] : bounds[i + 1]] for i in range(end - at)]
        at = end


def tokenise(records: DataFrame) -> DataFrame:
    """(kind, id, sig, toks) of the records (kind, id, text) that have a token: ``sig`` stands for the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for at, sets in token_sets(texts):
                keep = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
                if not len(keep):
                    continue
                flat = np.concatenate([sets[i] for i in keep]).astype(np.uint64)
                n = np.array([len(sets[i]) for i in keep])
                sig = tokens.mix(np.add.reduceat(tokens.mix(flat + np.uint64(77)), np.cumsum(n) - n) ^ n.astype(np.uint64)).view(np.int64)
                rows = b.slice(at, len(sets)).take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(sig), pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["kind", "id", "sig", "toks"])

    return records.select("kind", "id", "text").mapInArrow(run, "kind int, id string, sig bigint, toks binary")


def first_of_batch(b: pa.RecordBatch, seen: set) -> np.ndarray:
    """Rows whose (kind, sig) is new in this partition; ``seen`` is kept small, what slips through is only repeated work."""
    kind, sig = b.column(0).to_numpy(), b.column(2).to_numpy()
    keep = []
    for i, k in enumerate(zip(kind.tolist(), sig.tolist(), strict=True)):
        if k not in seen:
            seen.add(k)
            keep.append(i)
    if len(seen) > 500_000:
        seen.clear()
    return np.array(keep, np.int64)


class Packed:
    """An array that is compressed where it is stored: the driver and each executor keep a file of a broadcast, and most cells of a sketch are 0 or small."""

    def __init__(self, array: np.ndarray):
        self.array = array

    def __getstate__(self) -> tuple[str, bytes]:
        return self.array.dtype.str, zlib.compress(self.array.tobytes(), 1)

    def __setstate__(self, state: tuple[str, bytes]) -> None:
        self.array = np.frombuffer(zlib.decompress(state[1]), state[0])


def counted(sets: DataFrame, cells: int, choose) -> Broadcast:
    """``cells`` sums, map-side combined: how many sets have a token of each cell among those that ``choose(tokens, sizes)`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(cells, np.int64)
        seen: set = set()
        for b in batches:
            b = b.take(pa.array(first_of_batch(b, seen)))
            if len(b):
                blobs = b.column(3).to_pylist()
                flat = choose(np.frombuffer(b"".join(blobs), np.uint32), np.array([len(x) // 4 for x in blobs], np.int64))
                n += np.bincount(flat & np.uint32(cells - 1), minlength=cells)
        at = np.flatnonzero(n)
        for lo in range(0, len(at), 100_000):
            part = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[part])], ["cell", "n"])

    rows = sets.mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.int64)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return sets.sparkSession.sparkContext.broadcast(Packed(out.clip(0, 2**31 - 1).astype(np.uint32)))


def count_tokens(sets: DataFrame) -> Broadcast:
    """Sketch of how many sets hold each token: an upper bound of each token's own count."""
    cells = 1 << max(LEAST_CELLS, min(MOST_CELLS, (8 * sets.count()).bit_length()))
    return counted(sets, cells, lambda flat, n: flat)


def prefix(flat: np.ndarray, n: np.ndarray, df: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, token, position) of each set's first tokens by rarity: two sets that reach ``num`` / ``den`` share one of them. A token that is the only one of its cell can't be shared and is left out."""
    row = np.repeat(np.arange(len(n)), n)
    c = df[flat & np.uint32(len(df) - 1)]
    order = np.lexsort((flat, c, row))
    tok, c = flat[order], c[order]
    pos = np.arange(len(tok)) - np.repeat(np.cumsum(n) - n, n)
    need = (num * n + den - 1) // den
    keep = np.flatnonzero((pos <= (n - need)[row]) & (c > 1))
    return row[keep], tok[keep], pos[keep]


def list_lengths(sets: DataFrame, counts: Broadcast, num: int, den: int) -> Broadcast:
    """How many entries the index lists of each cell have: what decides into how many parts a list is cut."""
    return counted(sets, len(counts.value.array), lambda flat, n: prefix(flat, n, counts.value.array, num, den)[1])


#: meta: size << 33 | position << 2 | side of a pair of parts << 1 | whether it is one.
POSTING = "key bigint, sig bigint, meta bigint, s0 bigint, s1 bigint, wide binary"
#: Sets of more tokens have a sketch of 512 bits, too: 128 are too few to tell them apart.
WIDE, WIDE_BYTES = 130, 64
#: Longer lists are compared block by block instead of entry by entry.
LONG = 3000


def sketches(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words per set, each bit the parity of the set's tokens that fall on it."""
    h = tokens.mix(flat.astype(np.uint64) + np.uint64(12345))
    starts = np.cumsum(n) - n
    bit = h & np.uint64(127)
    one = np.uint64(1) << (bit & np.uint64(63))
    low = bit < np.uint64(64)
    zero = np.uint64(0)
    return np.bitwise_xor.reduceat(np.where(low, one, zero), starts).view(np.int64), np.bitwise_xor.reduceat(np.where(low, zero, one), starts).view(np.int64)


def wide_sketches(flat: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    """512 bits of parity for the sets of more than WIDE tokens, None for the others."""
    row = np.repeat(np.arange(len(n)), n)
    big = np.flatnonzero(n > WIDE)
    out: list[bytes | None] = [None] * len(n)
    if len(big):
        place = np.full(len(n), -1)
        place[big] = np.arange(len(big))
        take = place[row] >= 0
        h = tokens.mix(flat[take].astype(np.uint64) + np.uint64(999)) & np.uint64(511)
        bits = np.bincount(place[row[take]] * 512 + h.astype(np.int64), minlength=512 * len(big)) & 1
        packed = np.packbits(bits.astype(np.uint8).reshape(len(big), 512), axis=1)
        for i, k in enumerate(big.tolist()):
            out[k] = packed[i].tobytes()
    return out


def postings(sets: DataFrame, counts: Broadcast, num: int, den: int, lengths: Broadcast, others: Broadcast | None = None) -> DataFrame:
    """Index entries of each class's first tokens; ``lengths`` cut long lists into parts. ``lengths`` and ``others``, if given, are those of two sides, and entries of lists that one side does not have are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches:
            b = b.take(pa.array(first_of_batch(b, seen)))
            if not len(b):
                continue
            blobs = b.column(3).to_pylist()
            n = np.array([len(x) // 4 for x in blobs], np.int64)
            flat = np.frombuffer(b"".join(blobs), np.uint32)
            s0, s1 = sketches(flat, n)
            wide = wide_sketches(flat, n)
            kind, sig = b.column(0).to_numpy(), b.column(2).to_numpy()
            r, tok, p = prefix(flat, n, counts.value.array, num, den)
            # entries of long lists go to parts; each pair of parts gets both sides
            cell = tok & np.uint32(len(counts.value.array) - 1)
            long = lengths.value.array[cell].astype(np.int64)
            if others is not None:
                other = others.value.array[cell].astype(np.int64)
                both = np.flatnonzero((long > 0) & (other > 0))
                r, tok, p, long = r[both], tok[both], p[both], long[both] + other[both]
            parts = np.maximum(1, -(-long // PART))
            # the token itself, which takes less room in a shuffle than a hash of it; pairs of parts have the keys below 0
            key = (tok.astype(np.uint64) << np.uint64(8)) + kind[r].astype(np.uint64)
            own = (tokens.mix(sig[r].view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
            i = np.repeat(np.arange(len(r)), parts)
            other = np.arange(len(i)) - np.repeat(np.cumsum(parts) - parts, parts)
            a, z = np.minimum(own[i], other), np.maximum(own[i], other)
            key = np.where(parts[i] > 1, tokens.mix(tokens.mix(key[i]) + ((a << 32) | z).astype(np.uint64) + np.uint64(1)) | np.uint64(1 << 63), key[i]).view(np.int64)
            meta = (n[r][i] << 33) | (p[i] << 2) | ((own[i] != a) * 2) | (a != z)
            which = r[i]
            for lo in range(0, len(i), 100_000):
                w = which[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + 100_000]), pa.array(sig[w]), pa.array(meta[lo : lo + 100_000]), pa.array(s0[w]), pa.array(s1[w]), pa.array([wide[k] for k in w.tolist()], pa.binary())], [x.split()[0] for x in POSTING.split(", ")])

    return sets.mapInArrow(run, POSTING)


class List:
    """One index list (or a pair of its parts), sorted by size and position, in blocks of sizes."""

    def __init__(self, t: dict[str, np.ndarray], rows: np.ndarray):
        order = rows[np.lexsort((t["pos"][rows], t["size"][rows] // 4))]
        self.row, self.size, self.pos, self.s0, self.s1 = order, t["size"][order], t["pos"][order], t["s0"][order].view(np.uint64), t["s1"][order].view(np.uint64)
        block = self.size // 4
        cut = np.flatnonzero(np.diff(block)) + 1 if len(block) else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], cut]) if len(block) else np.zeros(0, np.int64)
        self.ends = np.concatenate([cut, [len(block)]]) if len(block) else np.zeros(0, np.int64)
        self.low = np.minimum.reduceat(self.size, self.starts) if len(block) else self.size
        self.high = np.maximum.reduceat(self.size, self.starts) if len(block) else self.size


def matches(x: List, y: List, same: bool, num: int, den: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Candidate rows of two lists of one token, by blocks; ``same``: x and y are one list."""
    out = []
    for i in range(len(x.starts)):
        for j in range(i + 1 if same else len(y.starts)):
            lo_a, lo_b = int(x.low[i]), int(y.low[j])
            hi_a, hi_b = int(x.high[i]), int(y.high[j])
            # sizes must be within the ratio
            if den * hi_b < num * lo_a or den * hi_a < num * lo_b:
                continue
            # the overlap that even the smallest sets of the two blocks need
            need = -(-num * (max(lo_a, -(-num * lo_b // den)) + max(lo_b, -(-num * lo_a // den))) // (num + den))
            a0, b0 = int(x.starts[i]), int(y.starts[j])
            a1 = a0 + int(np.searchsorted(x.pos[a0 : x.ends[i]], hi_a - need, "right"))
            b1 = b0 + int(np.searchsorted(y.pos[b0 : y.ends[j]], hi_b - need, "right"))
            step = max(1, 2_000_000 // max(1, b1 - b0))
            for a in range(a0, a1, step):
                e = min(a1, a + step)
                total = x.size[a:e, None] + y.size[None, b0:b1]
                # |A xor B| <= (1 - t) / (1 + t) * (|A| + |B|), and the sketches' differing bits bound it from below
                most = (den - num) * total
                bits = np.bitwise_count(x.s0[a:e, None] ^ y.s0[None, b0:b1]) + np.bitwise_count(x.s1[a:e, None] ^ y.s1[None, b0:b1])
                hit = bits.astype(np.int32) * (num + den) <= most
                r, c = np.nonzero(hit)
                if len(r):
                    r, c = r + a, c + b0
                    room = np.minimum(x.size[r] - x.pos[r], y.size[c] - y.pos[c])
                    ok = room * (num + den) >= num * (x.size[r] + y.size[c])
                    out.append((x.row[r[ok]], y.row[c[ok]]))
    return out


def near_lists(group, t: dict[str, np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate rows (i, j) of many lists at once, the set of i not larger than that of j.

    Entries are sorted by list and size. Size and position of i bound the sizes of j, so all else of the list is skipped.
    """
    order = np.lexsort((t["size"], group))
    size, pos = t["size"][order].astype(np.int64), t["pos"][order].astype(np.int64)
    s0, s1 = t["s0"][order].view(np.uint64), t["s1"][order].view(np.uint64)
    top = int(size.max()) + 2 if len(size) else 2
    place = group[order].astype(np.int64) * top + size
    # |x| - p >= num / (num + den) * (|x| + |y|) for the smaller x
    most = np.minimum(((num + den) * (size - pos)) // num - size, top - 1)
    n = len(size)
    end = np.searchsorted(place, place - size + np.maximum(most, 0), "right")
    count = np.maximum(0, end - np.arange(n) - 1)
    running = np.concatenate([[0], np.cumsum(count)])
    out_i, out_j = [], []
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(running, running[at] + 1_000_000, "right")) - 1)
        c = count[at:to]
        i = np.repeat(np.arange(at, to), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(running[at:to] - running[at], c)
        both = size[i] + size[j]
        ok = np.flatnonzero((size[j] - pos[j]) * (num + den) >= num * both)
        i, j, both = i[ok], j[ok], both[ok]
        bits = np.bitwise_count(s0[i] ^ s0[j]).astype(np.int64) + np.bitwise_count(s1[i] ^ s1[j])
        ok = np.flatnonzero(bits * (num + den) <= (den - num) * both)
        out_i.append(order[i[ok]])
        out_j.append(order[j[ok]])
        at = to
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def cross_lists(group, t: dict[str, np.ndarray], left: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate rows (i, j) of many lists at once, i of the left side and j of the right: sizes bound the stretch of the right list that each i meets."""
    x, y = np.flatnonzero(left), np.flatnonzero(~left)
    if not len(x) or not len(y):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    y = y[np.lexsort((t["size"][y], group[y]))]
    size, pos, s0, s1 = t["size"].astype(np.int64), t["pos"].astype(np.int64), t["s0"].view(np.uint64), t["s1"].view(np.uint64)
    top = int(size.max()) * den // num + 2
    place = group[y].astype(np.int64) * top + size[y]
    base = group[x].astype(np.int64) * top
    # |x| - p must reach num / (num + den) * (|x| + |y|), which bounds the sizes of y from above
    most = np.minimum(den * size[x] // num, ((num + den) * (size[x] - pos[x])) // num - size[x])
    first = np.searchsorted(place, base - (-num * size[x] // den), "left")
    count = np.maximum(0, np.searchsorted(place, base + np.maximum(most, 0), "right") - first)
    running = np.concatenate([[0], np.cumsum(count)])
    out_i, out_j = [], []
    at = 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(running, running[at] + 1_000_000, "right")) - 1)
        c = count[at:to]
        i = np.repeat(x[at:to], c)
        j = y[np.repeat(first[at:to], c) + np.arange(int(c.sum())) - np.repeat(running[at:to] - running[at], c)]
        both = size[i] + size[j]
        ok = np.flatnonzero((size[j] - pos[j]) * (num + den) >= num * both)
        i, j, both = i[ok], j[ok], both[ok]
        bits = np.bitwise_count(s0[i] ^ s0[j]).astype(np.int64) + np.bitwise_count(s1[i] ^ s1[j])
        ok = np.flatnonzero(bits * (num + den) <= (den - num) * both)
        out_i.append(i[ok])
        out_j.append(j[ok])
        at = to
    return np.concatenate(out_i), np.concatenate(out_j)


def wide_filter(t: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the candidate rows the wide sketches, where both have one, don't exclude; equal classes are excluded."""
    keep = t["sig"][i] != t["sig"][j]
    look = np.flatnonzero(keep & (t["size"][i] > WIDE) & (t["size"][j] > WIDE))
    if len(look):
        w = t["wide"]
        x = np.frombuffer(b"".join(w[i[look]]), np.uint64).reshape(-1, WIDE_BYTES // 8)
        y = np.frombuffer(b"".join(w[j[look]]), np.uint64).reshape(-1, WIDE_BYTES // 8)
        bits = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
        keep[look] = bits * (num + den) <= (den - num) * (t["size"][i[look]].astype(np.int64) + t["size"][j[look]])
    return np.flatnonzero(keep)


def candidates(entries: DataFrame, num: int, den: int, across: bool = False) -> DataFrame:
    """(a, b): pairs of classes, a < b, that no bound excludes; ``across``: only those of which one has an odd key and the other an even one."""

    def answer(t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """All candidates of complete lists, sorted by key."""
        change = np.flatnonzero(np.diff(t["key"]) != 0) + 1
        starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(t["key"])]])
        length = ends - starts
        t = t | {"size": t["meta"] >> 33, "pos": (t["meta"] >> 2) & 0x7FFFFFFF}
        odd = t["sig"] & 1 == 1
        plain = (t["meta"][starts] & 1 == 0) & (length <= LONG)
        small = np.flatnonzero(np.repeat(plain & (length > 1), length))
        group = np.repeat(np.arange(len(starts)), length)[small]
        part = {k: t[k][small] for k in ("size", "pos", "s0", "s1")}
        i, j = cross_lists(group, part, ~odd[small], num, den) if across else near_lists(group, part, num, den)
        found = [(small[i], small[j])]
        for g in np.flatnonzero(~plain):
            rows = np.arange(starts[g], ends[g])
            if t["meta"][starts[g]] & 1:
                side = t["meta"][rows] & 2 == 0
                found += compare(t, rows[side], rows[~side], odd)
            elif across:
                found += matches(List(t, rows[odd[rows]]), List(t, rows[~odd[rows]]), False, num, den)
            else:
                x = List(t, rows)
                found += matches(x, x, True, num, den)
        i, j = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        ok = wide_filter(t, i, j, num, den)
        a, b = t["sig"][i[ok]], t["sig"][j[ok]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        for lo in range(0, len(pairs), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[lo : lo + 100_000, k])) for k in (0, 1)], ["a", "b"])

    def compare(t: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, odd: np.ndarray) -> list:
        if not across:
            return matches(List(t, x), List(t, y), False, num, den)
        return matches(List(t, x[odd[x]]), List(t, y[~odd[y]]), False, num, den) + matches(List(t, x[~odd[x]]), List(t, y[odd[y]]), False, num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for b in batches:
            t = {n: b.column(i).to_numpy(zero_copy_only=n != "wide") for i, n in enumerate(b.schema.names)}
            held.append(t)
            size += len(b)
            if size < 200_000:
                continue
            t = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            cut = int(np.argmax(t["key"] == t["key"][-1]))
            if cut:
                yield from answer({k: v[:cut] for k, v in t.items()})
            held = [{k: v[cut:] for k, v in t.items()}]
            size = 0 if cut else size
        if held and len(held[0]["key"]) + sum(len(h["key"]) for h in held[1:]):
            yield from answer({k: np.concatenate([h[k] for h in held]) for k in held[0]})

    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint").distinct()


#: At most so many keys of sets (some 10 MB) are broadcast.
BROADCAST = 500_000


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) whose sets are similar, by their tokens."""
    ids = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()
    # few wanted sets are picked where they lie, without a shuffle of all
    if ids.count() <= BROADCAST:
        ids = F.broadcast(ids)
    held = sets.select("sig", "toks").join(ids, "sig", "left_semi").groupBy("sig").agg(F.first("toks").alias("toks"))
    both = pairs.join(held.withColumnsRenamed({"sig": "a", "toks": "x"}), "a").join(held.withColumnsRenamed({"sig": "b", "toks": "y"}), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(len(b), bool)
            # differences known from pairs of this batch: |A xor C| for A's answers C
            xs, ys = b.column(2).to_pylist(), b.column(3).to_pylist()
            left, right = b.column(0).to_pylist(), b.column(1).to_pylist()
            known: dict[tuple[int, int], int] = {}
            near: dict[int, int] = {}
            for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
                n, m = len(x) // 4, len(y) // 4
                most = (den - num) * (n + m)  # (num + den) * |A xor B| must not exceed it
                a, c = left[i], right[i]
                leader = near.get(a)
                if leader is not None and (d := known.get((leader, c))) is not None:
                    e = known[(leader, a)]
                    if (num + den) * (d + e) <= most:
                        keep[i] = True
                        continue
                    if (num + den) * abs(d - e) > most:
                        continue
                u, v = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                shared = n + m - len(np.union1d(u, v))
                d = n + m - 2 * shared
                known[(a, c)] = d
                if (num + den) * d <= most:
                    keep[i] = True
                    near.setdefault(c, a)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return both.sortWithinPartitions("a", "b").mapInArrow(run, "a bigint, b bigint")


def similar_classes(stage: Stage, records: DataFrame, num: int = 3, den: int = 4) -> tuple[DataFrame, DataFrame]:
    """(members, links): (kind, id, sig) of each record, and (a, b) of similar classes, a < b.

    Similarity is Jaccard, at least ``num`` / ``den``. Records without tokens (null, empty, only punctuation) are similar
    to none and have no class; rows that repeat an id with the same text are one record.
    """
    ship(records.sparkSession)
    sets = stage.keep(tokenise(records.filter("id is not null")), "sets")
    # the kind is part of the class, so that equal sets of different kinds stay apart
    sets = sets.withColumn("sig", F.xxhash64("kind", "sig"))
    counts = count_tokens(sets)
    found = stage.keep(candidates(postings(sets, counts, num, den, list_lengths(sets, counts, num, den)), num, den), "candidates")
    stage.free()
    links = stage.keep(verify(found, sets, num, den), "links")
    stage.drop("candidates")
    return sets.select("kind", "id", "sig").distinct(), links


def similar_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, id_a, id_b) of all similar pairs of records, id_a < id_b, equal sets included."""
    m = members
    both = links.join(m.select(F.col("sig").alias("a"), F.col("kind"), F.col("id").alias("x")), "a").join(m.select(F.col("sig").alias("b"), F.col("id").alias("y")), "b").select("kind", "x", "y")
    many = m.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("sig")
    copies = m.join(many, "sig", "left_semi")
    inside = copies.select("sig", "kind", F.col("id").alias("x")).join(copies.select("sig", F.col("id").alias("y")), "sig").filter("x < y").select("kind", "x", "y")
    return both.unionByName(inside).filter("x <> y").select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


KIND_NAMES = ("sft", "chunk")


def sft_texts(spark, d: str) -> DataFrame:
    return table(spark, d, "sft_sample").select(F.lit(0).alias("kind"), F.col("sample_id").alias("id"), F.concat_ws(" ", "instruction", "output").alias("text"))


def chunk_texts(spark, d: str) -> DataFrame:
    return table(spark, d, "cleaned_chunk").select(F.lit(1).alias("kind"), F.col("chunk_id").alias("id"), F.col("cleaned_text").alias("text")).filter("text is not null")


def kind_name(c):
    return F.element_at(F.array(*[F.lit(x) for x in KIND_NAMES]), c + 1)


@query("p4_found")
def p4_found(spark, d):
    members, links = similar_classes(Stage(spark, "p4"), sft_texts(spark, d).unionByName(chunk_texts(spark, d)))
    return similar_pairs(members, links).select(kind_name(F.col("kind")).alias("record_type"), "id_a", "id_b")


@query("p4_groups")
def p4_groups(spark, d):
    """(record_type, record_id, class_id, group_id, copies, links): class of equal sets and its number of records, group of all that links reach, and how many other classes are similar."""
    from plinth.llm.splits import components

    stage = Stage(spark, "p4g")
    members, links = similar_classes(stage, sft_texts(spark, d).unionByName(chunk_texts(spark, d)), 4, 5)
    labels = components(stage, links.select(F.col("b").alias("ent"), F.col("a").alias("top")))
    members = stage.keep(members, "members")
    sizes = members.groupBy("sig").agg(F.count(F.lit(1)).alias("copies"))
    many = links.select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("links"))
    out = members.join(sizes, "sig").join(labels.select(F.col("ent").alias("sig"), "label"), "sig", "left").join(many, "sig", "left")
    return out.select(kind_name(F.col("kind")).alias("record_type"), F.col("id").alias("record_id"), F.col("sig").alias("class_id"), F.coalesce("label", "sig").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


@query("p4_links")
def p4_links(spark, d):
    """(class_a, class_b): similar pairs of class representatives, class_a < class_b; with the classes of p4_groups no copies need be paired."""
    _, links = similar_classes(Stage(spark, "p4l"), sft_texts(spark, d).unionByName(chunk_texts(spark, d)), 4, 5)
    return links.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"))
