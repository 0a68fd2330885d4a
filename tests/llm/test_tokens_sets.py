import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plinth.llm import crossing, filters, leaks, sets, tokens
from plinth.runtime import Stage

TOKEN = re.compile(r"[㐀-鿿]+|[^\W_㐀-鿿]+")
ALPHABET = "ab1 _-.,é²ﬁＡ中文字。😀\n\0"


def plain_tokens(t):
    return [m for m in TOKEN.findall(unicodedata.normalize("NFKC", t).lower())]


def plain_sequence(t):
    return [x for m in plain_tokens(t) for x in (m if "㐀" <= m[0] <= "鿿" else [m])]


def plain_set(t):
    out = set()
    for m in plain_tokens(t):
        if "㐀" <= m[0] <= "鿿":
            out |= {m} if len(m) == 1 else {m[i : i + 2] for i in range(len(m) - 1)}
        else:
            out.add(m)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=30), max_size=6))
def test_tokens_are_those_of_the_definition(texts):
    c = tokens.chars(texts)
    doc, _, h = tokens.sequence(c)
    for i, t in enumerate(texts):
        want, got = plain_sequence(t), h[doc == i].tolist()
        assert len(want) == len(got)
        assert len(set(want)) == len(set(got)) and [want.index(x) for x in want] == [got.index(x) for x in got]
    for at, found in sets.token_sets(texts):
        assert [len(s) for s in found] == [len(plain_set(t)) for t in texts[at : at + len(found)]]


def near(rnd, words, n):
    out = list(words)
    for _ in range(n):
        k = rnd.randrange(len(out))
        what = rnd.random()
        if what < 0.4:
            out[k] = f"x{rnd.randrange(10**6)}"
        elif what < 0.7:
            out.pop(k)
        else:
            out.insert(k, f"y{rnd.randrange(10**6)}")
    return out


def corpus(seed, n, lo=5, hi=200):
    rnd = random.Random(seed)
    texts = []
    for _ in range(n):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.randint(lo, hi))]
        texts += [" ".join(base)] + [" ".join(near(rnd, base, rnd.randint(0, max(1, len(base) // 6)))) for _ in range(3)]
    return texts


@pytest.mark.parametrize("part,long", [(4096, 3000), (2, 3)])
def test_set_join_matches_brute_force(spark, monkeypatch, part, long):
    """Also with lists cut into parts and compared block by block."""
    monkeypatch.setattr(sets, "PART", part)
    monkeypatch.setattr(sets, "LONG", long)
    texts = corpus(3, 40) + ["", "...", None, "a b c d", "a b c d", "d c b a"]
    s = [plain_set(t or "") for t in texts]
    ids = [f"r{i:04d}" for i in range(len(texts))]
    want = {(ids[i], ids[j]) for i in range(len(s)) for j in range(i + 1, len(s)) if s[i] and s[j] and 4 * len(s[i] & s[j]) >= 3 * len(s[i] | s[j])}
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)) + [(ids[0], texts[0]), (None, "a b c d")], "id string, text string").withColumn("kind", F.lit(0))
    members, links = sets.similar_classes(Stage(spark, "t"), df)
    got = sets.similar_pairs(members, links).collect()
    assert {(r["id_a"], r["id_b"]) for r in got} == want and len(got) == len(want)


def test_kinds_stay_apart_and_empty_tables(spark):
    df = spark.createDataFrame([(0, "a", "x y z"), (1, "b", "x y z")], "kind int, id string, text string")
    assert sets.similar_pairs(*sets.similar_classes(Stage(spark, "t"), df)).count() == 0
    assert sets.similar_pairs(*sets.similar_classes(Stage(spark, "t"), df.limit(0))).count() == 0


def test_very_long_text(spark):
    t = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(0, "a", t), (0, "b", t + " more")], "kind int, id string, text string")
    assert sets.similar_pairs(*sets.similar_classes(Stage(spark, "t"), df)).count() == 1


@pytest.mark.parametrize("most", [filters.MAX_BITS, 1])
def test_crossing_matches_brute_force(spark, most):
    """Also where many texts begin alike, and where no filter holds the hashes."""
    same = " ".join(f"b{i}" for i in range(30)) + " "
    texts = [same + t for t in corpus(8, 15, 30, 80)] + corpus(5, 45, 12, 120) + ["a b", "a b", "", None, "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未", "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午申"]
    splits = [("train", "validation", "test", None)[i % 4] for i in range(len(texts))]
    s = [plain_set(t or "") for t in texts]
    want = set()
    for i in range(len(s)):
        for j in range(len(s)):
            if splits[i] in ("validation", "test") and splits[j] == "train" and s[i] and s[j] and 4 * len(s[i] & s[j]) >= 3 * len(s[i] | s[j]):
                want.add((f"r{i}", f"r{j}"))
    df = spark.createDataFrame([(f"r{i}", t, p) for i, (t, p) in enumerate(zip(texts, splits, strict=True))], "id string, text string, split string")
    got = {(r[0], r[1]) for r in crossing.crossing(Stage(spark, "t"), df.union(df.limit(3)), most=most).collect()}
    assert got == want and want
    assert crossing.crossing(Stage(spark, "t"), df.limit(0)).count() == 0


def test_crossing_without_common_spans(spark):
    """Reordered clauses and items share no span of the least length, nor do texts with a word replaced in every eight."""
    clauses = [" ".join(f"k{i}x{j}" for j in range(5)) for i in range(12)]
    items = ["".join(chr(0x4E00 + 20 * i + j) for j in range(9)) for i in range(12)]
    words = [f"v{i}" for i in range(160)]
    other = [f"z{i}" if i % 8 == 7 else w for i, w in enumerate(words)]
    rows = [("c1", ", ".join(clauses), "train"), ("c2", ", ".join(clauses[::-1]), "test"), ("i1", "，".join(items), "train"), ("i2", "，".join(items[::-1]), "validation"), ("w1", " ".join(words), "train"), ("w2", " ".join(other), "test"), ("n", " ".join(f"n{i}" for i in range(60)), "test")]
    got = crossing.crossing(Stage(spark, "t"), spark.createDataFrame(rows, "id string, text string, split string"))
    assert {tuple(r) for r in got.collect()} == {("c2", "c1"), ("i2", "i1"), ("w2", "w1")}


def test_edited_and_reordered_texts(spark):
    """One word in every two to ten replaced, or blocks of five words reordered: every pair that is similar is found."""
    rnd = random.Random(2)
    rows, want = [], set()
    for every in range(2, 11):
        words = [f"e{every}w{i}" for i in range(60)]
        other = [f"z{every}x{i}" if i % every == 0 else w for i, w in enumerate(words)]
        rows += [(f"t{every}", " ".join(words), "train"), (f"h{every}", " ".join(other), ("test", "validation")[every % 2])]
        a, b = set(words), set(other)
        if 4 * len(a & b) >= 3 * len(a | b):
            want.add((f"h{every}", f"t{every}"))
    words = [f"r{i}" for i in range(60)]
    blocks = [words[i : i + 5] for i in range(0, 60, 5)]
    rnd.shuffle(blocks)
    rows += [("t0", " ".join(words), "train"), ("h0", " ".join(w for x in blocks for w in x), "validation"), ("h1", " ".join([*words[:-1], "last"]), "test")]
    got = crossing.crossing(Stage(spark, "t"), spark.createDataFrame(rows, "id string, text string, split string"))
    assert {tuple(r) for r in got.collect()} == want | {("h0", "t0"), ("h1", "t0")} and len(want) == 3


@pytest.mark.parametrize("most", [filters.MAX_BITS, 1])
def test_coverage_is_that_of_the_shared_passages(spark, most):
    """Merged spans are the tokens that lie in a stretch of m or more which some train text has, too, also across ranges and for a passage that all texts begin with."""
    rnd = random.Random(6)
    start = [f"b{i}" for i in range(20)]
    train = [start + [f"w{rnd.randrange(60)}" for _ in range(rnd.randint(0, 40))] for _ in range(40)]
    held = [start + [f"w{rnd.randrange(60)}" for _ in range(10)] + rnd.choice(train)[25:50] + [f"v{rnd.randrange(9)}" for _ in range(9)] for _ in range(20)] + [["only", "three", "words"]]
    grams = {tuple(t[i : i + 8]) for t in train for i in range(len(t) - 7)}
    want = {}
    for k, t in enumerate(held):
        inside = {j for i in range(len(t) - 7) if tuple(t[i : i + 8]) in grams for j in range(i, i + 8)}
        if inside:
            want[f"h{k}"] = len(inside) / len(t)
    rows = [(f"t{i}", " ".join(t), "train") for i, t in enumerate(train)] + [(f"h{i}", " ".join(t), "test") for i, t in enumerate(held)]
    stage = Stage(spark, "t")
    got = crossing.record_coverage(stage, crossing.prepare(stage, spark.createDataFrame(rows, "id string, text string, split string"), most)).collect()
    assert {r["held_id"]: pytest.approx(r["coverage"]) for r in got} == want and all(r["longest"] >= 20 for r in got)


def test_repeated_passages_are_covered(spark):
    text = " ".join(" ".join(f"p{i}" for i in range(12)) for _ in range(30))
    stage = Stage(spark, "t")
    t = crossing.prepare(stage, spark.createDataFrame([("a", text + " more", "test"), ("b", text, "train")], "id string, text string, split string"))
    r = crossing.record_coverage(stage, t).first()
    assert r["longest"] == 360 and r["coverage"] == pytest.approx(360 / 361)


def test_filter_has_no_false_negatives(spark):
    h = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    bloom, k = filters.build(h, 20_000)
    v = h.toPandas()["h"].to_numpy()
    assert filters.contains(bloom.value, k, v).all()
    other = spark.range(10**6, 10**6 + 20_000).select(F.xxhash64("id").alias("h")).toPandas()["h"].to_numpy()
    assert filters.contains(bloom.value, k, other).mean() < 0.07
    assert filters.build(h, 20_000, 17) is None


@pytest.mark.parametrize("most", [filters.MAX_BITS, 1])
def test_leaks_match_brute_force(spark, most):
    rnd = random.Random(9)
    en = [[f"w{rnd.randrange(300)}" for _ in range(rnd.randint(8, 40))] for _ in range(30)]
    zh = [[chr(0x4E00 + rnd.randrange(300)) for _ in range(rnd.randint(20, 60))] for _ in range(30)]
    docs = []
    for words, join, least in ((en, " ", 12), (zh, "", 24)):
        for w in words:
            n = min(len(w), rnd.randint(least - 3, least + 3))
            a = rnd.randint(0, len(w) - n)
            passage = w[a : a + n]
            docs.append(join.join(["q1", "q2"] if join else ["问"]) + join + (", " if join else "，").join(passage[:5]) + join + join.join(passage[5:]) + join + "尾")
    test = spark.createDataFrame([(f"e{i}", " ".join(w), 0) for i, w in enumerate(en)] + [(f"z{i}", "".join(w), 1) for i, w in enumerate(zh)] + [("n", None, 0), ("s", "", 1)], "id string, text string, kind int")
    corpus_ = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(docs)] + [("null", None), ("d0", docs[0])], "id string, text string")

    def shares(a, b, n):
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
        return any(tuple(a[i : i + n]) in grams for i in range(len(a) - n + 1))

    want = {(r[0], r2[0]) for r in test.collect() for r2 in corpus_.collect() if r[1] and r2[1] and shares(plain_sequence(r[1]), plain_sequence(r2[1]), (12, 24)[r[2]])}
    got = leaks.overlaps(test, corpus_, Stage(spark, "t"), most)
    assert {(r["test_id"], r["corpus_id"]) for r in got.collect() if r["run"] >= (12, 24)[r["kind"]]} == want and want
    assert leaks.overlaps(test, corpus_.limit(0), Stage(spark, "t")).count() == 0


def test_seeds_tolerate_substitutions():
    h = np.arange(1, 40, dtype=np.uint64)
    for k in leaks.KINDS:
        for m in k.masks:
            other = h.copy()
            hole = m.index("0")
            other[hole] += np.uint64(1000)
            assert leaks.seeds(h, m, 1)[0] == leaks.seeds(other, m, 1)[0]


def test_substituted_overlaps_are_found(spark):
    """Recall of passages of 36 (48) tokens with one token in every n substituted; those without a window of the least length that is alike enough don't count."""
    rnd = random.Random(12)
    test, docs = [], []
    for k, (kind, n) in enumerate(((0, 36), (1, 48)) * 150):
        t = [f"w{rnd.randrange(10**5)}" if kind == 0 else chr(0x4E00 + rnd.randrange(8000)) for _ in range(n)]
        other = list(t)
        for i in rnd.sample(range(n), n // (9, 12)[kind]):
            other[i] = "sub" if kind == 0 else "替"
        sep = "" if kind else " "
        test.append((f"t{k}", sep.join(t), kind))
        docs.append((f"t{k}", sep.join(["q1 q2", *other, "q3"])))
    got = leaks.overlaps(spark.createDataFrame(test, "id string, text string, kind int"), spark.createDataFrame(docs, "id string, text string"), Stage(spark, "t"))
    least = (12, 24)
    found = {r["test_id"] for r in got.collect() if r["test_id"] == r["corpus_id"] and r["same"] >= leaks.TOLERANT * least[r["kind"]]}
    want = {a[0] for a, b in zip(test, docs, strict=True) if max(sum(x == y for x, y in list(zip(plain_sequence(a[1]), plain_sequence(b[1])[2:], strict=False))[i : i + least[a[2]]]) for i in range(len(plain_sequence(a[1])) - least[a[2]] + 1)) >= leaks.TOLERANT * least[a[2]]}
    print(len(found & want), len(want))
    assert found <= want and len(found) >= 0.9 * len(want)


def test_shared_arrays_take_little_disk_and_go_when_done(spark):
    import os
    import pickle

    from plinth.llm import crossing, sets

    rows = [(f"{split}{i}", " ".join(f"w{(i * 7 + k) % 90}" for k in range(30)) + f" own{i % 5}", split) for split in ("train", "test") for i in range(60)]
    records = spark.createDataFrame(rows, "id string, text string, split string")
    counts = sets.count_tokens(sets.tokenise(records.selectExpr("0 as kind", "id", "text")))
    array = counts.value.array
    again = pickle.loads(pickle.dumps(counts.value)).array
    assert array.nbytes == 4 << 20 and (again == array).all() and array.sum() > 0 and len(pickle.dumps(counts.value)) < 100_000
    counts.destroy()
    at = spark.sparkContext._temp_dir
    before = set(os.listdir(at))
    stage = Stage(spark, "t")
    assert crossing.crossing(stage, records).count() >= 60
    assert set(os.listdir(at)) <= before and not stage.held
