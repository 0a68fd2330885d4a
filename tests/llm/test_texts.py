
import pytest
from pyspark.sql import functions as F

from plinth.llm import ocr, pairs, quality

Q_EN = "Explain how the residual stress of the cured panel changes the load path of the bonded joint near 120 MPa."
Q_ZH = "请说明高温褶皱与石墨化法兰怎样共同校正环氧树脂的催化剂，并比较湿度的影响。"
A_EN = "The residual stress shifts the load towards the joint. It then relaxes with time."
A_ZH = "高温褶皱会放大环氧树脂的收缩。石墨化法兰随后稳定界面。"


@pytest.mark.parametrize(
    "q,a,want",
    [
        (Q_EN, None, ["empty_answer"]), (Q_EN, " \n", ["empty_answer"]), (Q_EN, "N/A", ["empty_answer"]), (Q_ZH, "答：", ["empty_answer"]), (Q_EN, "...", ["empty_answer"]), (Q_EN, "A", []), (Q_ZH, "34 ℃", []), (Q_EN, "The answer is B.", []),
        (Q_EN, A_EN, []), (Q_ZH, A_ZH, []), (Q_EN, "- stiff layer\n- void\n- core", []), (Q_EN, '{"a": "b", "c": 1}', []),
        (Q_EN, "I'm sorry, but I cannot help with this request.", ["refusal"]), (Q_ZH, "您问到了法兰。很抱歉，我无法提供相关内容，请联系相关部门。", ["refusal"]), (Q_EN, 'The panel shows "Sorry, I cannot read the sensor". The crew replaces the sensor.', []), (Q_ZH, "低于8 MPa时无法保持夹具，因此改为硬化密封圈。", []),
        (Q_EN, A_ZH, ["wrong_language"]), (Q_ZH, A_EN, ["wrong_language"]), ("Translate into Chinese: " + Q_EN, A_ZH, []), (Q_EN, "Das Gewebe schwächt langsam den Riss, und die Form bedeckt den Kern der Probe.", ["wrong_language"]),
        (Q_EN, Q_EN, ["question_copy"]), (Q_EN, "The question is: " + Q_EN, ["question_copy"]), (Q_ZH, "您的问题是：" + Q_ZH, ["question_copy"]),
        (Q_EN, A_EN + " Because the binder", ["truncated"]), (Q_EN, A_EN + " The ...", ["truncated"]), (Q_ZH, A_ZH + "由于低温", ["truncated"]), (Q_EN, '{"a": "b", "c":', ["truncated"]), (Q_EN, "- stiff layer\n- void\n- ", ["truncated"]),
    ],
)
def test_defects(q, a, want):
    assert pairs.defects(q, a) == want


@pytest.mark.parametrize("n", [1, 5, 30, 79, 80, 100, 199, 205, 1000])
def test_verdicts_do_not_change_with_length(n):
    """Blanks, dots and repetition, whatever their number, change no verdict."""
    assert pairs.defects(Q_ZH, "答案：" + " " * n) == ["empty_answer"] and pairs.defects(Q_EN, "N/A" + "." * n) == ["empty_answer"] and pairs.defects(Q_EN, "." * n) == ["empty_answer"]
    mixed = "把 RTM-6 与 TG-800 在 180 MPa 下混合。"
    assert pairs.language(mixed) == "zh" and pairs.language(mixed * n) == "zh"
    lead = " ".join(f"well{i}" for i in range(min(n, 15)))
    assert pairs.defects(Q_EN, f"{lead}: {Q_EN}") == ["question_copy"]


def test_long_copies():
    assert pairs.is_copy("a b c d e f g h", "a b c d e f g h " * 50_000) and not pairs.is_copy("a b c d e f g h", "a b a b " * 50_000)


def kind(text):
    m = quality.measure([text], COMMON, USUAL)[0]
    return quality.kind_of(m)


def test_null_prompt_and_long_text():
    assert pairs.defects(None, A_EN) == [] and pairs.defects(None, A_ZH) == []
    assert pairs.defects(Q_EN, A_EN * 20_000) == []


def test_flag(spark):
    df = spark.createDataFrame([("sft", "a", Q_EN, ""), ("sft", "b", Q_EN, A_EN), ("sft", "c", None, None)], "record_type string, record_id string, prompt string, answer string")
    assert {(r["record_id"], r["defects"][0]) for r in pairs.flag(df).collect()} == {("a", "empty_answer"), ("c", "empty_answer")}
    assert pairs.flag(df.limit(0)).count() == 0


COMMON = frozenset(["the", "of", "and", "is", "in", "a", "to", "的", "了", "在"])
#: Letter pairs of ordinary words, as counted over all texts.
USUAL = quality.np.ones(676, bool)
PROSE = "The resin flows in the mould and the fibre is wetted. A void is left in the corner of the part, and the crew repairs it."


@pytest.mark.parametrize(
    "text,want",
    [
        (PROSE, "prose"), ("在车间内，树脂流过模具。随后的固化使纤维定位，孔隙也减少了。", "prose"), (None, "junk"), (" \n ", "junk"), ("�����", "junk"), ("12 99 1034 5 77 8 123 4", "junk"), ("load " * 40, "junk"), ("<div>&nbsp;</div>" * 20, "junk"), ("Home | Login | Next | Menu | Back | Share", "junk"),
        ("items:\n- stiff core\n- dry fibre\n- thin ply\n- hot tool", "list"), ("1. 早期纤维\n2. 最小凝胶\n3. 加压催化剂\n4. 氧化标定", "list"), ("stiff core; dry fibre; thin ply; hot tool; wet lay-up", "list"),
        ("| a | b |\n| x 1 | 2.5 |\n| y 2 | 3.5 |", "table"), ("name,load,strain\nA 1,2.5,3.1\nB 2,4.0,9.9", "table"), ("名称\t数值\nA\t1.5\nB\t", "table"), ("a=1.5; b=2; c=3\na=2.5; b=4; c=5", "table"), ("name        load     strain\nA 1         2.5      3.1\nB 2         4.0      9.9", "table"),
        (PROSE + "\n| a | b |\n| 1 | 2 |\n" + PROSE, "prose"), (PROSE[:54] + "\n" + "\n".join(f"| row {i} | {i}.5 | {i}.25 |" for i in range(9)), "table"),
    ],
)
def test_kinds(text, want):
    assert kind(text) == want


def test_periodic_lines_are_items():
    """Unmarked items of long lines with an indented note each; prose of the same lines without the period stays prose."""
    item = "the stiff outer core of panel {} is held by the crew in the tool while the resin cures and then it is cut to size"
    text = "\n".join(f"{item.format(i)}\n    see the drawing of the panel {i}." for i in range(8))
    assert kind(text) == "list"
    assert kind("\n".join([item.format(i) for i in range(8)] + ["it is seen in the drawing."])) == "prose"


def test_statistics(spark):
    df = spark.createDataFrame([(1, "The cat is. x_y\nend"), (2, None)], "doc_id bigint, text string").withColumn("words", F.lit("clash"))
    r = {x["doc_id"]: x for x in quality.text_statistics(df, "doc_id", "text", COMMON).collect()}
    assert r[1]["words"] == 6 and r[1]["lines"] == 2 and r[1]["ended_lines"] == 0.0 and r[2]["words"] == 0 and r[2]["text_kind"] == "junk"
    assert quality.text_statistics(df.limit(0), "doc_id", "text", COMMON).count() == 0


def test_weights_follow_labels_but_stay_near_the_start():
    """Labels that contradict a clear text count little; many for doubtful texts move their verdict."""
    rows = quality.measure([PROSE] * 40 + ["items:\n- stiff core\n- dry fibre\n- thin ply\n- hot tool"] * 40, COMMON, USUAL)
    x = quality.np.array([quality.vector(m) for m in rows])
    wrong = quality.fit(x, quality.np.array([quality.KINDS.index("table")] * 80))
    assert [quality.kind_of(m, wrong) for m in (rows[0], rows[-1])] == ["prose", "list"]
    doubt = dict(rows[0], list_share=0.48, prose_share=0.52)
    taught = quality.fit(quality.np.array([quality.vector(doubt)] * 2000), quality.np.array([quality.KINDS.index("list")] * 2000))
    assert quality.kind_of(doubt) == "prose" and quality.kind_of(doubt, taught) == "list"
    assert (quality.fit(x[:0], quality.np.zeros(0, int)) == quality.START).all()


@pytest.mark.parametrize("blanks", [0, 300, 500])
def test_blanks_count_alike_in_short_and_long_texts(blanks):
    assert kind("<b>&nbsp;</b>\t\t" * 20 + "\t " * blanks) == "junk"


def test_letter_pairs_are_counted_over_all_texts(spark):
    df = spark.createDataFrame([("there where these",)] * 20 + [("zqxj",), (None,)], "text string")
    usual = quality.usual_pairs(df, "text")
    at = lambda p: (ord(p[0]) - 97) * 26 + ord(p[1]) - 97
    assert usual[at("he")] and usual[at("er")] and not usual[at("zq")] and not usual[at("qx")]


LEARNT = {"c": ["e"], "0": ["o"], "b": ["h"], "屋": ["层"], "庄": ["压"], "湿": ["温"]}


def model(texts, learnt=LEARNT):
    n = 1 << 16
    out = [quality.np.zeros(ocr.ROWS * n, quality.np.int64), quality.np.zeros(ocr.WORDS * ocr.CONTEXTS, quality.np.int64)]
    for t, (cell, count) in zip(out, ocr.count_arrays(texts, n), strict=True):
        quality.np.add.at(t, cell, count)
    return ocr.Model(out[0], *ocr.learn_vectors(out[1]), learnt)


CLEAN = ["the threshold of the resin remains low-viscosity and the liner degrades within the minimum load"] * 60 + ["低温固化剂覆盖涂层与热压罐，升温段随之稳定边界。"] * 60


def test_page_is_cleaned():
    m = model(CLEAN)
    page = "Handbook of Resin    12\nthe thresh0ld of the resin rem-\nains low-\nviscosity and the lincr degrades\n\n- 12 -\nHandbook of Resin\nwithin the minimum load."
    rows, text, repairs = ocr.clean(page, [12, 13], set(), m)
    assert set(rows) == {(1, "running_header"), (2, "misread"), (2, "hyphen_break"), (4, "misread"), (6, "page_number"), (7, "running_header")}
    assert text == "the threshold of the resin remains low-viscosity and the liner degrades within the minimum load." and len(repairs) == 2


def test_correction_does_not_depend_on_corpus_size():
    """Misread forms repeat in proportion to the corpus; the ratio to what they stand for decides."""
    base = ["the resin reaches the liner and then the resin reaches the core"] * 40 + ["the resin reacbcs the liner near tbe core"]
    for times in (1, 4):
        assert ocr.clean("the resin reacbcs the liner", [5], set(), model(base * times))[1] == "the resin reaches the liner"
    m = model(["the liner is held by the liner"] * 9000 + ["thc liner"] * 1001)
    assert ocr.clean("thc liner is held", [5], set(), m)[1] == "the liner is held"
    memo = {i: i for i in range(ocr.MEMO)}
    assert ocr.remember(memo, "x", 1) == 1 and memo == {"x": 1}


def test_chinese_page():
    rows, text, repairs = ocr.clean("第3页\n低温固化剂覆盖涂屋与热庄罐，升\n湿段随之稳定边界。", [3], set(), model(CLEAN))
    assert set(rows) == {(1, "page_number"), (2, "misread"), (3, "misread")} and text == "低温固化剂覆盖涂层与热压罐，升温段随之稳定边界。" and len(repairs) == 3


def test_headings_names_and_numbers_stay():
    m = model(CLEAN)
    assert ocr.clean("7.6 minimum load\n\nthe resin of Velraxdul TG-6636 remains at 12.5 K.", [5], set(), m)[0] == []
    assert ocr.clean("the load remains at 5O.3 GPa within the liner.", [5], set(), m)[0] == [(1, "misread")]
    assert ocr.clean("", None, set(), m) == ([], "", [])


def test_hashes_of_words_are_those_of_batches():
    code = quality.np.array([ord(c) for c in "resin ply"], quality.np.uint32)
    batch = ocr.tokens._words(ocr.tokens.Chars(code, ocr.latin()[code], quality.np.array([0, len(code)])))[1]
    assert [ocr.word_hash("resin"), ocr.word_hash("ply")] == batch.tolist()


def test_vectors_tell_a_words_contexts():
    """Words that stand among like words are near to these contexts, others are not."""
    m = model(["the cat drinks cold milk", "the dog drinks cold water", "an engine burns heavy fuel", "an engine burns heavy oil"] * 50)
    for word, own, other in (("milk", ["drinks", "cold"], ["burns", "heavy"]), ("fuel", ["burns", "heavy"], ["drinks", "cold"])):
        assert m.fit([word], own)[0] > m.fit([word], other)[0] + 0.5
    assert m.fit(["milk"], []) == [0.0]


def test_confusions_are_learnt(spark):
    """From recorded repairs at once, from texts that differ in one place when this recurs; what is only left out is none."""
    rows = [([{"original": "thc", "repaired": "the"}], None, None)] + [(None, f"the lbad {i} of thc resin\n低湿固化{i}", f"the load {i} of the resin\n低温固化{i}") for i in range(3)] + [(None, "the ply word here", "the word here"), ([None, {"original": None, "repaired": "x"}], "a", " ")]
    df = spark.createDataFrame(rows, "ocr_repairs array<map<string,string>>, original_text string, cleaned_text string")
    assert ocr.learnt_confusions(df) == {"c": ["e"], "b": ["o"], "湿": ["温"]}


def test_sums_do_not_depend_on_partitions(spark):
    """Three hundred partitions give the same sums, cell by cell; counts beyond 32 bits are cut off, not wrapped."""
    df = spark.createDataFrame([(t,) for t in CLEAN * 10], "text string")
    one, many = ocr.summed(df.coalesce(1), 1 << 16), ocr.summed(df.repartition(300), 1 << 16)
    assert all((a == b).all() for a, b in zip(one, many, strict=True)) and one[0].sum() > 0


def test_counts_are_upper_bounds():
    m = model(CLEAN)
    assert m.count("threshold") >= 60 and m.pair("涂", "层") >= 60 and m.count("nowhere") == 0


def test_denoise(spark):
    rows = [("a", "f", [1], "page 1 text", "clean text"), ("b", "f", [2], "Page 2\nthe resin", None), ("c", None, None, None, " "), ("b", "f", [2], "Page 2\nthe resin", None)]
    df = spark.createDataFrame(rows, "chunk_id string, source_file string, page_numbers array<int>, original_text string, cleaned_text string").withColumn("ocr_repairs", F.lit(None).cast("array<map<string,string>>"))
    got = ocr.denoise(spark, df).dropDuplicates(["chunk_id"]).collect()
    assert [(r["chunk_id"], [tuple(x) for x in r["noise"]], r["cleaned_text"]) for r in got] == [("b", [(1, "page_number")], "the resin")]
    assert ocr.denoise(spark, df.limit(0)).count() == 0
