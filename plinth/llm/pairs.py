"""Problem 6: broken prompt and response pairs.

Ordered rules find every defect that a pair triggers; the first of them is the pair's defect:
``empty_answer`` (nothing but blanks, punctuation, labels and placeholders), ``refusal`` (no sentence with content
beside phrases of refusal), ``wrong_language`` (script of the answer against the prompt's, unasked),
``question_copy`` (nothing but the prompt's own passages after a lead-in) and ``truncated`` (unclosed delimiters or
an abrupt ending). Null prompts count as empty; they trigger neither ``wrong_language`` nor ``question_copy``.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.registry import query
from plinth.runtime import ship, table

DEFECTS = ("empty_answer", "refusal", "wrong_language", "question_copy", "truncated")

#: Contents of answers that say nothing, without blanks and punctuation.
PLACEHOLDERS = {"", "na", "none", "null", "nil", "nan", "tbd", "tba", "todo", "pending", "undefined", "empty", "blank", "noanswer", "answer", "theanswer", "response", "output", "reply", "a", "待补充", "待定", "暂无", "无", "略", "空", "空白", "未填写", "待填写", "待完善", "无答案", "答", "答案", "回答", "答复", "xxx", "placeholder", "tobefilled", "tobeadded", "tobedetermined", "fillin", "tofollow", "comingsoon", "待续", "见上", "此处填写答案"}
LABEL = re.compile(r"^\s*(?:the\s+)?(?:answer|response|reply|output|a|答案?|回答|答复)\s*(?:is\s*)?[:：]\s*", re.I)

#: Who does not answer, as sentences say it: an apology, or the first person with a word of not doing.
REFUSE_EN = re.compile(
    r"\b(?:sorry|apologi[sz]e|apologies|regret\w*|afraid|unfortunately|no comment)\b|\bas an? (?:ai|artificial|language|large|virtual|digital|automated)\b"
    r"|\b(?:i|me|my|we|us|our|i'm|i'd|i've)\b.*\b(?:\w+n't|cannot|not|no|never|unable|declin\w*|refus\w*|pass on|stop\w*|prevent\w*|beyond|outside|lack\w*|rather|forbid\w*|prohibit\w*|impossible|avoid|abstain|refrain)\b"
    r"|\b(?:\w+n't|cannot|not|no|never|unable|impossible|beyond|outside|forbidden)\b.*\b(?:i|me|my|we|us|our)\b"
    r"|\b(?:unable|not able|cannot|can't) (?:to )?(?:help|assist|answer|respond|provide|comply|discuss|comment|reply)\b",
    re.I | re.S,
)
REFUSE_ZH = re.compile(r"抱歉|对不起|不好意思|遗憾|恕我|恕难|恕不|谅解|见谅|作为(?:一个|一名|一款)?(?:人工智能|语言模型|AI|大模型|大语言模型|智能|助手|模型)|我.*(?:不|无法|没|难以|超出|未|拒绝|无权|无能)|(?:超出|不在).*我|(?:无法|不能|不便|不宜|不应|拒绝|难以)(?:直接)?(?:回答|作答|答复|提供|协助|帮助|满足|回应|置评|评论|处理该|完成该)|没有办法(?:给出|回答|提供)", re.I)
#: Sentences that only lead in or close.
SOFT_EN = re.compile(r"^(?:(?:you(?:'re| are)? (?:asked|asking|want|would like|mention)|your (?:question|request) (?:is|was|concerns|about)|regarding|about|thank(?:s| you)|is there|are there|do you (?:need|have)|(?:please|kindly|try|consider) \w+|let me know|can i|could i|how else|may i|anything|feel free|i(?:'d| would) be (?:happy|glad)|i hope|if you (?:need|have|want|would)|hello|hi\b|thanks)\b.*)$", re.I | re.S)
SOFT_ZH = re.compile(r"^(?:您|你)(?:问|想|的问题|好|提|要|可以)|^关于|^还有(?:其他|什么|别的)|^请(?:联系|换|咨询|谅解|见谅|尝试|您|稍后|重新|查阅|另|提供|再)|^建议(?:您|你|咨询|联系)|^谢谢|^感谢|^如(?:有|果您|果你|需)|^需要|^希望|^是否|^欢迎|^有什么")
SENTENCE = re.compile(r"[^。！？!?\n]+?(?:[。！？!?\n]+|\.(?=\s|$)|$)")
QUOTED = re.compile(r"[“\"「『].*?[”\"」』]")

CJK = re.compile(r"[㐀-鿿]")
LATIN = re.compile(r"[A-Za-zÀ-ɏ]{2,}")
CODE = re.compile(r"\b[A-Z][a-z]+ [A-Z]{2}-\d+|\b[A-Z]{2,}-?\d*\b|\d[\d.,]*\s*[A-Za-z°µμ%/²³]+")
ASKS = re.compile(r"translat|翻译|译成|译为|(?:in|into) (?:english|chinese)|(?:用|以)(?:英|中)(?:文|语)|英文(?:回答|作答|版)|中文(?:回答|作答|版)|英译|中译|汉译", re.I)
TOKEN = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")

ENDS = "。.!?！？"
CLOSERS = "\"'”’」』)）]】}》*`"
ITEM = re.compile(r"^\s*(?:[-*•·●▪–+]|\(?\d{1,3}[.)）、:：]|[(（]\d{1,3}[)）]|[①-⑳]|[A-Ha-h][.)、])\s*")
OPTION = re.compile(r"^\s*(?:the answer is|answer is|answer|correct answer|答案[是为]?|选项?|选择)?\s*[:：]?\s*[(（]?[A-H](?:\s*[,，、和&]?\s*[A-H])*[)）]?(?:\s*[.．、:：)].*)?\s*[。.]?\s*$", re.I | re.S)
PAIRS = {"(": ")", "（": "）", "[": "]", "【": "】", "{": "}", "「": "」", "『": "』", "《": "》", "“": "”"}


def bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum())


#: No placeholder or label has as many letters and digits.
MOST = 64


def is_empty(a: str) -> bool:
    """Nothing but blanks, punctuation, labels and placeholders, however long."""
    n = 0
    for c in a:
        if c.isalnum():
            n += 1
            if n > MOST:
                return False
    b = bare(a)
    return b == "" or (b in PLACEHOLDERS and not re.fullmatch(r"\s*A[.)。]?\s*", a)) or bare(LABEL.sub("", a)) == ""


def is_refusal(a: str) -> bool:
    said = False
    for m in SENTENCE.finditer(a):
        s = m.group().strip()
        if not any(c.isalnum() for c in s):
            continue
        plain = QUOTED.sub(" ", s)
        if CJK.search(s):
            if REFUSE_ZH.search(plain):
                said = True
            elif not SOFT_ZH.search(s):
                return False
        elif REFUSE_EN.search(plain):
            said = True
        elif not SOFT_EN.search(s):
            return False
    return said


#: Frequent function words that tell languages of Latin script apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with as on by be are this it from at or an which was its then than when if not between because every any some neither while during",
    "de": "der die das und ist nicht ein eine einen dem den des mit von zu auf für im wird sich auch nach bei aus durch",
    "fr": "le la les et est des un une du dans que qui pour pas sur avec par au aux ce cette plus sont se en",
    "es": "el la los las y es un una del que en por con para no se al su como más son lo",
    "it": "il lo gli di e è un una del della che in per non con si dei delle sono alla nel",
    "pt": "o os as e é um uma do da dos das que em por com para não se ao na no são",
    "nl": "de het een en van is dat op te in niet met voor zijn aan door wordt",
}
LANGUAGE_OF: dict[str, set[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        LANGUAGE_OF.setdefault(_w, set()).add(_lang)
OTHER_SCRIPTS = (("ja", re.compile(r"[ぁ-ヿ]")), ("ko", re.compile(r"[가-힯]")), ("ru", re.compile(r"[Ѐ-ӿ]")), ("ar", re.compile(r"[؀-ۿ]")))


def latin_language(text: str) -> str:
    """The language of Latin script with the most function words; ``en`` unless another leads clearly."""
    n = dict.fromkeys(FUNCTION_WORDS, 0)
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        for k in LANGUAGE_OF.get(w, ()):
            n[k] += 1
    best = max(n, key=lambda k: (n[k], k == "en"))
    return best if n[best] >= 3 and n[best] > 2 * n["en"] else "en"


def language(text: str) -> str | None:
    """By script and function words, after names, codes and units; None if there is too little to tell."""
    if text.isascii():
        zh = 0
    else:
        zh = len(CJK.findall(text))
        for name, script in OTHER_SCRIPTS:
            n = len(script.findall(text))
            if n >= 8 and n * 3 > zh:
                return name
    if zh >= 4 and zh * 4 > len(text) - zh:
        return "zh"
    en = sum(map(len, LATIN.findall(CODE.sub(" ", text))))
    if zh >= 4 and zh * 4 > en:
        return "zh"
    if en >= 16 and zh * 12 < en:
        return latin_language(text)
    return None


def is_wrong_language(q: str, a: str) -> bool:
    if a.lstrip()[:1] in "{[":
        return False
    x, y = language(q), language(a)
    return x is not None and y is not None and x != y and not ASKS.search(q)


def tokens(text: str) -> list[str]:
    return TOKEN.findall(unicodedata.normalize("NFKC", text).lower())


LEADS = re.compile(r"^\s*(?:(?:the|your) (?:question|instruction|task|prompt) (?:is|was|reads|asks|says)|question|q|task|instruction|prompt|you(?:'re| are)? ask(?:ed|ing)?(?: about)?|(?:to|i will) answer (?:the|your|this) question|题目|问题?|任务|指令|(?:您|你)(?:的问题|问的)?是|关于(?:您|你)?的?问题)\s*[:：,，]?\s*", re.I)


def is_copy(q: str, a: str) -> bool:
    """Whether the answer, after a lead-in of less than half of it, is made of the prompt's own passages; eight tokens at least."""
    y = tokens(a)
    if len(y) < 8:
        return False
    x = tokens(q)
    known = set(x)
    # what the prompt does not have must be in the lead-in
    new = max((i + 1 for i, t in enumerate(y) if t not in known), default=0)
    made = covered(x, y)
    return any(made[lead] for lead in range(new, (len(y) + 1) // 2) if len(y) - lead >= 8)


def covered(x: list[str], y: list[str], run: int = 6) -> list[bool]:
    """For each place of ``y`` whether the rest is made of passages of ``x``, each the longest there and of ``run`` tokens or more (the last may be shorter); in time of the two lengths' product at most."""
    where: dict[str, list[int]] = {}
    for i, t in enumerate(x):
        where.setdefault(t, []).append(i)
    made = [False] * len(y)
    after: dict[int, int] = {}
    for at in range(len(y) - 1, -1, -1):
        after = {i: after.get(i + 1, 0) + 1 for i in where.get(y[at], ())}
        best = max(after.values(), default=0)
        end = at + best
        made[at] = best > 0 and (end == len(y) or best >= run and made[end])
    return made


#: Words that no item consists of.
DANGLING = frozenset("the a an of and or with to in its for by at on from which that this as is are 其中 以及 并且 的 与 和 及 或".split())


def mark_style(line: str) -> str:
    """The form of a line's item mark, whatever its number; empty without one."""
    m = ITEM.match(line)
    return re.sub(r"[0-9A-Za-z]+", "1", m[0].strip()) if m else ""


BRACKETS = re.compile("[" + re.escape("".join(PAIRS) + "".join(PAIRS.values())) + "]")


def unclosed(a: str) -> bool:
    stack = []
    for c in BRACKETS.findall(a):
        if c in PAIRS:
            stack.append(PAIRS[c])
        elif stack and c == stack[-1]:
            stack.pop()
    return bool(stack) or a.count("```") % 2 == 1


def is_truncated(a: str) -> bool:
    t = a.strip()
    if not t:
        return False
    if t[0] in "{[":
        try:
            json.loads(t)
            return False
        except ValueError:
            return t[-1] not in "}]" or unclosed(t)
    lines = t.split("\n")
    last = lines[-1].strip()
    if ITEM.match(last) and not ITEM.sub("", last).strip():
        return True  # an item that only has its mark
    if unclosed(ITEM.sub("", last) if len(lines) > 1 else t if not ITEM.match(t) else ITEM.sub("", t)):
        return True
    if re.search(r"(?:…|\.\.\.)[\"'”’」』)）]*$", t):
        return True
    core = t.rstrip(CLOSERS)
    if t[-1] in ENDS or core and core[-1] in ENDS:
        return False
    if t[-1] in ",，、:：;；-—":
        return True
    if OPTION.match(t) and len(t) < 120:
        return False
    items = sum(bool(ITEM.match(x)) for x in lines)
    if items >= 2:
        m = ITEM.match(last)
        # a sentence begun after the items, an item that is only a function word, or one marked unlike all others
        return not m or last[m.end() :].strip().lower() in DANGLING or len(lines) > 2 and len({mark_style(x) for x in lines[-4:-1]}) == 1 and mark_style(last) != mark_style(lines[-2])
    if len(lines) >= 3 and all(len(x) < 60 for x in lines):
        return False
    if "|" in last and last.count("|") >= 2 or "\t" in last:
        return False
    # prose: several sentences, or one too long for a name or a value
    words = len(tokens(t))
    if any(c in "。！？!?" for c in t[:-1]) or re.search(r"[a-z)%]\. [A-Z]", t):
        return True
    return words > 14 if not CJK.search(t) else words > 20


def defects(q: str | None, a: str | None) -> list[str]:
    """Every triggered defect in rule order; an empty answer triggers nothing else."""
    q, a = q or "", a or ""
    if is_empty(a):
        return ["empty_answer"]
    out = []
    if is_refusal(a):
        out.append("refusal")
    if is_wrong_language(q, a):
        out.append("wrong_language")
    if is_copy(q, a):
        out.append("question_copy")
    if is_truncated(a):
        out.append("truncated")
    return out


def flag(pairs: DataFrame) -> DataFrame:
    """(record_type, record_id, defects) of the pairs that have any; ``pairs``: record_type, record_id, prompt, answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [defects(q, a) for q, a in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            keep = pa.array([bool(x) for x in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.string()))], ["record_type", "record_id", "defects"]).filter(keep)

    ship(pairs.sparkSession)
    return pairs.select("record_type", "record_id", "prompt", "answer").mapInArrow(run, "record_type string, record_id string, defects array<string>")


def pairs_of(spark, d: str) -> DataFrame:
    sft = table(spark, d, "sft_sample").select(F.lit("sft").alias("record_type"), F.col("sample_id").alias("record_id"), F.col("instruction").alias("prompt"), F.col("output").alias("answer"))
    asked = table(spark, d, "benchmark_item").select("benchmark_id", "question")
    ran = table(spark, d, "evaluation_result").select("benchmark_id", "model_name", "raw_response", "prompt")
    ran = ran.join(asked, "benchmark_id", "left").select(F.lit("eval").alias("record_type"), F.concat_ws(":", "model_name", "benchmark_id").alias("record_id"), F.coalesce("question", "prompt").alias("prompt"), F.col("raw_response").alias("answer"))
    return sft.unionByName(ran).filter("record_id is not null")


@query("p6_found")
def p6_found(spark, d):
    return flag(pairs_of(spark, d)).select("record_type", "record_id", F.col("defects")[0].alias("defect")).distinct()


@query("p6_defects")
def p6_defects(spark, d):
    """Every triggered defect, one row each."""
    return flag(pairs_of(spark, d)).select("record_type", "record_id", F.explode("defects").alias("defect")).distinct()
