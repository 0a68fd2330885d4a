"""Problem 10: per-document text quality statistics and the kind of each text.

Words, symbols and letters of whole batches are counted as arrays. Lines are told apart by shape: fields parted by the same
delimiters, or by gaps that stand in the same columns, on neighbouring lines make table rows; marks and short even lines make list
items. The kind is the one with the highest score, a weighted sum of what the shapes say (shares of rows, items, prose and unreadable text), of the
period of indentation, the autocorrelation of line lengths, line ends, and the word, symbol and common-word ratios. The weights start
from fixed ones and are fitted to a bounded sample of hand labels with a prior that keeps them near the start, as some labels are wrong.
Which letters follow each other in readable words is counted over all texts. Statistics cover whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm import tokens
from plinth.llm.registry import query
from plinth.runtime import ship, table

KINDS = ("prose", "list", "table", "junk")
#: Marks that end a line of prose.
LINE_END = re.compile(r"[.!?。！？…][\"'”’」』)）]*\s*$")
MARK = re.compile(r"^\s*(?:[-*+•·●▪■□○◦‣–—►▶✓✔☐]\s+|[•·●▪■‣►]\s*|[(（]?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.)）、．](?!\d)\s*|[(（][一二三四五六七八九十\d]{1,3}[)）]\s*|[一二三四五六七八九十]{1,3}[、.．]\s*|[①-⑳]\s*|\[[ xX]?\]\s*|第[一二三四五六七八九十\d]+[条项步章节]\s*)")
KEY_VALUE = re.compile(r"^\s*[^:：\n]{1,60}[:：]\s*[^:：\n]{1,80}$")
SENTENCE_MARK = re.compile(r"[。！？]|[.!?](?=\s|$|[\"'”’)])")
INLINE = re.compile(r"\s+[/|·•>]\s+|[,;，；、]\s*")
RULE = re.compile(r"^[\s|+\-=:_─━│┃┄┆┌┐└┘├┤┬┴┼╔╗╚╝╠╣╦╩╬═║*.~]+$")
DELIMITERS = ("|", "│", "┃", "║", "\t", "¦", ";", "；", ",", "，")
DECIMAL = re.compile(r"\d\.\d")
GAP = re.compile(r"(?<=\S)(?: {2,}|　+)(?=\S)")
TAG = re.compile(r"</?[A-Za-z][^<>\n]*>|&[a-z]+;|&#\d+;")
CODE_NOISE = re.compile(r"[{}<>;=\\]|\bfunction\b|\bvar\b|\breturn\b|https?://|www\.")
CJK = re.compile(r"[㐀-鿿]")
WIDE = re.compile(r"[⺀-￯]")
BOX = re.compile(r"[│┃║─━═┄┆┌┐└┘├┤┬┴┼╔╗╚╝╠╣╦╩╬╋]")


def fields(line: str) -> tuple[str, int]:
    """The delimiter that parts the line into short fields, and their number; ("", 1) if none does."""
    sentence = None
    for d in DELIMITERS:
        if d not in line:
            continue
        if d in ",，;；":
            if sentence is None:
                sentence = bool(SENTENCE_MARK.search(DECIMAL.sub("", line)))
            if sentence:
                continue
        parts = [p.strip() for p in line.strip(" \n").strip("|│┃║¦").split(d)]
        if len(parts) < 2 or max(map(len, parts)) > 60 or d in ",，;；" and sum(len(p.split()) > 5 or len(p) > 10 and len(CJK.findall(p)) > 10 for p in parts):
            continue
        return d, len(parts)
    gaps = GAP.findall(line) if "  " in line or "　" in line else ()
    return ("gap", len(gaps) + 1) if gaps else ("", 1)


def gap_columns(lines: list[str]) -> float:
    """How far gaps of neighbouring lines end in the same columns, 0 to 1; wide characters count as one column or as two."""
    def ends(line: str, wide: int) -> set[int]:
        return {m.end() + (wide - 1) * len(WIDE.findall(line, 0, m.end())) for m in GAP.finditer(line)}

    best = 0.0
    for wide in (1, 2):
        sets = [ends(x, wide) for x in lines]
        # an overflowing cell shifts what follows a little
        same = [sum(any(abs(x - y) <= 3 for y in b) for x in a) / max(1, min(len(a), len(b))) for a, b in zip(sets, sets[1:], strict=False) if a and b]
        best = max(best, sum(same) / len(same) if same else 0.0)
    return best


def autocorrelation(x: list[int], most: int = 4) -> float:
    """The largest autocorrelation of line lengths at lags 1 to ``most``."""
    n = len(x)
    if n < 4:
        return 0.0
    m = sum(x) / n
    v = [a - m for a in x]
    total = sum(a * a for a in v)
    if total == 0:
        return 1.0
    return max(sum(v[i] * v[i + k] for i in range(n - k)) / total for k in range(1, min(most, n - 2) + 1))


def indent_period(lines: list[str]) -> float:
    """Share of lines whose indentation returns after the best period of 1 to 4 lines, if any line is indented."""
    x = [len(a) - len(a.lstrip()) for a in lines]
    n = len(x)
    if n < 4 or not any(x):
        return 0.0
    return max(sum(x[i] == x[i + k] for i in range(n - k)) / (n - k) for k in range(1, min(4, n - 2) + 1))


#: Words of menus and page frames, and of empty places.
MENU_WORDS = frozenset("home login log logout sign register menu search help cart share print back next previous prev more about contact contacts sitemap privacy terms cookie cookies subscribe download top faq skip click here read copyright reserved rights page pages follow news products account settings language english 首页 登录 注册 返回 下一页 上一页 打印 分享 搜索 帮助 更多 购物车 菜单 收藏 关于我们 联系我们 版权所有 退出 网站地图 点击 下载 目录 顶部".split())
PLACEHOLDERS = frozenset("na none null nil nan tbd tba todo empty blank 无 空 暂无 待补充 待定".split())
MENU_CJK = tuple(sorted((w for w in MENU_WORDS if w[0] > "⺀"), key=len, reverse=True))
RUN = re.compile(r"[!-+\--:<>-{}~]{25,}")
MOJIBAKE = re.compile(r"[À-ÿ][\u0080-\u00bf]|[ÃÂâåäæçèéï][\u0080-\u00bf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
#: Share of all letter pairs that the common ones make up.
USUAL = 0.9
_SPACE: np.ndarray | None = None


def is_space() -> np.ndarray:
    """For each code point whether it is white space; NUL, which ends a text in a batch, counts as such."""
    global _SPACE
    if _SPACE is None:
        n = len(tokens.char_class())
        _SPACE = np.fromiter((chr(i).isspace() for i in range(n)), bool, n)
        _SPACE[0] = True
    return _SPACE


class Counts:
    """Word, symbol and letter counts of a batch of texts, one array element a text."""

    def __init__(self, texts: list[str], common: np.ndarray, menu: np.ndarray, usual: np.ndarray):
        c = tokens.chars(texts, folded=True)
        code, n = c.code, len(texts)
        first = c.bounds[:-1]
        per = lambda x: np.add.reduceat(x.astype(np.int32), first) if n else np.zeros(0, np.int64)
        solid = ~is_space()[code]
        self.solid = per(solid)
        self.symbols = per(solid & (c.cls == 0))
        self.mixed = per((code >= 0xC0) & (code <= 0xFF)) > 0
        printed = (code > 32) & (code < 127)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], printed, [False]]).astype(np.int8)))
        wide = edges[::2][edges[1::2] - edges[::2] >= 25]
        self.runs = np.bincount(c.doc_of(wide), minlength=n) > 0
        cls = c.cls.copy()
        # an apostrophe or hyphen within a word belongs to it
        mark = np.flatnonzero(np.isin(code[1:-1], (39, 45, 0x2019)) & (cls[:-2] == 1) & (cls[2:] == 1)) + 1
        cls[mark] = 1
        low = np.where((code >= 65) & (code <= 90), code + 32, code)
        start, h = tokens._words(tokens.Chars(low, cls, c.bounds))
        doc = c.doc_of(start).astype(np.int64)
        word = cls == 1
        edge = np.flatnonzero(np.diff(np.append(word, False).astype(np.int8)) == -1) + 1
        length = edge - start
        cjk = np.flatnonzero(cls == 2)
        cjk_doc = c.doc_of(cjk).astype(np.int64)
        count = lambda d, w=None: np.bincount(d, weights=w, minlength=n).astype(np.int64)
        self.cjk = count(cjk_doc)
        self.words = count(doc) + self.cjk
        self.letters = count(doc, length) + self.cjk
        # words of one kind of character: sums over each word's characters
        at = np.flatnonzero(word)
        own = np.cumsum(length) - length
        whole = lambda ok: np.add.reduceat(ok[at].astype(np.int32), own) == length if len(start) else np.zeros(0, bool)
        digit = (low >= 48) & (low <= 57)
        self.numbers = count(doc, whole(digit))
        self.hex = count(doc, whole(digit | ((low >= 97) & (low <= 102))) & ((length == 2) | (length >= 8)))
        ascii_ = whole(code < 128)
        self.ascii_letters = count(doc, length * ascii_)
        self.common = count(doc, np.isin(h, common))
        self.menu = count(doc, length * np.isin(h, menu))
        hs = np.concatenate([h, tokens.mix(code[cjk].astype(np.uint64) + np.uint64(1 << 40))])
        self.common += count(cjk_doc, np.isin(hs[len(h):], common))
        key = np.unique(tokens.mix(hs + tokens.mix(np.concatenate([doc, cjk_doc]).astype(np.uint64))) & ~np.uint64(0xFFFFF) | np.concatenate([doc, cjk_doc]).astype(np.uint64))
        self.distinct = count((key & np.uint64(0xFFFFF)).astype(np.int64))
        # pairs of letters in words of four or more small Latin ones
        small = (code >= 97) & (code <= 122)
        take = np.repeat(whole(small) & (length >= 4), length)
        i = at[take]
        i = i[np.append(i[1:] == i[:-1] + 1, False)] if len(i) else i
        self.pair = (code[i] - 97) * 26 + code[i + 1] - 97 if len(i) else np.zeros(0, np.int64)
        pair_doc = c.doc_of(i)
        self.pairs = count(pair_doc)
        self.odd_pairs = count(pair_doc, ~usual[self.pair]) if len(usual) else self.pairs


def word_hashes(words) -> np.ndarray:
    """Hashes of words as ``Counts`` has them; a CJK word of one character is that character, longer ones are looked for in the text."""
    latin = [w for w in words if not CJK.search(w)]
    c = tokens.chars(latin, folded=True)
    cls = np.where(np.isin(c.code, (39, 45, 0x2019)), 1, c.cls)
    one = np.array([ord(w) for w in words if len(w) == 1 and CJK.match(w)], np.uint64)
    return np.concatenate([tokens._words(tokens.Chars(c.code, cls, c.bounds))[1], tokens.mix(one + np.uint64(1 << 40))])


def junk_share(text: str, c: Counts, i: int, common: float) -> float:
    """Share of the text that nobody can read: garbage, markup, repetition, bare numbers; 1.0 for blank text."""
    words, solid = int(c.words[i]), int(c.solid[i])
    if not words or not solid or solid <= 12 and re.sub(r"[\W_]", "", text).lower() in PLACEHOLDERS:
        return 1.0
    bad = text.count("�") + sum(map(len, TAG.findall(text))) if "<" in text or "&" in text or "�" in text else 0
    share = bad / solid
    # runs without blanks that no language has: hashes, base64, glued repetition
    long = 0
    for w in RUN.findall(text) if c.runs[i] else ():
        letters = re.sub(r"[^A-Za-z]", "", w)
        if not re.fullmatch(r"[-=_.*|+#~:]+", w) and (len(letters) < len(w) * 0.5 or re.search(r"[A-Z].*[a-z].*[A-Z].*\d|\d.*[a-z].*[A-Z]|[+/=]", w) or repeated(w) or len(w) > 40):
            long += len(w)
    share = max(share, long / solid)
    share = max(share, 2 * len(MOJIBAKE.findall(text)) / solid if c.mixed[i] else 0.0)
    menu = 0
    if common < 0.1:
        if c.pairs[i] >= 30 and c.odd_pairs[i] > 0.42 * c.pairs[i] and c.ascii_letters[i] > 0.5 * solid or words >= 16 and c.hex[i] > 0.7 * words:
            share = 1.0
    if common < 0.3:
        menu = c.menu[i]
        if not text.isascii():
            rest = text
            for w in MENU_CJK:
                if w in rest:
                    menu += rest.count(w) * len(w)
                    rest = rest.replace(w, " ")
    few = c.distinct[i] <= 0.12 * words and c.distinct[i] < 25
    if words >= 4 and (menu > 0.6 * c.letters[i] or c.numbers[i] == words) or words >= 12 and few or words >= 6 and repeated("".join(text.split())):
        share = 1.0
    symbols = int(c.symbols[i])
    if symbols > 0.6 * solid and (symbols := symbols - len(BOX.findall(text))) > 0.6 * solid:
        share = max(share, symbols / solid)
    return min(1.0, share)


def repeated(t: str) -> bool:
    """Whether a short unit, repeated, makes up the whole (at least six times)."""
    if len(t) < 12:
        return False
    p = (t + t).find(t, 1)
    if p * 6 <= len(t):
        return True
    # a broken last unit
    for p in range(1, min(40, len(t) // 6) + 1):
        if t[p:] == t[:-p]:
            return True
    return False


#: What a kind's score is made of, beside a constant.
FEATURES = ("junk_share", "table_share", "list_share", "prose_share", "swing", "length_autocorrelation", "ended_lines", "symbol_ratio", "common_words", "mean_word_length")
#: Weights of each kind's score before any label is seen: what makes up most of the text; unreadable text when it is more than half; and indentation that
#: goes up and down with a period, which the lengths of the lines follow, for list items without a mark.
START = np.zeros((len(KINDS), len(FEATURES) + 1))
START[KINDS.index("prose"), FEATURES.index("prose_share")] = START[KINDS.index("list"), FEATURES.index("list_share")] = START[KINDS.index("table"), FEATURES.index("table_share")] = 5.0
START[KINDS.index("table"), -1] = 0.005
START[KINDS.index("prose"), -1] = 0.01
START[KINDS.index("junk"), FEATURES.index("junk_share")], START[KINDS.index("junk"), -1] = 15.0, -2.5
START[KINDS.index("list"), FEATURES.index("swing")] = 7.5


def vector(m: dict) -> list[float]:
    return [m[f] / 10 if f == "mean_word_length" else m[f] for f in FEATURES] + [1.0]


def kind_of(m: dict, weights: np.ndarray = START) -> str:
    """The kind with the highest score; equal scores go to the first."""
    return KINDS[int(np.argmax(weights @ np.array(vector(m))))]


def fit(x: np.ndarray, y: np.ndarray, trust: float = 200.0, rounds: int = 500) -> np.ndarray:
    """Weights for feature rows ``x`` with kinds ``y`` (indices): softmax regression by gradient steps with a Gaussian prior around START, worth ``trust`` labels.

    A label that its text's score at the start contradicts counts little (by its likelihood there), as labels may be wrong.
    """
    w = START.copy()
    if not len(y):
        return w
    hot = np.eye(len(KINDS))[y]

    def likelihood(w: np.ndarray) -> np.ndarray:
        z = x @ w.T
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    sure = (likelihood(w) * hot).sum(1)
    for _ in range(rounds):
        w -= (((likelihood(w) - hot) * sure[:, None]).T @ x + trust / 10 * (w - START)) / (len(y) + trust)
    return w


def measure(texts: list[str | None], common: frozenset[str], usual: np.ndarray) -> list[dict]:
    """Statistics of texts; null and blank texts have zero counts and a junk share of 1."""
    texts = [t or "" for t in texts]
    c = Counts(texts, word_hashes(common), word_hashes(MENU_WORDS), usual)
    long = [w for w in common if len(w) > 1 and CJK.match(w)]
    out = []
    for i, text in enumerate(texts):
        n = int(c.words[i])
        lines = [x for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()]
        ended = sum(bool(LINE_END.search(x[-12:])) if x[-12:].strip() else bool(LINE_END.search(x)) for x in lines)
        hits = int(c.common[i])
        if c.cjk[i]:
            hits += sum(text.count(w) * len(w) for w in long)
        m = {
            "words": n, "mean_word_length": float(c.letters[i]) / n if n else 0.0, "symbol_ratio": int(c.symbols[i]) / max(1, len(text)), "lines": len(lines),
            "ended_lines": ended / len(lines) if lines else 0.0, "common_words": min(1.0, hits / n) if n else 0.0, "length_autocorrelation": autocorrelation([len(x) for x in lines]), "indent_periodicity": indent_period(lines),
        }
        m["junk_share"] = float(junk_share(text, c, i, m["common_words"]))
        m["table_share"], m["list_share"], m["prose_share"] = shapes(lines)
        m["swing"] = swing(lines, m)
        out.append(m)
    return out


def shapes(lines: list[str]) -> tuple[float, float, float]:
    """Shares of characters in table rows, list items and prose lines."""
    if not lines:
        return 0.0, 0.0, 0.0
    kinds: list[str] = []
    parsed = [fields(x) for x in lines]
    for i, x in enumerate(lines):
        s = x.strip()
        d, k = parsed[i]
        if RULE.match(s):
            kinds.append("rule")
        elif k >= 2 and any(0 <= j < len(lines) and (parsed[j][0] == d and parsed[j][1] >= 2 or RULE.match(lines[j].strip())) for j in (i - 1, i + 1)) and (k >= 3 or d in "|│┃║\t" or d == "gap") and not MARK.match(x):
            kinds.append("row")
        elif MARK.match(x):
            body = MARK.sub("", s)
            kinds.append("item" if len(SENTENCE_MARK.findall(body)) <= 1 and len(body) < 160 else "prose")
        elif KEY_VALUE.match(s) and not SENTENCE_MARK.search(re.sub(r"\d\.\d", "", s)):
            kinds.append("pair")
        elif not SENTENCE_MARK.search(s[:-1].replace(". ", " ") if s[0].isdigit() else s[:-1]) and (inline := INLINE.split(s)) and len(inline) >= 4 and max(len(x.split()) for x in inline) <= 5 and max(len(CJK.findall(x)) for x in inline) <= 16:
            kinds.append("item")
        elif d and d in ";；|、" and k >= 4 or s.count("、") + s.count(";") + s.count("；") >= 3 and not SENTENCE_MARK.search(s):
            kinds.append("item")
        elif SENTENCE_MARK.search(s[-3:]) or len(s.split()) > 14 or len(s) > 90 or len(CJK.findall(s)) > 24:
            kinds.append("prose")
        else:
            kinds.append("short")
    gaps = [x for x, (d, _), k in zip(lines, parsed, kinds, strict=True) if d == "gap" and k == "row"]
    if len(gaps) >= 2 and gap_columns(gaps) < 0.5:
        kinds = ["short" if k == "row" and p[0] == "gap" else k for k, p in zip(kinds, parsed, strict=True)]
    # a line of overflowing cells between rows is a row
    for i in range(1, len(kinds)):
        if kinds[i] == "short" and kinds[i - 1] == "row" and GAP.search(lines[i]) and re.search(r"\d\.\d", lines[i]):
            kinds[i] = "row"
    for i in range(len(kinds) - 2, -1, -1):
        if kinds[i] == "short" and kinds[i + 1] == "row" and GAP.search(lines[i]):
            kinds[i] = "row"
    size = dict.fromkeys(("row", "rule", "item", "pair", "prose", "short"), 0)
    for x, k in zip(lines, kinds, strict=True):
        size[k] += len(x.strip())
    total = sum(size.values())
    many = Counter(kinds)
    # bare short lines are items where they stand together or below a heading
    items = size["item"] + (size["pair"] if many["pair"] >= 2 else 0) + (size["short"] if many["short"] + many["item"] >= 3 else 0)
    rows = size["row"] + (size["rule"] if many["row"] else 0)
    return rows / total, items / total, size["prose"] / total


def swing(lines: list[str], m: dict) -> float:
    """How far indentation goes up and down with a period that the lengths of the lines follow, 0 to 1: the product of the period's share, the lengths' autocorrelation and the share of lines whose indentation changes, for six lines or more."""
    if m["lines"] < 6 or m["indent_periodicity"] < 0.9 or m["length_autocorrelation"] < 0.4:
        return 0.0
    x = [len(a) - len(a.lstrip()) for a in lines]
    change = sum(a != b for a, b in zip(x, x[1:], strict=False)) / (len(x) - 1)
    return min(1.0, 4 * m["indent_periodicity"] * m["length_autocorrelation"] * change) if change >= 0.3 else 0.0


STATS = "words bigint, mean_word_length double, symbol_ratio double, lines bigint, ended_lines double, common_words double, length_autocorrelation double, indent_periodicity double, swing double, junk_share double, table_share double, list_share double, prose_share double, text_kind string"
#: At most this many hand labels, those with the least hashes of the document, are used to fit the weights.
LABELS = 20_000


def slices(texts: list, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with at most ``most`` characters (or one text)."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < most or end == at):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def usual_pairs(docs: DataFrame, text: str) -> np.ndarray:
    """Which of the 26 x 26 pairs of letters are common: the most frequent ones of all texts' words that make up USUAL of all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(676, np.int64)
        none = np.zeros(0, bool)
        for b in batches:
            ts = b.column(0).to_pylist()
            for lo, hi in slices(ts):
                n += np.bincount(Counts([t or "" for t in ts[lo:hi]], np.zeros(0, np.uint64), np.zeros(0, np.uint64), none).pair, minlength=676)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(676, dtype=np.int32)), pa.array(n)], ["pair", "n"])

    n = np.zeros(676)
    for r in docs.select(F.col(text).alias("text")).mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        n[r["pair"]] = r["n"]
    order = np.argsort(-n, kind="stable")
    out = np.zeros(676, bool)
    out[order[: int(np.searchsorted(np.cumsum(n[order]), USUAL * n.sum())) + 1]] = True
    return out & (n > 0)


def text_statistics(docs: DataFrame, key: str, text: str, common: frozenset[str], labels: DataFrame | None = None) -> DataFrame:
    """(key, statistics, text_kind), one row per input row with a key; rows without one are left out. ``labels``: (key, text_kind), other kinds and null count for nothing.

    Letter pairs are counted over all texts, weights fitted to at most LABELS labelled ones; both stay the same for every row.
    """
    ship(docs.sparkSession)
    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null")
    usual, weights = usual_pairs(src, "text"), START
    names = [c.split()[0] for c in STATS.split(", ")]
    kind = dict(src.dtypes)["key"]

    def over(weights: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ts = b.column(1).to_pylist()
                for lo, hi in slices(ts):
                    got = measure(ts[lo:hi], common, usual)
                    best = np.argmax(np.array([vector(m) for m in got]) @ weights.T, axis=1)
                    cols = [pa.array([m[n] for m in got]) for n in names[:-1]]
                    yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], *cols, pa.array([KINDS[k] for k in best])], ["key", *names])

        return run

    if labels is not None:
        some = labels.filter(F.col("text_kind").isin(*KINDS) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col("text_kind").alias("said")).orderBy(F.xxhash64("key"), "said").limit(LABELS)
        rows = src.join(F.broadcast(some), "key").select("key", "text").mapInArrow(over(weights), f"key {kind}, {STATS}").join(F.broadcast(some), "key").orderBy("key", "said").collect()
        weights = fit(np.array([vector(r.asDict()) for r in rows], float).reshape(len(rows), len(FEATURES) + 1), np.array([KINDS.index(r["said"]) for r in rows], np.int64))
    return src.mapInArrow(over(weights), f"key {kind}, {STATS}").withColumnRenamed("key", key)


def common_words(spark, d: str) -> frozenset[str]:
    """The words of a table that does not grow."""
    return frozenset(r["w"] for r in table(spark, d, "common_word").select(F.lower(F.trim("word")).alias("w")).filter("w > ''").distinct().collect())


@query("p10_statistics")
def p10_statistics(spark, d):
    return text_statistics(table(spark, d, "documents"), "doc_id", "text", common_words(spark, d), table(spark, d, "doc_label"))


@query("p10_found")
def p10_found(spark, d):
    return p10_statistics(spark, d).filter("text_kind <> 'prose'").select("doc_id", "text_kind").distinct()
