"""Problem 3: noise in text from scanned pages.

All texts give counts of words and of neighbouring CJK characters (a count-min sketch whose size follows the data up to a bound) and how often words,
and CJK characters as words of their own, occur within two places of each other. From these sums the driver learns skip-gram vectors: by
gradient steps on the skip-gram objective with negative sampling, in expectation over all pairs, so that every row of the input counts
and no sample is drawn. What is misread for what is learnt too: from the repairs that cleaned chunks record, and from what differs between
their page text and their cleaned text.

In a pending chunk, page furniture is found by form, page numbers and titles that the file repeats; then each rare word is linked to frequent
words that plausible glyph edits reach and that are neighbours of its context by their vectors, and the one that fits
best is the correction; CJK characters likewise. What is left is reflowed into paragraphs.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm import tokens
from plinth.llm.registry import query
from plinth.runtime import Stage, ship, table

#: Rows of the sketch of counts, and its cells a row: one for 64 characters of all texts, between these powers of two (8 to 32 MB are broadcast).
ROWS, LEAST_CELLS, MOST_CELLS = 2, 20, 22
#: Hashed words and contexts that have vectors, dimensions, negative samples a pair, and gradient steps.
WORDS, CONTEXTS, DIMS, NEGATIVE, STEPS = 1 << 13, 128, 24, 5, 40

#: Letters that stand for digits, and digits for letters, in numbers and codes.
DIGIT_LIKE = {"O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "B": "8", "Z": "2", "!": "1", "|": "1"}

HYPHENS = "-‐‑¬­"
CJK = re.compile(r"[㐀-鿿]")
CJK_RUN = re.compile(r"[㐀-鿿]+")
WORD = re.compile(r"[A-Za-zÀ-ɏ]+(?:[-‐‑][A-Za-zÀ-ɏ]+)*")
SIMPLE = re.compile(r"[A-Za-zÀ-ɏ]+")
PAGE_FORMS = [re.compile(p, re.I) for p in (r"^[\[(（【<—–\-·•.*~\s]*(\d{1,5})[\])）】>—–\-·•.*~\s]*$", r"^(?:page|pg|p|pp)[.．:：]?\s*(\d{1,5})(?:\s*(?:of|/)\s*\d{1,5})?\s*$", r"^第\s*(\d{1,5})\s*页(?:\s*[/,，、]?\s*共\s*\d{1,5}\s*页)?$", r"^(\d{1,5})\s*/\s*\d{1,5}$")]
ROMAN = re.compile(r"^[\[(·•—–\-\s]*(?=[ivxlcdm])m{0,2}(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})[\])·•—–\-\s]*$", re.I)
NUMBERED = re.compile(r"^\s*(?:\d{1,2}(?:\.\d{1,2}){1,3}|[（(]?[一二三四五六七八九十]{1,3}[)）、.]|\d{1,2}[.)、])\s+\S")
CHAPTER = re.compile(r"^(?:第\s*[\d一二三四五六七八九十百]+\s*[章篇部]|chapter\s+\w+|part\s+[ivx\d]+\b)", re.I)
NUM_HEAD, NUM_TAIL = re.compile(r"^\s*((?=[\dOolISBZ]*\d)[\dOolISBZ!|]{1,5})(?:\s{2,}|\s*[|·•—–]\s*|\s+(?=\D))"), re.compile(r"(?:\s{2,}|\s*[|·•—–]\s*|\s+)((?=[OolISBZ!|]*\d)[\dOolISBZ!|]{1,5})\s*$")
STOPS = re.compile(r"[。，；：！？,;:!?]|[.](?:\s|$)")
SENTENCE_END = re.compile(r"[。！？!?…]|[.](?:[\"'”’)]*)$")


_MASK = (1 << 64) - 1


def _mix(h: int) -> int:
    """``tokens.mix`` of one integer."""
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & _MASK
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & _MASK
    return h ^ h >> 31


_POWERS = [1]
_CHARS: dict[str, int] = {}


def word_hash(w: str) -> int:
    """The hash that ``tokens`` gives a word of these characters."""
    while len(_POWERS) < len(w):
        _POWERS.append(_POWERS[-1] * int(tokens._BASE) & _MASK)
    total = len(w)
    for c, p in zip(w, _POWERS, strict=False):
        m = _CHARS.get(c)
        if m is None:
            m = _CHARS[c] = _mix(ord(c) + 1)
        total += m * p
    return _mix(total & _MASK)


def cells(h: np.ndarray, n: int) -> np.ndarray:
    """The sketch's cell of each hash in every row, (ROWS, n)."""
    h = h.astype(np.uint64)
    return np.stack([(tokens.mix(h + np.uint64(r * 7919)) % np.uint64(n)).astype(np.int64) + r * n for r in range(ROWS)])


_LATIN: np.ndarray | None = None


def latin() -> np.ndarray:
    """For each code point 1 (letter of WORD), 2 (CJK) or 0."""
    global _LATIN
    if _LATIN is None:
        c = np.zeros(len(tokens.char_class()), np.uint8)
        c[65:91] = c[97:123] = c[0xC0:0x250] = 1
        c[0x3400:0xA000] = 2
        _LATIN = c
    return _LATIN


def count_arrays(texts: list[str], n: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(cells, counts) of a sketch with ``n`` cells a row, and (cells, counts) of words within two places: word * CONTEXTS + context."""
    code = np.frombuffer(("\0".join(t.lower() for t in texts) + "\0\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where((code == 0x2010) | (code == 0x2011), 45, code)
    cls = latin()[code]
    bounds = np.array([0, len(code)])
    start, h = tokens._words(tokens.Chars(code, cls, bounds))
    # compounds: words with hyphens inside count whole and by their parts
    hyphen = np.flatnonzero((code[1:-1] == 45) & (cls[:-2] == 1) & (cls[2:] == 1)) + 1
    whole = np.zeros(0, np.uint64)
    if len(hyphen):
        joint = cls.copy()
        joint[hyphen] = 1
        at, hj = tokens._words(tokens.Chars(code, joint, bounds))
        whole = hj[np.unique(np.searchsorted(at, hyphen, "right") - 1)]
    cjk = np.flatnonzero(cls == 2)
    hc = tokens.mix(code[cjk].astype(np.uint64) + np.uint64(1 << 40))
    key, count = np.unique(np.concatenate([h, whole, pair_hashes(texts)]), return_counts=True)
    sketch = cells(key, n).ravel()
    # words and characters in order, texts apart
    end = np.flatnonzero(code == 0)
    at = np.concatenate([start, cjk, end])
    order = np.argsort(at, kind="stable")
    seq = np.concatenate([h, hc, np.zeros(len(end), np.uint64)])[order]
    inside = (np.concatenate([np.ones(len(start) + len(cjk), bool), np.zeros(len(end), bool)]))[order]
    word, context = slots(seq)
    near = []
    for d in (1, 2):
        ok = inside[:-d] & inside[d:] & (inside[1:-1] if d == 2 else True)
        near += [word[:-d][ok] * CONTEXTS + context[d:][ok], word[d:][ok] * CONTEXTS + context[:-d][ok]]
    cell, times = np.unique(np.concatenate(near), return_counts=True)
    return (sketch, np.tile(count, ROWS)), (cell, times)


def slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and context cells of hashes."""
    return (h % np.uint64(WORDS)).astype(np.int64), ((h >> np.uint64(40)) % np.uint64(CONTEXTS)).astype(np.int64)


def learn_vectors(counts: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(words, contexts) vectors from the counts of their pairs: Adam steps on the mean skip-gram objective with negative sampling,
    #(w, c) log s(wc) + NEGATIVE #(w) #(c) / N log s(-wc), over all pairs at once."""
    c = counts.reshape(WORDS, CONTEXTS).astype(np.float32)
    total = max(1.0, float(c.sum()))
    r = np.random.default_rng(seed)
    u, v = (r.normal(0, 0.1, (n, DIMS)).astype(np.float32) for n in (WORDS, CONTEXTS))
    row, col = c.sum(1, keepdims=True), c.sum(0, keepdims=True)
    # each word's pairs and its negative samples count by shares, so that words of every frequency learn alike fast
    pos = c / np.maximum(row, 1)
    neg = NEGATIVE * np.where(row > 0, col / total, 0).astype(np.float32)
    moments = [np.zeros_like(x) for x in (u, u, v, v)]
    weight = np.sqrt(row / total).astype(np.float32)
    for t in range(1, STEPS + 1):
        s = 1 / (1 + np.exp(-np.clip(u @ v.T, -20, 20)))
        g = pos * (1 - s) - neg * s
        for k, (x, d) in enumerate(((u, g @ v), (v, (g * weight).T @ u))):
            m, q = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (d - m)
            q += 0.05 * (d * d - q)
            x += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.95**t)) + 1e-6)
    return np.where(row > 0, u, 0).astype(np.float32), v


def pair_hashes(texts: list[str]) -> np.ndarray:
    """Hashes of neighbours in CJK runs, 0 for what is beyond a run."""
    code = np.frombuffer(("\n" + "\n".join(re.sub(r"\s+", "", t) for t in texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    cjk = (code >= 0x3400) & (code < 0xA000)
    c = np.where(cjk, code, np.uint64(0))
    near = cjk[:-1] | cjk[1:]
    return pair_key(c[:-1][near], c[1:][near])


def pair_key(a, b):
    return (np.uint64(1) << np.uint64(60)) | (np.uint64(a) if np.isscalar(a) else a) << np.uint64(21) | (np.uint64(b) if np.isscalar(b) else b)


#: Entries that a task's look-up tables hold before they are emptied; they only save repeated work.
MEMO = 200_000


def remember(memo: dict, key, value):
    if len(memo) >= MEMO:
        memo.clear()
    memo[key] = value
    return value


class Model:
    """Counts, vectors and confusions, looked up by word or pair of characters."""

    def __init__(self, sketch: np.ndarray, words: np.ndarray, contexts: np.ndarray, learnt: dict[str, list[str]]):
        self.sketch, self.n, self.memo, self.pairs, self.sound = sketch, len(sketch) // ROWS, {}, {}, set()
        self.words, self.contexts = words, contexts
        used = words[words.any(1)]
        self.mean, self.spread = (used.mean(0), np.atleast_2d(np.cov(used.T))) if len(used) > 1 else (np.zeros(DIMS), np.zeros((DIMS, DIMS)))
        self.glyphs: dict[str, list[str]] = defaultdict(list)
        self.cjk: dict[str, list[str]] = defaultdict(list)
        for wrong, rights in learnt.items():
            (self.cjk if CJK.match(wrong) else self.glyphs)[wrong] += rights
        self.suspects = re.compile("[" + "".join(map(re.escape, self.cjk)) + "]") if self.cjk else re.compile(r"(?!)")
        self.memo_fix: dict[str, list] = {}
        self.skeleton = Skeleton(learnt)

    def _count(self, h: int) -> int:
        return min(int(self.sketch[_mix((h + r * 7919) & _MASK) % self.n + r * self.n]) for r in range(ROWS))

    def count(self, word: str) -> int:
        n = self.memo.get(word)
        return remember(self.memo, word, self._count(word_hash(word))) if n is None else n

    def pair(self, a: str, b: str) -> int:
        """Count of neighbours in a CJK run; an empty string is what is beyond it."""
        n = self.pairs.get(a + "\0" + b)
        return remember(self.pairs, a + "\0" + b, self._count(1 << 60 | (ord(a) if a else 0) << 21 | (ord(b) if b else 0))) if n is None else n

    def fit(self, words: list[str], around: list[str]) -> list[float]:
        """How near each word is to the context by the vectors, in standard deviations of all words; 0 without a context."""
        if not around:
            return [0.0] * len(words)
        slot = lambda ws: slots(np.array([self.slot_hash(w) for w in ws], np.uint64))
        c = self.contexts[slot(around)[1]].mean(0)
        return (((self.words[slot(words)[0]] - self.mean) @ c) / max(1e-6, float(np.sqrt(max(0.0, c @ self.spread @ c))))).tolist()

    @staticmethod
    def slot_hash(w: str) -> int:
        return _mix(ord(w) + (1 << 40)) if len(w) == 1 and CJK.match(w) else word_hash(w)

    def variants(self, word: str) -> Iterator[tuple[str, int]]:
        """Words one glyph edit away, and where the edit is."""
        for at in range(len(word)):
            for n in (1, 2):
                for right in self.glyphs.get(word[at : at + n], ()) if at + n <= len(word) else ():
                    yield word[:at] + right + word[at + n :], at

    def fixes(self, word: str) -> list[tuple[int, str, int]]:
        """(count, frequent neighbour, place) of a word that is rare beside it, two edits where one is not enough. Only the ratio of counts decides, so that a larger corpus gives the same."""
        out = self.memo_fix.get(word)
        if out is None:
            n = self.count(word)
            least = max(4, 15 * n)
            one = list(self.variants(word))
            out = [(c, v, at) for v, at in one if (c := self.count(v)) >= least and SIMPLE.fullmatch(v)]
            if not out and len(word) >= 5:
                out = [(c, v, min(at, at2)) for w, at in one for v, at2 in self.variants(w) if v != word and (c := self.count(v)) >= max(20, least) and SIMPLE.fullmatch(v)]
            remember(self.memo_fix, word, out)
        return out


_DIGITS = str.maketrans("OolI!|SBZ", "001111582")


class Skeleton:
    """Titles with what is mistaken for each other made one: the learnt confusions, longest first, and letters like digits."""

    def __init__(self, learnt: dict[str, list[str]]):
        one = {w: rs[0] for w, rs in learnt.items()}
        self.long = sorted(((w.casefold(), r.casefold()) for w, r in one.items() if len(w.casefold()) > 1 and w.casefold() != r.casefold()), key=lambda x: (-len(x[0]), x))
        single = {w.casefold(): r.casefold() for w, r in one.items() if len(w.casefold()) == 1} | {"0": "o", "1": "l"}
        self.table: dict[int, str] = {}
        for w in single:
            r, seen = w, set()
            while r in single and r not in seen:
                seen.add(r)
                r = single[r]
            # a circle of confusions is named by its least member
            self.table[ord(w)] = min(seen) if r in seen else r

    def __call__(self, title: str) -> str:
        t = title.casefold()
        for a, b in self.long:
            t = t.replace(a, b)
        return t.translate(self.table)


def page_number(line: str, pages: set[int]) -> bool:
    """Whether a line is only a page number and its trimmings; a bare number must be near the chunk's pages, if these are known."""
    s = line.strip()
    if len(s) > 40:
        return False
    if ROMAN.match(s):
        return True
    if not any(c.isdigit() for c in s):
        return False
    # digits that were misread as letters, beside words that are known
    words = re.sub(r"[^\s\[\](){}<>·•—–\-./]+", lambda m: m[0].translate(_DIGITS) if any(c.isdigit() for c in m[0]) and "第" not in m[0] and "页" not in m[0] else m[0], s)
    if "页" in words:
        words = re.sub(r"(?<=第)\s*\S+?\s*(?=页)|(?<=共)\s*\S+?\s*(?=页)", lambda m: m[0].translate(_DIGITS), words)
    for i, p in enumerate(PAGE_FORMS):
        m = p.match(words)
        if m:
            return i in (1, 2) or not pages or any(abs(int(m[1]) - x) <= 2 for x in pages)
    return False


#: By definition a title is a line of at most so many characters, of CJK characters, of words.
TITLE, TITLE_CJK, TITLE_WORDS = 90, 40, 10


def title_of(line: str, pages: set[int], skeleton: Skeleton) -> tuple[str, bool] | None:
    """(normalised title, whether a page number stands with it) of a line with the form of a running header."""
    s = line.strip()
    if not s or len(s) > TITLE or NUMBERED.match(s):
        return None
    numbered = False
    for p in (NUM_HEAD, NUM_TAIL):
        m = p.search(s)
        if m and (not pages or any(abs(int(m[1].translate(_DIGITS)) - x) <= 2 for x in pages)):
            s = (s[: m.start()] + s[m.end() :]).strip(" |·•—–-")
            numbered = True
            break
    if not s or STOPS.search(s) or s[-1] in HYPHENS or re.search(r"\d{2}|\b\d|\d\b(?<![A-Za-z]\d)", CHAPTER.sub("", s)):
        return None
    if CJK.search(s):
        if len(s) > TITLE_CJK:
            return None
    else:
        words = s.split()
        if len(words) > TITLE_WORDS or not all(w[0].isupper() or w.lower() in ("of", "the", "and", "in", "for", "on", "to", "a", "an", "with", "by", "at", "from") for w in words if w[0].isalpha()) or not any(c.isalpha() for c in s):
            return None
    return skeleton(re.sub(r"\s+", " ", s)), numbered


def furniture(lines: list[str], pages: set[int], known: set[str], skeleton: Skeleton) -> dict[int, str]:
    """Kind of each line (from 0) that is a running header or a page number."""
    out: dict[int, str] = {}
    title: dict[int, tuple[str, bool]] = {}
    for i, x in enumerate(lines):
        if not x.strip():
            continue
        if page_number(x, pages):
            out[i] = "page_number"
        elif t := title_of(x, pages, skeleton):
            title[i] = t
    seen = defaultdict(int)
    for t, _ in title.values():
        seen[t] += 1
    widest = max(map(len, lines), default=0)
    last = max((i for i, x in enumerate(lines) if x.strip()), default=0)
    first = min((i for i, x in enumerate(lines) if x.strip()), default=0)
    for i, (t, numbered) in title.items():
        edge = i == first or i - 1 in out or i + 1 in out and i != last
        zh = bool(CJK.search(t))
        # a line of Chinese without a stop may be body text; of one language it must be a title in itself
        short = len(t) < 0.7 * widest if zh else len(t.split()) <= 7 and not (lines[i].isupper() and any(0 <= j < len(lines) and sum(c.isupper() for c in lines[j]) > 0.5 * max(1, sum(c.isalpha() for c in lines[j])) and j not in title for j in (i - 1, i + 1)))
        if numbered or t in known or seen[t] > 1 or CHAPTER.match(lines[i].strip()) or short and (not zh and i != last or edge and (not zh or i != last or i == first)):
            out[i] = "running_header"
    return out


def unbroken(left: str, right: str, mark: str, model: Model) -> bool:
    """Whether the hyphen between the parts belongs to the word."""
    a, b = left.lower(), right.lower()
    if not a or not b:
        return True
    with_, without = model.count(f"{a}-{b}"), model.count(a + b)
    if mark in "¬­":
        return with_ > 20 * max(1, without)
    if with_ or without:
        return with_ >= without
    # a longer compound: its head
    return model.count(a) >= 3 and model.count(b) >= 3


#: Units that stand apart from their number.
UNIT = re.compile(r"分钟|小时")
TOKEN = re.compile(r"[^\s㐀-鿿，。；：！？、（）“”‘’《》]+")
EDGE = " .,;:()[]{}\"'“”‘’…/"


class Body:
    """Characters of the body without furniture, each with its line; words divided by the layout are joined."""

    def __init__(self, lines: list[str], skip: dict[int, str], model: Model):
        self.breaks: list[int] = []
        self.parts: list[str] = []
        self.starts: list[int] = []
        self.lines: list[int] = []
        self.size = 0
        todo = [i for i in range(len(lines)) if i not in skip]
        while todo and not lines[todo[-1]].strip():
            todo.pop()
        for n, i in enumerate(todo):
            s = lines[i].strip()
            if not s:
                # furniture between blank lines is no end of a paragraph by itself
                if self.parts and self.parts[-1] != "\n" and SENTENCE_END.search(self.parts[-1].rstrip()[-3:] or self.parts[-2][-3:]) or not self.parts or (n + 1 < len(todo) and NUMBERED.match(lines[todo[n + 1]])) or (n > 0 and NUMBERED.match(lines[todo[n - 1]])):
                    self.add("\n", i)
                continue
            nxt = next((lines[j].strip() for j in todo[n + 1 :] if lines[j].strip()), "")
            cut = False
            if s[-1] in HYPHENS and len(s) > 1:
                left = re.search(r"[^\W\d_]+$", s[:-1])
                right = re.match(r"[^\W\d_]+", nxt)
                if left and right and not CJK.search(left[0] + right[0]) and not (left[0].isupper() and len(left[0]) <= 3):
                    if not unbroken(left[0], right[0], s[-1], model):
                        self.breaks.append(i)
                        s, cut = s[:-1], True
                    elif s[-1] in "¬­":
                        s = s[:-1] + "-"
                        cut = True
                    else:
                        cut = True
                elif s[-1] in "-‐‑" and nxt[:1].isdigit():
                    cut = True
            self.add(s, i)
            if not cut and nxt:
                wide = "，。；：！？、（）“”《》"
                glued = CJK.match(s[-1]) or CJK.match(nxt[0]) or s[-1] in wide or nxt[0] in wide
                if s[-1].isdigit() and UNIT.match(nxt):
                    glued = False
                if NUMBERED.match(s) and len(s) < 60:
                    self.add("\n", i)
                elif not glued:
                    self.add(" ", i)

    def add(self, s: str, i: int) -> None:
        if s == "\n" and (not self.parts or self.parts[-1] == "\n"):
            return
        self.parts.append(s)
        self.starts.append(self.size)
        self.lines.append(i)
        self.size += len(s)

    def line_of(self, at: int) -> int:
        return self.lines[bisect.bisect_right(self.starts, at) - 1]


def number_fix(w: str) -> tuple[str, int] | None:
    """The number or code that a token with a misread digit stands for, and where the first wrong character is."""
    m = re.fullmatch(r"([A-Z]{2,3})[-‐]([0-9OolISBZ!|]{2,})", w)
    if m and re.search(r"\d", m[2]) and re.search(r"\D", m[2]):
        return m[1] + "-" + "".join(DIGIT_LIKE.get(c, c) for c in m[2]), m.start(2) + re.search(r"\D", m[2]).start()
    m = re.fullmatch(r"([0-9OolISBZ!|]+(?:[.,][0-9OolISBZ!|]+)?)(%|℃|°C)?", w)
    if m and re.search(r"\d", m[1]) and (x := re.search(r"[OolISBZ!|]", m[1])):
        return "".join(DIGIT_LIKE.get(c, c) for c in m[1]) + (m[2] or ""), x.start()
    return None


def repair(body: Body, model: Model) -> list[tuple[int, int, str, str]]:
    """(position, length, wrong, right) of the misread words and characters, in order."""
    text = "".join(body.parts)
    out: list[tuple[int, int, str, str]] = []
    words = [(m.start(), m[0]) for m in TOKEN.finditer(text)]
    plain: list[str] = []
    for k, (at, raw) in enumerate(words):
        if raw in model.sound:
            continue
        before = len(out)
        doubt = False
        core = raw.lstrip(EDGE)
        at += len(raw) - len(core)
        core = core.rstrip(EDGE)
        stripped = core.rstrip("!?") if not re.search(r"[!|]", core[:-1]) else core
        core = stripped
        if not core:
            continue
        fix = number_fix(core)
        if fix:
            out.append((at, len(core), core, fix[0]))
            continue
        for m in re.finditer(r"[^-‐‑]+", core):
            w = m[0]
            if len(w) < 3 or not any(c.isalpha() for c in w) or w.isupper() and w.isalpha():
                continue
            low = w.lower()
            odd = bool(re.search(r"[A-Za-z][0-9!|]+[A-Za-z]|^[0-9!|]+[a-z]{3,}|[a-z]{3,}[0-9!|]+$|[a-zü]ü|ü[a-z]", w))
            if not odd and not SIMPLE.fullmatch(w):
                continue
            found = model.fixes(low)
            doubt = doubt or bool(found)
            if found:
                plain = plain or [w.strip(EDGE + "!?").lower() for _, w in words]
                near = [x for x in plain[max(0, k - 2) : k] + plain[k + 1 : k + 3] if x]
                best = max(zip(found, model.fit([f[1] for f in found], near), strict=True), key=lambda x: math.log(x[0][0]) + x[1])
                # no neighbour of this context
                if best[1] < FAR:
                    continue
                best = best[0]
                name = w[0].isupper() and not w.isupper() and (at == 0 or k == 0 or text[max(0, at - 2) : at].strip()[-1:] not in ".。\n")
                if name and best[0] < 40:
                    continue
                right = best[1].capitalize() if w[0].isupper() else best[1]
                out.append((at + m.start(), len(w), w, right))
            elif odd and not re.fullmatch(r"[A-Z]{1,3}\d+|[a-z]{1,2}\d+|\d+[a-z]{1,3}|\d+[A-Z]{1,2}", w) and re.search(r"[A-Za-z]{2}[0-9!|]|[0-9!|][a-z]{2}", w):
                at2 = re.search(r"[0-9!|]", w)
                fixed = re.sub(r"[!|]", "i", w.replace("0", "o").replace("1", "l").replace("5", "s"))
                if at2 and fixed != w and SIMPLE.fullmatch(fixed):
                    out.append((at + m.start(), len(w), w, fixed))
        if not doubt and len(out) == before and len(model.sound) < 200_000:
            model.sound.add(raw)
    for m in model.suspects.finditer(text):
        i, x = m.start(), m[0]
        left, right = text[i - 1] if i else "", text[i + 1] if i + 1 < len(text) else ""
        # what has been read on the left may have been repaired
        if out and out[-1][0] == i - 1 and len(out[-1][3]) == 1:
            left = out[-1][3]
        left, right = left if CJK.match(left or " ") else "", right if CJK.match(right or " ") else ""
        was = math.log(model.pair(left, x) + 0.5) + math.log(model.pair(x, right) + 0.5)
        best, gain = "", 0.0
        around = [c for c in text[max(0, i - 2) : i] + text[i + 1 : i + 3] if CJK.match(c)]
        for y, near in zip(model.cjk[x], model.fit(model.cjk[x], around), strict=True):
            if near < FAR:
                continue
            a, b = model.pair(left, y) if left else 0, model.pair(y, right) if right else 0
            if max(a, b) < 5:
                continue
            now = math.log(model.pair(left, y) + 0.5) + math.log(model.pair(y, right) + 0.5)
            if now - was > gain:
                best, gain = y, now - was
        if best and gain > THRESHOLD:
            out.append((i, 1, x, best))
    return sorted(out)


#: A word or character so many standard deviations farther from the context than the mean of all is no neighbour of it.
FAR = -2.0
#: How much more likely (log of counts with both neighbours) a CJK character must be than the one read.
THRESHOLD = 4.0


def clean(text: str, pages: list[int] | None, known: set[str], model: Model) -> tuple[list[tuple[int, str]], str, list[dict[str, str]]]:
    """((line from 1, kind) rows, continuous paragraphs, repairs) of a page text."""
    lines = re.sub(r"\r\n?", "\n", text).split("\n")
    near = {p for p in pages or [] if p is not None}
    out = furniture(lines, near, known, model.skeleton)
    body = Body(lines, out, model)
    fixes = repair(body, model)
    rows = {(i + 1, k) for i, k in out.items()} | {(i + 1, "hyphen_break") for i in body.breaks}
    for at, n, wrong, right in fixes:
        # the first character that differs tells the line
        d = next((j for j in range(min(len(wrong), len(right))) if wrong[j] != right[j]), min(len(wrong), len(right)) - 1)
        rows.add((body.line_of(at + max(0, min(d, n - 1))) + 1, "misread"))
    chars = list("".join(body.parts))
    for at, n, _, right in reversed(fixes):
        chars[at : at + n] = list(right)
    paragraphs = [p.strip() for p in "".join(chars).split("\n")]
    return sorted(rows), "\n\n".join(p for p in paragraphs if p), [{"original": w, "repaired": r} for _, _, w, r in fixes]


def diff_pairs(wrong: str | None, right: str | None) -> list[tuple[str, str]]:
    """What was misread for what in a recorded repair, where that is one place of at most two characters."""
    if not wrong or not right or wrong == right:
        return []
    a = 0
    while a < min(len(wrong), len(right)) and wrong[a] == right[a]:
        a += 1
    z = 0
    while z < min(len(wrong), len(right)) - a and wrong[-1 - z] == right[-1 - z]:
        z += 1
    x, y = wrong[a : len(wrong) - z], right[a : len(right) - z]
    if not x or not y:
        # ii for u and the like overlap with their neighbours
        return []
    return [(x, y)] if len(x) <= 2 and len(y) <= 2 else []


def summed(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sketch, counts of neighbours) of the texts in the only column: cells are summed map-side and by cell, so no task and not the driver sees more than the arrays' sizes."""
    sizes = (ROWS * n, WORDS * CONTEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(k, np.int64) for k in sizes]
        for b in batches:
            texts = [x for x in b.column(0).to_pylist() if x]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (size < 1_000_000 or end == at):
                    size += len(texts[end])
                    end += 1
                for t, (cell, count) in zip(total, count_arrays(texts[at:end], n), strict=True):
                    np.add.at(t, cell, count)
                at = end
        for k, t in enumerate(total):
            cell = np.flatnonzero(t)
            for lo in range(0, len(cell), 100_000):
                part = cell[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part + k * sizes[0]), pa.array(t[part])], ["cell", "n"])

    got = rows.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(sum(sizes), np.int64)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out[: sizes[0]].clip(0, 2**32 - 1).astype(np.uint32), out[sizes[0] :]


def text_confusions(page: str, clean: str) -> list[tuple[str, str]]:
    """What differs between a page text and its cleaned text in one place of a word, or in one CJK character between the same two others."""
    out = []
    read = lambda t: {w.strip(EDGE) for w in TOKEN.findall(t)}
    a, b = read(page), read(clean)
    wrong, right = a - b, b - a
    by_edge: dict[tuple, list[str]] = defaultdict(list)
    for r in right:
        if len(r) >= 4:
            by_edge["^", r[:2]].append(r)
            by_edge["$", r[-2:]].append(r)
    for w in wrong:
        if len(w) >= 4:
            near = {r for k in (("^", w[:2]), ("$", w[-2:])) for r in by_edge.get(k, ()) if abs(len(r) - len(w)) <= 1}
            if len(near) == 1:
                out += diff_pairs(w, near.pop())
    x, y = ("".join(CJK_RUN.findall(t)) for t in (page, clean))
    x, y = (set(zip(t, t[1:], t[2:], strict=False)) for t in (x, y))
    between: dict[tuple[str, str], set[str]] = defaultdict(set)
    for p, q, r in y - x:
        between[p, r].add(q)
    for p, q, r in x - y:
        if len(c := between.get((p, r), ())) == 1:
            out += [(q, c0) for c0 in c]
    return out


#: A difference of texts that no repair records counts as a confusion from so many occurrences on and from this share of all differences, whatever the size of the
#: input; and for one wrong glyph only those right ones that have a tenth of the commonest one's.
SEEN, LEAST_SHARE, SHARE = 3, 0.001, 0.1


def learnt_confusions(chunks: DataFrame) -> dict[str, list[str]]:
    """What is misread for what, commonest first: pairs of at most two characters in recorded repairs, and in the texts of cleaned chunks. The driver gets one row per distinct pair that counts: they are as many as glyphs are alike, not as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for repairs, page, clean in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                for m in repairs or ():
                    m = dict(m or ())
                    rows += [(w, r, 1) for w, r in diff_pairs(m.get("original"), m.get("repaired"))]
                if page and clean and clean.strip():
                    rows += [(w, r, 0) for w, r in text_confusions(page, clean)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))], ["wrong", "right", "recorded"])

    pairs = chunks.select("ocr_repairs", "original_text", "cleaned_text").mapInArrow(run, "wrong string, right string, recorded int")
    rows = pairs.groupBy("wrong", "right").agg(F.count(F.lit(1)).alias("n"), F.max("recorded").alias("recorded")).filter(f"recorded = 1 or n >= {SEEN}").collect()
    whole = sum(r["n"] for r in rows)
    out: dict[str, list[str]] = defaultdict(list)
    most: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (-r["n"], r["wrong"], r["right"])):
        w, x = r["wrong"], r["right"]
        if (w in DIGIT_LIKE and x.isdigit()) or x.isspace() or w.isspace() or bool(CJK.search(w)) != bool(CJK.search(x)) or w in HYPHENS or x in HYPHENS:
            continue
        if w.casefold() != x.casefold() and (r["recorded"] or r["n"] >= max(LEAST_SHARE * whole, SHARE * most.setdefault(w, r["n"]))):
            out[w].append(x)
    return dict(out)


def denoise(spark, chunks: DataFrame) -> DataFrame:
    """(chunk_id, noise, cleaned_text, ocr_repairs) of the chunks whose cleaned_text is null or blank.

    ``noise``: array of (line_no, noise_kind). Null and empty page texts have no noise and no text. A chunk that comes again with
    the same text gives the same row again.
    """
    blank = F.coalesce(F.trim(F.regexp_replace("cleaned_text", r"(?U)\s+", " ")), F.lit("")) == ""
    text = F.when(blank, F.col("original_text")).otherwise(F.col("cleaned_text"))
    ship(spark)
    chars = chunks.agg(F.sum(F.length(text))).first()[0] or 0
    n = 1 << max(LEAST_CELLS, min(MOST_CELLS, (chars // 64).bit_length()))
    sketch, context = summed(chunks.select(text.alias("text")), n)
    learnt = learnt_confusions(chunks)
    held = spark.sparkContext.broadcast((sketch, *learn_vectors(context), learnt))

    def titles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeleton = Skeleton(held.value[3])
        for b in batches:
            rows = []
            for i, f, t, p in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                near = {x for x in p or [] if x is not None}
                found = {x[0] for line in t.split("\n") if (x := title_of(line, near, skeleton))}
                rows += [(i, f, x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["chunk_id", "source_file", "title"])

    source = chunks.filter("chunk_id is not null and original_text is not null")
    # read by the count and by the join below
    found = Stage(spark, "p3").keep(source.select("chunk_id", F.lower(F.trim("source_file")).alias("source_file"), "original_text", "page_numbers").mapInArrow(titles, "chunk_id string, source_file string, title string").distinct(), "titles")
    again = found.groupBy("source_file", "title").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and source_file is not null").select("source_file", "title")
    pending = source.filter(blank).select("chunk_id", "original_text", "page_numbers")
    known = found.join(again, ["source_file", "title"]).join(pending.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.collect_set("title").alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        kinds = pa.list_(pa.struct([("line_no", pa.int64()), ("noise_kind", pa.string())]))
        for b in batches:
            got = [clean(t, p, set(k or ()), model) for t, p, k in zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True)]
            noise = pa.array([[{"line_no": n, "noise_kind": k} for n, k in g[0]] for g in got], kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), noise, pa.array([g[1] for g in got], pa.string()), pa.array([[list(x.items()) for x in g[2]] for g in got], pa.list_(pa.map_(pa.string(), pa.string())))], ["chunk_id", "noise", "cleaned_text", "ocr_repairs"])

    whole = pending.join(known, "chunk_id", "left").select("chunk_id", "original_text", "page_numbers", "known")
    return whole.mapInArrow(run, "chunk_id string, noise array<struct<line_no: bigint, noise_kind: string>>, cleaned_text string, ocr_repairs array<map<string, string>>")


def pages(spark, d: str) -> DataFrame:
    return table(spark, d, "cleaned_chunk").select("chunk_id", "source_file", "page_numbers", "original_text", "cleaned_text", "ocr_repairs")


@query("p3_found")
def p3_found(spark, d):
    return denoise(spark, pages(spark, d)).select("chunk_id", F.explode("noise").alias("x")).select("chunk_id", "x.line_no", "x.noise_kind").distinct()


@query("p3_cleaned")
def p3_cleaned(spark, d):
    """One row per pending chunk: its paragraphs and repairs."""
    return denoise(spark, pages(spark, d)).drop("noise").dropDuplicates(["chunk_id"])
