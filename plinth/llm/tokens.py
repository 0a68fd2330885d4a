"""Tokens of whole batches of texts as NumPy arrays.

After Unicode NFKC and lower-casing a token is a maximal run of letters and digits; every other
character (also ``_``) ends it, and CJK characters (U+3400 to U+9FFF) form runs of their own.
Nothing here loops over characters in Python.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass

import numpy as np

_CLASS: np.ndarray | None = None
_BASE = np.uint64(0x9E3779B97F4A7C15)


def char_class() -> np.ndarray:
    """For each code point 0 (separator), 1 (letter or digit) or 2 (CJK)."""
    global _CLASS
    if _CLASS is None:
        c = np.fromiter((chr(i).isalnum() for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        c[0x3400:0xA000] = 2
        _CLASS = c
    return _CLASS


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def fold(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text).lower() if text else ""


@dataclass
class Chars:
    """Folded characters of a batch; text k has those from ``bounds[k]`` to ``bounds[k + 1] - 2``, then a NUL."""

    code: np.ndarray
    cls: np.ndarray
    bounds: np.ndarray

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return (np.searchsorted(self.bounds, at, "right") - 1).astype(np.int32)


def chars(texts: list[str | None], folded: bool = False) -> Chars:
    """``folded``: the texts have been through ``fold``. Null counts as empty."""
    t = [x or "" for x in texts] if folded else [fold(x) for x in texts]
    bounds = np.zeros(len(t) + 1, np.int64)
    np.cumsum(np.fromiter((len(x) + 1 for x in t), np.int64, len(t)), out=bounds[1:])
    code = np.frombuffer(("\0".join(t) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    return Chars(code, char_class()[code], bounds)


def _words(c: Chars) -> tuple[np.ndarray, np.ndarray]:
    """First positions and hashes of the runs of class 1."""
    is_word = c.cls == 1
    edge = np.diff(is_word.astype(np.int8), prepend=np.int8(0))
    start = np.flatnonzero(edge == 1)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    end = np.flatnonzero(edge == -1)
    if len(end) < len(start):
        end = np.append(end, len(c.code))
    n = end - start
    at = np.flatnonzero(is_word)
    first = np.repeat(np.cumsum(n) - n, n)
    power = np.ones(int(n.max()), np.uint64)
    power[1:] = _BASE
    power = np.cumprod(power, dtype=np.uint64)
    h = mix(c.code[at].astype(np.uint64) + np.uint64(1)) * power[np.arange(len(at)) - first]
    return start, mix(np.add.reduceat(h, np.cumsum(n) - n) + n.astype(np.uint64))


def sequence(c: Chars) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens in order, each CJK character one token: document of each, its first position, its hash."""
    start, h = _words(c)
    cjk = np.flatnonzero(c.cls == 2)
    at = np.concatenate([start, cjk])
    h = np.concatenate([h, mix(c.code[cjk].astype(np.uint64) + np.uint64(1 << 40))])
    order = np.argsort(at, kind="stable")
    at = at[order]
    return c.doc_of(at), at, h[order]


def shingle_set(c: Chars) -> tuple[np.ndarray, np.ndarray]:
    """Words, every two neighbouring CJK characters of a run, and lone CJK characters: document and hash of each."""
    start, h = _words(c)
    is_cjk = c.cls == 2
    after = np.append(is_cjk[1:], False)
    before = np.concatenate([[False], is_cjk[:-1]])
    pair = np.flatnonzero(is_cjk & after)
    lone = np.flatnonzero(is_cjk & ~after & ~before)
    code = c.code.astype(np.uint64)
    at = np.concatenate([start, pair, lone])
    two = (code[pair] << np.uint64(21)) | code[np.minimum(pair + 1, len(code) - 1)]
    h = np.concatenate([h, mix(two + np.uint64(1 << 50)), mix(code[lone] + np.uint64(1 << 40))])
    return c.doc_of(at), h
