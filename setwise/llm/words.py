"""Words of a text, whatever its layout, markup and spelling of letters; shared by the operators of this subpackage."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import xxhash

_BREAK = re.compile(r"<\s*/?\s*(?:br|p|div|li|ul|ol|blockquote|hr|tr|td)\b[^<>]*>|\[/?(?:quote|list|code)[^\[\]]*\]", re.I)
_TAG = re.compile(r"<[/a-zA-Z!][^<>]*>|\[/?[A-Za-z*]+(?:=[^\[\]]*)?\]")
_HIDDEN = re.compile("[­​-‏⁠﻿̀-ͯ]")
_HYPHEN = re.compile(r"(?<=[^\W\d_])-\s*\n\s*(?:>\s*)*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """The text without markup, entities, hidden signs and accents, in lower case."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text or "[" in text:
        text = _TAG.sub("", _BREAK.sub(" ", text))
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text))
    if "-" in text:
        text = _HYPHEN.sub("", text)
    return text.casefold()


def words(text: str | None) -> list[str]:
    return _WORD.findall(plain(text)) if text else []


class WordIds:
    """64-bit ids of words; the cache is emptied when it grows large."""

    def __init__(self, most: int = 500_000):
        self.most, self.ids = most, {}

    def __call__(self, ws: list[str]) -> np.ndarray:
        ids = self.ids
        if len(ids) > self.most:
            ids.clear()
        out = np.empty(len(ws), np.uint64)
        for i, w in enumerate(ws):
            x = ids.get(w)
            if x is None:
                x = ids[w] = xxhash.xxh64_intdigest(w)
            out[i] = x
        return out


def shingle_ids(ids: np.ndarray, n: int) -> np.ndarray:
    """64-bit ids of the runs of n words, in order; empty where there are fewer words."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    m = len(ids) - n + 1
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ ids[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out
