"""Words and shingles of a text as 64-bit numbers, computed with numpy inside tasks."""

from __future__ import annotations

import numpy as np
import regex

_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 20
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
#: Bytes that make up a word of letters and digits: ASCII alphanumerics and all of UTF-8's longer sequences.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes of a word that ends at white space only.
SOLID = np.arange(256) > 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _scale(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _runs(data: bytes, of: np.ndarray, prefix: int):
    b = np.frombuffer(data, np.uint8)
    edge = np.diff(of[b].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _scale(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    whole = mix((total[end] - total[start]) * down[start])
    head = mix((total[np.minimum(start + prefix, end)] - total[start]) * down[start]) if prefix else None
    return whole, start, end, head


def runs(data: bytes, of: np.ndarray, prefix: int = 0):
    """Hash, start, end and hash of the first ``prefix`` bytes of every maximal run of bytes in ``of``."""
    if len(data) <= _CHUNK:
        return _runs(data, of, prefix)
    parts, at = [], 0
    table = np.frombuffer(data, np.uint8)
    while at < len(data):
        stop = min(at + _CHUNK, len(data))
        while stop < len(data) and of[table[stop]]:  # a run is never cut, however long
            gap = np.flatnonzero(~of[table[stop : stop + _CHUNK]])
            stop += int(gap[0]) if len(gap) else len(table[stop : stop + _CHUNK])
        whole, start, end, head = _runs(data[at:stop], of, prefix)
        parts.append((whole, start + at, end + at, head))
        at = stop
    return tuple(np.concatenate(x) if x[0] is not None else None for x in zip(*parts, strict=True))


#: Characters beyond ASCII that part words, and those of scripts that write no spaces, each a word of its own.
_MARK = regex.compile(r"[^\x00-\x7f\p{L}\p{N}\p{M}]")
_SPACELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*")


def plain(text: str) -> bytes:
    """UTF-8 of a text in which runs of ``ALNUM`` are its words: marks and spaces of any script are blanks."""
    if not text.isascii():
        if _MARK.search(text):
            text = _MARK.sub(" ", text)
        if _SPACELESS.search(text):
            text = _SPACELESS.sub(r" \g<0> ", text)
    return text.encode("utf-8", "surrogatepass")


def shingles(text: str, width: int) -> np.ndarray:
    """Hashes of every ``width`` consecutive words; of all words together where there are fewer; none for no words.

    Words are runs of letters and digits, so copies that differ in punctuation share their shingles;
    in scripts without spaces every character is a word.
    """
    words = runs(plain(text), ALNUM)[0]
    n = max(1, len(words) - width + 1) if len(words) else 0
    width = min(width, len(words))
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mix(out) + words[i : n + i]
    return mix(out)


def occurrences(items: np.ndarray) -> np.ndarray:
    """The items labelled by how often each has come before: equal items become different, in text order."""
    order = np.argsort(items, kind="stable")
    s = items[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, int)
    if len(first) == len(s):
        return items
    nth = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
    out = np.empty_like(items)
    out[order] = np.where(nth == 0, s, mix(s + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return out
