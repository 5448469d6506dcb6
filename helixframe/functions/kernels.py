"""Vectorised sequence kernels on batches of texts, for Arrow functions."""

from __future__ import annotations

import numpy as np

#: By byte: A, C, G, T (U as T) in either case as 0 to 3, anything else as 4.
CODES = np.full(256, 4, np.uint8)
for _base, _code in zip(b"ACGTUacgtu", (0, 1, 2, 3, 3) * 2, strict=True):
    CODES[_base] = _code
#: The widest k-mers that are numbers (two bits a base in a signed long), and the widest at all; between, they are texts.
MOST_K, MOST_TEXT_K = 31, 255
LETTERS = np.frombuffer(b"ACGTN", np.uint8)


def joined_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts with an invalid base after each, and where each text starts."""
    codes = CODES[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    starts = np.zeros(len(texts), np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts[:-1]), np.int64, max(len(texts) - 1, 0)), out=starts[1:])
    return codes, starts


def windows(codes: np.ndarray, k: int) -> np.ndarray:
    """The 2-bit value of each k-wide window (invalid bases as A), by doubling."""
    base = (codes & 3).astype(np.int64)
    size = len(codes) - k + 1
    value, width = np.zeros(size, np.int64), 0
    power, span, at = base, 1, 0
    left = k
    while left:
        if left & 1:
            value = value << 2 * span | power[at : at + size]
            at, width = at + span, width + span
        left >>= 1
        if left:
            power, span = power[: len(power) - span] << 2 * span | power[span:], 2 * span
    return value


def kmers(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and reverse-complement values of each window, and whether it has no invalid base."""
    if not 1 <= k <= MOST_K:
        raise ValueError(f"k must be 1 to {MOST_K}")
    if len(codes) < k:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(bool)
    bad = np.concatenate([[0], np.cumsum(codes > 3)])
    reverse = windows(np.where(codes > 3, 4, 3 - (codes & 3)).astype(np.uint8)[::-1], k)[::-1]
    return windows(codes, k), reverse, bad[k:] == bad[:-k]


def text_kmers(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The lesser of each window's text and its reverse complement's, and whether it has no invalid base."""
    if len(codes) < k:
        return np.zeros(0, f"S{k}"), np.zeros(0, bool)
    bad = np.concatenate([[0], np.cumsum(codes > 3)])
    back = LETTERS[np.where(codes > 3, 4, 3 - (codes & 3))][::-1]
    texts = lambda x: np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, k)).view(f"S{k}").ravel()
    forward, reverse = texts(LETTERS[codes]), texts(np.ascontiguousarray(back))[::-1]
    return np.where(forward <= reverse, forward, reverse), bad[k:] == bad[:-k]


def canonical(texts: list[bytes], k: int, step: int = 1, forward_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, canonical k-mer) of the valid windows of all texts; k-mers over MOST_K are texts.

    With a step, positions that it divides and each text's last window; a window lost to an invalid base is not
    moved.  With forward_only, k-mers (of MOST_K at most) are those of the texts' own strand.
    """
    if not 1 <= k <= MOST_TEXT_K:
        raise ValueError(f"k must be 1 to {MOST_TEXT_K}")
    if forward_only and k > MOST_K:
        raise ValueError(f"k must be 1 to {MOST_K}")
    codes, starts = joined_codes(texts)
    if k > MOST_K:
        value, valid = text_kmers(codes, k)
    else:
        forward, reverse, valid = kmers(codes, k)
        value = forward if forward_only else np.minimum(forward, reverse)
    at = np.flatnonzero(valid)
    number = np.searchsorted(starts, at, "right") - 1
    position = at - starts[number]
    if step > 1:
        last = np.fromiter(map(len, texts), np.int64, len(texts))[number] - k
        keep = (position % step == 0) | (position == last)
        at, number, position = at[keep], number[keep], position[keep]
    return number, position, value[at]


def window_minima(number: np.ndarray, value: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, value): the minima of w consecutive values of each number (of all of its values, if it has fewer), one
    where the same follows.  Numbers rise; windows are halved, so that a minimum takes log2(w) comparisons."""
    first = np.flatnonzero(np.diff(number, prepend=-1))
    few = np.flatnonzero(np.diff(first, append=len(number)) < w)
    low, span = value, 1
    while 2 * span <= w:
        low, span = np.minimum(low[:-span], low[span:]) if len(low) > span else low[:0], 2 * span
    if span < w:
        low = np.minimum(low[: span - w], low[w - span :]) if len(low) > w - span else low[:0]
    whole = number[: len(low)] == number[w - 1 : w - 1 + len(low)]
    low, of = low[whole], number[: len(low)][whole]
    keep = (np.diff(of, prepend=-1) != 0) | np.concatenate([[True], low[1:] != low[:-1]])[: len(low)]
    short = np.minimum.reduceat(value, first)[few] if len(first) else value[:0]
    return np.concatenate([of[keep], number[first[few]]]), np.concatenate([low[keep], short])


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for c in data:
        h = (h ^ c) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def edit_distance_within(a: str, b: str, most: int) -> int | None:
    """Edit distance, None if it exceeds most; a band of the matrix only."""
    if abs(len(a) - len(b)) > most:
        return None
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = i if j == 0 else min(row.get(j - 1, most + 1) + (x != b[j - 1]), row.get(j, most + 1) + 1, new.get(j - 1, most + 1) + 1)
        row = new
        if min(row.values()) > most:
            return None
    found = row.get(len(b), most + 1)
    return found if found <= most else None
