"""Texts as numpy arrays of code points, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

PIECE = 1 << 19  # code points that are worked on at once
WHITE = " \t\n\x0b\f\r"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _cuts(text: str, size: int, at_space: bool) -> Iterator[tuple[int, int]]:
    """Where the parts of a text begin and end; with ``at_space`` a part ends before white space."""
    low = 0
    while low < len(text):
        high = min(low + size, len(text))
        if at_space and high < len(text):
            last = max(text.rfind(c, low + 1, high + 1) for c in WHITE)
            following = [at for c in WHITE if (at := text.find(c, high)) >= 0] if last < 0 else []
            high = last if last >= 0 else min(following, default=len(text))
        yield low, high
        low = high


def pieces(
    texts: list[str | None], size: int | None = None, before: Callable[[str, int], int] | None = None,
    after: int = 0, at_space: bool = False,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, starts, owners, skip, stop): texts side by side, those above ``size`` in several parts.

    ``starts`` is where each part begins in ``codes`` and ``owners`` the text it belongs to. What a
    part adds to its text lies at ``skip`` up to ``stop`` in it. Around that stands what was next to
    it in the text: ``before(text, place)`` code points and ``after`` code points, so that nothing at
    a border is lost or counted twice. Empty and null texts have no part.
    """
    size = size or PIECE
    parts: list[np.ndarray] = []
    owners: list[int] = []
    cores: list[tuple[int, int]] = []
    held = 0

    def out():
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        skip, stop = np.array(cores, np.int64).T
        return np.concatenate(parts), np.cumsum(lengths) - lengths, np.array(owners), skip, stop

    for owner, text in enumerate(texts):
        for low, high in _cuts(text or "", size, at_space):
            first = low - before(text, low) if before and low else low
            part = code_points(text[first: high + after])
            if held and held + len(part) > size:
                yield out()
                parts, owners, cores, held = [], [], [], 0
            parts.append(part)
            owners.append(owner)
            cores.append((low - first, high - first))
            held += len(part)
    if held:
        yield out()


def mixed_multipliers(count: int, seed: int) -> np.ndarray:
    """Odd 64-bit factors, one for each place of an n-gram."""
    return np.random.default_rng(seed).integers(1, 1 << 63, count, dtype=np.uint64) * 2 + 1
