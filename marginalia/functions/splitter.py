"""Recursive character splitter for one text; used inside Arrow batches."""

from __future__ import annotations

from collections import deque


def _cut(text: str, sep: str) -> list[str]:
    """Pieces of ``text``; every piece after the first starts with its separator."""
    if not sep:
        return list(text)
    head, *tail = text.split(sep)
    return [p for p in (head, *(sep + t for t in tail)) if p]


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Join neighbouring pieces up to ``size``, carrying at most ``overlap`` characters over."""
    out: list[str] = []
    window: deque[str] = deque()
    length = 0
    for piece in pieces:
        if window and length + len(piece) > size:
            out.append("".join(window).strip())
            while window and (length > overlap or length + len(piece) > size):
                length -= len(window.popleft())
        window.append(piece)
        length += len(piece)
    out.append("".join(window).strip())
    return [p for p in out if p]


def split_text(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    """Split at the first separator that occurs; pieces that stay too long go to the next ones."""
    level = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    deeper = separators[level + 1 :]
    out: list[str] = []
    small: list[str] = []
    for piece in _cut(text, separators[level]):
        if len(piece) < size:
            small.append(piece)
            continue
        if small:
            out += _pack(small, size, overlap)
            small = []
        out += split_text(piece, size, overlap, deeper) if deeper else [piece]
    if small:
        out += _pack(small, size, overlap)
    return out
