"""Terms of texts: maximal runs of letters, or of letters and digits, of ASCII and all else beyond it."""

from __future__ import annotations

import numpy as np

from .arrow_text import SpanHasher, code_points, lower_ascii, runs


def is_letter(points: np.ndarray) -> np.ndarray:
    """A-Z, a-z and every code point beyond ASCII."""
    return ((points >= 65) & (points <= 90)) | ((points >= 97) & (points <= 122)) | (points >= 128)


def is_letter_or_digit(points: np.ndarray) -> np.ndarray:
    """0-9, A-Z, a-z and every code point beyond ASCII."""
    return is_letter(points) | ((points >= 48) & (points <= 57))


class Terms:
    """The terms of some texts, A-Z in lower case: ``begin``, ``end``, ``text`` (index) and ``hashes``."""

    def __init__(self, texts: list[str], member):
        points, starts = code_points(texts)
        points = lower_ascii(points)
        self.begin, self.end = runs(member(points), starts)
        self.text = np.searchsorted(starts, self.begin, side="right") - 1
        self.hashes = SpanHasher(points)(self.begin, self.end)
        self._whole = points.tobytes().decode("utf-32-le", "surrogatepass")

    def strings(self, at: np.ndarray) -> list[str]:
        whole = self._whole
        return [whole[b:e] for b, e in zip(self.begin[at].tolist(), self.end[at].tolist(), strict=True)]


def tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys: the place of one of each, each key's number among them, and how often it occurs."""
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first, inverse, counts
