"""Words, word hashes and shingles, for code that runs on executors.

``Hashed`` works on whole batches in numpy: words are found in the bytes of the texts, and their hashes are differences of one running
polynomial sum, so that no Python object is made for a word.
"""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(r"[0-9A-Za-z_\x80-\U0010ffff]+")


def words(text: str | None) -> list[str]:
    """Runs of ASCII letters, digits and underscores and of characters beyond ASCII, in lower case."""
    return WORD.findall(text.lower()) if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IN_WORD = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_BASE, _BACK)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[i] = np.cumprod(steps)
    return _powers


def spans_hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of ``data`` from starts to ends, and of their lengths."""
    powers, back = _powers_to(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(_BACK))


class Hashed:
    """The word hashes of a batch of texts: ``words`` in order, those of text i from ``begins[i]`` to ``begins[i + 1]``."""

    def __init__(self, texts: list[str | None]):
        parts = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
        data = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
        inside = _IN_WORD[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2] + 1, edges[1::2] + 1
        self.words = spans_hashed(data, starts, ends)
        self.begins = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]), "left") if len(texts) else np.zeros(1, dtype=np.int64)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words and the text of each; of a shorter text, the one hash of all its words."""
        n = np.diff(self.begins)
        out, owner = [], []
        with np.errstate(over="ignore"):
            if len(self.words) >= width:
                h = np.full(len(self.words) - width + 1, width, dtype=np.uint64)
                for j in range(width):
                    h = h * np.uint64(_BASE) + self.words[j : len(self.words) - width + 1 + j]
                text = np.repeat(np.arange(len(n), dtype=np.int64), n)
                whole = text[: len(h)] == text[width - 1 :]
                out.append(mixed(h[whole]))
                owner.append(text[: len(h)][whole])
            for i in np.flatnonzero((n > 0) & (n < width)):
                h = np.full(1, n[i], dtype=np.uint64)
                for w in self.words[self.begins[i] : self.begins[i + 1]]:
                    h = h * np.uint64(_BASE) + w
                out.append(mixed(h))
                owner.append(np.array([i], dtype=np.int64))
        return (np.concatenate(out), np.concatenate(owner)) if out else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))

    def counted(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingle, text, count), sorted by text and shingle, for a batch of at most 4,096 texts. Shingles keep 52 bits."""
        found, owner = self.shingles(width)
        keys = np.sort((owner.astype(np.uint64) << np.uint64(52)) | (found >> np.uint64(12)))
        if not len(keys):
            return keys, owner, owner
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        return keys & np.uint64((1 << 52) - 1), (keys >> np.uint64(52)).astype(np.int64), counts


def steps(texts, most: int = 1 << 18, rows: int = 4096):
    """Slices of a list of texts with about ``most`` characters and at most ``rows`` texts each."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most or i + 1 - begin >= rows:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def release() -> None:
    """Hands memory that Arrow keeps for later back to the system: workers live on, and other operators run in them."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
