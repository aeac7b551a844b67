"""Words of many texts at once, as numpy arrays over one byte buffer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TURN = 64  # positions with random values of their own
_VALUES = np.random.Generator(np.random.PCG64(20240611)).integers(0, 2**64, (_TURN, 256), dtype=np.uint64).ravel()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of an Arrow column as UTF-8 (null: empty), in runs of about ``limit`` bytes: (first row, texts).

    A text is never cut; one longer than the limit is a run of its own.
    """
    run, start, size = [], 0, 0
    for i, text in enumerate(column.cast(pa.large_binary())):
        text = text.as_py() or b""
        if run and size + len(text) > limit:
            yield start, run
            run, start, size = [], i, 0
        run.append(text)
        size += len(text)
    if run:
        yield start, run


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of ``texts``: the lower-cased (A-Z) buffer, word starts, word ends and the index of each word's text."""
    buffer = _LOWER[np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)]
    edge = np.diff(np.concatenate(([True], _SPACE[buffer], [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return buffer, starts, ends, np.searchsorted(np.cumsum(sizes), starts, side="right")


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit tabulation hashes of byte spans (none of them empty)."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sizes = ends - starts
    at = np.cumsum(sizes) - sizes
    place = np.arange(at[-1] + sizes[-1]) - np.repeat(at, sizes)
    byte = buffer[place + np.repeat(starts, sizes)]
    values = _VALUES[((place & (_TURN - 1)) << 8) | byte]
    if sizes.max() > _TURN:
        far = place >= _TURN
        values[far] *= (place[far] // _TURN).astype(np.uint64) * np.uint64(2) * _ODD + np.uint64(1)
    return mixed(np.add.reduceat(values, at) + sizes.astype(np.uint64) * _ODD)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the index of its text."""
    buffer, starts, ends, owner = word_spans(texts)
    return span_hashes(buffer, starts, ends), owner
