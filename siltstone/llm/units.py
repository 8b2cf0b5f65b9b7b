"""Texts as units that are encoded once: cut in bulk over their bytes, told apart by Arrow, their ids kept in one pool.

A unit is a stretch of text that an encoding never reaches across, so a text's ids are those of its units in a row. How text is cut is the caller's: a function of the bytes
of several texts, each followed by ``EDGE``, that gives the places where units begin.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: A byte that UTF-8 never has; it stands behind every text.
EDGE = 0xFF
#: Units that a worker remembers.
REMEMBERED = 1_000_000


def joined(texts: list[bytes]) -> bytes:
    """Texts in one buffer, ``EDGE`` behind each."""
    return b"\xff".join([*texts, b""])


class UnitPool:
    """The ids of units: ``encode`` gives for units the ids in a row and how many each has; ``edge`` are the ids of a text's end."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], edge: list[int], most: int = REMEMBERED):
        self.encode, self.most = encode, most
        self.number: dict[bytes, int] = {bytes([EDGE]): 0}
        self.pool, self.size = np.array(edge, dtype=np.uint32), np.array([len(edge)], dtype=np.int64)
        self.begin = np.zeros(1, dtype=np.int64)

    def ids(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units of ``data`` that begin at ``starts``, and how many each unit has."""
        cuts = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        told = pa.Array.from_buffers(pa.binary(), len(starts), [None, cuts, pa.py_buffer(data)]).dictionary_encode()
        units = told.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.number.get, units))
        fresh = [u for u, n in zip(units, found) if n is None]
        pool, size, begin = self.pool, self.size, self.begin
        if fresh:
            more, sizes = self.encode(fresh)
            new = iter(range(len(size), len(size) + len(fresh)))
            found = [next(new) if n is None else n for n in found]
            pool, size = np.concatenate([pool, more]), np.concatenate([size, sizes])
            begin = np.concatenate([begin, len(self.pool) + np.cumsum(sizes) - sizes])
            if len(self.number) + len(fresh) <= self.most:
                self.number.update(zip(fresh, range(len(self.size), len(size))))
                self.pool, self.size, self.begin = pool, size, begin
        unit = np.array(found, dtype=np.int64)[told.indices.to_numpy()]
        sizes = size[unit]
        return pool[places(begin[unit], sizes)], sizes


def places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The whole numbers of ranges in a row, each from ``begin`` on, ``size`` many."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def by_text(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many ids each text has, its end included, and 0 ahead of the first: cumulated, so text k has the ids from place k to place k + 1."""
    total = np.cumsum(sizes)
    return np.append(0, total[np.frombuffer(data, dtype=np.uint8)[starts] == EDGE])
