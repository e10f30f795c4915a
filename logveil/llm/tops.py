"""The best rows of many slots inside one task: a running top-k by (score descending, id ascending)."""

from __future__ import annotations

import numpy as np


class Tops:
    """At most `k` rows per slot; `floor[slot]` is a score below which a row cannot be among them.

    Scores are 64-bit integers. Rows wait in a buffer that is cut down whenever it holds several
    times what may stay, so memory follows slots * k.
    """

    def __init__(self, slots: int, k: int, floor: np.ndarray | None = None) -> None:
        self.k, self.most = k, max(4 * slots * k, 1 << 18)
        self.floor = np.full(slots, -(1 << 63), np.int64) if floor is None else floor.copy()
        self._parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._held = 0

    def add(self, slot: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        use = score >= self.floor[slot]
        self._parts.append((slot[use].astype(np.int64), score[use].astype(np.int64), key[use].astype(np.int64)))
        self._held += int(use.sum())
        if self._held > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keep the best `k` of each slot and return (slot, score, id) in that order."""
        empty = np.zeros(0, np.int64)
        slot, score, key = (np.concatenate([empty, *side]) for side in (zip(*self._parts) if self._parts else ((), (), ())))
        order = np.lexsort((key, ~score, slot))
        slot, score, key = slot[order], score[order], key[order]
        new = np.ones(len(slot), bool)
        new[1:] = slot[1:] != slot[:-1]
        number = np.arange(len(slot))
        place = number - np.maximum.accumulate(np.where(new, number, 0))
        last = place == self.k - 1
        self.floor[slot[last]] = np.maximum(self.floor[slot[last]], score[last])
        keep = place < self.k
        kept = slot[keep], score[keep], key[keep]
        self._parts, self._held = [kept], len(kept[0])
        return kept
