"""A spanning forest inside one task: links arrive in arrays, edges that join two trees leave."""

from __future__ import annotations

import numpy as np


class Forest:
    def __init__(self, n: int):
        self.label = np.arange(n)

    def root(self, i: int) -> int:
        label = self.label
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return int(i)

    def add(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Of the links a[i]-b[i], those that join two trees. Links inside a tree fall out in bulk."""
        out = []
        while len(a):
            label = self.label
            for _ in range(64):  # shorten all paths at once
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            for i, j in zip(a[:512].tolist(), b[:512].tolist()):
                x, y = self.root(i), self.root(j)
                if x != y:
                    self.label[max(x, y)] = min(x, y)
                    out.append((i, j))
            a, b = a[512:], b[512:]
        return out
