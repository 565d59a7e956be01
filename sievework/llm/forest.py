"""Links found inside one task, kept as a spanning forest instead of pairs."""

from __future__ import annotations

import numpy as np


class Forest:
    """Least labels over n places; link() may be called with any number of pairs, memory stays at n."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        label = self.label
        while len(x):
            a, b = label[x], label[y]
            apart = a != b
            if not apart.any():
                break
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            low = np.minimum(a, b)
            np.minimum.at(label, np.maximum(a, b), low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        x = np.flatnonzero(self.label != np.arange(len(self.label)))
        return x, self.label[x]
