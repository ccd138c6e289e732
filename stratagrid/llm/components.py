"""Spanning forests of small graphs; the distributed components are the library's own."""

from __future__ import annotations

import numpy as np

from stratagrid.operators.components import components  # noqa: F401


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph on ``n`` nodes with edges ``a[i], b[i]``, as node to root."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return [(i, int(r)) for i, r in enumerate(root) if r != i]
