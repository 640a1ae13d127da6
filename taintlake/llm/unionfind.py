"""Vectorised union-find over the rows of one task."""

from __future__ import annotations

import numpy as np


def union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join a[i] with b[i] in place; a root is the smallest index of its set."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up
