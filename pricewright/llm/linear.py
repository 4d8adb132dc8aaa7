"""Small dense linear algebra on the driver, in plain array operations.

Threaded BLAS can block in a process that has started a JVM; these matrices don't need it.
"""

from __future__ import annotations

import numpy as np


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan inverse with row pivoting."""
    n = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(n)])
    for i in range(n):
        pivot = i + int(np.argmax(np.abs(work[i:, i])))
        if abs(work[pivot, i]) < 1e-14:
            raise ArithmeticError("singular matrix")
        if pivot != i:
            work[[i, pivot]] = work[[pivot, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0
        work -= factor[:, None] * work[i][None, :]
    return work[:, n:]


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Matrix by vector."""
    return (matrix * vector[None, :]).sum(axis=1)
