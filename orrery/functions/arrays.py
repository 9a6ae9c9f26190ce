"""Array functions that need linear algebra, on Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@F.pandas_udf("array<double>")
def _quaternion(cells: pd.Series) -> pd.Series:
    m = np.stack([np.asarray(x, float) for x in cells]).reshape(-1, 3, 3) if len(cells) else np.zeros((0, 3, 3))
    k = np.zeros((len(m), 4, 4))
    # Bar-Itzhack: the quaternion is the eigenvector of the largest eigenvalue of this symmetric matrix, order x, y, z, w
    xx, yy, zz = m[:, 0, 0], m[:, 1, 1], m[:, 2, 2]
    k[:, 0, 0], k[:, 1, 1], k[:, 2, 2], k[:, 3, 3] = xx - yy - zz, yy - xx - zz, zz - xx - yy, xx + yy + zz
    k[:, 1, 0] = k[:, 0, 1] = m[:, 0, 1] + m[:, 1, 0]
    k[:, 2, 0] = k[:, 0, 2] = m[:, 0, 2] + m[:, 2, 0]
    k[:, 2, 1] = k[:, 1, 2] = m[:, 1, 2] + m[:, 2, 1]
    k[:, 3, 0] = k[:, 0, 3] = m[:, 2, 1] - m[:, 1, 2]
    k[:, 3, 1] = k[:, 1, 3] = m[:, 0, 2] - m[:, 2, 0]
    k[:, 3, 2] = k[:, 2, 3] = m[:, 1, 0] - m[:, 0, 1]
    q = np.linalg.eigh(k)[1][:, [3, 0, 1, 2], -1]
    q[q[:, 0] < 0] *= -1
    return pd.Series(list(q))


def quaternion_of_rotation(cells: Column) -> Column:
    """(w, x, y, z) with w >= 0 of a rotation's nine cells in rows."""
    return _quaternion(cells)
