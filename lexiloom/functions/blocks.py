"""Arrays of numbers as compressed byte planes, for frames that move many numbers in one row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def packed(values: np.ndarray) -> bytes:
    """The numbers as planes of equal bytes under zstandard, behind their count."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpacked(block: bytes, kind) -> np.ndarray:
    n, kind = int.from_bytes(block[:8], "little"), np.dtype(kind)
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(block[8:], n * kind.itemsize, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel()
