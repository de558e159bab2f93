"""Sets of 64-bit hashes: shingles, MinHash bands, and prefixes under a global order."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

#: Counts of shingles by the first bits of their hash, and the parts in which they are added up.
CELLS, CHUNKS = 1 << 21, 64
SHIFT = np.uint64(64 - 21)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingled(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``width`` words' hashes; one of all words if they are fewer."""
    w = mixed(np.asarray(words, dtype=np.int64).view(np.uint64))
    n = max(len(w) - width + 1, 1)
    size = min(width, len(w))
    acc = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        acc = mixed(acc * ODD + w[j : j + n])
    return np.unique(acc.view(np.int64))


def bands(sh: np.ndarray, count: int, rows: int) -> np.ndarray:
    """One hash for each band of a MinHash signature; shingles go through the permutations in blocks."""
    x = np.asarray(sh, dtype=np.int64).view(np.uint64)
    c = mixed(np.arange(1, 2 * count * rows + 1, dtype=np.uint64) * ODD).reshape(2, 1, -1)
    least = np.min([((x[i : i + 1024, None] ^ c[0]) * (c[1] | np.uint64(1))).min(axis=0) for i in range(0, len(x), 1024)], axis=0).reshape(count, rows)
    acc = np.arange(count, dtype=np.uint64)
    for j in range(rows):
        acc = mixed(acc * ODD + least[:, j])
    return acc.view(np.int64)


def cell(sh: np.ndarray) -> np.ndarray:
    return (np.asarray(sh, dtype=np.int64).view(np.uint64) >> SHIFT).astype(np.int64)


def cell_counts(batches):
    """Arrow batches of one column of hash lists -> (chunk, counts) of all of them."""
    total = np.zeros(CELLS, dtype=np.uint32)
    for b in batches:
        flat = b.column(0).flatten().to_numpy(zero_copy_only=False)
        total += np.bincount(cell(flat), minlength=CELLS).astype(np.uint32)
    parts = total.reshape(CHUNKS, -1)
    some = [i for i in range(CHUNKS) if parts[i].any()]
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["chunk", "counts"])


def added(parts: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CELLS // CHUNKS, dtype=np.uint32)
    for c in parts["counts"]:
        total += np.frombuffer(c, dtype=np.uint32)
    return pd.DataFrame({"chunk": parts["chunk"].iloc[:1], "counts": [total.tobytes()]})


def prefix(sh: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(percent n) + 1 of n hashes by (count, hash)."""
    a = np.asarray(sh, dtype=np.int64)
    n = len(a)
    return a[np.lexsort((a, counts[cell(a)]))[: n + (-n * percent) // 100 + 1]] if n else a
