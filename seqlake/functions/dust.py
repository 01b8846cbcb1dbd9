"""Low-complexity masking by symmetric DUST.

Definition (Morgulis et al., 2006). A stretch of bases scores sum(c (c - 1) / 2) over the counts c of its
triplets, over its number of triplets less one. A stretch of at most `window` bases is perfect if it
scores over threshold / 10 and no shorter stretch in it scores more; perfect stretches are masked.

All stretches of one length are scored at once, from those that are one triplet shorter, over as many
sequences as a batch holds; letters other than ACGT end a stretch.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW, THRESHOLD = 64, 20
PIECE = 1 << 16  # bases at a time: what is held of them stays in a core's cache


def base_codes(text: str):
    """0 to 3 for ACGT in either case, 4 for other characters."""
    import numpy as np

    table = np.full(256, 4, "u1")
    for k, pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
        for c in pair:
            table[ord(c)] = k
    return table[np.frombuffer(text.encode("latin-1", "replace"), "u1")]


def masked_piece(codes, window: int, threshold: int):
    """Which bases lie in a perfect stretch of this piece."""
    import numpy as np

    cover = np.zeros(len(codes) + 1, "i4")
    n = len(codes) - 2
    if n < 2:
        return cover[:-1] > 0
    word = codes[:-2] * np.uint8(16) + codes[1:-1] * np.uint8(4) + codes[2:]
    broken = np.flatnonzero((codes[:-2] > 3) | (codes[1:-1] > 3) | (codes[2:] > 3))
    # How many words from each on are whole, itself included.
    free = np.append(broken, n)[np.searchsorted(broken, np.arange(n))] - np.arange(n)
    like = np.zeros(n, "i2")  # of the words up to a distance, those equal to the first
    score = np.zeros(n, "i2")
    best = np.zeros(n, "f4")  # of all stretches inside; quotients this small differ in 32 bits if they differ at all
    for d in range(1, min(window - 2, n)):
        m = n - d
        like = like[:m] + (word[:m] == word[d:])
        score = score[1 : m + 1] + like
        mean = score / np.float32(d)
        inner = np.maximum(best[:m], best[1 : m + 1])
        first = np.flatnonzero((score * np.int32(10) > threshold * d) & (mean >= inner) & (free[:m] > d))
        cover[first] += 1
        cover[first + d + 3] -= 1
        best = np.maximum(mean, inner)
    return np.cumsum(cover[:-1]) > 0


def masked_bases(codes, window: int = WINDOW, threshold: int = THRESHOLD):
    """Which bases are masked. Pieces overlap by a window, so each stretch lies whole in one."""
    import numpy as np

    out = np.zeros(len(codes), bool)
    for at in range(0, len(codes), PIECE):
        end = min(len(codes), at + PIECE + window)
        out[at:end] |= masked_piece(codes[at:end], window, threshold)
    return out


def masks(seqs, window: int, threshold: int):
    """For each sequence (null: None) its mask; sequences are laid end to end with a letter between them."""
    held: list = []

    def flush():
        whole = masked_bases(base_codes("-".join(held)), window, threshold)
        at = 0
        for s in held:
            yield whole[at : at + len(s)]
            at += len(s) + 1

    size, waiting = 0, []
    for s in seqs:
        waiting.append(s is not None)
        if s is not None:
            held.append(s)
            size += len(s)
        if size >= PIECE:
            found = flush()
            yield from (next(found) if there else None for there in waiting)
            held, size, waiting = [], 0, []
    found = flush()
    yield from (next(found) if there else None for there in waiting)


def intervals(mask) -> list[tuple[int, int]]:
    """Half-open stretches of a mask."""
    import numpy as np

    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype("i1"), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def masked_intervals(seq: str, window: int = WINDOW, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Merged half-open intervals of low complexity."""
    return intervals(masked_bases(base_codes(seq), window, threshold))


def masked_fraction(seq: str, window: int = WINDOW, threshold: int = THRESHOLD) -> float:
    return float(masked_bases(base_codes(seq), window, threshold).mean()) if seq else 0.0


def dust_intervals(seq: Column, window: int = WINDOW, threshold: int = THRESHOLD) -> Column:
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(seqs: pd.Series) -> pd.Series:
        return pd.Series([None if m is None else [{"start": a, "end": b} for a, b in intervals(m)] for m in masks(seqs, window, threshold)])

    return run(seq)


def dust_fraction(seq: Column, window: int = WINDOW, threshold: int = THRESHOLD) -> Column:
    """Share of a sequence that is masked; 0 if it is empty."""

    @F.pandas_udf("double")
    def run(seqs: pd.Series) -> pd.Series:
        return pd.Series([None if m is None else float(m.mean()) if len(m) else 0.0 for m in masks(seqs, window, threshold)], dtype="float64")

    return run(seq)
