import numpy as np

from seqlake.functions import dust as D


def test_pieces_fit_a_cache_and_mask_the_same(monkeypatch):
    assert D.PIECE * 12 <= 1 << 20  # bytes of the three tables of scores; it was 12 MB
    rng = np.random.default_rng(4)
    codes = np.concatenate([rng.integers(0, 5 if k % 3 else 2, 900).astype("u1") for k in range(300)])
    assert len(codes) > 3 * D.PIECE
    got = D.masked_bases(codes)
    monkeypatch.setattr(D, "PIECE", len(codes))
    assert got.any() and (got == D.masked_bases(codes)).all()
