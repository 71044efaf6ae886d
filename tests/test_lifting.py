"""Wavelets on tiles of any size and origin: there and back, windows, and single samples."""

import numpy as np
import pytest

from wavelake.operators import lifting, settings


def test_there_and_back_with_windows():
    rng = np.random.default_rng(0)
    for _ in range(300):
        w, h = rng.integers(1, 20, 2)
        x0, y0 = rng.integers(0, 5, 2)
        levels = int(rng.integers(1, 4))
        a = rng.integers(-200, 200, (h, w))
        f = lifting.forward(a, x0, y0, levels, lifting.forward53)
        assert (lifting.inverse(f, x0, y0, levels, lifting.inverse53) == a).all()
        (left, right), (top, bottom) = sorted(rng.integers(0, w + 1, 2)), sorted(rng.integers(0, h + 1, 2))
        if left < right and top < bottom:
            window = (left, top, right, bottom)
            assert (lifting.window_inverse(f, x0, y0, levels, lifting.inverse53, window) == a[top:bottom, left:right]).all()
            whole = lifting.inverse(a, x0, y0, levels, lifting.inverse97)
            got = lifting.window_inverse(a.astype(np.float32), x0, y0, levels, lifting.inverse97, window)
            assert got == pytest.approx(whole[top:bottom, left:right], abs=0.05)


def test_irreversible_scale():
    """The way back takes highs at half of what the way there makes of them, up to the scale's rounding."""
    a = np.random.default_rng(1).integers(-100, 100, (1, 40)).astype(np.float32)
    f = lifting.forward97(a, 0)
    f[:, 20:] *= 2 / (lifting.K * lifting.HIGH_SCALE)
    f[:, 20:] /= 2
    assert lifting.inverse97(f, 0) == pytest.approx(a, abs=0.05)


def test_single_samples():
    one = np.array([[7]])
    assert lifting.forward53(one, 0).tolist() == [[7]] and lifting.forward53(one, 1).tolist() == [[14]]
    assert lifting.inverse53(np.array([[15]]), 1).tolist() == [[7]] and lifting.inverse53(np.array([[-15]]), 1).tolist() == [[-7]]
    assert lifting.forward97(one, 1).tolist() == [[7.0]]


def test_planes_of_a_table(spark):
    rows = [(1, 0, 3, 1, 4, [*range(12)]), (2, 0, 0, 0, 4, None), (3, 1, 0, 0, 4, []), (1, 0, 3, 1, 4, [*range(12)])]
    df = spark.createDataFrame(rows, "image_id long, compno long, x0 long, y0 long, w long, vals array<long>")
    back = lifting.transformed(lifting.transformed(df, "53", levels=2), "53", back=True, levels=2)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    window = lifting.transformed(lifting.transformed(df.where("image_id = 1"), "53"), "53", back=True, region=(1, 0, 3, 2)).first()
    assert (window.w, window.vals) == (2, [1, 2, 5, 6])
    assert lifting.transformed(df.limit(0), "97").count() == 0


def test_singular_matrix_has_no_inverse():
    assert settings.invert([[1.0, 2.0], [2.0, 4.0]]) is None
    got = np.array(settings.invert([[0.0, 2.0], [4.0, 1.0]]))
    assert got @ np.array([[0.0, 2.0], [4.0, 1.0]]) == pytest.approx(np.eye(2), abs=1e-6)
