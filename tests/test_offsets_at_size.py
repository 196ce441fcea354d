"""Long envelopes: what is sent grows with them, and the middle value is exact wherever it lies."""

import numpy as np
import pytest

from tests.test_fusion import envelopes, speechlike
from turnweave.operators import offset


@pytest.mark.parametrize("share", [0, 0.02, 64])
def test_bands_and_segments_change_nothing(spark, monkeypatch, share):
    monkeypatch.setattr(offset, "SHARE", share)
    a, b = speechlike(100, 1), speechlike(61, 2)
    e = envelopes(spark, a, b).where("not (side = 'b' and win_idx between 8 and 15)")
    b[8:16] = 0
    got = {r["lag"]: r["corr"] for r in offset.cross_correlation(e, False, 8).collect()}
    assert set(got) == set(range(-60, 100)) and np.allclose([got[k] for k in range(-60, 100)], np.correlate(a, b, "full"))


def test_what_is_sent_is_linear(spark):
    """Rows of segments do not multiply with the segments of the other side."""
    rows = [offset._segments(envelopes(spark, np.ones(n), np.ones(n)), False, 8).count() for n in (64, 256)]
    assert rows == [16, 64]


@pytest.mark.parametrize("ranges", [1, 7, 4096])
def test_medians_are_exact(spark, monkeypatch, ranges):
    monkeypatch.setattr(offset, "RANGES", ranges)
    rng = np.random.default_rng(ranges)
    values = {"odd": rng.normal(size=41), "even": rng.normal(size=40), "one": np.ones(1), "equal": np.ones(6), "apart": np.array([0.0] * 5 + [9.0] * 5), "ties": rng.integers(0, 3, 50).astype(float)}
    rows = [(k, i, float(v)) for k, x in values.items() for i, v in enumerate(x)]
    got = offset.peak_metrics(spark.createDataFrame(rows, "pair_id string, lag long, corr double")).collect()
    assert {r["pair_id"]: r["median"] for r in got} == {k: pytest.approx(np.median(x)) for k, x in values.items()}


def test_shuffled_places_over_ranges(spark, monkeypatch):
    e = envelopes(spark, speechlike(90, 1), np.arange(70.0))
    whole = sorted(map(tuple, offset.add_null_controls(e).collect()))
    monkeypatch.setattr(offset, "SEGMENT", 8)
    assert sorted(map(tuple, offset.add_null_controls(e).collect())) == whole
