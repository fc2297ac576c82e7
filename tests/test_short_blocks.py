import numpy as np
import pytest

from plumbline.operators import spectral as S


@pytest.mark.parametrize("normalise", [False, True])
def test_short_blocks_are_transformed_many_at_once(spark, monkeypatch, normalise):
    monkeypatch.setattr(S, "TOGETHER", 24)
    rng = np.random.default_rng(6)
    sides = {"syn": rng.normal(size=131), "orig": rng.normal(size=50)}
    pair = spark.createDataFrame([("v", s, i, float(x)) for s, own in sides.items() for i, x in enumerate(own)], "validation_id string, side string, id long, x double")
    got = S.psd(pair.repartition(3), ["x"], ["id"], 8, normalise).collect()
    assert len(got) == 10
    for side, own in sides.items():
        blocks = np.concatenate([own, np.zeros(-len(own) % 8)]).reshape(-1, 8)
        want = (np.abs(np.fft.rfft(blocks)) ** 2).sum(axis=0) / (len(own) if normalise else len(blocks))
        np.testing.assert_allclose([r["power"] for r in sorted(got, key=lambda r: r["freq"]) if r["side"] == side], want, rtol=1e-9)
