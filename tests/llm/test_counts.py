"""Learned counts beyond 32 bits."""

import numpy as np

from sievemark.llm.mixing import Code, Mixer


def test_counts_beyond_32_bits():
    """Counts summed over all partitions may pass 2^31; their log odds stay those of the counts."""
    code = Code.of(np.array([5, 3, 2, 1]))
    numbers = np.array([3e9, 5e9, 4e9, 1.0, 2.0, 6e9])
    mixer = Mixer(code, 4, 2).load({0: numbers, 1: np.tile([3e9, 6e9], 16)})
    assert np.allclose(mixer.tables[0], np.log((numbers[1::2] + 0.3) / (numbers[::2] + 0.3)), atol=1e-4)
    assert np.allclose(mixer.tables[1], np.log(2), atol=1e-4) and np.isfinite(mixer.refined).all()
    assert np.isfinite(mixer.losses(np.array([0, 1, 2, 3]), np.zeros(4, np.int64))).all()
