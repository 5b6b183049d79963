"""The filter of the last round loses a link of similarity 0.75 with a probability of 1e-7 at most."""

import numpy as np

from fleetfacts.llm import near_dedup


def test_miss_rate_of_agreeing_bits():
    # A bin agrees with probability 0.75, then in both bits; else each bit agrees by chance.
    one, total = np.array([0.25 * 0.25, 0.25 * 0.5, 0.75 + 0.25 * 0.25]), np.ones(1)
    for _ in range(near_dedup.BINS):
        total = np.convolve(total, one)
    assert total[: near_dedup.AGREEING_BITS].sum() <= 1e-7
