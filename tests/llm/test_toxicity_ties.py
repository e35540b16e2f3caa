"""Segments that score the same: the leftmost one counts."""

import numpy as np

from gradeflow.llm import toxicity as tx


def test_a_segment_that_starts_at_an_equal_low_is_joined_to_the_left():
    s = np.array([2.25, -1.0, -1.0, 5.5, -3.75, 5.5, -3.75, -3.75, 2.25, 5.5])  # back to zero before the last two
    at = np.flatnonzero(s != -1.0)
    assert tx.segments(at, s[at], len(s), -1.0) == [(0, 10, 7.75)]
