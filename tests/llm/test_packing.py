import numpy as np

from rankmill.llm.substring_dedup import _ints, _of_ints


def test_packed_numbers_come_back():
    r = np.random.default_rng(0)
    for x in ([5], [5, 5], [-3, 9, 2**40], [9, -4, 3], np.cumsum(r.geometric(1 / 64, 5000)), np.cumsum(r.integers(0, 70_000, 99)), [0, 255, 510, 765, 1020]):
        x = np.array(x, np.int64)
        assert (_of_ints(_ints(x)) == x).all()
