"""Sequential coders and fits."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.operators import coding


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 3)), max_size=200))
def test_range_coder(symbols):
    tables = [[0, 1, 2, 3, 4, 5, 6, 7], [0, 1000, 1001, 1002, 1003, 1004, 1005, 1006], [0, 1, 3, 7, 15, 31, 63, 127], [0, 5, 6, 60, 61, 300, 301, 302]]
    coder = coding.RangeEncoder()
    for s, t in symbols:
        coder.put(tables[t][s], tables[t][s + 1], tables[t][-1])
    decoder = coding.RangeDecoder(coder.finish())
    assert [decoder.get(tables[t]) for _, t in symbols] == [s for s, _ in symbols]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 40), st.integers(-200, 200), st.integers(-200, 200))
def test_line_has_a_closed_form(width, y0, y1):
    sign, size = (-1, y0 - y1) if y1 < y0 else (1, y1 - y0)
    base, rest = divmod(size, width)
    assert coding.render_line(0, y0, width, y1) == [y0 + sign * (base * x + rest * x // width) for x in range(width)]


def test_noise_floor_of_a_line():
    y = 3 + 0.5 * np.arange(50)
    at = np.arange(50)
    assert np.allclose(coding.noise_floor(y, np.maximum(at - 5, 0), np.minimum(at + 6, 50)), y)


def test_field_widths():
    widths = [(0, 0), (0, 1), (1, 1), (2, 3), (3, 2)]
    assert coding.scale_factor_widths([1, 0], [1], widths) == 2
    assert coding.scale_factor_widths([0], [0], widths) == 0
    assert coding.scale_factor_widths([9], [0], widths) is None
