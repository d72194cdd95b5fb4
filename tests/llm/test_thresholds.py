from math import comb
from pathlib import Path

import pytest

from quarry.llm.nearness import threshold

README = (Path(__file__).parents[2] / "README.md").read_text()


@pytest.mark.parametrize("percent, n, stated", [(85, 32, 5.7e-7), (85, 256, 5.8e-7), (80, 32, 1.9e-7), (80, 256, 5.0e-7)])
def test_stated_chance_is_the_binomial_tail(percent, n, stated):
    p = percent / 100
    tail = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(threshold(percent, n)))
    assert tail == pytest.approx(stated, rel=0.02)
    assert f"{stated:.1e}".replace("e-07", "e-7") in README
