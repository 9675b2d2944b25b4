"""Expected first-digit distribution and conformity bands."""

from __future__ import annotations

from math import comb, log10

# Published three-decimal first-digit frequencies.
EXPECTED = {
    1: 0.301,
    2: 0.176,
    3: 0.125,
    4: 0.097,
    5: 0.079,
    6: 0.067,
    7: 0.058,
    8: 0.051,
    9: 0.046,
}

# Conformity bands of the mean absolute deviation, lower bound inclusive.
MAD_BANDS = (
    (0.006, "close"),
    (0.012, "acceptable"),
    (0.015, "marginal"),
)
MAD_OTHERWISE = "non-conforming"

# Fixed value: significance level of the verdict.
SIGNIFICANCE = 0.05


def expected_frequencies(exact: bool = False) -> dict[int, float]:
    """Rounded published frequencies, or log10(1 + 1/d) with ``exact``."""
    if exact:
        return {d: log10(1 + 1 / d) for d in range(1, 10)}
    return dict(EXPECTED)


def equal_size_ks_pvalues(n: int = 9) -> dict[int, float]:
    """P(D >= k/n) of the two-sample KS test with n values on both sides."""
    total = comb(2 * n, n)
    table = {0: 1.0}
    for k in range(1, n + 1):
        tail = sum((-1) ** (j + 1) * comb(2 * n, n - j * k) for j in range(1, n // k + 1))
        table[k] = min(1.0, 2 * tail / total)
    return table
