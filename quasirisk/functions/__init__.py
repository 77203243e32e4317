"""Column functions: built-in expressions only, no Python UDFs."""

from quasirisk.functions.levels import safe_level
from quasirisk.functions.noise import gaussian_noise, laplace_noise
from quasirisk.functions.rounding import python_round, round_nearest, round_up, truncate

__all__ = [
    "gaussian_noise",
    "laplace_noise",
    "python_round",
    "round_nearest",
    "round_up",
    "safe_level",
    "truncate",
]
