"""Reproducible noise.

With a row id the draws come from a hash of (seed, stream, row id): the same row gets the
same noise whatever the partitioning, and a recomputed task repeats it.  Draws of different
streams are independent; callers name one per column and step.  Without a row id they come
from the generator of the task, for streams.  This perturbs
values; the scale is not tied to a sensitivity, so it is no differential-privacy
guarantee.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIFORM_BITS = 53


def _name(seed: int, stream: str, draw: int) -> str:
    return f"{seed}/{draw}/{stream}"


def _uniform(seed: int, row_id: Column | None, stream: str, draw: int = 0) -> Column:
    """A uniform number strictly between 0 and 1."""
    name = _name(seed, stream, draw)
    if row_id is None:
        return (F.rand(zlib.crc32(name.encode())) * (2.0**_UNIFORM_BITS - 1) + 0.5) / F.lit(2.0**_UNIFORM_BITS)
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(name), row_id), 64 - _UNIFORM_BITS)
    return (bits.cast("double") + 0.5) / F.lit(2.0**_UNIFORM_BITS)


def laplace_noise(seed: int = 0, row_id: Column | None = None, scale: float = 1.0, stream: str = "") -> Column:
    """Laplace(0, scale) by inverting the distribution function."""
    centred = _uniform(seed, row_id, stream) - 0.5
    return F.lit(-float(scale)) * F.signum(centred) * F.log1p(F.abs(centred) * -2.0)


def gaussian_noise(seed: int = 0, row_id: Column | None = None, scale: float = 1.0, stream: str = "") -> Column:
    """Normal(0, scale): Box-Muller with a row id, the built-in generator without."""
    if row_id is None:
        return F.randn(zlib.crc32(_name(seed, stream, 0).encode())) * float(scale)
    radius = F.sqrt(F.log(_uniform(seed, row_id, stream)) * -2.0)
    return radius * F.cos(_uniform(seed, row_id, stream, 1) * (2.0 * math.pi)) * float(scale)
