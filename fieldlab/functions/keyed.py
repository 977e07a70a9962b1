"""Keyed randomness: every draw is a pure function of its key.

A task that is retried, or a table that is partitioned differently, yields the same draw.
The key is the colon-joined text of its parts; use integers, strings and formatted dates.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = float(2**52)


def digest(*parts) -> Column:
    """MD5 of the key, as 32 hex digits. Also serves as a random sort key."""
    return F.md5(F.concat_ws(":", *[_text(p) for p in parts]))


def uniform(*parts) -> Column:
    """Uniform in [0, 1) from the first 13 hex digits of the key's digest."""
    return _fraction(digest(*parts), 1)


def normal(*parts) -> Column:
    """Standard normal (Box-Muller) from two disjoint 13-digit stretches of one digest."""
    d = digest(*parts)
    radius = F.sqrt(-2.0 * F.log(_fraction(d, 1) + 0.5 / _SCALE))
    return radius * F.cos(2.0 * math.pi * _fraction(d, 17))


def uniform_value(*parts) -> float:
    """The same uniform on the driver, for parameters such as fixed weights."""
    text = ":".join(str(p) for p in parts)
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / _SCALE


def _fraction(d: Column, start: int) -> Column:
    return F.conv(F.substring(d, start, 13), 16, 10).cast("bigint") / _SCALE


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))
