"""Hash draws that SQL engines reproduce: the first 13 hex digits of an MD5 as a number in [0, 1)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 16**13


def draw(*keys: Column | str) -> Column:
    """Uniform in [0, 1) by the keys alone, whatever the partitioning or the run."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("double") / float(SPAN)
