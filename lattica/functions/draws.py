"""Random numbers that depend on names alone: neither on partitions nor on the engine that draws them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_uniform(*columns: Column) -> Column:
    """A number in [0, 1): the first 52 bits of the MD5 of the columns' texts, joined by commas."""
    digest = F.md5(F.concat_ws(",", *(c.cast("string") for c in columns)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / 2.0**52
