"""Joins that broadcast one side only behind a check of its size; the core's, which measures bytes."""

from siftlake.operators.joins import MAX_BYTES, small_side

__all__ = ["MAX_BYTES", "small_side"]
