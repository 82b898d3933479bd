"""Imports every operator module of this subpackage, so that its queries register."""

from gridspark.llm import bagminhash, conversations, decontaminate, mixing, negatives, neural_lm, packing, pii, quality, secrets, sharding, substrings, warc  # noqa: F401
from gridspark.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
