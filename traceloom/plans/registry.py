"""Registered queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import clustering, conditions, evaluation, functions, noisy, sampling, sources, voting  # noqa: F401, I001  (they register themselves)
from . import demux, extras, formats  # noqa: F401, I001  (after those they write and read again)
from ._register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
