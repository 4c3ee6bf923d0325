"""Every query by name, with SQL that says the same where there is any."""

from __future__ import annotations

from cadence.plans import evaluation, frames, holds, pixels, signals
from cadence.plans.base import compile_all

QUERIES, ORACLES = compile_all({**holds.QUERIES, **pixels.QUERIES, **signals.QUERIES, **evaluation.QUERIES})
QUERIES |= frames.QUERIES
FLAGSHIP = "w1_hold_groups"
