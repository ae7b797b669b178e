"""Connection-history letters: upper case is the originator, lower case the responder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# History letters -> TCP flag bit (a data packet counts as PSH).
FLAG_BITS = [("F", 1), ("S", 2), ("R", 4), ("PD", 8), ("A", 16), ("U", 32)]
RETRANSMISSION_LETTERS = "cCtT"


def _bits(history: Column, lower: bool) -> Column:
    out = None
    for letters, bit in FLAG_BITS:
        seen = None
        for letter in letters.lower() if lower else letters:
            hit = history.contains(letter)
            seen = hit if seen is None else seen | hit
        part = F.when(seen, bit).otherwise(0)
        out = part if out is None else out + part
    return out


def tcp_flags(history: Column, side: str = "both") -> Column:
    """Flag bits seen from one side, or from both; a missing history has none."""
    if side == "client":
        return _bits(history, lower=False)
    if side == "server":
        return _bits(history, lower=True)
    return _bits(history, lower=False).bitwiseOR(_bits(history, lower=True))


def retransmissions(history: Column) -> Column:
    """How often one of the retransmission letters occurs."""
    others = F.translate(history, RETRANSMISSION_LETTERS, "")
    return F.coalesce(F.length(history) - F.length(others), F.lit(0))
