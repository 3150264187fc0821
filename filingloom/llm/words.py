"""Words of a text, as the operators on texts compare them."""

from __future__ import annotations

import re

import numpy as np

_RUNS = re.compile(r"[^\W_]+").findall


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, lower-cased; none for a null or empty text."""
    found = _RUNS(text) if text else []
    return " ".join(found).lower().split(" ") if found else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an unsigned array."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
