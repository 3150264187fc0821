"""Settings of a run in one frozen place, and what is odd about them."""

from __future__ import annotations

from dataclasses import dataclass, field

from filingloom.operators.scores import SECTION_WEIGHTS, SIGNALS


@dataclass(frozen=True)
class Settings:
    """Parameters that queries and operators take; the defaults are those of the operators."""

    signals: tuple[tuple[float, str], ...] = tuple(SIGNALS)
    section_weights: dict[str, float] = field(default_factory=lambda: dict(SECTION_WEIGHTS))
    blend_weights: dict[str, float] = field(default_factory=lambda: {"finbert": 0.60, "keywords": 0.40, "llm": 0.0})
    chunk_words: int = 500
    chunk_overlap: int = 50
    chunk_least: int = 100
    top_k: int = 5
    history_turns: int = 10
    shift_threshold: float = 0.15
    spike_ratio: float = 3.0
    least_history: int = 3
    return_windows: tuple[int, ...] = (30, 60, 90, 180, 365)
    flat_threshold: float = 0.02
    checkpoint_dir: str | None = None
    model: str = "auto"

    def problems(self) -> list[str]:
        """What is wrong or worth a warning; empty if all is well. Nothing is raised: callers decide."""
        found = []
        bounds = [b for b, _ in self.signals]
        if bounds != sorted(bounds, reverse=True):
            found.append("signals must be ordered from the highest bound to the lowest")
        for name, weights in (("section_weights", self.section_weights), ("blend_weights", self.blend_weights)):
            if any(w < 0 for w in weights.values()):
                found.append(f"{name} must not be negative")
            elif abs(sum(weights.values()) - 1) > 1e-9:
                found.append(f"{name} add up to {sum(weights.values()):g}, not 1; they are shared out anew")
        if not 0 <= self.chunk_overlap < self.chunk_words:
            found.append("chunk_overlap must be at least 0 and below chunk_words")
        if self.top_k < 1 or self.least_history < 1:
            found.append("top_k and least_history must be at least 1")
        if not self.return_windows or min(self.return_windows) < 1:
            found.append("return_windows must be days from 1 on")
        if self.checkpoint_dir is None:
            found.append("checkpoint_dir isn't set: only a local master can do without")
        return found
