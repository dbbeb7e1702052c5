"""Merge thresholds; scalars that the driver keeps between iterations."""

from __future__ import annotations

from dataclasses import dataclass, field


def reciprocal(t: int) -> float:
    return 1 / (t + 1)


def geometric(t: int, total: int, high: float, low: float) -> float:
    return high if total <= 1 else high * (low / high) ** ((t - 1) / (total - 1))


def lower_quantile(values: list[float], q: float) -> float:
    """Element floor(q (n-1)) of the sorted values."""
    values = sorted(values)
    return values[int(q * (len(values) - 1))]


@dataclass
class ThresholdState:
    policy: str = "reciprocal"
    high: float = 0.5
    low: float = 0.005
    min_low: float = 0.005
    q_high: float = 0.85
    q_low: float = 0.15
    target: float = 0.15
    scale: float = 1.0
    previous: list[float] = field(default_factory=list)

    def at(self, t: int, total: int) -> float:
        if self.policy == "reciprocal":
            return reciprocal(t)
        value = geom = geometric(t, total, self.high, self.low)
        if self.policy == "adaptive":
            q = self.q_high if total <= 1 else self.q_high + (self.q_low - self.q_high) * (t - 1) / (total - 1)
            value = min(geom, (lower_quantile(self.previous, q) if self.previous else geom) * self.scale)
        return min(max(value, self.min_low), self.high)

    # fixed values below: 0.5 and 2 times the target rate, factors 0.85 and 1.05, scales from 0.25 to 4
    def end(self, samples: list[float], tested: int, accepted: int) -> None:
        if self.policy == "adaptive" and tested:
            rate = accepted / tested
            if rate < self.target * 0.5:
                self.scale *= 0.85
            elif rate > self.target * 2:
                self.scale *= 1.05
            self.scale = min(max(self.scale, 0.25), 4.0)
        self.previous = samples
