"""Colours for event logs: hues for schemas that keep away from reserved ones."""

from __future__ import annotations

import colorsys


def hsv_to_rgb(hue: float, saturation: float, value: float) -> tuple[float, float, float]:
    return colorsys.hsv_to_rgb(hue % 1.0, saturation, value)


def rainbow(n: int, reserved: list[float] | None = None, gap: float = 0.05) -> list[float]:
    """`n` hues spread over the circle, at least `gap` from each reserved hue."""
    far = lambda h: all(min(abs(h - r) % 1, 1 - abs(h - r) % 1) >= gap for r in reserved or [])
    free = [k / 720 for k in range(720) if far(k / 720)]
    if not free:
        raise ValueError("the reserved hues leave none")
    return [free[k * len(free) // n] for k in range(n)]
