"""Sequential coders and fits of single frames, for use in grouped or batch functions."""

from __future__ import annotations

import numpy as np


class RangeEncoder:
    """Range coder with 32-bit state and carry, for cumulative frequencies (RFC 6716, section 5.1)."""

    TOP, BOTTOM = 1 << 31, 1 << 23

    def __init__(self):
        self.low, self.range, self.out = 0, 1 << 31, bytearray()
        self.held, self.waiting = -1, 0

    def _carry(self, symbol: int) -> None:
        if symbol != 0xFF:
            carry = symbol >> 8
            if self.held >= 0:
                self.out.append((self.held + carry) & 0xFF)
            self.out += bytes([(0xFF + carry) & 0xFF]) * self.waiting
            self.held, self.waiting = symbol & 0xFF, 0
        else:
            self.waiting += 1

    def _renormalise(self) -> None:
        while self.range <= self.BOTTOM:
            self._carry(self.low >> 23)
            self.low = (self.low << 8) & (self.TOP - 1)
            self.range <<= 8

    def put(self, start: int, end: int, total: int) -> None:
        """The symbol whose cumulative frequencies are [start, end) of total."""
        r = self.range // total
        if start:
            self.low += self.range - r * (total - start)
            self.range = r * (end - start)
        else:
            self.range -= r * (total - end)
        self._renormalise()

    def finish(self) -> bytes:
        """As few bytes as tell the state apart, whatever follows them."""
        bits = 32 - self.range.bit_length()
        mask = (self.TOP - 1) >> bits
        end = (self.low + mask) & ~mask
        if end | mask >= self.low + self.range:
            bits += 1
            mask >>= 1
            end = (self.low + mask) & ~mask
        while bits > 0:
            self._carry(end >> 23)
            end = (end << 8) & (self.TOP - 1)
            bits -= 8
        if self.held >= 0 or self.waiting:
            self._carry(0)
        return bytes(self.out)


class RangeDecoder:
    TOP, BOTTOM = RangeEncoder.TOP, RangeEncoder.BOTTOM

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.range = 128
        self.last = self._byte()
        self.value = 127 - (self.last >> 1)
        self._renormalise()

    def _byte(self) -> int:
        b = self.data[self.at] if self.at < len(self.data) else 0
        self.at += 1
        return b

    def _renormalise(self) -> None:
        while self.range <= self.BOTTOM:
            self.range <<= 8
            before, self.last = self.last, self._byte()
            symbol = (before << 8 | self.last) >> 1
            self.value = ((self.value << 8) + (0xFF & ~symbol)) & (self.TOP - 1)

    def get(self, cumulative: list[int]) -> int:
        """The index of the symbol; ``cumulative`` begins at 0 and ends with the total."""
        total = cumulative[-1]
        r = self.range // total
        place = total - min(self.value // r + 1, total)
        k = int(np.searchsorted(cumulative, place, "right")) - 1
        start, end = cumulative[k], cumulative[k + 1]
        self.value -= r * (total - end)
        self.range = r * (end - start) if start else self.range - r * (total - end)
        self._renormalise()
        return k


def render_line(x0: int, y0: int, x1: int, y1: int) -> list[int]:
    """Integer points from (x0, y0) to before x1, by the format's error-accumulating line."""
    dy, adx = y1 - y0, x1 - x0
    base = int(dy / adx)
    step = base - 1 if dy < 0 else base + 1
    rest, err, y, out = abs(dy) - abs(base) * adx, 0, y0, [y0]
    for _ in range(x0 + 1, x1):
        err += rest
        if err >= adx:
            err -= adx
            y += step
        else:
            y += base
        out.append(y)
    return out


def noise_floor(power_db: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each bin the value at it of a line fitted over bins low ... high - 1, by running moments.

    Weights are the levels' squares, so peaks pull the line up; never below zero.
    """
    x = np.arange(len(power_db), dtype=np.float64)
    y = np.maximum(power_db, 1.0)
    w = y * y
    sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (w, w * x, w * x * x, w * y, w * x * y)]
    n, sx, sxx, sy, sxy = (s[high] - s[low] for s in sums)
    d = n * sxx - sx * sx
    flat = np.where(n > 0, sy / np.where(n > 0, n, 1), 0.0)
    fitted = (sy * sxx - sx * sxy + (n * sxy - sx * sy) * x) / np.where(np.abs(d) > 1e-9, d, 1)
    return np.maximum(np.where(np.abs(d) > 1e-9, fitted, flat), 0.0)


def scale_factor_widths(low: list[int], high: list[int], widths: list[tuple[int, int]]) -> int | None:
    """The first index of the narrowest (low, high) field widths that hold both groups of scale factors."""
    a, b = max(low, default=0).bit_length(), max(high, default=0).bit_length()
    fit = [(x * len(low) + y * len(high), k) for k, (x, y) in enumerate(widths) if x >= a and y >= b]
    return min(fit)[1] if fit else None
