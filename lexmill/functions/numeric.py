"""Scalar functions of scores and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def logit(p: Column, eps: float = 1e-6) -> Column:
    c = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.ln(c / (1 - c))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def smooth_label(y: Column, s: float) -> Column:
    return y * (1 - s) + s / 2


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def above(x: float) -> float:
    """The next double over x."""
    return math.nextafter(x, math.inf)


def warmup_cosine(step: int, total: int, warmup: int, peak: float = 1.0) -> float:
    """Learning rate: linear to ``peak`` over the warm-up, then half a cosine to 0."""
    if step < warmup:
        return peak * (step + 1) / max(1, warmup)
    done = (step - warmup) / max(1, total - warmup)
    return peak * 0.5 * (1 + math.cos(math.pi * min(1.0, done)))


def unit_hash(key: Column) -> Column:
    """A reproducible number in [0, 1): the first 32 bits of the SHA-256 of a string."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def window_starts(ids: Column, width: int) -> Column:
    """Where the begin, middle and end windows of ``width`` ids start, from 0, without repeats; null has one at 0, as an empty list."""
    n = F.greatest(F.size(ids) - width, F.lit(0))
    return F.array_distinct(F.array(F.lit(0), F.floor(n / 2).cast("int"), n))


def pad_windows(ids: Column, width: int) -> Column:
    """Begin, middle and end windows of ``width`` ids, starts without repeats, padded with zeros to three
    windows of equal width."""
    def build(starts: Column) -> Column:
        def window(s: Column) -> Column:
            w = F.slice(ids, s + 1, F.lit(width))
            return F.concat(w, F.array_repeat(F.lit(0).cast("int"), width - F.size(w)))

        got = F.transform(starts, window)
        return F.concat(got, F.array_repeat(F.array_repeat(F.lit(0).cast("int"), width), 3 - F.size(starts)))

    return F.element_at(F.transform(F.array(window_starts(ids, width)), build), 1)
