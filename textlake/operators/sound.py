"""Sound as arrays of samples (-1 to 1): levels, fading, padding, resampling, noise; Column expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlake.functions.text import let


def _doubles(samples: Column | str) -> Column:
    return (F.col(samples) if isinstance(samples, str) else samples).cast("array<double>")


def _indices(n: Column) -> Column:
    """0 .. n-1; none for n below 1."""
    return F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _power(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda s, x: s + x * x) / F.greatest(F.size(samples), F.lit(1))


def frames(samples: Column | str, size: int) -> Column:
    """Frames of `size` samples; an incomplete last one is dropped."""
    return let(_doubles(samples), lambda s: F.transform(_indices(F.floor(F.size(s) / size).cast("int")), lambda i: F.slice(s, i * size + 1, size)))


def frame_levels(samples: Column | str, size: int) -> Column:
    """Level of each frame in dB of full scale, -120 at least; without a whole frame one of -120."""
    levels = F.transform(frames(samples, size), lambda f: 20 * F.log10(F.greatest(F.sqrt(_power(f)), F.lit(1e-6))))
    return let(levels, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(-120.0))))


def speech_level(samples: Column | str, size: int) -> Column:
    """Mean power of the loud frames (over -50 dB, at most 30 dB below the loudest) in dB; none: -120."""

    def level(x: Column) -> Column:
        loud = F.filter(x, lambda v: v > F.greatest(F.lit(-50.0), F.array_max(x) - 30))
        mean = F.aggregate(loud, F.lit(0.0), lambda s, v: s + F.pow(F.lit(10.0), v / 10)) / F.size(loud)
        return F.when(F.size(loud) > 0, 10 * F.log10(mean)).otherwise(F.lit(-120.0))

    return let(frame_levels(samples, size), level)


def soft_limit(samples: Column | str, ceiling: float = 0.97) -> Column:
    """Peaks above 0.8 of the ceiling approach it smoothly."""
    knee = 0.8 * ceiling
    bent = lambda x: F.signum(x) * (knee + (ceiling - knee) * F.tanh((F.abs(x) - knee) / (ceiling - knee)))
    return F.transform(_doubles(samples), lambda x: F.when(F.abs(x) > knee, bent(x)).otherwise(x))


def normalize(samples: Column | str, size: int, target_db: float) -> Column:
    """Speech brought to target_db, peaks limited; silence stays."""
    s, level = _doubles(samples), speech_level(samples, size)
    louder = let(F.pow(F.lit(10.0), (target_db - level) / 20), lambda g: F.transform(s, lambda x: x * g))
    return F.when(level < -100, s).otherwise(soft_limit(louder))


def fade(samples: Column | str, length: int) -> Column:
    """A straight rise at the start and fall at the end, each of `length` samples, at most half."""

    def run(s: Column) -> Column:
        n = F.least(F.floor(F.size(s) / 2), F.lit(length))
        share = lambda i: F.least(F.lit(1.0), i / (n - 1), (F.size(s) - 1 - i) / (n - 1))
        return F.when(n > 1, F.transform(s, lambda x, i: x * share(i))).otherwise(s)

    return let(_doubles(samples), run)


def pad(samples: Column | str, before: int, after: int) -> Column:
    """Silence in front and behind."""
    return F.concat(F.array_repeat(F.lit(0.0), before), _doubles(samples), F.array_repeat(F.lit(0.0), after))


def trim(samples: Column | str, size: int, threshold_db: float = -45.0, keep: int = 0) -> Column:
    """Quiet frames cut off at both ends but for `keep` samples; without a loud frame nothing stays."""

    def run(s: Column) -> Column:
        loud = F.filter(F.transform(frame_levels(s, size), lambda v, i: F.when(v > threshold_db, i)), lambda i: i.isNotNull())
        start = F.greatest(F.lit(0), F.array_min(loud) * size - keep)
        end = F.least(F.size(s), (F.array_max(loud) + 1) * size + keep)
        return F.when(F.size(loud) > 0, F.slice(s, start + 1, end - start)).otherwise(F.array().cast("array<double>"))

    return let(_doubles(samples), run)


def resample(samples: Column | str, rate: int, target: int) -> Column:
    """Linear interpolation; before a lower rate, means over as many samples as one becomes."""
    if rate == target:
        return _doubles(samples)
    width = max(1, round(rate / target)) if rate > target else 1

    def smooth(s: Column) -> Column:
        if width == 1:
            return s
        first = lambda i: F.greatest(F.lit(0), i - width // 2)
        last = lambda i: F.least(F.size(s) - 1, i + (width - 1) // 2)
        return F.transform(s, lambda _, i: F.aggregate(F.slice(s, first(i) + 1, last(i) - first(i) + 1), F.lit(0.0), lambda a, x: a + x) / width)

    def at(s: Column, i: Column) -> Column:
        place = i * (rate / target)
        low = F.floor(place).cast("int")
        a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return a + (b - a) * (place - low)

    return let(let(_doubles(samples), smooth), lambda s: F.transform(_indices(F.floor(F.size(s) * target / rate).cast("int")), lambda i: at(s, i)))


def add_noise(samples: Column | str, key: Column, snr_db: float, size: int) -> Column:
    """White noise at a signal-to-noise ratio, the signal's power taken over its sounding frames (1 % of the loudest).

    The noise of a sample depends on key and place alone (Box-Muller over hashes), so a rerun task gives the same. Silence stays.
    """
    unit = lambda i, salt: (F.pmod(F.xxhash64(key, i, F.lit(salt)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    normal = lambda i: F.sqrt(-2 * F.log(unit(i, 1))) * F.cos(2 * math.pi * unit(i, 2))

    def powers(s: Column) -> Column:
        return let(frames(s, size), lambda f: F.transform(F.when(F.size(f) > 0, f).otherwise(F.array(s)), _power))

    def mean(p: Column) -> Column:
        voiced = F.filter(p, lambda v: v >= F.array_max(p) * 0.01)
        return F.aggregate(voiced, F.lit(0.0), lambda a, v: a + v) / F.greatest(F.size(voiced), F.lit(1))

    def run(s: Column) -> Column:
        return let(F.sqrt(let(powers(s), mean) / 10 ** (snr_db / 10)), lambda d: F.transform(s, lambda x, i: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x + d * normal(i)))))

    s = _doubles(samples)
    return F.when(F.aggregate(s, F.lit(0.0), lambda a, x: a + x * x) > 0, let(s, run)).otherwise(s)
