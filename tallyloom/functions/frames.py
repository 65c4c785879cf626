"""Frame and resize arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patch size, pixel limits, frame limits.
FACTOR, MIN_PIXELS, MAX_PIXELS, MAX_RATIO = 28, 4 * 28 * 28, 16384 * 28 * 28, 200
FRAME_FACTOR, FPS, MIN_FRAMES, MAX_FRAMES = 2, 2.0, 4, 768


def round_by(c: Column, factor: int) -> Column:
    """The nearest multiple, halves to the even one."""
    return (F.bround(c / F.lit(float(factor))) * factor).cast("bigint")


def ceil_by(c: Column, factor: int) -> Column:
    return F.ceil(c / F.lit(float(factor))) * factor


def floor_by(c: Column, factor: int) -> Column:
    return F.floor(c / F.lit(float(factor))) * factor


def smart_resize(h: Column, w: Column, factor: int = FACTOR, min_pixels: int = MIN_PIXELS, max_pixels: int = MAX_PIXELS) -> Column:
    """(height, width), multiples of the factor within the pixel limits; null for an aspect ratio beyond MAX_RATIO."""
    h, w = h.cast("double"), w.cast("double")
    h1, w1 = F.greatest(F.lit(factor), round_by(h, factor)), F.greatest(F.lit(factor), round_by(w, factor))
    down, up = F.sqrt(h * w / F.lit(float(max_pixels))), F.sqrt(F.lit(float(min_pixels)) / (h * w))
    big, small = h1 * w1 > max_pixels, h1 * w1 < min_pixels
    pick = lambda one, x: F.when(big, floor_by(x / down, factor)).when(small, ceil_by(x * up, factor)).otherwise(one).cast("bigint")
    fits = F.greatest(h, w) / F.least(h, w) <= MAX_RATIO
    return F.when(fits, F.struct(pick(h1, h).alias("height"), pick(w1, w).alias("width")))


def smart_nframes(total: Column, video_fps: Column, fps: float = FPS, min_frames: int = MIN_FRAMES, max_frames: int = MAX_FRAMES) -> Column:
    """Frames to take at a rate, clamped and made even; null where outside [2, total]."""
    least = -(-min_frames // FRAME_FACTOR) * FRAME_FACTOR
    most = floor_by(F.least(F.lit(max_frames), total).cast("double"), FRAME_FACTOR)
    wanted = total / video_fps * F.lit(fps)
    n = floor_by(F.least(F.greatest(wanted, F.lit(float(least))), most.cast("double"), total.cast("double")), FRAME_FACTOR).cast("bigint")
    return F.when((n >= FRAME_FACTOR) & (n <= total), n)


def rounded_nframes(n: Column, total: Column) -> Column:
    """A number of frames given outright, made even; null where outside [2, total]."""
    r = round_by(n, FRAME_FACTOR)
    return F.when((r >= FRAME_FACTOR) & (r <= total), r)


def frame_indices(total: Column, n: Column) -> Column:
    """n indices evenly from 0 to total - 1, halves to the even one."""
    step = (total - 1).cast("double") / F.greatest(n - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1), lambda i: F.bround(i * step).cast("bigint"))


def truncated_indices(total: Column, n: Column) -> Column:
    step = (total - 1).cast("double") / F.greatest(n - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1), lambda i: F.floor(i * step))


def sample_fps(n: Column, total: Column, video_fps: Column) -> Column:
    return n / F.greatest(total.cast("double"), F.lit(1e-6)) * video_fps


def pixel_budget(n: Column, total_pixels: int, frame_max: int, frame_min: int, given: Column | None = None) -> Column:
    """Pixels a frame may have when n frames share a total; a maximum given by the row lowers it and never raises it."""
    limit = F.greatest(F.least(F.lit(float(frame_max)), F.lit(float(total_pixels)) / n * FRAME_FACTOR), F.lit(float(int(frame_min * 1.05))))
    return limit if given is None else F.least(given.cast("double"), limit)


def padded_even(frames: Column) -> Column:
    """The list with its last entry repeated until its length is even."""
    return F.when(F.size(frames) % 2 == 1, F.array_append(frames, F.element_at(frames, -1))).otherwise(frames)


def sampled_frames(total: Column, video_fps: Column, num_frames: int, fps: int) -> Column:
    """(n, duration, indices, timestamps): at most num_frames at a rate, timestamps in whole seconds; a rate of zero takes num_frames, a video rate of zero counts as 30."""
    rate = F.when(video_fps > 0, video_fps).otherwise(F.lit(30.0))
    duration = F.floor(total / rate)
    n = F.greatest(F.lit(1), F.least(F.lit(num_frames), F.floor(duration * fps))) if fps > 0 else F.lit(num_frames)
    idx = truncated_indices(total, n)
    return F.struct(n.cast("bigint").alias("n"), duration.alias("duration"), idx.alias("indices"), F.transform(idx, lambda i: F.floor(i / rate)).alias("timestamps"))


def capped_size(h: Column, w: Column, max_side: int = 448, transposed: bool = False) -> Column:
    """(height, width) no longer than max_side, never enlarged. `transposed` gives shrunken images the sides the other way round, as a reader does that takes width for height."""
    scale = F.lit(float(max_side)) / F.greatest(h, w)
    fit = lambda x: F.when(F.greatest(h, w) <= max_side, x).otherwise(F.floor(x * scale)).cast("bigint")
    a, b = fit(h), fit(w)
    if transposed:
        small = F.greatest(h, w) <= max_side
        a, b = F.when(small, a).otherwise(b), F.when(small, b).otherwise(a)
    return F.struct(a.alias("height"), b.alias("width"))


def backoff_delay(attempt: Column, base: float = 3.0, spread: Column | None = None) -> Column:
    """Seconds before a retry: base * 2^attempt plus up to a tenth of it."""
    d = F.lit(base) * F.pow(F.lit(2.0), attempt)
    return d if spread is None else d + spread * d * F.lit(0.1)
