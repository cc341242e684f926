"""Vector expressions over array columns: plain Catalyst higher-order functions, no Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gather(v: Column, indices: list[int]) -> Column:
    """Elements at ``indices`` (from 0); null where the vector is too short."""
    return F.transform(F.array(*[F.lit(i) for i in indices]), lambda i: F.get(v, i))


def part(v: Column, start: int, end: int) -> Column:
    """Elements ``start`` to ``end``, the latter exclusive."""
    return F.slice(v, start + 1, end - start)


def of_width(v: Column, width: int) -> Column:
    """``v``, or an error where its width is another one."""
    return F.when(F.size(v) == width, v).otherwise(F.raise_error(F.concat(F.lit(f"expected width {width}, got "), F.size(v).cast("string"))))


# The canonical layout of 80 slots, name -> (first, end).
SLOTS = {
    "left_joint": (0, 7), "left_eef": (7, 16), "left_gripper": (16, 17), "left_hand": (17, 29), "right_joint": (29, 36),
    "right_eef": (36, 45), "right_gripper": (45, 46), "right_hand": (46, 58), "reserved": (58, 80),
}


def slot_fill(parts: dict[str, tuple[Column, int]], slots: dict[str, tuple[int, int]] = SLOTS) -> tuple[Column, Column]:
    """The canonical vector and its mask from ``slot -> (vector, width)``; zeros and False where nothing is given."""
    values, mask = [], []
    for name, (lo, hi) in slots.items():
        vector, width = parts.get(name, (F.array().cast("array<double>"), 0))
        if width > hi - lo:
            raise ValueError(f"{name} has {hi - lo} slots, {width} were given")
        values.append(F.concat(vector, F.array_repeat(F.lit(0.0), hi - lo - width)))
        mask.append(F.concat(F.array_repeat(F.lit(True), width), F.array_repeat(F.lit(False), hi - lo - width)))
    return F.concat(*values), F.concat(*mask)


def stacked(parts: list[tuple[str, Column, int]]) -> dict[str, tuple[Column, int]]:
    """Parts named ``slot.piece`` in order: those of one slot follow one another in it."""
    out: dict[str, tuple[Column, int]] = {}
    for name, vector, width in parts:
        slot = name.split(".")[0]
        if slot in out:
            held, n = out[slot]
            out[slot] = F.concat(held, vector), n + width
        else:
            out[slot] = vector, width
    return out


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def min_max_scale(v: Column, lo: Column, hi: Column, keep: tuple[int, ...] = ()) -> Column:
    """``(x - lo) / (hi - lo)`` by dimension; a range under 1e-12 counts as 1; dimensions in ``keep`` are untouched."""
    kept = F.array(*[F.lit(k) for k in keep]).cast("array<int>")
    width = F.zip_with(hi, lo, lambda h, l: F.when(h - l < 1e-12, 1.0).otherwise(h - l))
    scaled = F.zip_with(minus(v, lo), width, lambda x, w: x / w)
    return F.transform(scaled, lambda x, i: F.when(F.array_contains(kept, i), F.get(v, i)).otherwise(x)) if keep else scaled


def normalize(v: Column, mode: str, stats: dict[str, Column]) -> Column:
    """Normalise by dimension with arrays of statistics; values are not clipped.

    ``q99`` and ``mean_std`` pass degenerate dimensions through, ``min_max`` and ``scale`` make them 0.
    """
    if mode == "binary":
        return F.transform(v, lambda x: F.when(x > 0.5, 1.0).otherwise(0.0))
    if mode == "mean_std":
        both = F.arrays_zip(v.alias("x"), stats["mean"].alias("m"), stats["std"].alias("s"))
        return F.transform(both, lambda t: F.when(t["s"] != 0, (t["x"] - t["m"]) / t["s"]).otherwise(t["x"]))
    if mode == "scale":
        both = F.arrays_zip(v.alias("x"), F.zip_with(stats["min"], stats["max"], lambda a, b: F.greatest(F.abs(a), F.abs(b))).alias("s"))
        return F.transform(both, lambda t: F.when(t["s"] != 0, t["x"] / t["s"]).otherwise(0.0))
    if mode not in ("q99", "min_max"):
        raise ValueError(f"unknown mode {mode}")
    lo, hi = (stats["q01"], stats["q99"]) if mode == "q99" else (stats["min"], stats["max"])
    both = F.arrays_zip(v.alias("x"), lo.alias("lo"), hi.alias("hi"))
    flat = (lambda t: t["x"]) if mode == "q99" else (lambda t: F.lit(0.0))
    return F.transform(both, lambda t: F.when(t["lo"] != t["hi"], 2 * (t["x"] - t["lo"]) / (t["hi"] - t["lo"]) - 1).otherwise(flat(t)))


def denormalize(v: Column, mode: str, stats: dict[str, Column]) -> Column:
    """The inverse of ``normalize``; ``scale`` has none."""
    if mode == "binary":
        return F.transform(v, lambda x: F.when(x > 0.5, 1.0).otherwise(0.0))
    if mode == "mean_std":
        both = F.arrays_zip(v.alias("x"), stats["mean"].alias("m"), stats["std"].alias("s"))
        return F.transform(both, lambda t: F.when(t["s"] != 0, t["x"] * t["s"] + t["m"]).otherwise(t["x"]))
    if mode not in ("q99", "min_max"):
        raise ValueError(f"{mode} can't be inverted")
    lo, hi = (stats["q01"], stats["q99"]) if mode == "q99" else (stats["min"], stats["max"])
    both = F.arrays_zip(v.alias("x"), lo.alias("lo"), hi.alias("hi"))
    return F.transform(both, lambda t: (t["x"] + 1) / 2 * (t["hi"] - t["lo"]) + t["lo"])


def denormalize_actions(v: Column, q01: Column, q99: Column, mask: Column) -> Column:
    """Clip to [-1, 1] and undo q99 where ``mask`` is True; elsewhere threshold at 0.5 to 0 or 1."""
    both = F.arrays_zip(v.alias("x"), q01.alias("lo"), q99.alias("hi"), mask.alias("m"))
    clip = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    return F.transform(both, lambda t: F.when(t["m"], 0.5 * (clip(t["x"]) + 1) * (t["hi"] - t["lo"]) + t["lo"]).otherwise(F.when(clip(t["x"]) < 0.5, 0.0).otherwise(1.0)))


def sin_cos(v: Column) -> Column:
    return F.concat(F.transform(v, F.sin), F.transform(v, F.cos))


def noisy(v: Column, key: Column, scale: float, seed: int, lo: Column, hi: Column) -> Column:
    """``v`` with seeded normal noise of deviation ``scale`` by dimension, clipped to [lo, hi]; the same rows give the same noise."""
    moved = F.transform(v, lambda x, i: x + scale * normal(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), i.cast("string"))))
    return F.zip_with(F.zip_with(moved, lo, lambda x, y: F.greatest(x, y)), hi, lambda x, y: F.least(x, y))


def dropout(v: Column, key: Column, share: float, seed: int) -> Column:
    """Zeros instead of the whole vector for about ``share`` of the rows, chosen by key."""
    return F.when(uniform(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))) < share, F.transform(v, lambda x: x * 0)).otherwise(v)


def normal(text: Column) -> Column:
    """A draw from the standard normal distribution, made from two uniform ones."""
    radius = F.sqrt(-2 * F.log(1 - uniform(F.concat(text, F.lit("|r")))))
    return radius * F.cos(6.283185307179586 * uniform(F.concat(text, F.lit("|a"))))


def uniform(text: Column) -> Column:
    """A number in [0, 1) from the md5 of ``text``: its first 13 hex digits over 16^13."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))
