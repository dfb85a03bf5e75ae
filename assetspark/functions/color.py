"""Color and packed-normal arithmetic on texel columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arithmetic import clip, half_even, half_up


def srgb_to_linear(value: Column) -> Column:
    v = value / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(value: Column) -> Column:
    v = clip(value, 0.0, 1.0)
    encoded = F.when(v <= 0.0031308, v * 12.92).otherwise(
        F.lit(1.055) * F.pow(v, F.lit(1 / 2.4)) - 0.055
    )
    return clip(half_even(encoded * 255), 0, 255)


def unpack_axis(value: Column) -> Column:
    return value / 127.5 - 1.0


def pack_axis(value: Column) -> Column:
    # guard digits keep values that are half apart only by rounding noise together
    return half_up(F.round(clip((value + 1.0) * 127.5, 0.0, 255.0), 9))


def decode_normal(g: Column, a: Column, inside_disk: bool = True) -> dict[str, Column]:
    """x from A, y from G; ``inside_disk`` pulls vectors back to the unit disk."""
    x, y = unpack_axis(a), unpack_axis(g)
    if inside_disk:
        scale = F.greatest(F.lit(1.0), F.sqrt(x * x + y * y))
        x, y = x / scale, y / scale
    z = F.sqrt(F.greatest(F.lit(0.0), 1.0 - x * x - y * y))
    return {"x": x, "y": y, "z": z}


def packed_length(px: Column, py: Column) -> Column:
    dx, dy = unpack_axis(px), unpack_axis(py)
    return F.sqrt(dx * dx + dy * dy)


def pack_normal(x: Column, y: Column) -> tuple[Column, Column]:
    """Packed (x, y) bytes; results outside the unit disk move to radius 0.99."""
    px, py = pack_axis(x), pack_axis(y)
    length = packed_length(px, py)
    outside = length > 1.0
    return (
        F.when(outside, pack_axis(unpack_axis(px) / length * 0.99)).otherwise(px),
        F.when(outside, pack_axis(unpack_axis(py) / length * 0.99)).otherwise(py),
    )


def blend_normals(base: dict[str, Column], detail: dict[str, Column]) -> dict[str, Column]:
    """Reoriented normal mapping of a detail vector onto a base vector."""
    t = {"x": base["x"], "y": base["y"], "z": base["z"] + 1.0}
    d = {"x": -detail["x"], "y": -detail["y"], "z": detail["z"]}
    dot = t["x"] * d["x"] + t["y"] * d["y"] + t["z"] * d["z"]
    pull = dot / F.greatest(t["z"], F.lit(1e-8))
    mixed = {k: t[k] * pull - d[k] for k in "xyz"}
    norm = F.greatest(F.sqrt(mixed["x"] ** 2 + mixed["y"] ** 2 + mixed["z"] ** 2), F.lit(1e-8))
    return {k: mixed[k] / norm for k in "xyz"}


def normal_shade(g: Column, a: Column, light: tuple[float, float, float]) -> Column:
    """0-255 shading of a packed normal under a light direction."""
    size = sum(v * v for v in light) ** 0.5
    if size == 0:
        raise ValueError("light direction is zero")
    n = decode_normal(g, a, inside_disk=False)
    length = F.greatest(F.lit(1e-6), F.sqrt(n["x"] ** 2 + n["y"] ** 2 + n["z"] ** 2))
    shade = sum((n[k] / length * (v / size) for k, v in zip("xyz", light)), F.lit(0.0))
    return clip(half_even((shade * 0.5 + 0.5) * 255.0), 0, 255)


def flatten_alpha(value: Column, alpha: Column, background: int) -> Column:
    """Channel composed over an opaque background."""
    mixed = (value * alpha + F.lit(background) * (255 - alpha)) / 255.0
    return half_up(F.round(mixed, 9))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def rgb_distance(r: Column, g: Column, b: Column, color: list[float]) -> Column:
    return F.sqrt((r - color[0]) ** 2 + (g - color[1]) ** 2 + (b - color[2]) ** 2)
