"""Plans made on the driver: which columns form a vector, and which expressions transform it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions import rotations, vectors

# Limits of rotated absolute vectors by kind.
ROTATED_LIMITS = {"six": 1.0, "quat": 1.0, "wxyz": 1.0, "matrix": 1.0, "euler": 3.141592653589793, "rotvec": 3.141592653589793}
ROTATED_WIDTH = {"six": 6, "quat": 4, "wxyz": 4, "matrix": 9, "euler": 3, "rotvec": 3}


def type_tag(tag: str) -> tuple[str, str]:
    """``abs_quat`` -> (abs, quat)."""
    motion, _, form = tag.partition("_")
    if motion not in ("abs", "delta", "rel") or not form:
        raise ValueError(f"not a type tag: {tag}")
    return motion, form


def eef_parts(parts: dict[str, str]) -> dict[str, tuple[list[str], str]]:
    """Per side the pieces of its end effector in the order given; the type of the last piece counts.

    ``parts``: column key, such as ``left_eef`` or ``left_eef.rot``, -> type tag.
    """
    out: dict[str, tuple[list[str], str]] = {}
    for key, tag in parts.items():
        side = key.split(".")[0]
        if side in ("left_eef", "right_eef"):
            out[side] = [*out.get(side, ([], ""))[0], key], tag
    return out


def effector(available: set[str], side: str) -> str | None:
    """What closes a hand: the hand is preferred over the gripper."""
    return next((f"{side}_{kind}" for kind in ("hand", "gripper") if f"{side}_{kind}" in available), None)


def first_side(available: set[str], kind: str, order: tuple[str, ...] = ("right", "left")) -> str | None:
    """The first arm that has data of a kind; the others are fall-backs."""
    return next((s for s in order if f"{s}_{kind}" in available), None)


def pose_vector(position: Column, rotation: Column, kind: str, gripper: Column | None) -> Column:
    """Eight elements: position, quaternion, gripper (0 if there is none)."""
    return F.concat(position, rotations.decode(rotation, kind), F.array(gripper if gripper is not None else F.lit(0.0)))


def joint_vector(joints: Column, gripper: Column | None, indices: list[int] | None = None) -> Column:
    """Joints and gripper; without indices the last joint column is the gripper already."""
    if indices is None and gripper is None:
        return joints
    chosen = vectors.gather(joints, indices) if indices is not None else joints
    return F.concat(chosen, F.array(gripper if gripper is not None else F.lit(0.0)))


def reposed(target: str, source: str, state: Column, action: Column, first: Column) -> Column:
    """Seven-element poses between ``abs``, ``delta`` and ``rel``."""
    absolute = rotations.pose_from_delta(state, action) if source == "delta" else action
    if target == "abs":
        return absolute
    return rotations.pose_delta(state, absolute) if target == "delta" else rotations.pose_relative(first, absolute)


def rejointed(target: str, source: str, state: Column, action: Column, first: Column) -> Column:
    """Joints between ``abs``, ``delta`` (to the present state) and ``rel`` (to the first)."""
    absolute = vectors.plus(state, action) if source == "delta" else action
    return absolute if target == "abs" else vectors.minus(absolute, state if target == "delta" else first)


@dataclass(frozen=True)
class KeySpec:
    """How one key is transformed: rotated from ``form`` to ``to``, then normalised by ``mode``."""

    mode: str
    form: str | None = None
    to: str | None = None
    absolute: bool = True
    continuous: bool = True


def transform_key(spec: KeySpec, v: Column, stats: dict[str, Column]) -> Column:
    """The expression of a key. Rotated absolute keys have fixed limits, rotated relative keys can't be normalised."""
    if not spec.continuous and spec.mode != "binary":
        raise ValueError("keys that aren't continuous must be binary")
    if spec.to and spec.form != spec.to:
        if not spec.absolute:
            raise ValueError("relative keys can't be rotated and normalised")
        v = rotations.encode(rotations.decode(v, spec.form), spec.to)
        limit, width = ROTATED_LIMITS[spec.to], ROTATED_WIDTH[spec.to]
        stats = {"min": F.array_repeat(F.lit(-limit), width), "max": F.array_repeat(F.lit(limit), width)}
        return vectors.normalize(v, "min_max", stats)
    return vectors.normalize(v, spec.mode, stats)


def joined(values: dict[str, Column], order: list[str]) -> Column:
    """Vectors end to end in a given order, which must name them all."""
    if set(values) != set(order):
        raise ValueError(f"order names {sorted(order)}, values are {sorted(values)}")
    return F.concat(*[values[k] for k in order])


def taken_apart(v: Column, widths: dict[str, int]) -> dict[str, Column]:
    """The inverse of ``joined``."""
    out, at = {}, 0
    for key, width in widths.items():
        out[key] = vectors.part(v, at, at + width)
        at += width
    return out


def export_order(keys: list[str], single: bool) -> list[str]:
    """Keys of exported statistics: of a single dataset with grippers last, of a mixture as configured."""
    return sorted(keys, key=lambda k: "gripper" in k) if single else list(keys)


def export_mask(keys: list[str], widths: dict[str, int]) -> list[bool]:
    """False for grippers, which aren't normalised."""
    return ["gripper" not in k for k in keys for _ in range(widths[k])]


def dimension_names(names: list[str] | dict[str, list[str]] | None, width: int) -> list[str]:
    flat = [x for part in names.values() for x in part] if isinstance(names, dict) else list(names or [])
    return flat if len(flat) == width else [f"dim_{k}" for k in range(width)]


def vector_fields(features: dict[str, dict], skip: tuple[str, ...] = ("timestamp", "frame_index", "episode_index", "index", "task_index")) -> dict[str, list[str]]:
    """State and action columns among a dataset's features."""
    usable = [k for k, f in features.items() if k not in skip and f.get("dtype") != "video"]
    return {"state": [k for k in usable if k.startswith(("observation.state", "state"))], "action": [k for k in usable if k.startswith("action")]}


def video_keys(features: dict[str, dict], order: list[str] | None = None) -> list[str]:
    """Views in an explicit order and then the unknown ones; without an order by name."""
    found = [k.removeprefix("observation.images.") for k, f in features.items() if f.get("dtype") == "video" and k.startswith("observation.images.")]
    return sorted(found) if order is None else [v for v in order if v in found] + [v for v in found if v not in order]


def repaired_modality(own: dict, parent: dict, features: dict[str, dict]) -> dict:
    """A modality document made complete: missing parts from the parent, videos from the features as ``image_0``, ``image_1``."""
    if {"state", "action", "video"} <= set(own):
        return own
    video = {f"image_{n}": {"original_key": f"observation.images.{k}"} for n, k in enumerate(video_keys(features))}
    return {**{k: v for k, v in parent.items() if k != "video"}, **own, "video": own.get("video") or video}


def cluster_count(total: int, divisor: int) -> int:
    return max(2, total // divisor)
