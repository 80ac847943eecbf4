"""Identities carried by file names and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of panorama files, and prefixes of keys in annotation trees.
PANO_FILE = r"^floor_(\d+)_partial_room_(\d+)_pano_(\d+)\.jpg"
KEY_PREFIXES = {"floor": "floor_", "room": "room_", "complete": "complete_room_", "partial": "partial_room_", "pano": "pano_"}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The base name without its last suffix."""
    return F.regexp_replace(basename(path), r"\.[^.]+$", "")


def pano_ids(file: Column) -> list[Column]:
    """floor_id, room_id and pano_id of a panorama's file name, null where it is none; ids keep leading zeros."""
    good = file.rlike(PANO_FILE)
    return [F.when(good, F.regexp_extract(file, PANO_FILE, k)).alias(n) for k, n in enumerate(("floor_id", "room_id", "pano_id"), 1)]


def room_of(file: Column) -> Column:
    """The room number wherever `room_<digits>` stands, floors merged; null where it does not."""
    return F.nullif(F.regexp_extract(file, r"room_(\d+)", 1), F.lit(""))


def after_token(name: Column, token: str) -> Column:
    """The part that follows `token` among the parts between underscores, null without one."""
    parts = F.split(name, "_")
    at = F.array_position(parts, token)
    return F.when((at > 0) & (at < F.size(parts)), F.try_element_at(parts, (at + 1).cast("int")))


def key_suffix(key: Column, default: str = "00") -> Column:
    """`complete_room_07` -> `07`; a key without an underscore gives `default`."""
    return F.when(F.contains(key, F.lit("_")), F.element_at(F.split(key, "_"), -1)).otherwise(F.lit(default))


def is_scene(name: Column, digits: int | None = None) -> Column:
    """All-digit directory names, or those of exactly so many digits."""
    return name.rlike("^[0-9]+$" if digits is None else f"^[0-9]{{{digits}}}$")


def scene_name(number: Column) -> Column:
    return F.format_string("scene_%05d", number)


def split_of(number: Column, bounds: tuple[tuple[int, str], ...] = ((3000, "train"), (3250, "valid")), rest: str = "test") -> Column:
    """Which split a numbered scene falls in: the first bound above the number."""
    out = F.when(number < bounds[0][0], bounds[0][1])
    for bound, name in bounds[1:]:
        out = out.when(number < bound, name)
    return out.otherwise(rest)
