"""Feature blocks by modality, nested values with defaults, and hashed single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from windlass.sources.files import block_names

# Block names and their beginnings, by modality and by ablation group.
MODALITIES = {
    "video": ("video_",),
    "motion_capture": ("hand_", "body_"),
    "pose_slam": ("camera_", "slam_point_cloud", "calibration"),
    "depth": ("depth_",),
    "inertial": ("imu_",),
    "audio": ("audio_",),
    "language": ("caption_",),
}
GROUPS = {
    "video": ["video_"],
    "depth": ["depth_confidence"],
    "pose_slam": ["camera_translation", "camera_rotation_matrix", "slam_point_cloud", "calibration"],
    "motion_capture": ["hand_left_joints", "hand_right_joints", "body_joints", "body_contacts"],
    "inertial": ["imu_accel_gyro"],
    "audio": ["audio_"],
    "language": ["caption_objects_interaction_text"],
}


def modality(block: Column) -> Column:
    """The modality of a block by its name: a name that ends in "_" above stands for all that begin
    with it, others for themselves; "other" if none fits."""
    found = None
    for name, starts in MODALITIES.items():
        hit = F.lit(False)
        for s in starts:
            hit = hit | (block.startswith(s) if s.endswith("_") else block == s)
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found.otherwise("other")


def group_blocks(names: list[str]) -> dict[str, list[str]]:
    """The blocks of each ablation group that has one: all, each modality, all but language."""
    made = {"all_features": list(names), **{g: block_names(names, xs) for g, xs in GROUPS.items()}, "no_language": block_names(names, exclude=GROUPS["language"])}
    return {g: xs for g, xs in made.items() if xs}


def in_group(block: Column, group: str) -> Column:
    """Whether a block belongs to an ablation group, as an expression."""
    starts = lambda xs: F.lit(False) if not xs else F.array_contains(F.transform(F.array(*map(F.lit, xs)), lambda x: F.startswith(block, x)), True)
    if group == "all_features":
        return F.lit(True)
    return ~starts(GROUPS["language"]) if group == "no_language" else starts(GROUPS[group])


def nested(row: Column, path: str, default: object) -> Column:
    """A field of a JSON text by its path, or a default where any part of the path is missing."""
    return F.coalesce(F.get_json_object(row, path), F.lit(str(default)))


def first_present(row: Column, paths: list[str]) -> Column:
    """The first of alternative fields of a JSON text that is there and not blank."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(row, p)), F.lit("")) for p in paths])


def display_name(key: Column, names: dict[str, str]) -> Column:
    """A name for showing, or else the key with blanks for underscores."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.replace(key, F.lit("_"), F.lit(" ")))


def place_of(text: Column, dims: int) -> Column:
    """A stable place in [0, dims) from the first 32 bits of a hash."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % dims


def hashed_one_hot(value: Column, dims: int, namespace: str) -> Column:
    """A vector of zeros with one 1 or -1: place and sign by hashes of their own."""
    said = F.concat(F.lit(f"{namespace}:"), value)
    sign = F.when(place_of(F.concat(F.lit("sign:"), said), 2) == 0, 1.0).otherwise(-1.0)
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long")), lambda k: F.when(k == place_of(said, dims), sign).otherwise(0.0))


def signed_bag(text: Column, dims: int, namespace: str) -> Column:
    """Hashed bag of words of a whole text as one array expression: tokens are runs of letters and
    digits, lower-cased; place and sign have hashes of their own. Not normalised."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"), F.lit(1))
    said = F.transform(words, lambda w: F.concat(F.lit(f"{namespace}:"), w))
    coded = F.transform(said, lambda w: F.struct(place_of(w, dims).alias("p"), F.when(place_of(F.concat(F.lit("sign:"), w), 2) == 0, 1.0).otherwise(-1.0).alias("s")))
    return add_up(coded, dims)


def add_up(coded: Column, dims: int) -> Column:
    """The sums of an array of (p, s) by place; one pass for each place, no shuffle."""
    one = F.transform(F.array(coded), lambda held: F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long")),
        lambda k: F.aggregate(held, F.lit(0.0), lambda a, c: a + F.when(c["p"] == k, c["s"]).otherwise(0.0)),
    ))
    return one[0]
