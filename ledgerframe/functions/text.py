"""Column functions that normalise names, paths and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The name prefixes a subtype drops, and what an empty one becomes; the patterns of the functions below.
SUBTYPE_PREFIXES = ("non_batik_", "nonbatik_", "batik_", "flanel_", "kain_")
UNKNOWN_SUBTYPE = "tidak_diketahui"
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp")


def class_name(c: Column) -> Column:
    """Trimmed lower case, blanks and dashes as single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_"), "_+", "_")


def checked_class(c: Column, known: tuple[str, ...]) -> Column:
    """class_name, or an error for a class that isn't known."""
    name = class_name(c)
    return F.when(name.isin(*known), name).otherwise(F.raise_error(F.concat(F.lit("unknown class: "), name)))


def subtype(stem: Column) -> Column:
    """A file's stem without a copy number, final digits and its class prefix."""
    s = F.regexp_replace(F.lower(stem), r"\s*\(\d+\)\s*$", "")
    s = F.regexp_replace(s, r"[0-9]+$", "")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    cut = s
    for p in reversed(SUBTYPE_PREFIXES):
        cut = F.when(s.startswith(p), F.substring(s, len(p) + 1, 1 << 20)).otherwise(cut)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(UNKNOWN_SUBTYPE))


def stable_id(c: Column) -> Column:
    """The first 12 hex digits of the text's SHA-1."""
    return F.substring(F.sha1(c.cast("binary")), 1, 12)


def safe_stem(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("image"))


def slug(c: Column) -> Column:
    return F.translate(F.lower(c), " ()", "_")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def is_image(path: Column) -> Column:
    return suffix(path).isin(*IMAGE_SUFFIXES)


def derived_name(stem: Column, item_id: Column, index: Column, extension: Column) -> Column:
    return F.concat(F.concat_ws("__", stem, item_id, F.concat(F.lit("transform_"), F.lpad(index.cast("string"), 4, "0"))), extension)


def parent_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def strict_bool(c: Column) -> Column:
    """true or false in any case; anything else is an error."""
    s = F.lower(F.trim(c))
    return F.when(s == "true", F.lit(True)).when(s == "false", F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(c, F.lit("null")))).cast("boolean"))


def lenient_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes", "y"), F.lit(False))


def sentences(c: Column) -> Column:
    """Text split after . ; or : before a capital or a bracket."""
    return F.split(c, r"(?<=[.;:]) (?=[A-Z(])")


def significant(c: Column, digits: int = 15) -> Column:
    """A double's shortest text after rounding to so many significant digits."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits - 1}e", c).try_cast("double").cast("string"))


def mapped(c: Column, names: dict, what: str = "value") -> Column:
    """What names gives for c, as for labels of classes, classes of labels and aliases of models; an error for a value it lacks, null for null."""
    pairs = F.create_map(*(F.lit(v) for pair in names.items() for v in pair))
    return F.when(c.isNull(), None).otherwise(F.coalesce(F.try_element_at(pairs, c), F.raise_error(F.concat(F.lit(f"unknown {what}: "), c.cast("string")))))


def condition_key(*parts: Column, between: str = "+") -> Column:
    return F.concat_ws(between, *parts)


def condition_parts(c: Column, between: str = "+") -> Column:
    return F.split(c, "\\" + between if len(between) == 1 else between)


def map_cell(pairs: Column, key: str, value: str) -> Column:
    """A JSON object of an array of structs of a key and a value, both numbers, in order of the keys."""
    shown = F.transform(F.sort_array(pairs), lambda p: F.concat(F.lit('"'), p[key].cast("string"), F.lit('":'), p[value].cast("string")))
    return F.concat(F.lit("{"), F.array_join(shown, ","), F.lit("}"))


def map_sums(cell: Column) -> tuple[Column, Column]:
    """Of such an object the sum of its values and that of keys times values."""
    pairs = F.map_entries(F.from_json(cell, "map<string,bigint>"))
    add = lambda f: F.aggregate(pairs, F.lit(0).cast("long"), lambda a, p: a + f(p))
    return add(lambda p: p["value"]), add(lambda p: p["key"].cast("long") * p["value"])
