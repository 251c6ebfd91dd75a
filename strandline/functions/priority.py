"""Priorities, sizes and classes of files and tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Category, lowest and highest priority, weight, description.
CATEGORIES = [
    ("Critical", -128, -1, 1, "Must download before game can start"),
    ("Essential", 0, 0, 2, "Required for basic gameplay"),
    ("High", 1, 2, 3, "Important for full experience"),
    ("Normal", 3, 5, 4, "Standard game content"),
    ("Low", 6, 127, 5, "Optional or deferrable content"),
]

# Tag type, number in files, download weight, download description.
TAG_TYPES = [
    ("Platform", 0x0001, 1, "Platform compatibility files"),
    ("Architecture", 0x0002, 2, "Architecture-specific binaries"),
    ("Locale", 0x0003, 5, "Language and localization files"),
    ("Category", 0x0004, 4, "Core game content categories"),
    ("Unknown", 0x0005, 4, "Unknown category content"),
    ("Component", 0x0010, 3, "Essential game components"),
    ("Version", 0x0020, 8, "Version-specific content"),
    ("Optimization", 0x0040, 12, "Performance optimizations"),
    ("Region", 0x0080, 6, "Regional customizations"),
    ("Device", 0x0100, 9, "Device-specific optimizations"),
    ("Mode", 0x0200, 10, "Game mode content"),
    ("Branch", 0x0400, 11, "Development branch content"),
    ("Content", 0x0800, 13, "General game content"),
    ("Feature", 0x1000, 7, "Feature-specific content"),
    ("Expansion", 0x2000, 14, "Expansion pack content"),
    ("Alternate", 0x4000, 15, "Alternative content versions"),
    ("Option", 0x8000, 16, "Optional features and content"),
]

# Which tag types a class holds (FLT-22..26, 49..51).
TAG_CLASSES = {
    "platform_specific": ("Platform", "Architecture", "Device"),
    "optional": ("Option", "Alternate", "Expansion", "Content"),
    "required": ("Platform", "Architecture", "Component", "Category"),
    "streamable": ("Content", "Feature", "Expansion", "Option", "Alternate"),
    "locale_specific": ("Locale", "Region"),
    "affects_streaming": ("Platform", "Architecture", "Locale", "Feature", "Component", "Region"),
    "essential_for_download": ("Platform", "Architecture", "Component", "Category"),
    "feature_content": ("Feature", "Content", "Expansion"),
}

# FLT-52.
PLATFORM_NAMES = ["Windows", "Mac", "Linux"]
ARCHITECTURE_NAMES = ["x86", "x86_64", "arm64"]
LOCALE_NAMES = ["enUS", "enGB", "deDE", "frFR", "esES", "zhCN", "koKR", "jaJP"]


def clamp8(x: Column) -> Column:
    """Into the range of a signed byte."""
    return F.greatest(F.lit(-128), F.least(F.lit(127), x.cast("int")))


def effective(priority: Column, base: Column | int = 0, version: Column | int = 3) -> Column:
    """PRJ-01: version 3 subtracts the base priority and saturates; earlier ones leave it."""
    v = version if isinstance(version, Column) else F.lit(version)
    b = base if isinstance(base, Column) else F.lit(base)
    return F.when(v >= 3, clamp8(priority.cast("int") - b)).otherwise(priority.cast("int"))


def category(eff: Column) -> Column:
    """PRJ-02: category of an effective priority."""
    out = F.lit(CATEGORIES[-1][0])
    for name, _, high, _, _ in reversed(CATEGORIES[:-1]):
        out = F.when(eff <= high, F.lit(name)).otherwise(out)
    return F.when(eff.isNotNull(), out)


def category_table(spark: SparkSession) -> DataFrame:
    """PRJ-03, 04, 05: the categories with bounds, weight and description."""
    return spark.createDataFrame(CATEGORIES, "category string, low int, high int, weight int, description string")


def tag_type_table(spark: SparkSession) -> DataFrame:
    """PRJ-26, 27: the tag types with number, weight and description, and a flag for each class."""
    df = spark.createDataFrame(TAG_TYPES, "tag_type string, code int, weight int, description string")
    return df.select("*", *[F.col("tag_type").isin(*v).alias(k) for k, v in TAG_CLASSES.items()])


def category_weight(cat: Column) -> Column:
    return reduce(lambda acc, c: F.when(cat == c[0], F.lit(c[3])).otherwise(acc), CATEGORIES, F.lit(None).cast("int"))


def rank(eff: Column) -> Column:
    """PRJ-06: 0 to 255."""
    return eff + 128


def is_high(eff: Column) -> Column:
    """FLT-20."""
    return eff <= 1


def is_essential(eff: Column) -> Column:
    """FLT-18."""
    return eff <= 0


def is_critical(eff: Column) -> Column:
    """FLT-19."""
    return eff < 0


def in_class(tag_type: Column, name: str) -> Column:
    """FLT-22..26 and 49..51: is a tag type of a class?"""
    return F.coalesce(tag_type.isin(*TAG_CLASSES[name]), F.lit(False))


def tag_matches_platform(tag_type: Column, name: Column, platform: str, architecture: str) -> Column:
    """FLT-27: tags of other types pass."""
    return F.when(tag_type == "Platform", name == platform).when(tag_type == "Architecture", name == architecture).otherwise(F.lit(True))


def tag_matches_locale(tag_type: Column, name: Column, locale: str, region: str | None = None) -> Column:
    """FLT-28: without a region, region tags pass."""
    hit = F.when(tag_type == "Locale", name == locale)
    if region is not None:
        hit = hit.when(tag_type == "Region", name == region)
    return hit.otherwise(F.lit(True))


def is_large(size: Column) -> Column:
    """FLT-21: more than 32 bits."""
    return size > 4_294_967_295


def is_significant(part_files: Column, files: Column, part_bytes: Column, total: Column) -> Column:
    """FLT-47: more than one hundredth of files or bytes."""
    return (part_files * 100 > files) | (part_bytes * 100 > total)


def serialized_size(has_checksum: Column, flag_size: Column) -> Column:
    """PRJ-07: bytes of a download entry."""
    return F.lit(22) + F.when(has_checksum, 4).otherwise(0) + flag_size


def human_size(size: Column) -> Column:
    """SCL-16: steps of 1024 up to TB; one decimal unless whole."""
    x = size.cast("double")
    out = None
    for i, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        v = x / float(1024**i)
        text = F.concat(F.when(v == F.floor(v), F.format_string("%.0f", v)).otherwise(F.format_string("%.1f", F.bround(v, 1))), F.lit(f" {unit}"))
        step = (v < 1024) if i < 4 else F.lit(True)
        out = F.when(step, text) if out is None else out.when(step, text)
    return F.when(size.isNotNull(), out)


def pack_offset(archive: Column, offset: Column) -> Column:
    """PRJ-17: archive number above a 32-bit offset."""
    return F.shiftleft(archive.cast("long"), 32).bitwiseOR(offset.cast("long"))


def unpack_offset(packed: Column) -> Column:
    """PRJ-18."""
    return F.struct(F.shiftright(packed, 32).cast("int").alias("archive"), packed.bitwiseAND(0xFFFFFFFF).alias("offset"))


def platform_config(platform: Column, mac: Column, windows: Column) -> Column:
    """PRJ-16: sub-configuration by alias; null for other names."""
    p = F.lower(platform)
    return F.when(p.isin("mac", "macos", "osx"), mac).when(p.isin("win", "windows"), windows)


def root_block_size(n: Column, version: int, named: Column) -> Column:
    """PRJ-32: bytes of a root block of ``n`` records."""
    if version == 1:
        return F.lit(12) + n * 28
    return F.lit({2: 17, 3: 17, 4: 18}[version]) + n * 20 + F.when(named, n * 8).otherwise(0)
