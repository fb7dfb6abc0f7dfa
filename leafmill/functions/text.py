"""Formatting and parsing functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display name and colour of the categories, and the grey of unknown ones.
DISPLAY = {
    "images": "图片",
    "fonts": "嵌入字体",
    "content": "内容流",
    "forms": "表单X对象",
    "metadata": "元数据",
    "other_streams": "其他流对象",
    "structure": "结构对象",
    "unused": "未使用对象",
}
COLOURS = {
    "images": "#ef4444",
    "fonts": "#f59e0b",
    "content": "#3b82f6",
    "forms": "#8b5cf6",
    "metadata": "#6b7280",
    "other_streams": "#ec4899",
    "structure": "#10b981",
    "unused": "#f97316",
}
GREY = "#6b7280"
MINUTE, SECOND = "分", "秒"

KB, MB, GB = 1024, 1024**2, 1024**3


def _fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.round(value, digits))


def size_text(n: Column) -> Column:
    """B, KB, MB or GB with one decimal."""
    return (
        F.when(n < KB, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < MB, F.concat(_fixed(n / KB, 1), F.lit(" KB")))
        .when(n < GB, F.concat(_fixed(n / MB, 1), F.lit(" MB")))
        .otherwise(F.concat(_fixed(n / GB, 1), F.lit(" GB")))
    )


def written_size_text(n: Column) -> Column:
    """KB with one decimal, MB with two, nothing larger."""
    return (
        F.when(n < KB, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < MB, F.concat(_fixed(n / KB, 1), F.lit(" KB")))
        .otherwise(F.concat(_fixed(n / MB, 2), F.lit(" MB")))
    )


def signed_size_text(n: Column) -> Column:
    """KB with one decimal, MB and GB with two, minus sign in front."""
    a = F.abs(n)
    text = (
        F.when(a < KB, F.concat(a.cast("string"), F.lit(" B")))
        .when(a < MB, F.concat(_fixed(a / KB, 1), F.lit(" KB")))
        .when(a < GB, F.concat(_fixed(a / MB, 2), F.lit(" MB")))
        .otherwise(F.concat(_fixed(a / GB, 2), F.lit(" GB")))
    )
    return F.concat(F.when(n < 0, F.lit("-")).otherwise(F.lit("")), text)


def percent(part: Column, total: Column) -> Column:
    """Percentage, 0 when there is no total."""
    return F.when(total == 0, F.lit(0.0)).otherwise(part * 100.0 / total)


def percent_text(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit("0%")).otherwise(F.concat(_fixed(percent(part, total), 1), F.lit("%")))


def compression_ratio(original: Column, small: Column) -> Column:
    """Percent saved; negative when it grew, 0 without an original."""
    return F.when(original == 0, F.lit(0.0)).otherwise((1 - small / original) * 100.0)


def duration_text(seconds: Column, padded: bool = True) -> Column:
    """Seconds alone below a minute, else minutes and seconds."""
    rest = (seconds % 60).cast("string")
    rest = F.lpad(rest, 2, "0") if padded else rest
    minutes = F.concat(F.floor(seconds / 60).cast("string"), F.lit(MINUTE), rest, F.lit(SECOND))
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit(SECOND))).otherwise(minutes)


def parse_size(text: Column) -> Column:
    """Leading number times its unit, which is the letter right behind it (k, m, g; else bytes), rounded; 0 without a number."""
    plain = F.trim(text)
    number = F.regexp_extract(plain, r"^([0-9.]*)", 1)
    unit = F.lower(F.substring(plain, F.length(number) + 1, F.lit(1)))
    factor = F.when(unit == "k", KB).when(unit == "m", MB).when(unit == "g", GB).otherwise(1)
    return F.coalesce(F.round(number.try_cast("double") * factor).cast("long"), F.lit(0).cast("long"))


def image_format(path: Column) -> Column:
    """Format by extension (jpeg, png, webp), null for all others."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("jpg", "jpeg"), F.lit("jpeg")).when(ext.isin("png", "webp"), ext)


def trailing_number(path: Column) -> Column:
    """Number behind the last hyphen of the file name, or the whole name if it is one; else null."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return F.regexp_extract(F.substring_index(stem, "-", -1), r"^([0-9]+)$", 1).try_cast("long")


def object_id(text: Column) -> tuple[Column, Column]:
    """Number and generation of ``3 0 R``, ``3 0`` or ``obj:3 0 R``; nulls if out of range or anything else."""
    pattern = r"^(?:obj:)?([0-9]{1,10}) ([0-9]{1,5})(?: R)?$"
    number, gen = (F.regexp_extract(text, pattern, k).try_cast("long") for k in (1, 2))
    ok = (number <= 4294967295) & (gen <= 65535)
    return F.when(ok, number), F.when(ok, gen.cast("int"))


def output_path(path: Column, suffix: str) -> Column:
    """``x.pdf`` becomes ``x_<suffix>.pdf``."""
    return F.regexp_replace(path, r"(?i)\.pdf$", f"_{suffix}.pdf")


def operator_text(operands: Column, operator: Column) -> Column:
    return F.concat_ws(" ", operands, operator)


def display_name(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in DISPLAY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, category), category)


def colour(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, category), F.lit(GREY))


def page_list(pages: Column, shown: int = 6) -> Column:
    """The first pages, and how many there are if some are left out."""
    first = F.concat_ws(", ", F.transform(F.slice(pages, 1, shown), lambda p: p.cast("string")))
    return F.when(F.size(pages) > shown, F.concat(first, F.lit(" … ("), F.size(pages).cast("string"), F.lit(")"))).otherwise(first)


def clamped_page(page: Column, last: Column) -> Column:
    """Null below 1, else at most the largest page."""
    return F.when(page >= 1, F.least(page, last))
