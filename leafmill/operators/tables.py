"""Relational operators over object tables: rollups, duplicates, reachability, lookups, scans, filters.

All are compositions of built-in operators.  Keys are lists of column names, so the same operator works
on one file (``obj_num, gen``) and on a corpus (``path, obj_num, gen``).
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import image_format, trailing_number
from leafmill.plans.lineage import stored

# --- aggregation


def category_rollup(rows: DataFrame, category: Column, size: Column, categories: list[str], by: list[str] | None = None) -> DataFrame:
    """Count and size of each of the fixed categories, in their order, zero where there is nothing.

    One partial aggregation and one shuffle; the categories are a literal table of fixed size.
    """
    by = by or []
    sums = rows.groupBy(*by, category.alias("category")).agg(F.count("*").alias("n"), F.sum(size).alias("size"))
    fixed = F.explode(F.array(*[F.struct(F.lit(k).alias("position"), F.lit(c).alias("category")) for k, c in enumerate(categories)])).alias("c")
    frame = (rows.select(*by).distinct() if by else rows.sparkSession.range(1)).select(*by, fixed).select(*by, "c.position", "c.category")
    joined = frame.join(sums, [*by, "category"], "left")
    return joined.select(*by, "position", "category", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("size", F.lit(0)).alias("size"))


def share_of_total(rows: DataFrame, size: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``share``: the row's part of the sum of its group; 0 when that sum is 0.

    The sums are aggregated and joined back, so neither the whole table nor a large group meets in one task.
    """
    sums = rows.groupBy(*(by or [])).agg(F.sum(size).alias("_total"))
    if by:
        keys = [F.col(k).alias(f"_{n}") for n, k in enumerate(by)]
        sums = sums.select(*keys, "_total")
        joined = rows.join(sums, [rows[k].eqNullSafe(sums[f"_{n}"]) for n, k in enumerate(by)])
    else:
        joined = rows.withColumn("_total", sums.scalar())
    share = F.when(F.col("_total") == 0, F.lit(0.0)).otherwise(F.col(size) / F.col("_total"))
    return joined.withColumn("share", share).select(*rows.columns, "share")


def shown_segments(rows: DataFrame, share: str = "share", least: float = 0.001) -> DataFrame:
    """Segments that are wide enough to be seen."""
    return rows.filter(F.col(share) >= least)


def duplicate_groups(rows: DataFrame, bucket: list[str], fingerprint: Column, size: str, member: str) -> DataFrame:
    """Groups of at least two rows with one bucket and fingerprint: members, total and savings.

    The bucket (width and height, say) is part of the grouping key, so the cheap prefilter on it
    needs no pass of its own.
    """
    groups = rows.groupBy(*bucket, fingerprint.alias("fingerprint")).agg(
        F.count("*").alias("members"), F.sum(size).alias("total_size"), (F.sum(size) - F.min(size)).alias("savings"), F.min(member).alias("first_member")
    )
    return groups.filter("members > 1")


def duplicate_members(rows: DataFrame, keys: list[str], fingerprint: Column, size: str, member: str) -> DataFrame:
    """As :func:`duplicate_groups`, with the members themselves by size descending."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col(size)).alias("minus"), F.col(member).alias("id"), F.col(size).alias("size"))))
    groups = rows.groupBy(*keys, fingerprint.alias("fingerprint")).agg(F.sum(size).alias("total_size"), (F.sum(size) - F.min(size)).alias("savings"), listed.alias("m"))
    return groups.filter(F.size("m") > 1).withColumn("members", F.transform("m", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size")))).drop("m")


def reused(rows: DataFrame, key: list[str], place: str, grouped: DataFrame) -> DataFrame:
    """Keys that occur more than once outside ``grouped``: occurrences and distinct places."""
    counted = rows.groupBy(*key).agg(F.count("*").alias("occurrences"), F.count_distinct(place).alias("places"))
    return counted.filter("occurrences > 1").join(grouped, key, "left_anti")


# --- graph

MERGE_LEVELS = 16


def reachable(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", limit: int = 10_000) -> DataFrame:
    """Distinct nodes reachable from ``roots`` (column ``node``), roots included, through cycles too.

    A frontier loop: one equi-join and one anti-join per level.  Only the new level is stored; what was
    visited is the union of the stored levels, merged into one table every ``MERGE_LEVELS`` levels.
    """
    levels = [stored(roots.select("node").distinct())]
    for _ in range(limit):
        visited = reduce(DataFrame.unionByName, levels)
        step = edges.join(levels[-1], edges[src] == levels[-1]["node"]).select(F.col(dst).alias("node")).distinct()
        frontier = stored(step.join(visited, "node", "left_anti"))
        if frontier.limit(1).count() == 0:
            return visited
        if len(levels) == MERGE_LEVELS:
            levels = [stored(visited)]
        levels.append(frontier)
    raise RuntimeError("the graph is deeper than the limit")


def unreachable(objects: DataFrame, visited: DataFrame, node: str = "node") -> DataFrame:
    return objects.join(visited.withColumnRenamed("node", node), node, "left_anti")


# --- lookups


def nearest_value(rows: DataFrame, parents: DataFrame, key: str, parent: str, value: str, depth: int = 64) -> DataFrame:
    """``value`` of each row, or of its nearest ancestor that has one; a walk that meets a node again stops.

    ``parents`` has key, parent and value.  One join per level, on the rows still without a value.
    """
    up = parents.select(F.col(key).alias("_key"), F.col(parent).alias("_next"), F.col(value).alias("_value"))
    state = rows.select(F.col(key).alias("_row"), F.col(key).alias("_at"), F.array(F.col(key)).alias("_seen"), F.lit(None).cast(parents.schema[value].dataType).alias("found"))
    done = None
    for level in range(depth):
        step = state.join(up, state["_at"] == up["_key"], "left")
        state = stored(step.select("_row", F.col("_next").alias("_at"), F.concat("_seen", F.array("_next")).alias("_seen"), F.col("_value").alias("found"), F.array_contains("_seen", F.col("_next")).alias("again")))
        ended = state.filter("found is not null or _at is null or again").select("_row", "found")
        done = ended if done is None else done.unionByName(ended)
        state = state.filter("found is null and _at is not null and not again").drop("again")
        if state.limit(1).count() == 0:
            break
    return done.withColumnRenamed("_row", key).withColumnRenamed("found", value)


def with_parts(owners: DataFrame, links: DataFrame, parts: DataFrame, owner: str, part: str, size: Column) -> DataFrame:
    """Owner, whether it has any link, and the summed size of the parts it links to (0 without)."""
    sums = links.join(parts, part, "left").groupBy(owner).agg(F.sum(F.coalesce(size, F.lit(0))).alias("size"))
    return owners.select(owner).join(sums.withColumn("linked", F.lit(True)), owner, "left").select(owner, F.coalesce("linked", F.lit(False)).alias("embedded"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))


# --- ordered scans


def stack_depth(tokens: Column, opens: str, closes: str) -> Column:
    """Struct of the deepest and the last depth over an array of markers; closing an empty stack is ignored."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest"))

    def step(acc: Column, t: Column) -> Column:
        depth = F.when(t == opens, acc["depth"] + 1).when(t == closes, F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        return F.struct(depth.alias("depth"), F.greatest(acc["deepest"], depth).alias("deepest"))

    return F.aggregate(tokens, start, step)


def running_sum(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(value).over(w))


def last_operators(rows: DataFrame, by: list[str], order: list[str], op: str, n: int = 10, name: str = "ops") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - n, 0)
    return rows.withColumn(name, F.collect_list(op).over(w))


def carry_forward(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def first_per_key(rows: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


# --- filters and paging


@dataclass(frozen=True)
class Bounds:
    """Numeric bounds of a list filter; 0 means not set."""

    min_width: float = 0
    max_width: float = 0
    min_height: float = 0
    max_height: float = 0
    min_size_kb: float = 0
    max_size_kb: float = 0
    min_pixels: float = 0
    max_pixels: float = 0
    min_compressed_kb: float = 0
    max_compressed_kb: float = 0
    min_saving_kb: float = 0
    max_saving_kb: float = 0


def list_filter(columns: dict[str, Column], bounds: Bounds, page: int | None = None, compressed: str = "all", formats: list[str] | None = None) -> Column:
    """Condition of the image list filter.

    ``columns``: width, height, size, pixels, compressed (null without a preview), page, format.  A set
    bound on compressed values fails rows without a preview; no page and no formats mean all.
    """
    size_kb, small_kb = columns["size"] / 1024, columns["compressed"] / 1024
    measures = {"width": columns["width"], "height": columns["height"], "size_kb": size_kb, "pixels": columns["pixels"], "compressed_kb": small_kb, "saving_kb": size_kb - small_kb}
    out = F.lit(True)
    for f in fields(bounds):
        bound = getattr(bounds, f.name)
        if bound:
            side, name = f.name.split("_", 1)
            value = measures[name]
            out = out & F.coalesce(value >= bound if side == "min" else value <= bound, F.lit(False))
    if page is not None:
        out = out & (columns["page"] == page)
    if compressed != "all":
        out = out & (columns["compressed"].isNotNull() if compressed == "compressed" else columns["compressed"].isNull())
    if formats:
        out = out & columns["format"].isin(formats)
    return out


def page_bounds(n: int, size: int, page: int) -> tuple[int, int]:
    """The page that is shown (clamped to what exists, at least one) and its offset."""
    last = max(1, -(-n // size))
    shown = min(max(page, 1), last)
    return shown, (shown - 1) * size


def page_slice(rows: DataFrame, order: list[Column], size: int, page: int) -> DataFrame:
    """One page of the ordered rows; the page number is clamped."""
    _, offset = page_bounds(rows.count(), size, page)
    return rows.orderBy(*order).offset(offset).limit(size)


def in_sizes(width: str, height: str, sizes: list[tuple[int, int]]) -> Column:
    """Membership in a list of target sizes; sizes that are not positive are left out."""
    usable = [(w, h) for w, h in sizes if w > 0 and h > 0]
    return F.struct(F.col(width).cast("int").alias("w"), F.col(height).cast("int").alias("h")).isin([F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in usable]) if usable else F.lit(False)


def preview_totals(rows: DataFrame, by: list[str], original: Column, small: Column) -> DataFrame:
    """Sums of original and compressed sizes and of the savings (never negative), and their percentage (0 to 100)."""
    saving = F.sum(F.greatest(original - small, F.lit(0)))
    sums = rows.groupBy(*by).agg(F.sum(original).alias("original"), F.sum(small).alias("compressed"), saving.alias("savings"))
    percent = F.when(F.col("original") > 0, F.least(F.col("savings") * 100.0 / F.col("original"), F.lit(100.0))).otherwise(F.lit(0.0))
    return sums.withColumn("percent", percent)


def replace_if_smaller(old: Column, new: Column, forced: Column) -> Column:
    return forced | (new < old)


def effective_size(pdf_size: Column, file_size: Column) -> Column:
    """The size in the file if it is known, 0 included."""
    return F.coalesce(pdf_size, file_size)


def by_page_and_name(rows: DataFrame, page: str, member: str, name: str = "position", by: list[str] | None = None) -> DataFrame:
    """Adds the place in the list by page and then by id as text."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [])).orderBy(page, F.col(member).cast("string"))))


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """Adds the place of every row in its group's order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def distinct_pages(rows: DataFrame, by: list[str], page: str, form: str, order: str) -> DataFrame:
    """Pages in ascending order, and formats in the order in which they are first seen."""
    firsts = rows.groupBy(*by, form).agg(F.min(order).alias("_at"), F.collect_set(page).alias("_pages"))
    seen = F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(form).alias("f")))), lambda x: x["f"])
    return firsts.groupBy(*by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_pages")))).alias("pages"), seen.alias("formats"))


def with_listing(listing: DataFrame, exported: DataFrame, number: str, path: str) -> DataFrame:
    """Listing rows with the exported file of their number and its format; rows without a known format are left out."""
    files = exported.select(trailing_number(F.col(path)).alias(number), F.col(path).alias("file"), image_format(F.col(path)).alias("format"))
    return listing.join(files.filter("format is not null"), number)


def estimated_size(file_size: Column, savings: Column) -> Column:
    """What a file may shrink to: never negative."""
    return F.greatest(file_size - savings, F.lit(0))
