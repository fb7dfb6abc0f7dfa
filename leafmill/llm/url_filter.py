"""URL filters: host and path rules, and gradient-boosted trees on lexical features, in built-in functions.

Features: lengths of url, host and path, path depth, host depth, digit share, letter entropy, number of
parameters, hyphens, and two suffix statistics (how many labelled urls end in the host's last label,
and the smoothed share of them that is blocked).  Labels are the verdicts of rules, or any label column.

Training is a sequence of aggregations.  A labelled url's suffix statistics come from the folds that it is not
in.  Equal rows of bins are counted together first, so a host that holds a third of all urls shrinks before
it meets.  Each level of a tree takes one histogram of gradients per node, feature and bin: a bounded
number of rows.  Everything is summed as integers and bins lie at fixed levels, so the result does not
depend on the order of execution.  Scoring is a sum of CASE expressions.

Defined results
---------------
* null url, or one without ``://``: empty host and path, no rule, verdict of the trees;
* very long urls are read whole; ties and repeated rows: every row is judged by itself, null ids are kept;
* of several fitting rules the longest wins, of equally long ones the first in text order;
* no labelled urls: everything is allowed; labels of one kind: that verdict;
* an empty table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._graph import stored

# The rules (host and path, verdict).
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

FEATURES = ["url_length", "host_length", "path_length", "path_depth", "host_depth", "digit_share", "entropy", "parameters", "hyphens", "suffix_urls", "suffix_blocked"]
TREES, DEPTH, BINS, RATE, RIDGE = 8, 3, 16, 0.4, 1.0
#: Gradients are summed as integers of this fraction.
UNIT = 1_000_000
#: Folds of the suffix statistics in training; different rows of bins that trees are grown from (a bound of the
#: training alone: the ones that come first by hash, with their counts); and levels at which a feature is counted
#: for its bins, with the levels per unit of each feature.
FOLDS, TRAINING_ROWS, LEVELS = 5, 200_000, 8_192
STEPS = {"digit_share": 4_096, "entropy": 256, "suffix_urls": 128, "suffix_blocked": 4_096}


@dataclass
class Trees:
    """Split thresholds ``edges[feature]`` and trees in level order; a node is (feature, bin) or None, a leaf a value."""

    base: float
    edges: list[list[float]]
    nodes: list[list[tuple[int, int] | None]] = field(default_factory=list)
    leaves: list[list[float]] = field(default_factory=list)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def ruled(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds host, path, rule and ruled (the rule's verdict) to rows with a url."""
    host, path = parts(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return rows.withColumns({"rule": rule, "ruled": verdict})


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the features that need no statistics, and ``suffix``, to rows with url, host and path."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    letters = F.split(url, "")
    entropy = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda a, c: a + F.when(F.length(c) == 0, 0.0).otherwise(-(_share(url, c, n)) * F.log2(_share(url, c, n))))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    return rows.withColumns({
        "url_length": F.length(url).cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "path_depth": _count(F.col("path"), "/").cast("double"),
        "host_depth": _count(F.col("host"), ".").cast("double"),
        "digit_share": F.length(F.regexp_replace(url, "[^0-9]", "")) / n,
        "entropy": F.round(entropy, 9),
        "parameters": F.when(F.length(query) > 0, _count(query, "&") + 1).otherwise(0).cast("double"),
        "hyphens": _count(url, "-").cast("double"),
        "suffix": F.substring_index("host", ".", -1),
    })


def _share(url: Column, letter: Column, n: Column) -> Column:
    return (F.length(url) - F.length(F.replace(url, letter, F.lit("")))) / F.greatest(F.length(letter), F.lit(1)) / n


def _suffix_counts(rows: DataFrame, *more: Column) -> DataFrame:
    """Labelled urls and blocked ones by suffix; combined per task before they meet."""
    return rows.filter("y is not null").groupBy(F.col("suffix").alias("stat_suffix"), *more).agg(F.count("*").alias("n"), F.sum("y").alias("blocked"))


def _with_statistics(rows: DataFrame, n: Column, blocked: Column) -> DataFrame:
    n, blocked = F.coalesce(n, F.lit(0)), F.coalesce(blocked, F.lit(0))
    return rows.withColumns({"suffix_urls": F.log1p(n.cast("double")), "suffix_blocked": (blocked + 1.0) / (n + 2.0)})


def with_suffixes(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """Adds the suffix statistics over all labelled rows (y: 1 block, 0 allow, null unlabelled)."""
    stats = _suffix_counts(labelled)
    joined = rows.join(stats, F.col("suffix") == F.col("stat_suffix"), "left")
    return _with_statistics(joined, F.col("n"), F.col("blocked")).drop("n", "blocked", "stat_suffix")


def with_other_folds(rows: DataFrame) -> DataFrame:
    """Labelled rows with the suffix statistics of the folds that they are not in, so that no label is its own
    feature.  Equal urls share a fold."""
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
    parts = _suffix_counts(rows, fold.alias("stat_fold"))
    per_suffix = parts.groupBy("stat_suffix").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.map_from_entries(F.collect_list(F.struct("stat_fold", F.struct("n", "blocked")))).alias("own"))  # FOLDS entries at most
    joined = rows.filter("y is not null").join(per_suffix, F.col("suffix") == F.col("stat_suffix"))
    own = F.try_element_at("own", fold)
    return _with_statistics(joined, F.col("n") - own["n"], F.col("blocked") - own["blocked"]).drop("n", "blocked", "own", "stat_suffix")


def binned(model: Trees) -> list[Column]:
    """Bin of each feature: how many thresholds lie below its value."""
    return [(reduce(lambda a, b: a + b, [(F.col(f) > e).cast("int") for e in edges]) if edges else F.lit(0)).alias(f"b_{f}") for f, edges in zip(FEATURES, model.edges, strict=True)]


def _walk(nodes: list, values: list[Column], at: int = 0) -> Column:
    """CASE expression of one tree over the bin columns."""
    if at >= len(nodes):
        return values[at - len(nodes)]
    left = _walk(nodes, values, 2 * at + 1)
    if nodes[at] is None:
        return left
    feature, bin_ = nodes[at]
    return F.when(F.col(f"b_{FEATURES[feature]}") <= bin_, left).otherwise(_walk(nodes, values, 2 * at + 2))


def margin(model: Trees) -> Column:
    out = F.lit(model.base)
    for nodes, leaves in zip(model.nodes, model.leaves, strict=True):
        out = out + _walk(nodes, [F.lit(v) for v in leaves])
    return out


def _sums(p: Column) -> list[Column]:
    g = F.sum(F.round((p - F.col("y")) * UNIT).cast("long") * F.col("n")).alias("g")
    return [g, F.sum(F.round(p * (1 - p) * UNIT).cast("long") * F.col("n")).alias("h")]


def bin_edges(known: DataFrame) -> list[list[float]]:
    """Thresholds of every feature at equal shares of its rows.

    Features are counted at fixed levels (whole numbers, or fractions of one), so the counts are exact
    whatever the order and partitioning, and bounded: LEVELS rows per feature.
    """
    level = F.array(*[F.struct(F.lit(k).alias("f"), F.least(F.floor(F.col(f) * STEPS.get(f, 1)), F.lit(LEVELS)).cast("int").alias("at")) for k, f in enumerate(FEATURES)])
    counts = known.select(F.explode(level).alias("x")).groupBy("x.f", "x.at").count().collect()
    out = []
    for k, f in enumerate(FEATURES):
        mine = sorted((r["at"], r["count"]) for r in counts if r["f"] == k)
        total, seen, edges = sum(n for _, n in mine), 0, set()
        for at, n in mine[:-1]:
            if (seen + n) * BINS // total > seen * BINS // total:
                edges.add((at + 1) / STEPS.get(f, 1) - 1e-9)
            seen += n
        out.append(sorted(edges))
    return out


def fit(rows: DataFrame) -> Trees:
    """Boosted trees from rows with FEATURES and y (0 or 1, nulls left out)."""
    known = rows.filter("y is not null")
    first = known.agg(F.count("*").alias("n"), F.sum("y").alias("ones")).first()
    n, ones = first["n"], first["ones"] or 0
    if ones in (0, n):
        return Trees(-20.0 if ones == 0 else 20.0, [[] for _ in FEATURES])
    model = Trees(math.log(ones / (n - ones)), bin_edges(known))
    bins = [f"b_{f}" for f in FEATURES]
    counted = known.select("y", *binned(model)).groupBy("y", *bins).agg(F.count("*").alias("n"))
    table = stored(counted.orderBy(F.xxhash64("y", *bins), "y", *bins).limit(TRAINING_ROWS))
    inner = (1 << DEPTH) - 1
    for _ in range(TREES):
        p = 1 / (1 + F.exp(-margin(model)))
        nodes: list[tuple[int, int] | None] = [None] * inner
        cells: list = []
        for level in range(DEPTH):
            low, wide = (1 << level) - 1, 1 << level
            here = _walk(nodes[:low], [F.lit(k) for k in range(wide)]) if low else F.lit(0)
            spread = table.select("y", "n", p.alias("p"), here.alias("node"), F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(b).alias("b")) for k, b in enumerate(bins)])).alias("x"))
            cells = spread.groupBy("node", "x.f", "x.b").agg(*_sums(F.col("p"))).collect()  # nodes x features x bins at most
            nodes[low : low + wide] = _splits(cells, wide)
        model.nodes.append(nodes)
        model.leaves.append(_leaves(cells, nodes[inner // 2 :]))
    return model


def _leaves(cells: list, splits: list[tuple[int, int] | None]) -> list[float]:
    """Values of the leaves below the last level, from that level's histogram."""
    out = []
    for node, split in enumerate(splits):
        feature, bin_ = split or (0, BINS)
        for left in (True, False):
            mine = [r for r in cells if r["node"] == node and r["f"] == feature and (r["b"] <= bin_) == left]
            g, h = (sum(r[k] for r in mine) / UNIT for k in ("g", "h"))
            out.append(-RATE * g / (h + RIDGE))
    return out


def _splits(cells: list, wide: int) -> list[tuple[int, int] | None]:
    """Best (feature, bin) of every node of a level."""
    by_node: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
    for r in cells:
        by_node.setdefault(r["node"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"] / UNIT, r["h"] / UNIT)
    out: list[tuple[int, int] | None] = [None] * wide
    for node, features in by_node.items():
        best = 1e-6
        for f in sorted(features):
            bins = features[f]
            total_g, total_h = (sum(x[k] for x in bins.values()) for k in (0, 1))
            g = h = 0.0
            for b in sorted(bins)[:-1]:
                g, h = g + bins[b][0], h + bins[b][1]
                gain = g * g / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g**2 / (total_h + RIDGE)
                if gain > best + 1e-9:
                    best, out[node] = gain, (f, b)
    return out


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, id_col: str = "page_id", url_col: str = "url", label_col: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict (the rule's, else the trees') and score (chance of block).

    ``label_col`` names a column of labels (1 block, 0 allow); without it the rules' verdicts are learned.
    """
    rules = RULES if rules is None else rules
    picked = [F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url")]
    if label_col is not None:
        picked.append(F.col(f"`{label_col}`").cast("int").alias("y"))
    rows = ruled(pages.select(*picked), rules)
    if label_col is None:
        rows = rows.withColumn("y", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    rows = lexical(rows)
    model = fit(with_other_folds(rows))
    scored = with_suffixes(rows, rows).select("page_id", "host", "path", "rule", "ruled", *binned(model)).withColumn("score", 1 / (1 + F.exp(-margin(model))))
    learned = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "score")
