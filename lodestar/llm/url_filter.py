"""URL rules, and gradient-boosted trees on lexical features for URLs that no rule decides.

DataFrame and SQL functions only. Features are binned, so labelled URLs come down to a
table of distinct binned rows with counts, whose size depends on the number of bins and
not on the number of URLs. Suffix statistics are a table of their own that URLs join; the
labels a row was counted in never decide its own statistic (folds). Each level of each tree is one small aggregate over that table;
the finished trees are one expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: Upper bin edges of each feature; values above the last edge make one more bin.
EDGES = {
    "length": [24, 30, 36, 42, 50, 60, 80],
    "host_length": [12, 16, 18, 20, 23, 27, 35],
    "labels": [1, 2, 3, 4, 5],
    "depth": [0, 1, 2, 3, 4, 6],
    "digits": [0.0, 0.03, 0.06, 0.09, 0.12, 0.2, 0.4],
    "entropy": [2.5, 3.0, 3.4, 3.6, 3.8, 4.0, 4.3],
    "parameters": [0, 1, 2, 4],
    "hyphens": [0, 1, 2, 4],
    "suffix_rate": [0.05, 0.15, 0.3, 0.5, 0.7, 0.85, 0.95],
}
#: Folds of labelled URLs, by host, and the weight of the mean in a suffix's rate.
FOLDS, MEAN = 5, 4
#: Suffixes up to which their table is sent to every executor.
SMALL = 100_000


@dataclass
class Model:
    """rates: (suffix, own), the share of blocked URLs for each suffix of a labelled host; rate: that of all."""

    prior: float = 0.0
    rates: DataFrame | None = None
    rate: float = 0.5
    trees: list = field(default_factory=list)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and for one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of (verdict, host, path) rules that fits; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # a longer one outdoes those before it
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def features(url: Column, host: Column, path: Column, rate: Column) -> dict[str, Column]:
    """The lexical features of a URL whose suffix has a rate."""
    url = F.coalesce(url, F.lit(""))
    n = F.greatest(F.char_length(url), F.lit(1))
    counts = F.transform(F.array_distinct(F.split(url, "")), lambda c: (n - F.char_length(F.replace(url, c, F.lit("")))) / n)
    entropy = F.aggregate(counts, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "length": F.char_length(url),
        "host_length": F.char_length(host),
        "labels": F.size(F.split(host, r"\.")),
        "depth": F.char_length(path) - F.char_length(F.replace(path, F.lit("/"), F.lit(""))),
        "digits": F.char_length(F.regexp_replace(url, r"[^0-9]", "")) / n,
        "entropy": entropy,
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "[&;]"))),
        "hyphens": F.char_length(host) - F.char_length(F.replace(host, F.lit("-"), F.lit(""))),
        "suffix_rate": rate,
    }


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has been counted and found small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _bin(value: Column, edges: list) -> Column:
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(value <= edges[i], i).otherwise(out)
    return out


def _grow(tree, leaf):
    """A tree (feature, bin, left, right) or leaf value as an expression; leaf says what becomes of leaves."""
    if not isinstance(tree, tuple):
        return leaf(tree)
    name, at, left, right = tree
    return F.when(F.col(name) <= at, _grow(left, leaf)).otherwise(_grow(right, leaf))


def train(urls: DataFrame, url_col: str, blocked_col: str, rounds: int = 8, depth: int = 3, rate: float = 0.4, smooth: float = 1.0) -> Model:
    """Fit on all rows of urls whose blocked_col is not null; a null URL is one without host and path.

    Repeated URLs count as often as they stand there. Without both kinds of label the model is a constant; without any label it allows.
    """
    host, path = host_and_path(F.col(url_col))
    rows = urls.where(F.col(blocked_col).isNotNull()).select(F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), F.col(blocked_col).cast("int").alias("y"))
    rows = rows.withColumn("suffix", _suffix(F.col("host"))).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)))
    # Suffix and fold first: one small table gives all counts, with and without a fold.
    each = cut(rows.groupBy("suffix", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")))
    n, y = each.agg(F.sum("n"), F.sum("y")).first()
    if not n:
        return Model(prior=-1.0)
    import math

    share = (y + 0.5) / (n + 1)
    rated = lambda y, n: (y + MEAN * share) / (n + MEAN)
    per = each.groupBy("suffix").agg(F.sum("n").alias("all_n"), F.sum("y").alias("all_y"))
    model = Model(math.log(share / (1 - share)), cut(per.select("suffix", rated(F.col("all_y"), F.col("all_n")).alias("own"))), share)
    if y in (0, n):
        return model
    others = each.join(per, "suffix").select("suffix", "fold", rated(F.col("all_y") - F.col("y"), F.col("all_n") - F.col("n")).alias("own"))
    names = list(EDGES)
    got = features(F.col("url"), F.col("host"), F.col("path"), F.col("own"))
    binned = rows.join(_small(others), ["suffix", "fold"]).select("y", *[_bin(got[k], EDGES[k]).alias(k) for k in names])
    table = cut(binned.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")))  # bounded by the bins
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-margin(model)))
        graded = table.select(*names, (F.col("y") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
        tree: object = (0,)  # paths stand for open leaves
        open_leaves, done = [""], {}
        splits: dict[str, tuple[str, int]] = {}

        def shape(at: str, splits=splits, done=done):
            return (*splits[at], shape(at + "0"), shape(at + "1")) if at in splits else (done[at] if at in done else at)

        for _level in range(depth + 1):
            at = _grow(shape(""), lambda v: F.lit(v if isinstance(v, str) else None).cast("string"))
            each = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("bin")) for k in names]))
            sums = graded.select(at.alias("leaf"), "g", "h", each.alias("f")).where(F.col("leaf").isNotNull()).groupBy("leaf", "f.name", "f.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            for leaf in open_leaves:
                mine = [r for r in sums if r.leaf == leaf]
                g, h = (sum(r[k] for r in mine if r.name == names[0]) for k in ("g", "h"))
                found = (1e-6, None)
                for name in names if _level < depth else []:
                    left_g = left_h = 0.0
                    for r in sorted((r for r in mine if r.name == name), key=lambda r: r.bin)[:-1]:
                        left_g, left_h = left_g + r.g, left_h + r.h
                        gain = left_g**2 / (left_h + smooth) + (g - left_g) ** 2 / (h - left_h + smooth) - g**2 / (h + smooth)
                        if gain > found[0]:
                            found = (gain, (name, r.bin))
                if found[1]:
                    splits[leaf] = found[1]
                else:
                    done[leaf] = rate * g / (h + smooth)
            open_leaves = [leaf + side for leaf in open_leaves if leaf in splits and leaf + "0" not in splits and leaf + "0" not in done for side in "01"]
            if not open_leaves:
                break
        model.trees.append(shape(""))
    return model


def margin(model: Model) -> Column:
    """Log odds of block from binned features in columns of their names."""
    out = F.lit(model.prior)
    for tree in model.trees:
        out = out + _grow(tree, lambda v: F.lit(float(v)))
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], model: Model, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, verdict (the rule's, else the model's), block_score (the model's probability).

    A null URL and one without :// have an empty host and path, so no rule with a host fits
    and the model decides from their features. Repeated rows and null ids stay; other
    columns are ignored. Unless there are more suffixes than SMALL, nothing is shuffled.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    if model.rates is None:
        parsed = parsed.withColumn("own", F.lit(None).cast("double"))
    else:
        parsed = parsed.withColumn("suffix", _suffix(F.col("host"))).join(_small(model.rates), "suffix", "left")
    got = features(F.col("url"), F.col("host"), F.col("path"), F.coalesce("own", F.lit(model.rate)))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    binned = parsed.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), *[_bin(got[k], EDGES[k]).alias(k) for k in EDGES])
    scored = binned.select("id", "host", "path", "rule", "ruled", (1 / (1 + F.exp(-margin(model)))).alias("block_score"))
    own = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "block_score")


def labelled_by(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """(url, blocked): URLs with the label their rule gives, null without a rule."""
    host, path = host_and_path(F.col(url_col))
    return pages.select(F.col(url_col).alias("url"), (ruled(host, path, rules)[1] == "block").alias("blocked"))
