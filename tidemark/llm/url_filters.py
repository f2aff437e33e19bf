"""URL filters: allow and block rules by host and path, and for other URLs gradient-boosted trees over lexical features.

Features, rules and scores are DataFrame expressions; only the bounded training sample reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import trees
from tidemark.llm.common import materialise, table

#: The contract's rules: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Distinct labelled URLs that the trees are trained on, at most.
MAX_ROWS = 20_000
BLOCK_AT = 0.5
#: Lexical features of what the rules do not look at, and statistics of the suffix that hold no label: its length and how rare it is.
FEATURES = ["rest_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "longest_segment", "escapes", "suffix_length", "suffix_rarity"]
#: Features that tell hosts and suffixes apart. Where rules give the labels these repeat the rules (leave_one_rule_out() measures it); with labels of another origin they may serve.
HOST_FEATURES = ["host_length", "host_labels", "host_entropy"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _parts(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest) + 1), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path: null URLs and those without :// have neither (empty). Columns of these names are replaced."""
    host, path = _parts(F.col(url_col))
    return df.withColumns({"host": host, "path": path})


def rule_of(rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the host or a parent domain and whose path begins the path; null without one.

    The rules are configuration, a list that a person writes, so they become one expression.
    """
    fits = lambda host, path: ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in reversed(ordered):
        rule = F.when(fits(host, path), host + path).otherwise(rule)
        verdict = F.when(fits(host, path), v).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"[^.]*$", 0)


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    n = F.length(text)
    shares = F.transform(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), lambda c: (n - F.length(F.replace(text, c))) / n)
    return -F.aggregate(shares, F.lit(0.0), lambda a, p: a + p * F.log2(p))


def lexical(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds FEATURES and HOST_FEATURES, but for the suffix's rarity, as doubles named _f_<feature>, and _u_suffix.

    Rules judge by the ends of hosts and the starts of paths. So the lexical features are those of the rest: the path from its second segment on (or
    its only one), query and fragment. What several features share is a column of its own, so that it is computed once.
    """
    col, whole = F.col, F.coalesce(F.col(url_col), F.lit(""))
    host, path = _parts(col(url_col))
    out = df.withColumns({"_u_host": host, "_u_segments": F.filter(F.split(path, "/"), lambda s: s != ""), "_u_query": F.regexp_extract(whole, r"\?([^#]*)", 1), "_u_after": F.regexp_extract(whole, r"[?#].*$", 0)})
    many = F.size("_u_segments") > 1
    out = out.withColumn("_u_tail", F.when(many, F.slice("_u_segments", F.lit(2), F.greatest(F.size("_u_segments") - 1, F.lit(0)))).otherwise(col("_u_segments")))
    out = out.withColumns({"_u_rest": F.concat(F.array_join("_u_tail", "/"), "_u_after"), "_u_suffix": suffix_of(col("_u_host"))})
    rest, query, n = col("_u_rest"), col("_u_query"), F.length("_u_rest")
    count = lambda c, part: F.length(c) - F.length(F.replace(c, F.lit(part)))
    columns = {
        "rest_length": n, "depth": F.size("_u_segments"), "digit_ratio": F.regexp_count(rest, F.lit("[0-9]")) / F.greatest(n, F.lit(1)), "entropy": _entropy(rest),
        "parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1), "hyphens": count(rest, "-"),
        "longest_segment": F.coalesce(F.array_max(F.transform("_u_tail", F.length)), F.lit(0)), "escapes": count(rest, "%"), "suffix_length": F.length("_u_suffix"),
        "host_length": F.length("_u_host"), "host_labels": F.size(F.split("_u_host", r"\.")), "host_entropy": _entropy(col("_u_host")),
    }
    return out.withColumns({f"_f_{k}": c.cast("double") for k, c in columns.items()})


def suffix_statistics(df: DataFrame, url_col: str = "url") -> DataFrame:
    """(_suffix, _rarity): for every suffix of the table, without a cap, how many powers of ten it is rarer than all rows together. One row a suffix, aggregated before the shuffle."""
    counts = df.groupBy(suffix_of(_parts(F.col(url_col))[0]).alias("_suffix")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    return counts.join(F.broadcast(total)).select("_suffix", F.floor(F.log10(F.col("_all") / F.col("_n"))).cast("double").alias("_rarity"))


def featured(df: DataFrame, statistics: DataFrame, url_col: str = "url", features: list[str] = FEATURES) -> DataFrame:
    """Adds the features as columns _f_<feature>. A suffix that the statistics lack is as rare as can be told: 9."""
    found = lexical(df, url_col).join(statistics, F.col("_u_suffix") == F.col("_suffix"), "left")
    found = found.withColumn("_f_suffix_rarity", F.coalesce("_rarity", F.lit(9.0)))
    return found.select(*df.columns, *(f"_f_{f}" for f in features))


@dataclass
class Model:
    trees: trees.Trees
    features: list[str]

    def score(self, df: DataFrame, statistics: DataFrame, url_col: str = "url") -> DataFrame:
        """Adds the probability of block."""
        out = featured(df, statistics, url_col, self.features)
        return out.withColumn("probability", 1 / (1 + F.exp(-F.expr(self.trees.sql([f"_f_{f}" for f in self.features]))))).drop(*(f"_f_{f}" for f in self.features))


def fit(labelled: DataFrame, statistics: DataFrame, url_col: str = "url", label_col: str = "blocked", max_rows: int = MAX_ROWS, features: list[str] = FEATURES) -> Model:
    """Trains on at most max_rows distinct URLs, those of the least hashes; a URL with both labels counts as blocked. No rows, or one label only: the prior."""
    rows = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(url_col).alias("url")).agg(F.max(label_col).alias("blocked"))
    rows = rows.orderBy(F.xxhash64("url"), "url").limit(max_rows)
    rows = featured(rows, statistics, "url", features).select("blocked", *(f"_f_{f}" for f in features)).collect()
    if not rows:
        return Model(trees.fit(np.zeros((0, len(features))), np.zeros(0)), features)
    return Model(trees.fit(np.array([[r[f"_f_{f}"] for f in features] for r in rows]), np.array([r.blocked for r in rows], float), n_trees=30, depth=3, rate=0.3), features)


def filter_urls(df: DataFrame, model: Model, statistics: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """df with host, path, rule, probability and verdict (allow or block) for every row.

    Null, empty and malformed URLs have an empty host and path, no rule, and the trees' verdict on their features. Repeated
    rows are judged alike; an empty table gives no rows. Columns of df that bear one of the five names are replaced, all others stay, whatever their names:
    they ride in a struct while features are made.
    """
    added = ["host", "path", "rule", "probability", "verdict"]
    rule, verdict = rule_of(rules)
    kept = [c for c in df.columns if c not in added]
    rows = df.select(F.struct(*(kept or [F.lit(0)])).alias("row"), F.col(url_col).alias("url"))
    out = with_parts(model.score(rows, statistics)).withColumn("rule", rule)
    judged = F.when(F.col("probability") >= BLOCK_AT, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce(verdict, judged)).select(*(F.col("row")[c].alias(c) for c in kept), *added)


def rule_labels(df: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(url, rule, blocked) of the URLs that a rule judges: the labelled URLs."""
    rule, verdict = rule_of(rules)
    parts = with_parts(df.select(F.col(url_col).alias("url")))
    return parts.select("url", rule.alias("rule"), (verdict == "block").cast("int").alias("blocked")).where("blocked is not null")


def leave_one_rule_out(df: DataFrame, url_col: str = "url", features: list[str] = FEATURES, rules: tuple[tuple[str, str, str], ...] = RULES) -> list[tuple[str, int, float, float]]:
    """(rule, its URLs, share of them judged as it says by trees that never saw it, share of the URLs without a rule that are blocked): what features learn beyond the rules themselves."""
    labels, statistics = rule_labels(df, url_col, rules), suffix_statistics(df, url_col)
    free = with_parts(df.select(F.col(url_col).alias("url"))).where(rule_of(rules)[0].isNull()).select("url")
    out = []
    for verdict, host, path in rules:
        model = fit(labels.where(F.col("rule") != host + path), statistics, features=features)
        right = ((F.col("probability") >= BLOCK_AT) == F.lit(verdict == "block")).cast("int")
        r = model.score(labels.where(F.col("rule") == host + path), statistics).agg(F.count("*").alias("n"), F.avg(right).alias("share")).first()
        blocked = model.score(free, statistics).agg(F.avg((F.col("probability") >= BLOCK_AT).cast("int"))).first()[0]
        out.append((host + path, r.n, r.share, blocked))
    return out


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged: by its rule, else by trees trained on the URLs that have one."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    statistics = materialise(spark, suffix_statistics(pages), "suffixes")
    return filter_urls(pages, fit(rule_labels(pages), statistics), statistics).select("page_id", "host", "path", "rule", "verdict")
