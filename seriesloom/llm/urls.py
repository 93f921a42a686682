"""URL filters: explicit host and path rules, and association rules mined from labelled URLs.

Everything here is DataFrame work; FP-growth is Spark's own.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.store import fresh, materialize, shuffle_width

#: The item that stands for a bad label in a transaction; no token starts like it.
BAD = "=bad"
#: The explicit rules are written into one expression, so their number is bounded.
MAX_RULES = 1000


def host_of(url: Column) -> Column:
    """From after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """From the host to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels and their hyphenated words, folders, file ending, query keys, fragment.

    Numbers inside folders are ids, not tokens.  A null URL has none.
    """
    url = F.coalesce(url, F.lit(""))
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    marked = lambda mark, parts: F.transform(parts, lambda x: F.concat(F.lit(mark), x))
    kept = lambda parts: F.filter(parts, lambda x: (x != "") & ~x.rlike(r"^\d+(\..*)?$"))
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    labels = F.split(host, r"\.")
    folders = F.split(path, "/")
    ending = F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^[^=]*", 0))
    words = F.filter(F.split(host, r"[.-]"), lambda x: F.instr(host, "-") > 0)
    return F.array_distinct(
        F.concat(
            marked("s:", kept(F.array(scheme))),
            marked("h:", kept(labels)),
            marked("w:", kept(F.filter(words, lambda x: ~F.array_contains(labels, x)))),
            marked("d:", kept(folders)),
            marked("e:", F.filter(F.array(ending), lambda x: x != "")),
            marked("q:", kept(keys)),
            F.filter(F.array(F.when(F.instr(url, "#") > 0, F.lit("f:"))), lambda x: x.isNotNull()),
        )
    )


def mine_rules(
    labelled: DataFrame, min_support: float, min_confidence: float, min_bad: int | None = None, deviations: float | None = None
) -> DataFrame:
    """Rules ``tokens -> bad``: ``tokens, size, confidence, rarest`` from ``labelled(url, bad)``.

    Support is the share of labelled URLs that hold all tokens and are bad; ``min_bad``, if
    given, is their least number instead, whatever the number of labelled URLs.  With
    ``deviations``, the confidence must be above the share of bad URLs among all by more than
    chance: the lower end of its Wilson interval of so many deviations is compared.  ``rarest``
    is the rule's token with the fewest URLs; the inverted index files the rule there.
    """
    whole = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("bigint")).alias("bad")).first()
    if min_bad is not None:
        min_support = min(1.0, (min_bad - 0.5) / whole.n)  # half a URL less: FP-growth rounds up
    items = F.concat(url_tokens(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>")))
    baskets = labelled.select(items.alias("items"))
    mined = FPGrowth(
        itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=shuffle_width(labelled)
    ).fit(baskets)
    rules = mined.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD)))
    if deviations is not None:
        p, n, z = F.col("confidence"), F.col("support") * whole.n / F.col("confidence"), deviations
        low = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
        rules = rules.filter(low > whole.bad / whole.n)
    rules = materialize(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence"))
    seen = mined.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rarest = (
        rules.select("tokens", F.explode("tokens").alias("token"))
        .join(seen, "token")
        .groupBy("tokens")
        .agg(F.min(F.struct("freq", "token")).alias("r"))
        .select("tokens", F.col("r.token").alias("rarest"))
    )
    return rules.join(rarest, "tokens").select("tokens", F.size("tokens").alias("size"), "confidence", "rarest")


def match_rules(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Add ``confidence``: of the surest mined rule whose tokens the URL has; null where none fits.

    URLs meet the rules as distinct token sets, so that a host with a third of all pages is
    matched once, and only those rules whose rarest token they hold.
    """
    tokens, sure = fresh(pages, "_tokens", "_sure")
    marked = pages.withColumn(tokens, F.array_sort(url_tokens(F.col(url))))
    sets = marked.groupBy(tokens).agg(F.count(F.lit(1)).alias("_n")).select(F.col(tokens).alias("tokens"))
    hits = (
        sets.select("tokens", F.explode("tokens").alias("rarest"))
        .join(rules.select("rarest", F.col("tokens").alias("rule"), "confidence"), "rarest")
        .filter(F.size(F.array_except("rule", "tokens")) == 0)
        .groupBy("tokens")
        .agg(F.max("confidence").alias("sure"))
        .toDF(tokens, sure)
    )
    return marked.join(hits, tokens, "left").select(*pages.columns, F.col(sure).alias("confidence"))


def explicit_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``(verdict, host, path)`` that fits; nulls where none does.

    A rule fits its host and all subdomains where the URL's path starts with the rule's.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} explicit rules")
    rule = verdict = None
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path) if rule is None else rule.when(fits, rule_host + rule_path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def judge_urls(
    pages: DataFrame,
    labelled: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    min_support: float = 0.005,
    min_confidence: float = 0.6,
    min_bad: int | None = None,
    deviations: float | None = None,
) -> DataFrame:
    """Add ``host, path, rule, verdict, confidence`` to ``pages(url, ...)``.

    The verdict is that of the longest explicit rule; without one, ``block`` if a mined rule
    fits, else ``allow``; limits are those of ``mine_rules``.  Null URLs and such without ``://`` have an empty host and path and no
    explicit rule.  Repeated rows are judged alike; no labels or no rules mean ``allow``.
    Columns of ``pages`` with the names of the results are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "confidence")
    labelled = labelled.select("url", F.coalesce("bad", F.lit(False)).alias("bad"))
    if labelled.isEmpty():
        judged = pages.withColumn("confidence", F.lit(None).cast("double"))
    else:
        judged = match_rules(pages, mine_rules(labelled, min_support, min_confidence, min_bad, deviations))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = explicit_rule(host, path, rules)
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return judged.select("*", host.alias("host"), path.alias("path"), rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"))
