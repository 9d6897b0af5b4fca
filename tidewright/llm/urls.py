"""URL filters: fixed rules of hosts and paths, and rules mined from labels.

A fixed rule fits its host and all its subdomains, where the URL's path starts
with the rule's; the longest that fits decides. Every other URL is judged by
association rules: Spark's FP-growth mines the token combinations that labelled
URLs share, with their label as one more item, over all labelled rows. A
combination becomes a rule for a label if label and tokens have the support,
and the label the confidence, that are asked for; a rule that a shorter one
makes needless (a part of its tokens says the same as surely) goes. Rules stand
in an inverted index, each under its rarest token, so that a URL looks at the
rules of its own tokens only; of those whose tokens it all has, the surest
decides (ties: more support, fewer tokens, the tokens in order, block before
allow). URLs are judged where they are read, without a shuffle.

Tokens: labels of the host, split at hyphens (``h:``), the last of them also as
``t:``, segments of the path (``p:``) and names of query parameters (``q:``),
A-Z lower-cased, digits as ``#``. Mining and matching read all of them. A
combination of n tokens holds 2^n others, so time and the rules before pruning
follow the combinations that enough labelled URLs share; their number depends
on the longest of those, not on the number of URLs.

Defined results: null URLs, and those without ``://``, have empty host and path
and no token; without a rule that fits the verdict is ``default``; with no
labelled URL there are no mined rules; repeated rows count as often as they
stand there and give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import saved, small_batches

BLOCK, ALLOW = "block", "allow"
#: Tokens of a URL that are mined: no bound.
MAX_ITEMS = None
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE = 0.005, 5, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"

#: (host, path, verdict)
Fixed = tuple[str, str, str]


def _part(url: Column, k: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, k), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return _part(url, 2)


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL: top domain, host from the right, path, names of parameters."""

    def plain(c: Column) -> Column:
        return F.regexp_replace(F.translate(c, _UPPER, _LOWER), "[0-9]+", "#")

    def some(parts: Column, kind: str) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))

    h = F.split(plain(_part(url, 1)), r"\.")
    top = some(F.slice(h, -1, 1), "t:")
    labels = some(F.flatten(F.transform(F.reverse(h), lambda x: F.split(x, "-"))), "h:")
    below = some(F.split(plain(path(url)), "/"), "p:")
    names = some(F.transform(F.split(plain(_part(url, 3)), "&"), lambda x: F.split(x, "=")[0]), "q:")
    return F.array_distinct(F.concat(top, labels, below, names))


@dataclass(frozen=True)
class Rule:
    """Tokens that speak for a verdict, in how many labelled URLs, and in which share of those that have them."""

    tokens: tuple[str, ...]
    verdict: str
    rows: int
    confidence: float

    @property
    def order(self) -> tuple:
        return (-self.confidence, -self.rows, len(self.tokens), self.tokens, self.verdict != BLOCK)


def mine(labelled: DataFrame, url: str = "url", label: str = "label", min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> list[Rule]:
    """The pruned rules of rows with a label ``block`` or ``allow``; other rows are left out."""
    kept = labelled.filter(F.col(label).isin(BLOCK, ALLOW) & F.col(url).isNotNull())
    items = F.concat(tokens(F.col(url)), F.array(F.concat(F.lit("="), F.col(label))))
    baskets = saved(kept.select(items.alias("items")), "url-items")
    n = baskets.count()
    if not n:
        return []
    least = max(min_rows, math.ceil(min_support * n))
    if least > n:
        return []
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=1.0).fit(baskets).freqItemsets
    found = saved(found.select(F.array_sort("items").alias("items"), "freq"), "url-sets")
    of_label = F.exists("items", lambda x: x.startswith("="))
    with_label = found.filter(of_label & (F.size("items") > 1)).select(F.filter("items", lambda x: ~x.startswith("=")).alias("tokens"), F.filter("items", lambda x: x.startswith("="))[0].substr(2, 99).alias("verdict"), F.col("freq").alias("rows"))
    all_rows = found.filter(~of_label).select(F.col("items").alias("tokens"), F.col("freq").alias("of"))
    rules = with_label.join(all_rows, "tokens").withColumn("confidence", F.col("rows") / F.col("of")).filter(F.col("confidence") >= min_confidence)
    return pruned([Rule(tuple(r.tokens), r.verdict, r.rows, r.confidence) for r in rules.toLocalIterator()])


def pruned(rules: list[Rule]) -> list[Rule]:
    """Without the rules that one on a part of their tokens outranks, which fits wherever they do."""
    out, index = [], Index([])
    for r in sorted(rules, key=lambda r: r.order):
        if index.best(frozenset(r.tokens)) is None:
            out.append(r)
            index.add(r, r.tokens[0])
    return out


class Index:
    """Rules under one token each, the rarest among the rules."""

    def __init__(self, rules: list[Rule]):
        self.under: dict[str, list[tuple[tuple, frozenset, Rule]]] = {}
        often: dict[str, int] = {}
        for r in rules:
            for t in r.tokens:
                often[t] = often.get(t, 0) + 1
        for r in sorted(rules, key=lambda r: r.order):
            self.add(r, min(r.tokens, key=lambda t: (often[t], t)))

    def add(self, rule: Rule, token: str) -> None:
        """Rules come in their order."""
        self.under.setdefault(token, []).append((rule.order, frozenset(rule.tokens), rule))

    def best(self, have: frozenset) -> Rule | None:
        top = None
        for t in have:
            for order, need, rule in self.under.get(t, ()):
                if top is not None and order >= top[0]:
                    break
                if need <= have:
                    top = (order, rule)
                    break
        return None if top is None else top[1]


def fixed(url: Column, rules: Sequence[Fixed]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fixed rule that fits; nulls if none does."""
    h, p = host(url), path(url)
    rule = verdict = None
    for rh, rp, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        rule = F.when(fits, rh + rp) if rule is None else rule.when(fits, rh + rp)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def judge(df: DataFrame, rules: Sequence[Fixed], mined: list[Rule], key: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """``host``, ``path``, ``rule``, ``verdict`` of each row, and the mined rule (``tokens``, ``confidence``) that decided, if one did."""
    spark = df.sparkSession
    u = F.col(url)
    rule, verdict = fixed(u, rules)
    seen = df.select(F.col(key).alias("_key"), host(u).alias("host"), path(u).alias("path"), rule.alias("rule"), verdict.alias("verdict"), tokens(u).alias("tokens"))
    small_batches(spark)
    shared = spark.sparkContext.broadcast(mined)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, memo = Index(shared.value), {}
        for b in batches:
            verdicts, by, sure = b.column(4).to_pylist(), [None] * b.num_rows, [None] * b.num_rows
            for i, have in enumerate(b.column(5).to_pylist()):
                if verdicts[i] is not None:
                    continue
                have = frozenset(have)
                if have not in memo:
                    if len(memo) > 10_000:
                        memo.clear()
                    memo[have] = index.best(have)
                r = memo[have]
                verdicts[i] = default if r is None else r.verdict
                if r is not None:
                    by[i], sure[i] = " ".join(r.tokens), r.confidence
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(verdicts, pa.string()), pa.array(by, pa.string()), pa.array(sure, pa.float64())], [key, "host", "path", "rule", "verdict", "mined", "confidence"])

    return seen.mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string, mined string, confidence double")


def parse(rules: str) -> list[Fixed]:
    """``block net/, allow org/fr/`` as (host, path, verdict)."""
    return [(h, "/" + p, v) for v, h, p in re.findall(r"(block|allow)\s+([^/\s]+)/([^\s,]*)", rules)]


__all__ = ["Rule", "judge", "mine", "parse", "tokens"]
