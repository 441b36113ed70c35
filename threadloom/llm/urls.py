"""URL filter: a trie over reversed host labels and, below each host, over path segments, broadcast to the tasks.

A rule (action, host, path) fits its host and all subdomains of it where the url's path starts with the rule's. Of the rules that fit,
the one with the most host labels decides, then the one with the longest path; of an allow and a block rule for one host and path,
block decides. An empty host fits every url, an empty path every path. Host and path of urls are taken as they stand, but for A-Z in
the host: ports, escapes and empty labels are part of them.

A null url, or one without ``://``, has an empty host and an empty path, and so only rules without a host and a path fit it. Rows of equal
urls are judged alike; an empty table gives an empty one; urls of any length cost one walk. A rule with a null host, path or action is an
error, as is another action than allow and block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.shipping import ship

from .common import tables

#: Rules of one broadcast trie; a longer list is judged by several tries, one after the other.
TRIE_RULES = 500_000
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(found, "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(found, "(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Trie:
    """Nodes are dicts: child label to node. At a host node, ``None`` leads to the trie of its paths, whose nodes have their whole
    segments as labels and, under ``None``, the rules that end there: action by what is left of the path after the last whole
    segment, and under ``None`` the lengths that these rests have."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for action, host, path in rules:
            if action not in ("allow", "block") or host is None or path is None:
                raise ValueError(f"no rule: {(action, host, path)}")
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, {None: set()})
            ends[None].add(len(tail))
            if ends.get(tail) != "block":
                ends[tail] = action

    @staticmethod
    def _longest(node: dict, path: str) -> tuple[str, str] | None:
        """The longest rule path that ``path`` starts with, and its action."""
        best, at = None, 0
        while True:
            end = path.find("/", at)
            room = (end if end >= 0 else len(path)) - at
            ends = node.get(None, {None: ()})
            fit = [n for n in ends[None] if n <= room and path[at : at + n] in ends]
            if fit:
                best = path[: at + max(fit)], ends[path[at : at + max(fit)]]
            if end < 0 or (node := node.get(path[at:end])) is None:
                return best
            at = end + 1

    def match(self, host: str, path: str) -> tuple[int, str, str] | None:
        """(host labels, rule, action) of the deciding rule."""
        node, depth, best = self.root, 0, None
        labels = host.split(".") if host else []
        while True:
            if None in node and (found := self._longest(node[None], path)):
                best = depth, ".".join(labels[len(labels) - depth :]) + found[0], found[1]
            if depth == len(labels) or (node := node.get(labels[-1 - depth])) is None:
                return best
            depth += 1


def _blocks(rules: DataFrame | Iterable[tuple[str, str, str]], size: int) -> Iterator[list[tuple[str, str, str]]]:
    rows = rules.select("action", "host", "path").distinct().toLocalIterator() if isinstance(rules, DataFrame) else iter(rules)
    block: list = []
    for row in rows:
        block.append(tuple(row))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _matcher(trie):
    @F.pandas_udf("depth int, rule string, verdict string")
    def match(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [trie.value.match(h, p) or (None, None, None) for h, p in zip(hosts, paths)]
        return pd.DataFrame(found, columns=["depth", "rule", "verdict"]).astype({"depth": "Int32"})

    return match


def judge(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]], url: str = "url", default: str = "allow", trie_rules: int = TRIE_RULES) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict; ``default`` is the verdict without a rule.

    Columns of these names in ``pages`` are replaced. ``rules`` of any number: each ``trie_rules`` of them make a trie, and what one trie finds
    yields to a longer match of the next.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    at = F.struct(host.alias("host"), path.alias("path"))
    out, best = pages.select(*kept, at.alias("_at")), None
    ship(pages.sparkSession)
    for block in _blocks(rules, trie_rules):
        trie = pages.sparkSession.sparkContext.broadcast(Trie(block))

        one = _matcher(trie)(F.col("_at.host"), F.col("_at.path"))
        # deeper host, then longer rule, then block before allow
        key = F.when(one["depth"].isNotNull(), F.struct(one["depth"].alias("depth"), F.length(one["rule"]).alias("n"), one["verdict"].alias("verdict"), one["rule"].alias("rule")))
        best = key if best is None else F.greatest(best, key)
    none = F.lit(None).cast("string")
    return out.withColumn("_best", best if best is not None else F.lit(None).cast("struct<rule:string,verdict:string>")).select(
        *kept, "_at.host", "_at.path", F.coalesce(F.col("_best.rule"), none).alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict")
    )


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(tables(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP11_SQL = f"""
WITH rules (action, rule_host, rule_path) AS (VALUES {', '.join(str(r) for r in RULES)}
), cut AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), places AS (SELECT DISTINCT host, path FROM cut
), fit AS (
  SELECT host, path, rule_host || rule_path AS rule, action,
    row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS k
  FROM places JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, cut.host, cut.path, rule, coalesce(action, 'allow') AS verdict
FROM cut LEFT JOIN fit ON cut.host = fit.host AND cut.path = fit.path AND k = 1
"""
