"""URL filters: a broadcast trie over reversed host labels and path segments.

A rule is (verdict, host, path). It fits its host and all subdomains of it where the url's path
starts with the rule's path. Of the rules that fit, the one with the longest host wins, then the
one with the longest path, then block before allow.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import over_batches

Rule = tuple[str, str, str]
#: Rules that are broadcast at most; beyond them the verdicts come from joins.
MOST_RULES = 500_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` and for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Trie:
    """A node is (children by host label, root of its paths); a path node is (children by segment, rules by the rest of their path)."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: list = [{}, None]
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node[0].setdefault(label, [{}, None])
            node[1] = node[1] or [{}, {}]
            place = node[1]
            *segments, rest = path.split("/")
            for s in segments:
                place = place[0].setdefault(s, [{}, {}])
            if place[1].get(rest, ("", ""))[0] != "block":
                place[1][rest] = (verdict, host + path)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest match."""
        node, found = self.root, None
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            if node[1]:
                found = self._below(node[1], segments) or found
        return found

    @staticmethod
    def _below(place: list, segments: list[str]) -> tuple[str, str] | None:
        found = None
        for s in segments:
            for rest in sorted(place[1], key=len):
                if s.startswith(rest):
                    found = place[1][rest]
            place = place[0].get(s)
            if place is None:
                break
        return found


def judge_urls(pages: DataFrame, rules: list[Rule] | DataFrame, url: str = "url", page_id: str = "page_id", default: str = "allow", most_rules: int = MOST_RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule (null if none fits), verdict.

    rules: (verdict, host, path) rows. Up to ``most_rules`` they are broadcast as a trie, otherwise
    joined; both give the same rows. Urls without ``://`` and null urls have an empty host and path
    and get ``default``, as do all that no rule fits. Repeated rows give repeated rows; an empty table
    gives none; other columns are not read.
    """
    if isinstance(rules, DataFrame):
        if rules.limit(most_rules + 1).count() > most_rules:
            return judge_by_join(pages, rules, url, page_id, default)
        rules = [tuple(r) for r in rules.select("verdict", "host", "path").collect()]
    shared = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.match(h, p) or (default, None) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r for _, r in found], pa.string()), pa.array([v for v, _ in found], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema[page_id].dataType.simpleString()
    c = F.col(url).cast("string")
    return over_batches(pages, [F.col(page_id), host_of(c), path_of(c)], work, f"page_id {kind}, host string, path string, rule string, verdict string")


def judge_by_join(pages: DataFrame, rules: DataFrame, url: str = "url", page_id: str = "page_id", default: str = "allow") -> DataFrame:
    """As ``judge_urls`` for any number of rules: urls meet rules on the host's suffix and the folder of the path."""
    c = F.col(url).cast("string")
    base = pages.select(F.col(page_id).alias("page_id"), host_of(c).alias("host"), path_of(c).alias("path")).withColumn("row", F.xxhash64("host", "path"))
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    urls = base.select("host", "path").distinct()
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    folder = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i - 1), "/"))
    keys = urls.withColumn("at", F.explode(suffix)).withColumn("folder", F.explode(folder))
    cuts = F.length("rule_path") - F.length(F.substring_index("rule_path", "/", -1))
    known = rules.select("verdict", F.col("host").alias("at"), F.col("path").alias("rule_path")).withColumn("folder", F.when(cuts > 0, F.expr("substring(rule_path, 1, length(rule_path) - length(substring_index(rule_path, '/', -1)) - 1)")).otherwise(F.lit("")))
    rank = F.struct(F.length("at"), F.length("rule_path"), (F.col("verdict") == "block").alias("b"), F.concat("at", "rule_path").alias("rule"), "verdict")
    won = keys.join(known, ["at", "folder"]).filter(F.expr("startswith(path, rule_path)")).groupBy("host", "path").agg(F.max(rank).alias("won"))
    return base.join(won, ["host", "path"], "left").select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
