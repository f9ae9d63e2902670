"""URL filter: a trie over reversed host labels and then path segments, longest match between allow and block rules.

Nulls, urls without ``://`` and empty hosts have host and path ``''`` and meet no rule: they get the default verdict.
Of equal rules the last given wins. Other columns are handed on untouched, but those called ``host``, ``path``, ``rule`` or
``verdict``, which are replaced. Repeated rows are judged alike and all stay; an empty table gives an empty table. Urls of any
length are judged whole.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, lower_ascii


@dataclass(frozen=True)
class Rule:
    """``host`` also stands for all its subdomains; ``path`` is a plain prefix of the url's path."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def label(self) -> str:
        return self.host + self.path


class Trie:
    """Nested dicts: host labels from the right, then under ``/`` the path's whole segments.

    A rule's last segment may be cut anywhere (``/en/1`` fits ``/en/12``), so the node of its whole segments holds the
    rest as ``(rest, rule)``, longest first.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(label, {})
            *segments, rest = rule.path.split("/")
            for segment in segments:
                node = node.setdefault("/", {}).setdefault(segment, {})
            ends = [e for e in node.get("", []) if e[0] != rest] + [(rest, rule)]
            node[""] = sorted(ends, key=lambda e: -len(e[0]))

    def match(self, host: str, path: str) -> Rule | None:
        """The rule with most host labels, and of those with the longest path."""
        node, found = self.root, None
        for label in reversed(host.split(".")) if host else ():
            node = node.get(label)
            if node is None or not label:
                break
            found = self._path(node, path) or found
        return found

    @staticmethod
    def _path(node: dict, path: str) -> Rule | None:
        found, segments = None, path.split("/")
        for depth in range(len(segments)):
            tail = "/".join(segments[depth:])
            found = next((rule for rest, rule in node.get("", ()) if tail.startswith(rest)), found)
            node = node.get("/", {}).get(segments[depth])
            if node is None:
                break
        return found


def judge_urls(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null without a match) and ``verdict``; columns of these names are replaced.

    The rules are a hand-written list (bounded by ``len(rules)``), so their trie is broadcast.
    """
    trie = df.sparkSession.sparkContext.broadcast(Trie(rules))
    address = F.regexp_extract(F.col(f"`{url}`"), r"(?s)^.*?://([^/?#]*)([^?#]*)", 0)

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [trie.value.match(h, p) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame(
            {"rule": [r and r.label for r in found], "verdict": [r.verdict if r else default for r in found]},
            dtype=object,
        )

    def part(k: int):
        return F.coalesce(F.regexp_extract(address, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))

    kept = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    split = df.select(*[F.col(f"`{c}`") for c in kept], lower_ascii(part(1)).alias("host"), part(2).alias("path"))
    (found,) = fresh(split, "judged")
    judged = split.withColumn(found, judge("host", "path"))
    return judged.select(*[F.col(f"`{c}`") for c in [*kept, "host", "path"]], F.col(found)["rule"].alias("rule"), F.col(found)["verdict"].alias("verdict"))
