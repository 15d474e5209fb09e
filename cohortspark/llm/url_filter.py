"""URL filter: a trie over reversed host labels and path segments, broadcast, longest match wins.

Rules are (action, host, path prefix). A rule fits its host and every subdomain when the URL's path starts
with the rule's path. Of all fitting rules the one with most host labels wins, then the longest path, then block before allow.

Edge cases: a null URL or one without ``://`` has an empty host and path and fits no rule; URLs no rule
fits get ``default``. Repeated rows are judged alike; extra columns are ignored (``judge_urls`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import plain

#: Characters of rules that one broadcast trie holds at most; longer lists are matched in several passes.
TRIE_CHARS = 8_000_000
ALLOW, BLOCK = "allow", "block"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = str.maketrans(_UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Host labels from the last one inwards, then path segments; each node may end rules.

    The last piece of a rule's path need not be a whole segment, so a node keeps the
    partial segments that end rules there, by length.
    """

    __slots__ = ("root",)

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for action, host, path in rules:
            node = self.root
            for label in reversed(host.translate(_ASCII_LOWER).split(".")):
                node = node.setdefault(("h", label), {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(("p", segment), {})
            ends = node.setdefault("ends", {}).setdefault(len(last), {})
            if ends.get(last, (None,))[0] != BLOCK:
                ends[last] = (action, host + path)

    def match(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """(host labels, path length, action, rule) of the best rule, or None."""
        best, node = None, self.root
        for depth, label in enumerate(reversed(host.split(".")), 1):
            node = node.get(("h", label))
            if node is None:
                break
            best = self._path(node, path, depth) or best
        return best

    @staticmethod
    def _path(node: dict, path: str, depth: int) -> tuple[int, int, str, str] | None:
        best, used = None, 0
        for segment in path.split("/"):
            for size, ends in node.get("ends", {}).items():
                hit = ends.get(segment[:size]) if len(segment) >= size else None
                if hit and (best is None or used + size > best[1]):
                    best = (depth, used + size, *hit)
            node = node.get(("p", segment))
            if node is None:
                break
            used += len(segment) + 1
        return best


def _passes(rules: list[tuple[str, str, str]]) -> list[list[tuple[str, str, str]]]:
    out: list[list[tuple[str, str, str]]] = [[]]
    size = 0
    for r in rules:
        size += len(r[1]) + len(r[2])
        if size > TRIE_CHARS and out[-1]:
            out.append([])
            size = len(r[1]) + len(r[2])
        out[-1].append(r)
    return out


def _matcher(shared):
    """A vectorised UDF that looks hosts and paths up in the broadcast trie."""

    @F.pandas_udf("labels int, length int, blocks int, action string, rule string")
    def best(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for host, path in batches:
            hits = [shared.value.match(h, p) or (None,) * 4 for h, p in zip(host, path, strict=True)]
            frame = pd.DataFrame(hits, columns=["labels", "length", "action", "rule"]).astype({"labels": "Int32", "length": "Int32"})
            frame.insert(2, "blocks", (frame["action"] == BLOCK).astype("Int32"))
            yield frame

    return best


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """Append host, path, rule and verdict to every row of ``df``.

    ``rules`` are (allow or block, host, path prefix). A list beyond ``TRIE_CHARS`` is cut into
    several tries, each broadcast in turn, and the best of their matches is kept.
    """
    sc = df.sparkSession.sparkContext
    url = F.col(f"`{url_col}`")
    out = df.withColumns({"host": host_of(url), "path": path_of(url)})
    found = []
    for part in _passes(rules):
        found.append(_matcher(sc.broadcast(Trie(part)))(F.col("host"), F.col("path")))
    if len(found) == 1:
        out = out.withColumn("_best", found[0])
    else:
        out = out.withColumns({f"_m{i}": c for i, c in enumerate(found)})
        out = out.withColumn("_best", F.array_max(F.filter(F.array(*[f"_m{i}" for i in range(len(found))]), lambda m: m["labels"].isNotNull())))
    return (out.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce(F.col("_best.action"), F.lit(default))})
            .drop("_best", *[f"_m{i}" for i in range(len(found))]))


#: The rules of the registered query.
PAGE_RULES = [(ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"),
              (ALLOW, "com", "/fr/"), (BLOCK, "com", "/de/")]


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = plain(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url")
    return judge_urls(pages, PAGE_RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    row_number() OVER () AS row_no
  FROM pages),
r(action, rhost, rpath) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'),
  ('allow','com','/fr/'), ('block','com','/de/')),
m AS (
  SELECT u.row_no, arg_max(rhost || rpath, length(rhost) * 100000 + length(rpath)) AS rule,
    arg_max(action, length(rhost) * 100000 + length(rpath)) AS action
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY u.row_no)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN m USING (row_no)
"""
