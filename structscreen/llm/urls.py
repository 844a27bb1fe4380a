"""URL filters: allow and block entries in a trie over reversed host labels and path segments.

The trie is built on the driver from a rule list of bounded size (``MAX_RULES``, checked) and
broadcast once; each task walks it per URL.  Walking the labels from the last one visits exactly
the rules whose host is the URL's host or a parent of it; from every such node the path segments
are walked, and the last, possibly partial, segment of a rule is looked up by the lengths that a
node's rules have, longest first, so the number of rules at a node does not slow a URL.  Of all
rules that fit, the one with the longest text (host and path) wins; among equal texts, block wins.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule;
no fitting rule gives ``default``; repeated rules count once; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """``rules`` are (host, path, 'allow' or 'block').

    A node is ``{"labels": {...}, "paths": node}``; a path node is ``{"next": {segment: node},
    "ends": {partial segment: verdict}, "lengths": [longest first]}``.
    """
    rules = list(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the broadcast trie takes {MAX_RULES} at most")
    root: dict = {"labels": {}}
    for host, path, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        node = root
        for label in reversed(host.lower().split(".")):
            node = node["labels"].setdefault(label, {"labels": {}})
        at = node.setdefault("paths", {"next": {}, "ends": {}, "lengths": []})
        *whole, partial = path.split("/")
        for segment in whole:
            at = at["next"].setdefault(segment, {"next": {}, "ends": {}, "lengths": []})
        if len(partial) not in at["lengths"]:
            at["lengths"] = sorted((*at["lengths"], len(partial)), reverse=True)
        if at["ends"].get(partial) != "block":
            at["ends"][partial] = verdict
    return root


def match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule text, verdict) of the longest rule that fits, or None."""
    best = None  # (length, is block, rule, verdict)
    node, labels, segments = trie, host.split("."), path.split("/")
    for depth in range(1, len(labels) + 1):
        node = node["labels"].get(labels[-depth])
        if node is None:
            break
        if "paths" not in node:
            continue
        name, at, walked = ".".join(labels[-depth:]), node["paths"], ""
        for segment in segments:
            for length in at["lengths"]:
                verdict = at["ends"].get(segment[:length]) if length <= len(segment) else None
                if verdict:
                    rule = name + walked + segment[:length]
                    found = (len(rule), verdict == "block", rule, verdict)
                    best = found if best is None or found > best else best
                    break
            at = at["next"].get(segment)
            if at is None:
                break
            walked += segment + "/"
    return best and best[2:]


def judge_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``; columns of these names are replaced."""
    trie = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def walk(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        root = trie.value
        for hosts, paths in parts:
            found = [match(root, h, p) for h, p in zip(hosts, paths)]
            yield pd.DataFrame({"rule": [f and f[0] for f in found], "verdict": [f[1] if f else default for f in found]}, dtype=object)

    url = F.coalesce(F.col(url_col), F.lit(""))
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    parts = df.select(
        *[F.col(c) for c in kept], F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, _PARTS, 2).alias("path")
    )
    return parts.withColumn("_m", walk("host", "path")).select(*kept, "host", "path", F.col("_m.rule").alias("rule"), F.col("_m.verdict").alias("verdict"))
