"""URL filters: sort-merge range join of pages with nested host/path rules.

A host's canonical key is its labels reversed, each followed by a dot
(``a.example.net`` -> ``net.example.a.``), so that a rule's host and all its
subdomains are one key interval and intervals are nested or apart.  Pages and
rule starts are range-partitioned and sorted together by key; a sweep keeps a
stack of the rules whose interval is open and asks the most specific host first, its
longest fitting path first.  Partition boundaries also split a hot host,
as the page id is part of the range key.  Rules still open where a partition
starts are found by an equi-join on the ancestors of its first key.

Defined results: a null url, or one without ``://``, has an empty host and
path; only a rule with an empty host can fit it.  Paths are compared as they stand, case
included.  Of rules with the same host and path, ``block`` wins.  Repeated
pages give repeated rows; an empty rule table leaves the default verdict;
an empty page table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, parts_for

PAGES_PER_PART = 100_000


def url_host_path(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: after ``://`` up to ``/ ? #``, then up to ``? #``."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise(F.lit(""))
    return (ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _sweep(default: str):
    def sweep(events: pd.DataFrame) -> pd.DataFrame:
        events = events.sort_values(["key", "kind"], kind="stable")
        stack: list[tuple[str, dict]] = []  # open rule hosts, outermost first: path -> (action, rule)
        ids, hosts, paths, rules, verdicts = [], [], [], [], []
        for key, kind, page_id, host, path, action in events[
                ["key", "kind", "page_id", "host", "path", "action"]].itertuples(index=False, name=None):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}))
                known = stack[-1][1]
                if path not in known or action == "block":
                    known[path] = (action, host + path)
                continue
            found = (default, None)
            for _, known in reversed(stack):
                fits = [p for p in known if path.startswith(p)]
                if fits:
                    found = known[max(fits, key=len)]
                    break
            ids.append(page_id)
            hosts.append(host)
            paths.append(path)
            rules.append(found[1])
            verdicts.append(found[0])
        return pd.DataFrame({"page_id": pd.array(ids, dtype="Int64"), "host": hosts, "path": paths,
                             "rule": pd.Series(rules, dtype="object"), "verdict": verdicts})
    return sweep


def apply_url_rules(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                    default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict.

    ``rules`` has columns host, path, action (``allow`` or ``block``)."""
    host, path = url_host_path(F.col(f"`{url_col}`").cast("string"))
    page_rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    page_rows = page_rows.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "page_id", "host", "path",
                                 F.lit(None).cast("string").alias("action"))
    rule_rows = rules.select(ascii_lower(F.coalesce("host", F.lit(""))).alias("host"),
                             F.coalesce("path", F.lit("")).alias("path"), F.lower("action").alias("action"))
    rule_rows = rule_rows.select(host_key(F.col("host")).alias("key"), F.lit(0).alias("kind"),
                                 F.lit(None).cast("long").alias("page_id"), "host", "path", "action")
    parts = parts_for(pages.count(), PAGES_PER_PART, 8)
    events = materialise(page_rows.unionByName(rule_rows)
                         .repartitionByRange(parts, "key", "kind", "page_id")
                         .withColumn("part", F.spark_partition_id()), "url-events")
    labels = F.filter(F.split("first", r"\."), lambda x: x != "")
    above = F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))),
        lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("."))))
    starts = (events.groupBy("part").agg(F.min("key").alias("first"))
              .select("part", F.explode(above).alias("key")).distinct())
    open_rules = starts.join(rule_rows, "key").select(*events.columns)
    return (events.unionByName(open_rules).groupBy("part")
            .applyInPandas(_sweep(default), "page_id long, host string, path string, rule string, verdict string"))
