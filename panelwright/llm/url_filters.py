"""URL filters that redirects can not escape.

A rule names a host and a path prefix and fits the host with all its subdomains; the longest
fitting rule decides. Among fitting rules of one length an allow goes before a block, then the later text.
URLs joined by redirects, canonical links or refreshes are aliases: the
connected components of these links carry a block from any blocked alias to every alias that no
rule fits itself. An explicit rule, allow above all, is never overruled by an alias.

A URL is known by host, path and query; scheme and fragment do not count. Links are resolved against
the URL of their page as browsers do (relative paths, ``..``, character references); what stands
in comments, scripts and styles is no link.

Defined results: a NULL URL or one without ``://`` has an empty host and path, no rule and no
aliases, and is allowed; repeated pages are judged each; links to nowhere (other schemes, broken
hosts, tags without an end) are ignored; an empty table gives an empty result; columns other than id, URL and html are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import host_of, path_of, picked, query_of
from panelwright.llm.graph import components
from panelwright.llm.html_extraction import Scanner, attributes
from panelwright.runtime import stage


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.host, r.path, r.host + r.path, r.verdict) for r in rules], "rule_host string, rule_path string, rule string, verdict string")


def decisions(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``node``, ``rule`` and ``verdict`` of the longest rule that fits, for nodes that have one.

    Every suffix of the host at a dot is looked up in the rules, so the work per URL is its
    number of labels however many rules there are.
    """
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = urls.where("host != ''").select("node", "path", F.explode(suffixes).alias("rule_host"))
    fit = tried.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = F.max(F.struct(F.length("rule").alias("size"), (F.col("verdict") == "allow").alias("allowed"), "rule", "verdict"))
    return fit.groupBy("node").agg(best.alias("best")).select("node", "best.rule", "best.verdict")


TO = re.compile(r"""\burl\s*=\s*["']?([^"'>;]*)""", re.I)


def links_in(url: str, source: str) -> list[str]:
    """Absolute URLs of the canonical links and refreshes of a page."""
    scanner, found = Scanner(source), []
    while (tag := scanner.next()) is not None:
        _, closes, name, inner = tag
        if closes or name not in ("link", "meta", "script", "style"):
            continue
        if name in ("script", "style"):
            if not inner.rstrip().endswith("/"):
                scanner.skip_raw(name)
            continue
        given = attributes(inner)
        to = None
        if name == "link" and "canonical" in given.get("rel", "").lower().split():
            to = given.get("href")
        elif name == "meta" and given.get("http-equiv", "").strip().lower() == "refresh":
            to = m[1] if (m := TO.search(given.get("content", ""))) else None
        if to and to.strip():
            try:
                found.append(urljoin(url, to.strip()))
            except ValueError:
                continue  # no host that could be an alias
    return [to for to in found if "://" in to]


def page_links(pages: DataFrame) -> DataFrame:
    """``from_url`` and ``to_url`` of canonical links and refreshes in the html, made absolute."""
    rows = pages.where("url IS NOT NULL AND html RLIKE '(?i)canonical|refresh|&#'").select("url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(u, to) for u, h in zip(batch.column("url").to_pylist(), batch.column("html"), strict=True) for to in links_in(u, h.as_py())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([u for u, _ in pairs], pa.string()), pa.array([to for _, to in pairs], pa.string())], names=["from_url", "to_url"]
            )

    return rows.mapInArrow(run, "from_url string, to_url string")


def _node(url: Column) -> Column:
    """Host, path and query as one text: hosts hold neither slash nor question mark, paths no question mark."""
    spot = F.concat(host_of(url), path_of(url))
    return F.when(spot == "", "").otherwise(F.concat(spot, query_of(url)))


def verdicts(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Per page ``page_id``, ``host``, ``path``, the ``rule`` that fits and the ``verdict``.

    ``redirects`` (``from_url``, ``to_url``) adds links to those that the html holds.
    """
    rows = picked(pages, page_id="page_id", url="url", html="html")
    links = page_links(rows)
    if redirects is not None:
        links = links.unionByName(picked(redirects, from_url="from_url", to_url="to_url"))
    edges = links.select("from_url", "to_url").distinct()
    edges = stage(edges.select(_node(F.col("from_url")).alias("a"), _node(F.col("to_url")).alias("b")).where("a != '' AND b != '' AND a != b"))
    addressed = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), _node(F.col("url")).alias("node"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).withColumns(
        {"host": F.regexp_extract("node", "^[^/?]*", 0), "path": F.regexp_extract("node", "^[^/?]*([^?]*)", 1)}
    )
    nodes = addressed.select("node", "host", "path").union(ends.select("node", "host", "path")).distinct()
    decided = stage(decisions(nodes, rules))
    aliases = components(edges)
    blocked = aliases.join(decided.where("verdict = 'block'"), "node").select("root").distinct()
    tainted = stage(aliases.join(blocked, "root").select("node").distinct().withColumn("tainted", F.lit(True)))
    return (
        addressed.join(decided, "node", "left")
        .join(tainted, "node", "left")
        .select(
            "page_id",
            "host",
            "path",
            "rule",
            F.coalesce("verdict", F.when(F.col("tainted"), "block").otherwise("allow")).alias("verdict"),
        )
    )
