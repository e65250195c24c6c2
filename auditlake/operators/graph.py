"""Relations between the files of a package: governing manifest, links, reach."""

from __future__ import annotations

import functools
import posixpath
import re
import unicodedata
import urllib.parse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def directory(rel: str = "rel"):
    """Directory of a path, '' at the root."""
    return F.regexp_replace(F.col(rel), r"/?[^/]*$", "")


def governing_manifest(artifact_files: DataFrame) -> DataFrame:
    """The manifest in the nearest directory at or above each file: ``pkg_id, rel, manifest`` (null if none).

    Every file names its ancestor directories (depth of the path, not size of
    the package), which meet the manifests by equality; the deepest wins by an
    aggregate, so no window over a package is sorted.
    """
    manifests = artifact_files.where("kind = 'skill_manifest'").groupBy("pkg_id", directory().alias("dir")).agg(F.min("rel").alias("manifest"))
    parts = F.split(directory(), "/")
    ups = F.when(directory() == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))))
    paths = artifact_files.select("pkg_id", "rel").distinct().withColumn("ups", ups)
    met = paths.select("pkg_id", "rel", F.explode("ups").alias("dir")).join(manifests, ["pkg_id", "dir"])
    best = met.groupBy("pkg_id", "rel").agg(F.max_by("manifest", F.length("dir")).alias("manifest"))
    return paths.select("pkg_id", "rel").join(best, ["pkg_id", "rel"], "left")


_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:")


def resolve_link(source: str | None, href: str | None) -> str | None:
    """Path inside the package that a link in ``source`` names; null for other schemes, anchors and paths that leave the package."""
    if source is None or href is None:
        return None
    href = re.split(r"[?#]", href.strip().strip("<>"), maxsplit=1)[0]
    if not href or _SCHEME.match(href) or href.startswith(("/", "\\")):
        return None
    path = unicodedata.normalize("NFC", urllib.parse.unquote(href))
    path = posixpath.normpath(posixpath.join(posixpath.dirname(source), path))
    return None if path.startswith("..") or path == "." else path


@F.pandas_udf(StringType())
def _resolve(source: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([resolve_link(a, b) for a, b in zip(source, href)], dtype=object)


def references(artifacts: DataFrame) -> DataFrame:
    """Links between files of one package: ``pkg_id, source, target``."""
    hrefs = F.regexp_extract_all("text", F.lit(r"\]\(([^()\s]+)"), F.lit(1))
    links = artifacts.where(F.col("kind").isin("skill_manifest", "instruction", "agent_identity", "doc") & F.col("text").contains("](")).select("pkg_id", F.col("rel").alias("source"), F.explode(hrefs).alias("href"))
    named = links.distinct().withColumn("target", _resolve("source", "href")).where("target is not null").select("pkg_id", "source", "target").distinct()
    there = artifacts.select("pkg_id", F.col("rel").alias("target")).distinct()
    return named.join(there, ["pkg_id", "target"]).select("pkg_id", "source", "target")


#: Rounds of a reach whose findings are kept apart before they are written as one.
TOGETHER = 16


def reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes ``pkg_id, rel`` reachable from ``roots`` over ``edges``, roots included.

    Each round joins only what the last one found, until it finds nothing new, so
    a chain of any length is followed to its end.  What a round finds is written
    once to the checkpoint folder; the rounds are put together in one file set
    every ``TOGETHER`` rounds, so that neither the plan nor the writing grows with
    the length of a chain times its files.
    """
    front = roots.select("pkg_id", "rel").distinct().checkpoint()
    parts = [front]
    while True:
        step = front.select("pkg_id", F.col("rel").alias("source")).join(edges, ["pkg_id", "source"]).select("pkg_id", F.col("target").alias("rel")).distinct()
        reached = functools.reduce(DataFrame.unionByName, parts)
        front = step.join(reached, ["pkg_id", "rel"], "left_anti").checkpoint()
        if front.isEmpty():
            return reached
        parts.append(front)
        if len(parts) > TOGETHER:
            parts = [functools.reduce(DataFrame.unionByName, parts).checkpoint()]
