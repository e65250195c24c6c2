"""Source and configuration files that are not valid in the language their name promises.

Language by extension, in every directory and kind: Python 3, shell (bash
syntax), JavaScript modules, TypeScript, strict JSON and TOML.  JavaScript,
TypeScript, Python and JSON are lexed in chunks whose state maps and bracket
summaries are reduced associatively; only a balanced text goes on to be parsed
statement by statement (``script_grammar``, ``statement_grammar``).  Shell texts
are read in one pass, as here-documents and nested substitutions make the state
between two chunks unbounded; TOML by its own parser, as a key or table given
twice anywhere in the document makes it invalid.

Null text is not judged.  An empty JSON file is invalid, an empty file of any
other language is valid.  A file nested too deeply for its parser counts as
invalid with the reason ``too complex``.
"""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import script_grammar, shell_grammar, statement_grammar
from .common import extension, map_rows

LANGUAGES = {".py": "python", ".sh": "shell", ".js": "javascript", ".ts": "typescript", ".json": "json", ".toml": "toml"}


def toml_error(text: str) -> str | None:
    try:
        tomllib.loads(text)
    except ValueError as e:
        return str(e)
    except RecursionError:
        return "too complex"
    return None


CHECKS = {
    ".py": statement_grammar.python_error,
    ".sh": shell_grammar.check,
    ".js": lambda text: script_grammar.check(text, False),
    ".ts": lambda text: script_grammar.check(text, True),
    ".json": statement_grammar.json_error,
    ".toml": toml_error,
}


def syntax_flags(df: DataFrame) -> DataFrame:
    """``artifact_id, pkg_id, language, is_valid, reason``: one row for each delivery of a file in one of the languages.

    Only the files of these languages leave the scan, and the text goes no further than the worker.
    """
    ext = extension()
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    kept = df.where(F.col("text").isNotNull()).withColumn("ext", ext).where(F.col("ext").isin(*LANGUAGES))

    def one(i: int, pkg: str | None, kind: str, text: str) -> list[tuple]:
        why = CHECKS[kind](text)
        return [(i, pkg, kind, why is None, why and why[:200])]

    out = map_rows(kept, one, "artifact_id long, pkg_id string, ext string, is_valid boolean, reason string", ["artifact_id", "pkg_id", "ext", "text"])
    return out.withColumn("language", names[F.col("ext")]).drop("ext")


def invalid_rates(flags: DataFrame, packages: DataFrame) -> DataFrame:
    """``repo, language, n_files, n_invalid, invalid_rate`` over files counted once each.

    Counts are summed per package before the join, so a package with a tenth of
    all files is one row a language there; files without a repository are the
    group with null ``repo``.
    """
    files = flags.groupBy("artifact_id", "language").agg(F.first("pkg_id", ignorenulls=True).alias("pkg_id"), F.min("is_valid").alias("is_valid"))
    per = files.groupBy("pkg_id", "language").agg(F.count("*").alias("n"), F.count_if(~F.col("is_valid")).alias("bad"))
    repos = packages.select("pkg_id", "repo").groupBy("pkg_id").agg(F.max("repo").alias("repo"))
    return (
        per.join(repos, "pkg_id", "left")
        .groupBy("repo", "language")
        .agg(F.sum("n").alias("n_files"), F.sum("bad").alias("n_invalid"))
        .withColumn("invalid_rate", F.col("n_invalid") / F.col("n_files"))
    )
