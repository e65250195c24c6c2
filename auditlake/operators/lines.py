"""Lines of files and the sequential operators over them, as windows keyed by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE = ("pkg_id", "rel")


def explode_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row a line, ``line_no`` from 1; the empty line after a final newline counts."""
    keep = [c for c in df.columns if c != text]
    return df.where(F.col(text).isNotNull()).select(*keep, F.posexplode(F.split(F.col(text), "\n", -1)).alias("_p", "line")).select(*keep, (F.col("_p") + 1).alias("line_no"), "line")


def neighbours(lines: DataFrame, keys: tuple[str, ...] = FILE, reach: int = 2, itself: bool = False) -> DataFrame:
    """``around``: the lines up to ``reach`` before and after, joined by newlines."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    parts = [F.lag("line", k).over(w) for k in range(reach, 0, -1)] + ([F.col("line")] if itself else []) + [F.lead("line", k).over(w) for k in range(1, reach + 1)]
    return lines.withColumn("around", F.concat_ws("\n", *parts))


def islands(lines: DataFrame, starts: Column, keys: tuple[str, ...] = FILE, name: str = "island") -> DataFrame:
    """Number of rows with ``starts`` up to each line: a running id of the stretch it belongs to."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def paragraphs(lines: DataFrame, keys: tuple[str, ...] = FILE) -> DataFrame:
    """Stretches between blank lines: first and last line and number of characters."""
    blank = F.trim("line") == ""
    return islands(lines, blank, keys).where(~blank).groupBy(*keys, "island").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.sum(F.length("line")).alias("n_chars")).drop("island")


def fill_down(lines: DataFrame, value: Column, name: str, keys: tuple[str, ...] = FILE) -> DataFrame:
    """The last value that is not null at or before each line."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(w))


def continued(lines: DataFrame, keys: tuple[str, ...] = FILE) -> DataFrame:
    """Logical lines: physical lines that end in a backslash go on in the next one; a comment does not. First line number kept."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    goes_on = F.col("line").endswith("\\") & ~F.ltrim("line").startswith("#")
    starts = ~F.coalesce(F.lag(goes_on).over(w), F.lit(False))
    marked = lines.withColumn("_s", starts)
    joined = islands(marked, F.col("_s"), keys).withColumn("_part", F.when(goes_on, F.expr("substring(line, 1, length(line) - 1)")).otherwise(F.col("line")))
    return (
        joined.groupBy(*keys, "island")
        .agg(F.min("line_no").alias("line_no"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_part"))), lambda x: x["_part"]).alias("_parts"))
        .select(*keys, "line_no", F.array_join("_parts", "").alias("line"))
    )


def fenced(lines: DataFrame, keys: tuple[str, ...] = FILE) -> DataFrame:
    """``in_fence``: whether a line lies inside a fenced code block (the fence lines themselves do not)."""
    mark = F.col("line").rlike(r"^ {0,3}(```|~~~)")
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.when(mark, 1).otherwise(0)).over(w)
    return lines.withColumn("in_fence", ~mark & (n % 2 == 1))


# -- prose across lines ------------------------------------------------------------------------------

#: Lines that end a soft-wrapped run before them: blank, fence, list item, heading, quote or table row.
BREAKS = r"^[ \t]*($|```|~~~|[-*+][ \t]|[0-9]+[.)][ \t]|#{1,6}[ \t]|>|\|)"
ENDS = r"[.!?:][\"')*_`]*[ \t]*$"


def soft_wraps(lines: DataFrame, keys: tuple[str, ...] = FILE, most: int = 8) -> DataFrame:
    """``wrapped``: each line that begins no break with those behind it, up to a break, the end of a sentence or ``most`` lines."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(0, most)
    ahead = F.collect_list("line").over(w)
    stop = F.expr("get(filter(sequence(1, size(ahead)), k -> k = size(ahead) OR get(ahead, k) RLIKE breaks OR get(ahead, k - 1) RLIKE ends), 0)")
    out = lines.where(F.col("line").isNotNull()).withColumn("ahead", ahead).withColumns({"breaks": F.lit(BREAKS), "ends": F.lit(ENDS)})
    joined = F.array_join(F.transform(F.expr("slice(ahead, 1, stop)"), lambda x: F.trim(x)), " ")
    return out.withColumn("stop", stop).where(~F.col("line").rlike(BREAKS)).withColumn("wrapped", joined).select(*keys, "line_no", F.col("stop").cast("int").alias("n_lines"), "wrapped")


def blocks(lines: DataFrame, keys: tuple[str, ...] = FILE) -> DataFrame:
    """Paragraphs with their text: ``block_no`` from 1, first and last line, text joined by single blanks."""
    blank = F.trim("line") == ""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.trim(x["line"])), " ")
    by = islands(lines, blank, keys).where(~blank).groupBy(*keys, "island").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), text.alias("text"))
    return by.withColumn("block_no", F.row_number().over(Window.partitionBy(*keys).orderBy("start_line"))).drop("island")


ITEM = r"^([-*+]|[0-9]+[.)])[ \t]"


def carried_intros(paragraphs_: DataFrame, keys: tuple[str, ...] = FILE) -> DataFrame:
    """``intro``: the paragraph with a colon at its end that still governs a list paragraph behind it; other prose in between ends it."""
    w = Window.partitionBy(*keys).orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    item = F.col("text").rlike(ITEM)
    state = F.when(F.col("text").endswith(":"), F.col("text")).when(~item, F.lit(""))
    return paragraphs_.withColumn("_state", F.last(state, ignorenulls=True).over(w)).where(item).select(*keys, "block_no", F.nullif("_state", F.lit("")).alias("intro"))


def sentence_tails(paragraphs_: DataFrame, keys: tuple[str, ...] = FILE, most: int = 4000) -> DataFrame:
    """``tail``: the last sentence of the paragraph before, at most its last ``most`` characters."""
    last = F.right(F.regexp_extract("text", r"((?:[^.!?]|[.!?][^ ])*[.!?]?[\"')]*)$", 1), F.lit(most))
    w = Window.partitionBy(*keys).orderBy("block_no")
    return paragraphs_.withColumn("_last", F.trim(last)).withColumn("tail", F.lag("_last").over(w)).where("tail is not null").select(*keys, "block_no", "tail")


QUALIFIER = r"(?i)^(for example|e[.]g[.]|note|however|only|except|unless|but|this applies|that is)($|[^a-z])"


def merged_qualifiers(paragraphs_: DataFrame, keys: tuple[str, ...] = FILE) -> DataFrame:
    """Paragraphs with the qualifying or exemplifying ones behind them merged in: first and last line, number of paragraphs."""
    w = Window.partitionBy(*keys).orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = paragraphs_.withColumn("_g", F.sum(F.when(F.col("text").rlike(QUALIFIER) & (F.col("block_no") > 1), 0).otherwise(1)).over(w))
    return marked.groupBy(*keys, "_g").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("n_blocks")).drop("_g")


def following_lists(paragraphs_: DataFrame, keys: tuple[str, ...] = FILE, gap: int = 2) -> DataFrame:
    """For a paragraph that ends in a colon, the list paragraphs behind it with at most ``gap`` lines between: ``list_end``, ``n_lists``."""
    w = Window.partitionBy(*keys).orderBy("block_no")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    goes_on = F.col("text").rlike(ITEM + "|^>") & (F.col("start_line") - F.lag("end_line").over(w) <= gap)
    marked = paragraphs_.withColumn("_on", F.coalesce(goes_on, F.lit(False))).withColumn("_g", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(up_to))
    by = marked.groupBy(*keys, "_g").agg(F.min("start_line").alias("start_line"), F.min_by("text", "block_no").alias("_head"), F.max("end_line").alias("list_end"), (F.count("*") - 1).alias("n_lists"))
    return by.where(F.col("_head").endswith(":") & (F.col("n_lists") > 0)).select(*keys, "start_line", "list_end", "n_lists")


def first_seen(df: DataFrame, group: list[str], order: str = "line_no") -> DataFrame:
    """Groups in the order in which they are first seen: ``first_at`` and ``seen_no`` (ties by group)."""
    by = df.groupBy(*FILE, *group).agg(F.min(order).alias("first_at"))
    return by.withColumn("seen_no", F.row_number().over(Window.partitionBy(*FILE).orderBy("first_at", *group)))


#: Tokens of a line: names of variables and words of letters, digits and underscores.
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*"
ADDRESS = r"https?://[^ \t\"'`)>]+"


def own_tokens(line: Column) -> Column:
    """Tokens of a line without those of its addresses."""
    whole = F.array_distinct(F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0)))
    inside = F.flatten(F.transform(F.regexp_extract_all(line, F.lit(ADDRESS), F.lit(0)), lambda u: F.regexp_extract_all(u, F.lit(TOKEN), F.lit(0))))
    return F.array_except(whole, inside)


def adjacent_addresses(lines: DataFrame, verb: str, keys: tuple[str, ...] = FILE) -> DataFrame:
    """Address of each line with a verb of egress: on the line, on the next one if it holds nothing else, or in a link or code of the next: ``line_no, address``."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    here = F.nullif(F.regexp_extract("line", ADDRESS, 0), F.lit(""))
    alone = F.nullif(F.regexp_extract("_next", rf"^[ \t]*<?({ADDRESS})[ \t]*$", 1), F.lit(""))
    linked = F.nullif(F.regexp_extract("_next", rf"(?:\]\(|`)({ADDRESS})", 1), F.lit(""))
    return lines.withColumn("_next", F.lead("line").over(w)).where(F.col("line").rlike(verb)).select(*keys, "line_no", F.coalesce(here, alone, linked).alias("address")).where("address is not null")
