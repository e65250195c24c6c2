"""Scripts of characters: ranges of code points by script, prototypes in ASCII, and how much native script stands around a line."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lines import FILE

_COMMON = {"DIGIT", "MODIFIER", "COMBINING", "FULLWIDTH", "HALFWIDTH", "SUPERSCRIPT", "SUBSCRIPT", "FEMININE", "MASCULINE", "MICRO", "SCRIPT", "DOUBLE-STRUCK", "MATHEMATICAL", "CIRCLED", "PARENTHESIZED", "SQUARED", "ROMAN", "OLD", "SMALL", "TURNED"}


@functools.cache
def script_ranges(last: int = 0x3100) -> list[tuple[int, int, str]]:
    """``(first, last, script)`` of letters, by the first word of their names: runs of neighbouring letters of one script, with ideographs and syllables as ranges of their own."""
    out: list[list] = []
    for cp in range(0x41, last):
        c = chr(cp)
        if not c.isalpha():
            continue
        word = unicodedata.name(c, "").split(" ")[0]
        script = "COMMON" if not word or word in _COMMON else word
        if out and out[-1][2] == script and cp - out[-1][1] <= 64:
            out[-1][1] = cp
        else:
            out.append([cp, cp, script])
    return [tuple(x) for x in out] + [(0x3400, 0x9FFF, "CJK"), (0xAC00, 0xD7A3, "HANGUL")]


def code_points(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Letters beyond ASCII of each text, once each: ``cp``."""
    letters = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?![\x00-\x7f])\p{L}"), F.lit(0)))
    return texts.where(F.col("text").rlike(r"[^\x00-\x7f]")).select(*keys, F.explode(letters).alias("letter")).select(*keys, "letter", _point(F.col("letter")).alias("cp"))


def _point(letter: Column) -> Column:
    """Code point of a character, from its bytes in UTF-32."""
    return F.conv(F.hex(F.encode(letter, "utf-32")), 16, 10).cast("int")


def with_script(points: DataFrame, ranges: list[tuple[int, int, str]] | None = None, width: int = 256) -> DataFrame:
    """``script`` of each ``cp``, 'Unknown' outside all ranges.

    The ranges (a fixed table of Unicode) are cut at multiples of ``width``, so the range join is one by equality on the block and at most a few ranges each.
    """
    spark: SparkSession = points.sparkSession
    cut = [(b, max(lo, b * width), min(hi, b * width + width - 1), s) for lo, hi, s in ranges or script_ranges() for b in range(lo // width, hi // width + 1)]
    table = spark.createDataFrame(cut, "block int, lo int, hi int, script string")
    met = points.withColumn("block", F.floor(F.col("cp") / width).cast("int")).join(F.broadcast(table), "block", "left")
    inside = F.col("cp").between(F.col("lo"), F.col("hi"))
    return met.groupBy(*points.columns).agg(F.coalesce(F.max(F.when(inside, F.col("script"))), F.lit("Unknown")).alias("script"))


# Letters of other scripts drawn like an ASCII letter.
ASCII_LIKE = {
    **dict(zip("аеорсухѕіјһԁԛԝ", "aeopcyxsijhdqw")), **dict(zip("АВЕКМНОРСТУХЅІЈ", "ABEKMHOPCTYXSIJ")), **dict(zip("οναικρτυχ", "ovaikptux")), **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX")),
    **dict(zip("օոսցհյ", "onughj")), **dict(zip("ɑɡı", "agi")),
}


def prototype(c: Column) -> Column:
    """ASCII letter that a letter is drawn like, null if there is none: the table, then the compatibility form of full-width letters."""
    wide = {chr(0xFF21 + k + d): chr(0x41 + k + d) for d in (0, 32) for k in range(26)}
    both = ASCII_LIKE | wide
    mapped = F.translate(c, "".join(both), "".join(both.values()))
    return F.when(mapped != c, mapped)


#: Letters of scripts whose presence around a line makes a token of that script native there.
NATIVE = "[Ͱ-ϿЀ-ԯ԰-֏֐-׿؀-ۿऀ-෿฀-๿぀-ヿ㐀-鿿가-힣]"


def native_around(lines: DataFrame, reach: int = 2, keys: tuple[str, ...] = FILE) -> DataFrame:
    """``native``: native letters in the lines up to ``reach`` before and after each line, the line itself left out."""
    own = F.length(F.regexp_replace("line", NATIVE.replace("[", "[^", 1), ""))
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(-reach, reach)
    return lines.withColumn("_own", own).withColumn("native", F.sum("_own").over(w) - F.col("_own")).drop("_own")
