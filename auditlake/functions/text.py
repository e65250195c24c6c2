"""Text, URL, JSON and requirement functions: Catalyst expressions where they are exact, Arrow functions where they are not."""

from __future__ import annotations

import ipaddress
import json
import re
import shlex
import unicodedata
import urllib.parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

#: Blanks as Python counts them: Unicode spaces and the four separators 0x1c to 0x1f.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"


def strip(c: Column) -> Column:
    """Blanks of any kind off both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def head(c: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(c, 1, n)


def split_extension(c: Column) -> Column:
    """Last extension with its dot; leading dots of a name begin no extension."""
    return F.regexp_extract(F.regexp_extract(c, r"([^/]*)$", 1), r"^\.*[^.].*?(\.[^.]*)$", 1)


def flatten(c: Column) -> Column:
    """Soft line breaks turned to single blanks."""
    return F.trim(F.regexp_replace(c, r"[ \t]*\n[ \t]*", " "))


def url_host(c: Column) -> Column:
    """Host of an address in lower case without user, port and brackets, '' if it has none."""
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[([^\]/?#]*)\]|([^/?#:\[]*))", 2))


_ADDRESS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^/?#:\[]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_split(c: Column) -> Column:
    """Parts of an address: scheme and host in lower case, user, port, path, query and fragment; empty parts are null, and all of them where it is none."""
    part = lambda k: F.nullif(F.regexp_extract(c, _ADDRESS, k), F.lit(""))
    return F.struct(F.lower(part(1)).alias("scheme"), part(2).alias("user"), F.lower(part(3)).alias("host"), part(4).cast("int").alias("port"), part(5).alias("path"), part(6).alias("query"), part(7).alias("fragment"))


def url_unsplit(parts: Column) -> Column:
    """Address of its parts; null without a scheme."""
    extra = lambda name, sign: F.coalesce(F.concat(F.lit(sign), parts[name].cast("string")), F.lit(""))
    user = F.coalesce(F.concat(parts["user"], F.lit("@")), F.lit(""))
    return F.concat(parts["scheme"], F.lit("://"), user, F.coalesce(parts["host"], F.lit("")), extra("port", ":"), F.coalesce(parts["path"], F.lit("")), extra("query", "?"), extra("fragment", "#"))


def clean_source(c: Column) -> Column:
    """Address without user information, query and fragment; a text that is no address loses what stands behind its first ? or #."""
    parts = url_split(c)
    bare = F.concat(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1), F.regexp_extract(c, _ADDRESS, 3), F.coalesce(F.concat(F.lit(":"), F.nullif(F.regexp_extract(c, _ADDRESS, 4), F.lit(""))), F.lit("")), F.regexp_extract(c, _ADDRESS, 5))
    return F.when(parts["scheme"].isNotNull(), bare).otherwise(F.regexp_replace(c, r"[?#].*$", ""))


def privacy(c: Column) -> Column:
    """Keys, bearer values, named secrets, mail addresses and address credentials blanked; line breaks stay."""
    c = F.regexp_replace(c, r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z0-9 ]*PRIVATE KEY-----", "[private key]")
    c = F.regexp_replace(c, r"(?i)(bearer|token|basic)[ ]+[A-Za-z0-9._~+/=-]{12,}", "$1 [redacted]")
    c = F.regexp_replace(c, r"(sk-|gh[pousr]_|npm_|xox[abprs]-|AKIA|ASIA)[A-Za-z0-9_-]{12,}", "[redacted]")
    c = F.regexp_replace(c, r"(?i)((password|passwd|secret|api[_-]?key|token)[\"']?[ ]*[:=][ ]*[\"']?)[^\s\"',;]{6,}", "$1[redacted]")
    return F.regexp_replace(c, r"([a-z][a-z0-9+.-]*://)[^/@\s:]+:[^/@\s]+@", "$1[redacted]@")


PRIVACY_SQL = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[A-Za-z0-9+/=\\s]*-----END [A-Z0-9 ]*PRIVATE KEY-----', '[private key]', 'g'),
 '(?i)(bearer|token|basic)[ ]+[A-Za-z0-9._~+/=-]{12,}', '\\1 [redacted]', 'g'),
 '(sk-|gh[pousr]_|npm_|xox[abprs]-|AKIA|ASIA)[A-Za-z0-9_-]{12,}', '[redacted]', 'g'),
 '(?i)((password|passwd|secret|api[_-]?key|token)["'']?[ ]*[:=][ ]*["'']?)[^\\s"'',;]{6,}', '\\1[redacted]', 'g'),
 '([a-z][a-z0-9+.-]*://)[^/@\\s:]+:[^/@\\s]+@', '\\1[redacted]@', 'g')"""


def _each(values: pd.Series, fn) -> pd.Series:
    return pd.Series([None if v is None else fn(v) for v in values], dtype=object)


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    return _each(s, str.casefold)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return _each(s, lambda v: unicodedata.normalize("NFC", v))


@F.pandas_udf(StringType())
def python_repr(s: pd.Series) -> pd.Series:
    return _each(s, repr)


def shown(v: str) -> str:
    """A name with control, format and line characters and backslashes escaped."""
    return "".join(c if c.isprintable() and c != "\\" else c.encode("unicode_escape").decode() for c in v)


@F.pandas_udf(StringType())
def shown_name(s: pd.Series) -> pd.Series:
    return _each(s, shown)


@F.pandas_udf(ArrayType(StringType()))
def split_lines(s: pd.Series) -> pd.Series:
    """Lines at every Unicode line boundary."""
    return _each(s, str.splitlines)


def shell_words(v: str) -> list[str] | None:
    try:
        return shlex.split(v)
    except ValueError:
        return None


@F.pandas_udf(ArrayType(StringType()))
def words(s: pd.Series) -> pd.Series:
    """Words of a command line; null where a quote is not closed."""
    return _each(s, shell_words)


@F.pandas_udf(StringType())
def quote(s: pd.Series) -> pd.Series:
    return _each(s, urllib.parse.quote)


@F.pandas_udf(StringType())
def unquote(s: pd.Series) -> pd.Series:
    return _each(s, urllib.parse.unquote)


def canonical(v: str) -> str | None:
    """JSON with sorted keys in ASCII; null if it is none."""
    try:
        return json.dumps(json.loads(v), sort_keys=True, ensure_ascii=True, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    return _each(s, canonical)


def prompts(v: str, keys: tuple[str, ...] = ("prompt", "description", "instructions", "message", "text", "content")) -> list[tuple[str, str]]:
    """``(path, text)`` of the fields of a configuration that carry prose, at any depth."""
    out: list[tuple[str, str]] = []
    try:
        todo = [("", json.loads(v))]
    except (ValueError, RecursionError):
        return out
    while todo:
        path, x = todo.pop()
        if isinstance(x, dict):
            todo += [(f"{path}.{k}" if path else k, y) for k, y in reversed(list(x.items()))]
        elif isinstance(x, list):
            todo += [(f"{path}[{i}]", y) for i, y in reversed(list(enumerate(x)))]
        elif isinstance(x, str) and re.sub(r"\[\d+\]$", "", path).rsplit(".", 1)[-1].lower() in keys:
            out.append((path, x))
    return out


@F.pandas_udf(ArrayType(StructType([StructField("path", StringType()), StructField("text", StringType())])))
def prompt_fields(s: pd.Series) -> pd.Series:
    return _each(s, prompts)


def public_address(v: str) -> bool | None:
    """Whether an address is one of the open internet; mapped and translated IPv4 addresses count as what they carry."""
    try:
        a = ipaddress.ip_address(v)
    except ValueError:
        return None
    if isinstance(a, ipaddress.IPv6Address):
        if a.ipv4_mapped:
            a = a.ipv4_mapped
        elif a in ipaddress.ip_network("64:ff9b::/96"):
            a = ipaddress.IPv4Address(int(a) & 0xFFFFFFFF)
    return a.is_global and not a.is_multicast


@F.pandas_udf(BooleanType())
def is_public_address(s: pd.Series) -> pd.Series:
    return _each(s, public_address)


def exact_pin(spec: str) -> bool:
    """Whether a package argument of a runner names one exact version."""
    return bool(re.search(r"(?:(?<!^)@|===?)v?\d+(?:\.\d+)+(?:[-+.][0-9A-Za-z.+-]*)?$", spec.strip()))


@F.pandas_udf(BooleanType())
def is_exact_pin(s: pd.Series) -> pd.Series:
    return _each(s, exact_pin)
