"""Credentials in source code, configuration, key files and code shown in Markdown: their places, and texts with them redacted.

A text is scanned for key containers, tokens of known shape, named values,
authorisation headers, command-line passwords and addresses with a password.
Literals that hold another layer (base64, hex, percent or backslash escapes)
are decoded and scanned again, layer by layer, until nothing decodes any more
(each layer is shorter than the literal that held it); a binary layer and the
body of a PEM block are parsed to the end as a key container (PKCS#1, PKCS#8
plain and encrypted, SEC1, DSA, PKCS#12, OpenSSH).  A hit in a decoded layer redacts the literal that encloses it, re-encoded where
the layer can be written again, so the file stays as valid as before.

Null text gives nothing; an empty text is returned as it is; a file delivered
several times gives the same places each time (callers count it once).
"""

from __future__ import annotations

import base64
import bisect
import binascii
import re
import struct
import urllib.parse
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame

from .common import map_rows

MASK = "REDACTED"


class Hit(NamedTuple):
    start: int
    end: int
    kind: str
    mask: str


# A name is a credential's if one of these stands in it as a word of its own.
_SECRET = r"pass(?:w(?:or)?d|phrase|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|signing[_-]?key|secret[_-]?key|encryption[_-]?key|auth[_-]?key|auth[_-]?token|client[_-]?secret|credentials?"
_NAME = re.compile(
    rf"""(?<![A-Za-z0-9])(?P<name>(?:[A-Za-z0-9]+[_.-])*(?:[a-z0-9]+(?=[A-Z]))?(?i:{_SECRET})(?![a-z])(?:[_-][A-Za-z0-9_]+)?)["'`]?\s*(?:(?P<op>:=|=>|==?|:|,)\s*|(?P<gap>\s))""",
)
_NOT_NAME = re.compile(r"(?i)(?:^|[_.-])(?:count|counts|len|length|limit|max|min|ttl|expir\w*|type|kind|file|path|dir|url|uri|endpoint|ids?|idx|index|size|hash|digest|public|pub|tokenizer|budget|usage|regex|pattern|field|header|prompt|name|env)(?:$|[_.-])")
_QUOTED = re.compile(r"""(?P<q>"|'|`)(?P<v>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)""")
_MORE = re.compile(r"""\s*(?:\+|\\)?\s*(?P<q>"|'|`)(?P<v>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)""")
_OPEN = re.compile(r"\(\s*")
_BARE = re.compile(r"""[^\s"'`,;<>(){}\[\]|\\]+""")
_PLACE = re.compile(
    r"""(?i)^(?:\$|<|%\(|%\w+%$|\{|\[|vault:|env[:.]|ref[:+]|secret[s]?[:.]|op://|ssm:|arn:|file:|\?|your[_\- ]|my[_-]?(?:secret|token|password)|(?:replace|change|insert|todo|tbd|example|sample|dummy|fake|placeholder|redacted|missing|set[_ -]?me)(?![a-z])|replace[_-]?me|change[_-]?(?:me|this|it)|none$|null$|true$|false$|undefined$|x{4,}|\*{3,}|\.{3}|-{3,}|_{3,}|process\.env|os\.(?:environ|getenv)|getenv|import\.meta|sha\d+[:-])|example$|EXAMPLE|x{8,}|\*{4,}"""
)
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9_/+-])(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_-]{18,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{28,}|AIza[A-Za-z0-9_-]{30,}|xox[abeposr]-[A-Za-z0-9-]{12,}|(?:AKIA|ASIA)[A-Z0-9]{16}|pypi-[A-Za-z0-9_-]{30,}|sk-[A-Za-z0-9_-]{24,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"
)
_HEADER = re.compile(r"""(?i)\bauthorization["'`]?\s*[:=,]\s*["'`]?(?P<scheme>basic|bearer|token|digest|apikey)\s+(?P<v>[^\s"'`<>,;)}\]\\]+)""")
_URL = re.compile(r"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@"'`<>]*:(?P<v>[^\s/"'`<>]+)@(?=[^\s"'`<>/])""")
_USER = re.compile(r"""(?:\bcurl\b[^\n]*?\s(?:-u|--user)|\bwget\b[^\n]*?--user)[\s=]+["']?[^\s:"']+:(?P<v>[^\s"']+)""")
_DASH_P = re.compile(r"""\b(?:mysql|mysqldump|mysqladmin|mariadb|sshpass|mongo|mongodump|psql|7z)\b[^\n|;]*?\s-p(?P<v>[^\s"'|;]{4,})""")
_FLAG = re.compile(rf"""--(?:[a-z0-9]+-)*(?i:{_SECRET})(?:["'`]\s*,\s*["'`]|[ =]["']?)(?P<v>[^\s"'`,;|<>]+)""")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_WORDS = ("pass", "pwd", "secret", "token", "key", "credential")
_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "k_live_", "k_test_", "npm_", "hf_", "AIza", "xox", "AKIA", "ASIA", "pypi-", "sk-", "SG.", "eyJ")
_LONG = re.compile(r"[A-Za-z0-9+/_-]{20}")
_LONG_HEX = re.compile(r"[0-9a-fA-F]{32}")

_B64 = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_HEX = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{2}){16,}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:[0-9A-F]{2}){16,}(?![A-Za-z0-9])")
_PERCENT = re.compile(r"(?:[A-Za-z0-9._~-]|%[0-9A-Fa-f]{2})*(?:%[0-9A-Fa-f]{2}[A-Za-z0-9._~-]{0,3}){5,}(?:[A-Za-z0-9._~-]|%[0-9A-Fa-f]{2})*")
_ESCAPED = re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}){6,}")
_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|--|;|rem\b)")
_CODE_EXT = (".py", ".js", ".ts", ".mjs", ".cjs", ".jsx", ".tsx", ".rb", ".go", ".java", ".rs", ".php")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n([\s\S]*?)(?:^ {0,3}\1[`~]*\s*$|\Z)", re.M)
_INLINE = re.compile(r"(?<!`)(`+)(?!`)([^\n]*?[^`\n])\1(?!`)")
_PRE = re.compile(r"(?is)<(pre|code)\b[^>]*>(.*?)</\1>")
_INDENT = re.compile(r"(?:(?<=\n\n)|\A)(?:(?: {4}|\t)[^\n]*(?:\n|\Z))+")


def is_secret(value: str, named: bool = True) -> bool:
    """Whether a value can be a working credential: no placeholder or reference, long and mixed enough."""
    n = len(value)
    if n < 6 or _PLACE.search(value) or "${" in value or "{{" in value or " " in value or "\t" in value:
        return False
    letters = any(c.isalpha() for c in value)
    digits = any(c.isdigit() for c in value)
    signs = any(c in "!@#$%^&*+~?=" for c in value)
    if len(set(value)) < 5 or not letters:
        return False
    if digits or signs:
        return n >= 8
    # letters only: capitals and small ones must change more often than in words joined by capitals
    mixed = sum(a.islower() != b.islower() for a, b in zip(value, value[1:]))
    return n >= 16 and mixed >= n // 4 or n >= 8 and 3 * mixed >= n


def _der(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """Tag, start and end of the content of one DER element; raises ValueError when it does not fit."""
    if at + 2 > end:
        raise ValueError
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        k = size & 0x7F
        if not 1 <= k <= 8 or at + k > end:
            raise ValueError
        size, at = int.from_bytes(data[at : at + k]), at + k
    if at + size > end:
        raise ValueError
    return tag, at, at + size


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    """Elements of a constructed one, which they must fill exactly; constructed ones among them are parsed too."""
    out, todo = [], [(at, end, True)]
    while todo:
        at, end, top = todo.pop()
        while at < end:
            tag, a, b = _der(data, at, end)
            if top:
                out.append((tag, a, b))
            if tag & 0x20:
                todo.append((a, b, False))
            at = b
    return out


INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
# Prefixes of the object ids of password-based encryption (PKCS#5 and PKCS#12) and of PKCS#7 content.
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_CONTENT = bytes.fromhex("2a864886f70d0107")


def key_container(data: bytes) -> str | None:
    """Name of the private-key container that the bytes are by their grammar, or None: public keys and certificates are none."""
    if data.startswith(b"openssh-key-v1\0"):
        return "openssh" if _openssh(data) else None
    try:
        tag, at, end = _der(data, 0, len(data))
        if tag != SEQUENCE or end != len(data):
            return None
        parts = _children(data, at, end)
        tags = [t for t, _, _ in parts]
        algorithm = next((data[a:b] for t, a, b in _children(data, *parts[tags.index(SEQUENCE)][1:]) if t == OID), None) if SEQUENCE in tags[:2] else None
    except ValueError:
        return None
    version = data[parts[0][1] : parts[0][2]] if tags[:1] == [INTEGER] else None
    if version in (b"\0", b"\1"):
        if tags[1:3] == [SEQUENCE, OCTETS] and set(tags[3:]) <= {0xA0, 0x80, 0xA1, 0x81}:
            return "pkcs8" if algorithm else None
        if version == b"\1" and tags[1:2] == [OCTETS] and set(tags[2:]) <= {0xA0, 0xA1}:
            return "sec1"
        if set(tags[:9]) == {INTEGER} and (len(tags) == 9 or len(tags) == 10 and tags[9] == SEQUENCE and version == b"\1"):
            return "pkcs1"
        return "dsa" if version == b"\0" and tags == [INTEGER] * 6 else None
    if version == b"\3" and tags[1:2] == [SEQUENCE] and len(tags) <= 3:
        return "pkcs12" if algorithm and algorithm.startswith(_CONTENT) else None
    return "encrypted_pkcs8" if tags == [SEQUENCE, OCTETS] and algorithm and algorithm.startswith(_PBE) else None


def _openssh(data: bytes) -> bool:
    """The OpenSSH container to its end: cipher, derivation and its options, number of keys, public blobs, private section."""
    at = 15

    def text() -> bytes:
        nonlocal at
        if at + 4 > len(data):
            raise ValueError
        (n,) = struct.unpack_from(">I", data, at)
        if at + 4 + n > len(data):
            raise ValueError
        at += 4 + n
        return data[at - n : at]

    try:
        cipher = text()
        text()
        text()
        if at + 4 > len(data):
            return False
        (n,) = struct.unpack_from(">I", data, at)
        at += 4
        if not 1 <= n <= len(data) // 4:
            return False
        for _ in range(n):
            text()
        secret = text()
    except ValueError:
        return False
    return at == len(data) and len(secret) >= 8 and (cipher != b"none" or secret[:4] == secret[4:8])


def _pem_keys(text: str) -> Iterator[tuple[int, int, int]]:
    """Begin of the mark, of the body and end of the body of each private key in PEM; the body runs to its END mark or the end of the text."""
    for m in _PEM.finditer(text):
        end = text.find("-----", m.end())
        if end >= 0 and not text.startswith("-----END", end):
            continue
        end = len(text) if end < 0 else end
        if end - m.end() >= 32:
            yield m.start(), m.end(), end


def _layers(text: str) -> Iterator[tuple[int, int, str | bytes, str]]:
    """Encoded literals of a text: place, decoded content, and how to write one again."""
    long = _LONG.search(text)
    for m in _B64.finditer(text) if long else ():
        v = m.group()
        try:
            data = base64.b64decode(v.replace("-", "+").replace("_", "/") + "=" * (-len(v) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        if printable(data):
            yield m.start(), m.end(), data.decode("ascii"), "base64"
        elif data[:1] == b"\x30" or data.startswith(b"openssh-key-v1\0"):
            yield m.start(), m.end(), data, "base64"
    for m in _HEX.finditer(text) if long and _LONG_HEX.search(text) else ():
        data = bytes.fromhex(m.group())
        if printable(data):
            yield m.start(), m.end(), data.decode("ascii"), "hex"
        elif data[:1] == b"\x30":
            yield m.start(), m.end(), data, "hex"
    if "%" in text:
        for m in _PERCENT.finditer(text):
            yield m.start(), m.end(), urllib.parse.unquote(m.group(), errors="replace"), "percent"
    if "\\x" in text or "\\u00" in text:
        for m in _ESCAPED.finditer(text):
            yield m.start(), m.end(), re.sub(r"\\x(..)|\\u00(..)", lambda k: chr(int(k[1] or k[2], 16)), m.group()), "escape"


def printable(data: bytes) -> bool:
    return len(data) >= 8 and all(32 <= c < 127 or c in b"\n\r\t" for c in data)


def _encode(text: str, how: str) -> str:
    if how == "base64":
        return base64.b64encode(text.encode()).decode()
    if how == "hex":
        return text.encode().hex()
    if how == "percent":
        return urllib.parse.quote(text, safe="")
    return "".join(f"\\x{b:02x}" for b in text.encode())


def _named(text: str, code: bool) -> Iterator[Hit]:
    for m in _NAME.finditer(text):
        if _NOT_NAME.search(m["name"]) or text[max(0, m.start() - 2) : m.start()] == "${":
            continue
        at = m.end()
        op = m["op"]
        if op == "==":
            continue
        if op is None:
            # "password value" as in login files; prose has such words too, so the value must be strict
            b = _BARE.match(text, at)
            start = text.rfind("\n", 0, m.start()) + 1
            login = re.match(r"\s*(?:machine\s+\S+\s+)?(?:login\s+\S+\s+)?(?:password|account)\s", text[start : at + 1])
            if b and login and is_secret(b.group()):
                yield Hit(b.start(), b.end(), "named", MASK)
            continue
        if op == ",":
            if text[m.end("name") : m.end("name") + 1] not in "\"'`" or not _QUOTED.match(text, at):
                continue
            if not re.search(r"""(?:["'`](?:-{1,2}))$""", text[max(0, m.start() - 3) : m.start()]):
                continue
        q = _QUOTED.match(text, at)
        if not q and text[at : at + 1] == "(":
            q = _QUOTED.match(text, _OPEN.match(text, at).end())
        if q:
            parts = [(q.start("v"), q.end("v"))]
            value, end = q["v"], q.end()
            while p := _MORE.match(text, end):
                if "+" not in text[end : p.start("q")] and "\\" not in text[end : p.start("q")] and "\n" not in text[end : p.start("q")]:
                    break
                if "\n" in text[end : p.start("q")] and not re.search(r"[+\\]|^\s*\n\s*$", text[end : p.start("q")]):
                    break
                if ":" in text[p.end() : p.end() + 2]:
                    break
                parts.append((p.start("v"), p.end("v")))
                value, end = value + p["v"], p.end()
            if "-----BEGIN" not in value and is_secret(value):
                for k, (a, b) in enumerate(parts):
                    yield Hit(a, b, "named" if k == 0 else "piece", MASK if k == 0 else "")
            continue
        line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        if code and not _COMMENT.match(line + "x"):
            continue
        b = _BARE.match(text, at)
        if b and "\n" not in text[m.end("name") : at] and is_secret(b.group()) and text[b.end() : b.end() + 1] not in ("(", "["):
            yield Hit(b.start(), b.end(), "named", MASK)


def _pem_container(body: str) -> str | None:
    try:
        return key_container(base64.b64decode(body, validate=True))
    except ValueError:
        return None


def scan(text: str, code: bool = False) -> list[Hit]:
    """All credentials of one text as spans, outermost layer first, without overlaps."""
    low = text.lower()
    hits: list[Hit] = []
    for start, begin, end in _pem_keys(text) if "-----BEGIN" in text else ():
        body = text[begin:end]
        plain = "".join(body.replace("\\n", "").split())
        if sum(c.isalnum() or c in "+/=" for c in body) >= 0.8 * len(plain) and not _PLACE.search(body.strip()):
            mask = re.sub(r"[A-Za-z0-9+/=:,-]+(?: [A-Za-z0-9+/=:,-]+)*", MASK, body.replace("\\n", "\n")).replace("\n", "\\n" if "\\n" in body else "\n")
            hits.append(Hit(start, end, f"private_key:{held}" if (held := _pem_container(plain)) else "private_key", text[start:begin] + mask))
    for m in _HEADER.finditer(text) if "authorization" in low else ():
        v = m["v"]
        if m["scheme"].lower() == "basic":
            try:
                plain = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode()
            except ValueError:
                continue
            user, colon, word = plain.partition(":")
            if colon and word and not _PLACE.search(word):
                hits.append(Hit(m.start("v"), m.end("v"), "basic_auth", _encode(f"{user}:{MASK}", "base64")))
        elif is_secret(v):
            hits.append(Hit(m.start("v"), m.end("v"), "header", MASK))
    for pattern, kind, sign in ((_URL, "url_password", "://"), (_USER, "basic_auth", "-u"), (_DASH_P, "password", " -p"), (_FLAG, "flag", "--")):
        for m in pattern.finditer(text) if sign in text else ():
            v = m["v"]
            if not _PLACE.search(v) and not v.startswith("$") and (is_secret(v) or kind == "url_password" and len(v) >= 6 and not v.isdigit() and not re.fullmatch(r"(?i)pass(?:word)?|secret|token|xxx+|\*+", v)):
                hits.append(Hit(m.start("v"), m.end("v"), kind, MASK))
    for m in _KNOWN.finditer(text) if any(x in text for x in _PREFIXES) else ():
        if is_secret(m.group()):
            hits.append(Hit(m.start(), m.end(), "known_shape", MASK))
    if any(w in low for w in _WORDS):
        hits += _named(text, code)
    for a, b, inner, how in _layers(text):
        if isinstance(inner, bytes):
            if held := key_container(inner):
                hits.append(Hit(a, b, f"private_key:{held}", _encode(MASK, how)))
        elif found := scan(inner):
            hits.append(Hit(a, b, found[0].kind, _encode(apply(inner, found), how)))
    return _outermost(hits)


def _outermost(hits: list[Hit]) -> list[Hit]:
    out: list[Hit] = []
    for h in sorted(set(hits), key=lambda h: (h.start, -h.end)):
        if out and h.start < out[-1].end:
            continue
        out.append(h)
    return out


def apply(text: str, hits: list[Hit]) -> str:
    parts, at = [], 0
    for h in hits:
        parts += [text[at : h.start], h.mask]
        at = h.end
    return "".join([*parts, text[at:]])


def shown_code(text: str) -> list[tuple[int, int]]:
    """Places of code in Markdown: fenced, inline, preformatted and indented."""
    spans = [m.span(2) for m in _FENCE.finditer(text)]
    inside = _blanked(text, spans)
    spans += [m.span(2) for m in _INLINE.finditer(inside)]
    spans += [m.span(2) for m in _PRE.finditer(inside)]
    spans += [m.span() for m in _INDENT.finditer(inside)]
    return sorted(spans)


def _blanked(text: str, spans: list[tuple[int, int]]) -> str:
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], re.sub(r"[^\n]", " ", text[a:b])]
        at = b
    return "".join([*out, text[at:]])


def scan_file(rel: str | None, text: str | None) -> list[Hit]:
    """Credentials of one file; in Markdown only those in code, in prose files none."""
    if not text:
        return []
    name = (rel or "").rsplit("/", 1)[-1].lower()
    if name.endswith((".md", ".markdown", ".mdx")):
        hits = []
        for a, b in shown_code(text):
            hits += [h._replace(start=h.start + a, end=h.end + a) for h in scan(text[a:b])]
        return _outermost(hits)
    if name.endswith((".txt", ".rst", ".adoc")) and not re.match(r"(?:.*require|.*constraint|.*secret|.*credential|.*password)", name):
        return []
    return scan(text, code=name.endswith(_CODE_EXT))


def places(rel: str | None, text: str | None) -> list[tuple[int, str]]:
    """``(line number, kind)`` of each credential."""
    hits = scan_file(rel, text)
    if not hits:
        return []
    lines = [m.start() for m in re.finditer("\n", text)]
    return [(bisect.bisect_left(lines, h.start) + 1, h.kind) for h in hits if h.kind != "piece"]


def credential_places(df: DataFrame) -> DataFrame:
    """``artifact_id, line_no, kind`` for every credential of the files in ``df`` (artifact_id, rel, text)."""
    return map_rows(
        df.where("text is not null"),
        lambda i, rel, text: [(i, n, k) for n, k in places(rel, text)],
        "artifact_id long, line_no int, kind string",
        ["artifact_id", "rel", "text"],
    )


def redacted(df: DataFrame) -> DataFrame:
    """``artifact_id, n_redacted, text_redacted`` of the files that hold credentials."""

    def one(i: int, rel: str, text: str) -> list[tuple]:
        hits = scan_file(rel, text)
        return [(i, sum(h.kind != "piece" for h in hits), apply(text, hits))] if hits else []

    return map_rows(df.where("text is not null"), one, "artifact_id long, n_redacted int, text_redacted string", ["artifact_id", "rel", "text"])
