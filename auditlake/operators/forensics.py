"""What the bytes of a file are, against what its name says: formats by structure, archives behind other data, bytes that nothing refers to.

A format is only recognised when its structure holds together; a magic number
alone is nothing.  Searches for embedded programs and end records are bounded;
one that meets its bound says so (``capped``), so that no file is silently
looked at in part.
"""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

TRIES, END_RECORDS, MAX_MEMBER, MAX_7Z = 64, 128, 1 << 20, 262_144
EXECUTABLE = {"pe", "elf", "macho"}
ARCHIVE = {"zip", "gzip", "7z"}
IMAGE = {"png", "gif", "jpeg"}
DANGEROUS = EXECUTABLE | ARCHIVE
# What files of a name are expected to hold, by extension.
_IMAGES = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "gif": "gif"}
_ARCHIVES = {"zip": "zip", "gz": "gzip", "tgz": "gzip", "whl": "zip", "jar": "zip", "7z": "7z"}
_COMPILED = {"so": {"elf"}, "exe": {"pe"}, "dll": {"pe"}, "pyd": {"pe"}, "dylib": {"macho"}, "node": {"elf", "pe", "macho"}, "jar": {"zip"}, "war": {"zip"}, "o": {"elf", "macho"}, "a": set(), "class": set(), "wasm": set(), "pyc": set()}


class ByteFinding(NamedTuple):
    vector: str
    rule: str
    severity: str
    message: str
    offset: int | None
    length: int | None


def is_pe(b: bytes, at: int = 0) -> bool:
    if b[at : at + 2] != b"MZ" or len(b) < at + 64:
        return False
    head = at + struct.unpack_from("<I", b, at + 60)[0]
    if head < at + 0x40 or head + 24 > len(b) or b[head : head + 4] != b"PE\0\0":
        return False
    return head + 24 + struct.unpack_from("<H", b, head + 20)[0] <= len(b)


def is_elf(b: bytes, at: int = 0) -> bool:
    if b[at : at + 4] != b"\x7fELF" or len(b) < at + 52 or b[at + 4] not in (1, 2) or b[at + 5] not in (1, 2) or b[at + 6] != 1:
        return False
    order = "<" if b[at + 5] == 1 else ">"
    wide = b[at + 4] == 2
    if wide and len(b) < at + 64:
        return False
    version = struct.unpack_from(order + "I", b, at + 20)[0]
    size = struct.unpack_from(order + "H", b, at + (52 if wide else 40))[0]
    return version == 1 and size == (64 if wide else 52)


_CPUS = {7, 12, 18, 0x01000007, 0x0100000C, 0x01000012, 0x0200000C}


def is_macho(b: bytes, at: int = 0) -> bool:
    magic = b[at : at + 4]
    orders = {b"\xfe\xed\xfa\xce": ">", b"\xfe\xed\xfa\xcf": ">", b"\xce\xfa\xed\xfe": "<", b"\xcf\xfa\xed\xfe": "<"}
    if magic in orders and len(b) >= at + 28:
        cpu, _, kind = struct.unpack_from(orders[magic] + "III", b, at + 4)
        return cpu in _CPUS and 1 <= kind <= 11
    if magic in (b"\xca\xfe\xba\xbe", b"\xca\xfe\xba\xbf") and len(b) >= at + 8:
        n = struct.unpack_from(">I", b, at + 4)[0]
        size = 20 if magic[3] == 0xBE else 32
        return 1 <= n <= 32 and len(b) >= at + 8 + n * size and all(struct.unpack_from(">I", b, at + 8 + k * size)[0] in _CPUS for k in range(n))
    return False


def is_gzip(b: bytes, at: int = 0) -> bool:
    """One whole member: deflate, no reserved flag, checksum right, at most a MiB inflated."""
    if b[at : at + 3] != b"\x1f\x8b\x08" or len(b) < at + 18 or b[at + 3] & 0xE0:
        return False
    d = zlib.decompressobj(31)
    try:
        d.decompress(b[at:], MAX_MEMBER + 1)
    except zlib.error:
        return False
    return d.eof


def is_7z(b: bytes, at: int = 0) -> bool:
    """Both header checksums, and a next header inside the file."""
    if b[at : at + 6] != b"7z\xbc\xaf\x27\x1c" or len(b) < at + 32:
        return False
    start_crc = struct.unpack_from("<I", b, at + 8)[0]
    if zlib.crc32(b[at + 12 : at + 32]) != start_crc:
        return False
    offset, size, crc = struct.unpack_from("<QQI", b, at + 12)
    begin = at + 32 + offset
    return 1 <= size <= MAX_7Z and begin + size <= len(b) and zlib.crc32(b[begin : begin + size]) == crc


def png_end(b: bytes) -> int | None:
    """Offset after the end chunk of a sound PNG: header first, every checksum right, image data seen, empty end."""
    at, seen = 8, False
    if b[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    while at + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, at)
        end = at + 12 + size
        if end > len(b) or zlib.crc32(b[at + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0] or at == 8 and (kind != b"IHDR" or size != 13):
            return None
        seen = seen or kind == b"IDAT"
        if kind == b"IEND":
            return end if seen and size == 0 else None
        at = end
    return None


def gif_end(b: bytes) -> int | None:
    """Offset after the trailer of a GIF whose blocks follow each other."""
    if b[:6] not in (b"GIF87a", b"GIF89a") or len(b) < 14:
        return None
    at = 13 + (3 << (b[10] & 7) + 1 if b[10] & 0x80 else 0)

    def chain(i: int) -> int | None:
        while i < len(b):
            if b[i] == 0:
                return i + 1
            i += b[i] + 1
        return None

    while at is not None and at < len(b):
        if b[at] == 0x3B:
            return at + 1
        if b[at] == 0x21:
            at = chain(at + 2)
        elif b[at] == 0x2C and at + 10 < len(b):
            flags = b[at + 9]
            at = chain(at + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
        else:
            return None
    return None


def jpeg_end(b: bytes) -> int | None:
    """Offset after the end marker of a JPEG whose segments follow each other."""
    if b[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 2 <= len(b):
        if b[at] != 0xFF:
            return None
        mark = b[at + 1]
        if mark == 0xFF:
            at += 1
        elif mark == 0xD9:
            return at + 2
        elif mark == 1 or 0xD0 <= mark <= 0xD7:
            at += 2
        else:
            if at + 4 > len(b):
                return None
            at += 2 + struct.unpack_from(">H", b, at + 2)[0]
            if mark == 0xDA:  # entropy-coded data up to the next marker that is no restart or stuffed byte
                while True:
                    at = b.find(b"\xff", at)
                    if at < 0 or at + 1 >= len(b):
                        return None
                    if b[at + 1] != 0 and not 0xD0 <= b[at + 1] <= 0xD7:
                        break
                    at += 2
    return None


class Zip(NamedTuple):
    start: int
    record: int
    end: int
    sound: bool


def find_zip(b: bytes) -> tuple[Zip | None, bool]:
    """The last end record of a zip archive whose directory fits, and whether more records were there than are tried.

    Every entry of the directory must name a local header with the same name and sizes inside the file.
    """
    at, loose = len(b), None
    for _ in range(END_RECORDS):
        at = b.rfind(b"PK\5\6", 0, at)
        if at < 0:
            return loose, False
        if at + 22 > len(b):
            continue
        disk, first_disk, here, total, size, offset, comment = struct.unpack_from("<4H2IH", b, at + 4)
        end = at + 22 + comment
        if disk or first_disk or here != total or end > len(b):
            continue
        begin = at - size - offset
        if begin < 0 or size > at:
            loose = loose or Zip(at, at, end, False)
            continue
        if total == 0:
            if begin and png_end(b[:begin]) != begin and gif_end(b[:begin]) != begin and jpeg_end(b[:begin]) != begin:
                continue
            return Zip(begin, at, end, True), False
        if _directory(b, at - size, at, begin, total):
            return Zip(begin, at, end, True), False
    return loose, b.rfind(b"PK\5\6", 0, at) >= 0


def _directory(b: bytes, at: int, end: int, begin: int, total: int) -> bool:
    for _ in range(total):
        if at + 46 > end or b[at : at + 4] != b"PK\1\2":
            return False
        packed, _, n, extra, comment = struct.unpack_from("<IIHHH", b, at + 20)
        local = begin + struct.unpack_from("<I", b, at + 42)[0]
        name = b[at + 46 : at + 46 + n]
        if local + 30 > end or b[local : local + 4] != b"PK\3\4":
            return False
        ln, le = struct.unpack_from("<HH", b, local + 26)
        if b[local + 30 : local + 30 + ln] != name or local + 30 + ln + le + packed > end:
            return False
        at += 46 + n + extra + comment
    return at == end


def sniff(b: bytes) -> str:
    """Format of the bytes by their structure; 'text', or 'unknown'."""
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        return "png" if png_end(b) else "png_broken"
    for name, test in (("pe", is_pe), ("elf", is_elf), ("macho", is_macho), ("gzip", is_gzip), ("7z", is_7z)):
        if test(b):
            return name
    if gif_end(b):
        return "gif"
    if jpeg_end(b):
        return "jpeg"
    z, _ = find_zip(b)
    if z and z.sound and b[z.start : z.start + 2] == b"PK":
        return "zip"
    if b[:5] == b"%PDF-":
        return "pdf"
    return "text" if textual(b) else "unknown"


_READABLE = bytes([9, 10, 12, 13, *range(32, 127), *range(128, 256)])


def textual(b: bytes) -> bool:
    return bool(b) and b"\0" not in b and len(b.translate(None, _READABLE)) <= 0.15 * len(b)


_SIGNS = ((b"MZ", is_pe, "pe"), (b"\x7fELF", is_elf, "elf"), (b"\xfe\xed\xfa", is_macho, "macho"), (b"\xfa\xed\xfe", None, "macho"), (b"\x1f\x8b\x08", is_gzip, "gzip"), (b"7z\xbc\xaf\x27\x1c", is_7z, "7z"))


def embedded(b: bytes) -> tuple[int, str] | tuple[None, str]:
    """``(offset, format)`` of the first program or archive inside the bytes, ``(None, "capped")`` when a signature stands more often than is tried, ``(None, "")`` for none."""
    best, capped = None, False
    for sign, test, name in _SIGNS:
        at, tries = -1, 0
        while (at := b.find(sign, at + 1)) >= 0:
            begin, check = (at - 1, is_macho) if test is None else (at, test)
            if begin >= 0 and check(b, begin):
                best = min(best, (begin, name)) if best else (begin, name)
                break
            tries += 1
            if tries >= TRIES:
                capped = True
                break
    return best or (None, "capped" if capped else "")


def byte_findings(rel: str, raw: bytes) -> list[ByteFinding]:
    """Findings of a file's bytes: another format than its name says, a container behind other data, bytes that nothing refers to."""
    if not raw:
        return []
    out: list[ByteFinding] = []
    ext = rel.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if "." in rel.rsplit("/", 1)[-1] else ""
    found = sniff(raw)
    severity = _mismatch(ext, found, raw)
    if severity:
        out.append(ByteFinding("SXV-035", "magic-mismatch", severity, f"named {ext or 'without extension'}, holds {found}", 0, len(raw)))
    z, capped = find_zip(raw)
    loose = lambda s, m, a, n: out.append(ByteFinding("SXV-037", "unreferenced-bytes", s, m, a, n))
    if capped:
        loose("medium", "more end records of archives than are followed (capped)", None, None)
    elif z is None and raw[:4] in (b"PK\3\4", b"PK\5\6", b"PK\7\x08"):
        loose("low", "the archive is malformed, its trailing bytes could not be verified", 0, len(raw))
    elif z and not z.sound:
        loose("medium", "an end record of an archive whose structure does not line up", z.record, len(raw) - z.record)
    elif z:
        if z.start:
            carrier = sniff(raw[: z.start])
            whole = {"png": png_end, "gif": gif_end, "jpeg": jpeg_end}
            sound = carrier in whole and whole[carrier](raw[: z.start]) == z.start
            out.append(ByteFinding("SXV-036", "polyglot", "high" if sound else "medium", f"{z.start} bytes before a zip archive" + (f": {carrier}" if sound else ""), 0, z.start))
        if z.end < len(raw):
            at, name = embedded(raw[z.end :])
            if at:
                loose("medium", f"{at} bytes before an appended payload", z.end, at)
            loose("high" if name in DANGEROUS else "medium", f"{len(raw) - z.end - (at or 0)} bytes after the archive" + (f": {name}" if name else ""), z.end + (at or 0), len(raw) - z.end - (at or 0))
    if found in IMAGE and not (z and z.sound):
        end = {"png": png_end, "gif": gif_end, "jpeg": jpeg_end}[found](raw)
        if end < len(raw):
            name = sniff(raw[end:])
            loose("high" if name in DANGEROUS else "medium", f"{len(raw) - end} bytes after the image" + (f": {name}" if name in DANGEROUS else ""), end, len(raw) - end)
        at, name = embedded(raw[:end])
        if name in EXECUTABLE:
            loose("high", f"a program inside the image: {name}", at, end - at)
        elif name == "capped":
            loose("low", "more signatures of programs inside the image than are followed (capped)", None, None)
    elif found == "png_broken":
        loose("low", "the image is malformed, its trailing bytes could not be verified", 8, max(0, len(raw) - 8))
    return out


def _mismatch(ext: str, found: str, raw: bytes) -> str | None:
    if ext in _COMPILED and not (ext in _ARCHIVES and found == _ARCHIVES[ext]):
        return "high" if found in DANGEROUS and found not in _COMPILED[ext] else None
    declared = "image" if ext in _IMAGES else "archive" if ext in _ARCHIVES else ext if ext in ("svg", "pdf") else "text"
    if declared == "text" and textual(raw):
        return None
    if found in EXECUTABLE:
        return "high"
    if found in ARCHIVE:
        return ("medium" if found != _ARCHIVES[ext] else None) if declared == "archive" else "high"
    if found in IMAGE:
        if declared == "archive":
            return "medium"
        return "low" if declared in ("text", "svg", "pdf") or found != _IMAGES.get(ext) else None
    return "medium" if found == "text" and declared in ("image", "archive") else None
