"""Ogg pages and packets (RFC 3533)."""

from __future__ import annotations

import struct
from dataclasses import dataclass


from tonewright.sources.bits import crc32_ogg
from tonewright.sources.errors import AudioError, bad_data, bad_header, ended
from tonewright.sources.info import Decoded

CONTINUED, FIRST, LAST = 1, 2, 4


@dataclass
class Page:
    at: int
    flags: int
    granule: int
    serial: int
    number: int
    lacing: bytes
    body: bytes


def page_crc(page: bytes) -> int:
    """Over the page with its CRC field as zeros."""
    return crc32_ogg(page[:22] + bytes(4) + page[26:])


def parse_page(data: bytes, at: int) -> tuple[Page, int]:
    """The page at an offset and where it ends."""
    if at + 27 > len(data):
        raise ended("page header")
    magic, version, flags, granule, serial, number, crc, segments = struct.unpack_from("<4sBBqIIIB", data, at)
    if magic != b"OggS":
        raise bad_header("missing OggS capture pattern")
    if version:
        raise bad_header(f"unsupported Ogg version: {version}")
    body = at + 27 + segments
    lacing = data[at + 27 : body]
    end = body + sum(lacing)
    if len(lacing) < segments or end > len(data):
        raise ended("page body")
    if page_crc(data[at:end]) != crc:
        raise bad_data(f"page CRC mismatch at {at}")
    return Page(at, flags, granule, serial, number, lacing, data[body:end]), end


def pages(data: bytes) -> list[Page]:
    """Consecutive pages, up to the first bytes that don't begin one."""
    out, at = [], 0
    while data[at : at + 4] == b"OggS":
        page, at = parse_page(data, at)
        out.append(page)
    return out


def packets_of(found: list[Page]) -> list[bytes]:
    """Packets by lacing: a value under 255 ends one; a page that doesn't continue ends an open one."""
    out: list[bytes] = []
    open_: list[bytes] = []
    for page in found:
        if not page.flags & CONTINUED and any(open_):
            out.append(b"".join(open_))
            open_ = []
        at = 0
        for n in page.lacing:
            open_.append(page.body[at : at + n])
            at += n
            if n < 255:
                out.append(b"".join(open_))
                open_ = []
    return out + ([b"".join(open_)] if any(open_) else [])


def extract_packets(data: bytes) -> list[bytes]:
    return packets_of(pages(data))


def lacing_of(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


def build_page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = struct.pack("<4sBBqIIIB", b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + crc32_ogg(page).to_bytes(4, "little") + page[26:]


def mux(packets: list[bytes], granules: list[int], serial: int, first: int = 0, begin: bool = True, finish: bool = True) -> bytes:
    """A page for each packet; one longer than 255 segments is continued over pages."""
    out, number = [], first
    for k, (packet, granule) in enumerate(zip(packets, granules, strict=True)):
        lacing, at = lacing_of(len(packet)), 0
        for i in range(0, len(lacing), 255):
            part = lacing[i : i + 255]
            more = i + 255 < len(lacing)
            flags = CONTINUED * (i > 0) | FIRST * (begin and k == 0 and i == 0) | LAST * (finish and k == len(packets) - 1 and not more)
            out.append(build_page(flags, -1 if more else granule, serial, number, part, packet[at : at + sum(part)]))
            at += sum(part)
            number += 1
    return b"".join(out)


def decode(data: bytes) -> Decoded:
    from tonewright.sources import opus

    found = pages(data)
    packets = packets_of([p for p in found if p.serial == found[0].serial]) if found else []
    if not packets:
        raise ended("no packet")
    if not packets[0].startswith(b"OpusHead"):
        raise AudioError("UnsupportedFormat", "Ogg stream is not Opus")
    return opus.described(packets, found)


