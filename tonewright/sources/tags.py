"""ID3v2 and Vorbis Comment tags: frames and pairs in order; the last of a field wins."""

from __future__ import annotations

import struct

from tonewright.sources.errors import bad_header, ended

FIELDS = ("title", "artist", "album", "track_number", "year", "genre", "comment")
ID3V22 = {"TT2": "title", "TP1": "artist", "TAL": "album", "TRK": "track_number", "TYE": "year", "TCO": "genre", "COM": "comment"}
ID3V23 = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TRCK": "track_number", "TDRC": "year", "TYER": "year", "TCON": "genre", "COMM": "comment"}
VORBIS = {"TITLE": "title", "ARTIST": "artist", "ALBUM": "album", "TRACKNUMBER": "track_number", "DATE": "year", "GENRE": "genre", "COMMENT": "comment"}


def syncsafe(raw: bytes) -> int:
    return sum((b & 0x7F) << (21 - 7 * i) for i, b in enumerate(raw))


def decoded(kind: int, body: bytes) -> str | None:
    """Text by ID3 encoding, without NULs at its end; None if empty or malformed."""
    try:
        if kind == 1:
            if len(body) < 2:
                return None
            body, codec = body[2:], "utf-16-le" if body[:2] == b"\xff\xfe" else "utf-16-be"
        elif kind == 2:
            codec = "utf-16-be"
        else:
            codec = {0: "latin-1", 3: "utf-8"}[kind]
        said = body[: len(body) & ~1].decode(codec) if codec.startswith("utf-16") else body.decode(codec, "replace")
    except (KeyError, UnicodeDecodeError):
        return None
    return said.rstrip("\0") or None


def id3_frames(data: bytes) -> list[tuple[str, bytes]]:
    """(id, body) of the frames of a leading tag: v2.2 with short ids, later with long ones and sizes of v2.4 syncsafe."""
    if len(data) < 10 or data[:3] != b"ID3":
        raise bad_header("missing ID3 tag")
    version, size = data[3], syncsafe(data[6:10])
    body = data[10 : 10 + size]
    if len(body) < size:
        raise ended("ID3 tag")
    out, at, n, head = [], 0, 3 if version == 2 else 4, 6 if version == 2 else 10
    while at + head <= len(body) and body[at]:
        raw = body[at + n : at + 2 * n]
        length = syncsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        if not length or at + head + length > len(body):
            break
        out.append((body[at : at + n].decode("latin-1"), body[at + head : at + head + length]))
        at += head + length
    return out


def comment_text(body: bytes) -> str | None:
    """Of a COMM frame: encoding, language, short description, text."""
    if len(body) < 4:
        return None
    kind, rest = body[0], body[4:]
    end = b"\0\0" if kind in (1, 2) else b"\0"
    at = 0
    while at < len(rest) and rest[at : at + len(end)] != end:
        at += len(end)
    return decoded(kind, rest[at + len(end) :])


def id3_fields(data: bytes) -> dict[str, str]:
    out = {}
    names = ID3V22 if data[3:4] == b"\2" else ID3V23
    for name, body in id3_frames(data):
        field = names.get(name)
        text = comment_text(body) if field == "comment" else decoded(body[0], body[1:])
        if field and text is not None:
            out[field] = text
    return out


def vorbis_pairs(data: bytes) -> list[tuple[str, str]]:
    """FIELD (upper case) and value of each comment that has one; a cut end is left out."""
    if len(data) < 4:
        raise ended("vendor")
    at = 4 + struct.unpack_from("<I", data)[0]
    if at + 4 > len(data):
        raise ended("comments")
    count, at = struct.unpack_from("<I", data, at)[0], at + 4
    out = []
    for _ in range(count):
        if at + 4 > len(data):
            break
        n = struct.unpack_from("<I", data, at)[0]
        raw, at = data[at + 4 : at + 4 + n], at + 4 + n
        if len(raw) < n:
            break
        try:
            field, equals, value = raw.decode().partition("=")
        except UnicodeDecodeError:
            continue
        if equals and value:
            out.append((field.upper(), value))
    return out


def vorbis_fields(data: bytes) -> dict[str, str]:
    return {VORBIS[k]: v for k, v in vorbis_pairs(data) if k in VORBIS}


def opus_tags(packet: bytes) -> dict[str, str]:
    if packet[:8] != b"OpusTags":
        raise bad_header("missing OpusTags magic")
    return vorbis_fields(packet[8:])


def id3_tag(fields: dict[str, str], version: int = 3) -> bytes:
    """A tag with UTF-8 (v2.4) or UTF-16 text frames."""
    names = {v: k for k, v in reversed((ID3V22 if version == 2 else ID3V23).items())} | ({"year": "TDRC"} if version == 4 else {"year": "TYER"} if version == 3 else {})
    out = b""
    for field, text in fields.items():
        said = b"\3" + text.encode() if version == 4 else b"\1\xff\xfe" + text.encode("utf-16-le")
        if field == "comment":
            gap = b"\0" if version == 4 else b"\xff\xfe\0\0\xff\xfe"
            said = said[:1] + b"eng" + gap + (text.encode() if version == 4 else text.encode("utf-16-le"))
        name = names[field].encode()
        size = bytes(len(said) >> s & 0x7F for s in (21, 14, 7, 0)) if version == 4 else len(said).to_bytes(3 if version == 2 else 4, "big")
        out += name + size + (b"" if version == 2 else b"\0\0") + said
    return b"ID3" + bytes([version, 0, 0]) + bytes(len(out) >> s & 0x7F for s in (21, 14, 7, 0)) + out


def vorbis_comment(pairs: list[tuple[str, str]], vendor: str = "tonewright") -> bytes:
    raw = vendor.encode()
    out = struct.pack("<I", len(raw)) + raw + struct.pack("<I", len(pairs))
    for k, v in pairs:
        said = f"{k}={v}".encode()
        out += struct.pack("<I", len(said)) + said
    return out
