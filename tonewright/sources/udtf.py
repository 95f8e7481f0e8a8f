"""Table functions that split files: pages, frames, blocks and tag frames, one row each.

    spark.sql("SELECT f.path, p.* FROM files f, LATERAL ogg_pages(f.content) p")

register_all(spark) makes them known to SQL. Where frames follow one another by sizes in their own
headers, the scan is sequential in a file; files are read in parallel. A malformed file gives the
rows before its fault, unless the function says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tonewright.sources import aac, flac, mpeg, ogg, tags
from tonewright.sources.errors import AudioError


@udtf(returnType="page_no int, at int, flags int, granule bigint, serial bigint, number bigint, lacing array<int>, body binary, head binary")
class OggPages:
    def eval(self, content: bytes) -> Iterator[tuple]:
        at = k = 0
        while content is not None and content[at : at + 4] == b"OggS":
            try:
                p, at = ogg.parse_page(content, at)
            except AudioError:
                return
            yield k, p.at, p.flags, p.granule, p.serial, p.number, list(p.lacing), p.body, content[p.at : p.at + 27 + len(p.lacing)]
            k += 1


@udtf(returnType="frame_no int, at int, version string, layer string, bitrate int, sample_rate int, channel_mode string, frame_size bigint, samples_per_frame int, padding boolean")
class MpegFrames:
    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            found = mpeg.scan(content or b"")
        except AudioError:
            return
        for k, f in enumerate(found):
            yield k, f.at, f.version, f.layer, f.bitrate, f.sample_rate, f.channel_mode, f.frame_size, f.samples_per_frame, f.padding


@udtf(returnType="frame_no int, at int, profile int, sample_rate int, channels int, frame_length int, payload binary")
class AdtsFrames:
    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            found = aac.frames(content or b"")
        except AudioError:
            return
        for k, f in enumerate(found):
            yield k, f.at, f.profile, f.sample_rate, f.channels, f.frame_length, content[f.at + f.header_size : f.at + f.frame_length]


@udtf(returnType="block_no int, kind int, at int, size int, content binary")
class FlacBlocks:
    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            found = flac.metadata(content or b"").blocks
        except AudioError:
            return
        for k, (kind, at, size) in enumerate(found):
            yield k, kind, at, size, content[at : at + size]


@udtf(returnType="sample_number bigint, byte_offset bigint, frame_samples int")
class FlacSeekPoints:
    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            yield from flac.metadata(content or b"").seek_points
        except AudioError:
            return


@udtf(returnType="frame_no int, at int, size int, start bigint, block int, channel_code int, bits int")
class FlacFrames:
    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            found = flac.index(content or b"")
        except AudioError:
            return
        for k, f in enumerate(found):
            yield k, f.at, f.size, f.start, f.block, f.channel_code, f.bits


@udtf(returnType="frame_no int, id string, body binary")
class Id3Frames:
    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            found = tags.id3_frames(content or b"")
        except AudioError:
            return
        for k, (name, body) in enumerate(found):
            yield k, name, body


@udtf(returnType="pair_no int, field string, value string")
class VorbisPairs:
    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            found = tags.vorbis_pairs(content or b"")
        except AudioError:
            return
        for k, (field, value) in enumerate(found):
            yield k, field, value


FUNCTIONS = {
    "ogg_pages": OggPages,
    "mpeg_frames": MpegFrames,
    "adts_frames": AdtsFrames,
    "flac_blocks": FlacBlocks,
    "flac_seek_points": FlacSeekPoints,
    "flac_frames": FlacFrames,
    "id3_frames": Id3Frames,
    "vorbis_pairs": VorbisPairs,
}


def register_all(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
