"""Container and frame headers as projections over BINARY columns; no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonewright.functions.numeric import ColumnOrInt, be, bits, col, joined, le, lookup, part, sign_extend, syncsafe, text, to_be, to_le

# Fixed values of ISO 11172-3, 13818-3, 13818-7 and RFC 9639.
MPEG1_L3_KBIT = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0]
MPEG2_L3_KBIT = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0]
MPEG_RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
AAC_RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]
AAC_CHANNELS = [0, 1, 2, 3, 4, 5, 6, 8]
FLAC_SIZES = [None, 192, *[144 << k for k in range(2, 6)], None, None, *[1 << k for k in range(8, 16)]]
FLAC_RATES = [None, 88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000]
FLAC_BITS = [None, 8, 12, None, 16, 20, 24, 32]


def detect_format(content: Column) -> Column:
    """Format by leading bytes; null if too short or unknown."""
    starts = lambda magic: part(content, 0, len(magic)) == text(magic)
    form = part(content, 8, 4)
    b0, b1 = be(content, 0, 1), be(content, 1, 1)
    and_ = lambda x, m: x.bitwiseAND(F.lit(m).cast("long"))
    sync = (b0 == 0xFF) & (and_(b1, 0xE0) == 0xE0)
    return F.when(
        F.octet_length(content) >= 4,
        F.when(starts("RIFF"), "Wav")
        .when(starts("fLaC"), "Flac")
        .when(starts("OggS"), "Ogg")
        .when(starts("FORM") & ((form == text("AIFF")) | (form == text("AIFC"))), "Aiff")
        .when(starts("ID3"), "Mp3")
        .when(sync & (and_(b1, 0xF6) == 0xF0), "Aac")
        .when(sync, "Mp3"),
    )


def mpeg_frame_header(content: Column, at: ColumnOrInt = 0) -> Column:
    """Struct of the 4-byte header; null if it isn't one. Layers I and II read the Layer III rates, as documented."""
    return F.element_at(F.transform(F.array(be(content, at, 4)), _mpeg_fields), 1)  # the word is read once for all fields


def _mpeg_fields(w: Column) -> Column:
    version, layer = bits(w, 19, 2), bits(w, 17, 2)
    v1, l3, l1 = version == 3, layer == 1, layer == 3
    rate_no = bits(w, 10, 2)
    kbit = F.when(~v1 & l3, lookup(bits(w, 12, 4), MPEG2_L3_KBIT)).otherwise(lookup(bits(w, 12, 4), MPEG1_L3_KBIT))
    rate = F.when(v1, lookup(rate_no, MPEG_RATES[3])).when(version == 2, lookup(rate_no, MPEG_RATES[2])).otherwise(lookup(rate_no, MPEG_RATES[0]))
    pad = bits(w, 9, 1)
    spf = F.when(l1, 384).when(l3 & ~v1, 576).otherwise(1152)
    size = F.when(l1, (F.floor(kbit * 12000 / rate) + pad) * 4).otherwise(F.floor(F.when(l3 & ~v1, 576).otherwise(1152) * kbit * 1000 / (rate * 8)) + pad)
    mode = F.element_at(F.array(*map(F.lit, ("Stereo", "JointStereo", "DualChannel", "Mono"))), (bits(w, 6, 2) + 1).cast("int"))
    ok = (bits(w, 21, 11) == 0x7FF) & (version != 1) & (layer != 0) & (kbit > 0) & (rate_no < 3)
    return F.when(
        ok,
        F.struct(
            F.when(v1, "V1").when(version == 2, "V2").otherwise("V25").alias("version"),
            F.when(l1, "I").when(l3, "III").otherwise("II").alias("layer"),
            kbit.cast("int").alias("bitrate"),
            rate.cast("int").alias("sample_rate"),
            mode.alias("channel_mode"),
            size.cast("long").alias("frame_size"),
            spf.cast("int").alias("samples_per_frame"),
            (pad == 1).alias("padding"),
        ),
    )


def id3v2_skip(content: Column) -> Column:
    """Bytes of a leading ID3v2 tag, 0 if there is none; bit 7 of the size bytes isn't masked here."""
    has = (F.octet_length(content) >= 10) & (part(content, 0, 3) == text("ID3"))
    return F.when(has, 10 + syncsafe(content, 6, mask=False)).otherwise(F.lit(0).cast("long"))


def adts_header(content: Column, at: ColumnOrInt = 0) -> Column:
    """Struct of the 7-byte ADTS header; null if it isn't one."""
    w = be(content, at, 7)
    rate_no, config, length = bits(w, 34, 4), bits(w, 30, 3), bits(w, 13, 13)
    ok = (bits(w, 44, 12) == 0xFFF) & (bits(w, 41, 2) == 0) & (rate_no < 13) & (config > 0) & (length >= 7)
    return F.when(
        ok,
        F.struct(
            bits(w, 38, 2).cast("int").alias("profile"),
            lookup(rate_no, AAC_RATES).alias("sample_rate"),
            lookup(config, AAC_CHANNELS).alias("channels"),
            length.cast("int").alias("frame_length"),
            F.when(bits(w, 40, 1) == 1, 7).otherwise(9).alias("header_size"),
        ),
    )


def adts_header_write(sample_rate: Column, channels: Column, payload_bytes: Column) -> Column:
    """7 bytes: MPEG-4, LC, no CRC, variable rate; an unknown rate is written as 44100."""
    index = F.array_position(F.array(*[F.lit(r) for r in AAC_RATES]), sample_rate)
    index = F.when(index > 0, index - 1).otherwise(4).cast("long")
    n = payload_bytes.cast("long") + 7
    w = F.lit(0xFFF1 << 40).cast("long") + F.shiftleft(F.lit(1).cast("long"), 38) + F.shiftleft(index, 34) + F.shiftleft(channels.cast("long"), 30)
    return to_be(w + F.shiftleft(n, 13) + F.lit(0x1FFC).cast("long"), 7)


def flac_streaminfo(content: Column, at: ColumnOrInt = 0) -> Column:
    """Struct of the 34-byte STREAMINFO block."""
    mid = be(content, col(at) + 10, 4)
    low = be(content, col(at) + 14, 4)
    return F.struct(
        be(content, at, 2).cast("int").alias("min_block"),
        be(content, col(at) + 2, 2).cast("int").alias("max_block"),
        be(content, col(at) + 4, 3).cast("int").alias("min_frame"),
        be(content, col(at) + 7, 3).cast("int").alias("max_frame"),
        bits(mid, 12, 20).cast("int").alias("sample_rate"),
        (bits(mid, 9, 3) + 1).cast("int").alias("channels"),
        (bits(mid, 4, 5) + 1).cast("int").alias("bit_depth"),
        (F.shiftleft(bits(mid, 0, 4), 32) + low).alias("total_samples"),
    )


def flac_frame_header(content: Column, at: ColumnOrInt = 0) -> Column:
    """Struct of the fixed four bytes of a frame header; block size and rate are null where they follow the coded number."""
    w = be(content, at, 4)
    size, rate, depth = bits(w, 12, 4), bits(w, 8, 4), bits(w, 1, 3)
    return F.when(
        (bits(w, 17, 15) == 0x7FFC) & (size > 0) & (rate < 15) & (bits(w, 0, 1) == 0),
        F.struct(
            (bits(w, 16, 1) == 1).alias("variable"),
            lookup(size, FLAC_SIZES).alias("block_size"),
            lookup(rate, FLAC_RATES).alias("sample_rate"),
            bits(w, 4, 4).cast("int").alias("channel_code"),
            lookup(depth, FLAC_BITS).alias("bit_depth"),
        ),
    )


def opus_head(packet: Column) -> Column:
    """Struct of the identification packet; null if it isn't one or has no channel."""
    ok = (F.octet_length(packet) >= 19) & (part(packet, 0, 8) == text("OpusHead")) & (be(packet, 9, 1) > 0)
    return F.when(
        ok,
        F.struct(
            be(packet, 8, 1).cast("int").alias("version"),
            be(packet, 9, 1).cast("int").alias("channel_count"),
            le(packet, 10, 2).cast("int").alias("pre_skip"),
            le(packet, 12, 4).alias("input_sample_rate"),
            sign_extend(le(packet, 16, 2), 16).cast("int").alias("output_gain"),
            be(packet, 18, 1).cast("int").alias("channel_mapping_family"),
        ),
    )


def opus_head_write(channels: Column, pre_skip: Column, sample_rate: Column) -> Column:
    return joined(text("OpusHead"), to_be(F.lit(1), 1), to_be(channels, 1), to_le(pre_skip, 2), to_le(sample_rate, 4), to_le(F.lit(0), 2), to_be(F.lit(0), 1))


def opus_tags_write(vendor: str = "tonewright") -> Column:
    return joined(text("OpusTags"), to_le(F.lit(len(vendor)), 4), text(vendor), to_le(F.lit(0), 4))


def opus_duration(granule: Column, pre_skip: Column) -> Column:
    """Struct of frames at 48 kHz and seconds."""
    n = F.greatest(granule - pre_skip, F.lit(0).cast("long"))
    return F.struct(n.alias("total_samples"), (n / 48000.0).alias("duration_secs"))


def alac_config(content: Column, at: ColumnOrInt = 0) -> Column:
    """Struct of the 24-byte cookie; null if it isn't valid."""
    b = lambda k: be(content, col(at) + k, 1)
    ok = (F.octet_length(content) >= col(at) + 24) & (b(4) == 0) & b(5).isin(16, 20, 24, 32) & b(9).between(1, 8) & (be(content, col(at) + 20, 4) > 0)
    return F.when(
        ok,
        F.struct(
            be(content, at, 4).alias("frame_length"),
            *[b(k).cast("int").alias(n) for k, n in ((5, "bit_depth"), (6, "pb"), (7, "mb"), (8, "kb"), (9, "num_channels"))],
            be(content, col(at) + 10, 2).cast("int").alias("max_run"),
            be(content, col(at) + 12, 4).alias("max_frame_bytes"),
            be(content, col(at) + 16, 4).alias("avg_bit_rate"),
            be(content, col(at) + 20, 4).alias("sample_rate"),
        ),
    )


def wav_header(content: Column) -> Column:
    """Struct of a canonical 44-byte header (fmt first, then data); null for others, which the decoder walks."""
    ok = (part(content, 0, 4) == text("RIFF")) & (part(content, 8, 4) == text("WAVE")) & (part(content, 12, 4) == text("fmt ")) & (part(content, 36, 4) == text("data"))
    return F.when(
        ok,
        F.struct(
            le(content, 20, 2).cast("int").alias("format_code"),
            le(content, 22, 2).cast("int").alias("channels"),
            le(content, 24, 4).cast("int").alias("sample_rate"),
            le(content, 34, 2).cast("int").alias("bit_depth"),
            le(content, 40, 4).alias("data_bytes"),
        ),
    )


def wav_header_write(data_bytes: Column, sample_rate: Column, channels: Column, bits_per_sample: Column, code: int = 1) -> Column:
    align = (channels * bits_per_sample / 8).cast("long")
    return joined(
        text("RIFF"), to_le(data_bytes.cast("long") + 36, 4), text("WAVEfmt "), to_le(F.lit(16), 4), to_le(F.lit(code), 2), to_le(channels, 2),
        to_le(sample_rate, 4), to_le(sample_rate * align, 4), to_le(align, 2), to_le(bits_per_sample, 2), text("data"), to_le(data_bytes, 4),
    )


def _utf16(body: Column, little: bool) -> Column:
    """Whole units decoded; null if a surrogate stands alone, as Spark's decode would stop the job."""
    even = F.substring(body, F.lit(1), F.octet_length(body) - F.octet_length(body) % 2)
    pair = r"^(?:..(?!D[89A-F])..|..D[89AB]..D[C-F])*$" if little else r"^(?:(?!D[89A-F])....|D[89AB]..D[C-F]..)*$"
    return F.when(F.hex(even).rlike(pair), F.decode(even, "UTF-16LE" if little else "UTF-16BE"))


def _utf8(body: Column) -> Column:
    return F.make_valid_utf8(body.cast("string"))


def id3_text(frame: Column) -> Column:
    """Text of an ID3v2 text frame's body: encodings 0 (Latin-1), 1 (UTF-16 with mark), 2 (UTF-16BE), 3 (UTF-8); null if empty."""
    kind, body = be(frame, 0, 1), F.substring(frame, 2, 1 << 30)
    little = part(body, 0, 2) == F.lit(bytearray(b"\xff\xfe"))
    wide = F.substring(body, 3, 1 << 30)
    said = (
        F.when(kind == 0, F.decode(body, "ISO-8859-1"))
        .when(kind == 3, _utf8(body))
        .when((kind == 1) & (F.octet_length(body) >= 2), F.when(little, _utf16(wide, True)).otherwise(_utf16(wide, False)))
        .when(kind == 2, _utf16(body, False))
    )
    return F.nullif(F.rtrim(said, F.lit("\0")), F.lit(""))


def id3_comment(frame: Column) -> Column:
    """Text of an ID3v2 comment frame's body: after the encoding, three bytes of language and a description that a NUL ends."""
    kind, rest = be(frame, 0, 1), F.substring(frame, 5, 1 << 30)
    little = part(rest, 0, 2) == F.lit(bytearray(b"\xff\xfe"))
    said = (
        F.when(kind == 0, F.decode(rest, "ISO-8859-1"))
        .when(kind == 3, _utf8(rest))
        .when((kind == 2) | (kind == 1) & ~little, _utf16(rest, False))
        .when(kind == 1, _utf16(rest, True))
    )
    text_ = F.regexp_replace(said, r"(?s)^[^\x00]*\x00\uFEFF?", "")
    return F.nullif(F.rtrim(F.when(F.instr(said, "\0") > 0, text_), F.lit("\0")), F.lit(""))


def flac_size_code(n: Column) -> Column:
    """Frame header code of a block size: 6 and 7 stand for a size that follows in 8 or 16 bits."""
    code = F.lit(None).cast("int")
    for k, v in ((1, 192), *((k, 144 << k) for k in range(2, 6)), *((k, 1 << k) for k in range(8, 16))):
        code = F.coalesce(code, F.when(n == v, F.lit(k)))
    return F.coalesce(code, F.when(n <= 256, 6).otherwise(7))


def flac_rate_code(rate: Column) -> Column:
    """12 to 14 stand for a rate that follows in kHz, Hz or tens of Hz; 0 for the rate in STREAMINFO."""
    other = F.when((rate % 1000 == 0) & (rate <= 255000), 12).when(rate <= 65535, 13).when((rate % 10 == 0) & (rate <= 655350), 14).otherwise(0)
    return F.coalesce(*[F.when(rate == r, F.lit(k)) for k, r in enumerate(FLAC_RATES) if r], other)


def flac_bits_code(depth: Column) -> Column:
    return F.coalesce(*[F.when(depth == b, F.lit(k)) for k, b in enumerate(FLAC_BITS) if b and k < 7], F.lit(0))
