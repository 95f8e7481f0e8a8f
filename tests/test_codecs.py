"""Containers and codecs over bytes."""

import hashlib
import io
import json
import struct
import time
import wave

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tonewright.operators import dither, resample
from tonewright.sources import aac, aiff, alac, flac, mpeg, ogg, opus, tags, transform, wav
from tonewright.sources.bits import walk as bits_walk
from tonewright.sources.bits import BitSink, Bits, crc8, crc16, crc32_ogg, crc_table
from tonewright.sources.errors import AudioError


def sine(n, rate=44100, hz=440, gain=0.8):
    return (gain * np.sin(2 * np.pi * hz * np.arange(n) / rate)).astype(np.float32)


def slow_crc(data, width, poly):
    table, crc = crc_table(width, poly), 0
    for b in data:
        crc = ((crc << 8) & ((1 << width) - 1)) ^ table[(crc >> (width - 8)) ^ b]
    return crc


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 100, 4095, 4096, 4097, 9000])
def test_crcs(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    for f, width, poly in ((crc8, 8, 7), (crc16, 16, 0x8005), (crc32_ogg, 32, 0x04C11DB7)):
        assert f(data) == slow_crc(data, width, poly)


# WAV


@pytest.mark.parametrize(("fmt", "off"), [("I8", 0.02), ("I16", 0.001), ("I24", 1e-5), ("I32", 1e-6), ("F32", 0)])
def test_wav_round_trip(fmt, off):
    x = np.array([0, 0.5, -0.5, 1, -1], np.float32)
    info, y = wav.decode(wav.encode(x, 44100, 1, fmt))
    assert (info.format, info.sample_rate, info.channels, info.total_samples) == ("Wav", 44100, 1, 5)
    assert np.abs(x - y).max() <= off + (1 / 128 if fmt == "I8" else 0)


def test_wav_by_another_reader():
    x = sine(1000)
    with wave.open(io.BytesIO(wav.encode(x, 48000, 2, "I16"))) as w:
        assert (w.getnchannels(), w.getframerate(), w.getnframes()) == (2, 48000, 500)
        assert np.array_equal(np.frombuffer(w.readframes(500), "<i2"), np.trunc(x * np.float32(32767)).astype(int))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 3, 8000, 0, "NONE", ""))
        w.writeframes(b"\0\0\x40" + b"\0\0\xc0")
    assert wav.decode(out.getvalue() + bytes(8))[1].tolist() == [0.5, -0.5]


def test_wav_extensible_and_odd_chunks():
    fmt = struct.pack("<HHIIHHHHI", 0xFFFE, 1, 44100, 88200, 2, 16, 22, 16, 4) + struct.pack("<H", 1) + bytes(14)
    data = b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"JUNK" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", 40) + fmt + b"data" + struct.pack("<I", 4) + struct.pack("<hh", 16384, -16384)
    assert wav.decode(data)[1].tolist() == [0.5, -0.5]
    assert len(wav.encode(sine(3), 8000, 1, "I8")) % 2 == 0


@pytest.mark.parametrize(
    ("data", "code"),
    [
        (b"", "InvalidHeader"),
        (b"RIFF" + bytes(60), "InvalidHeader"),
        (b"XXXX" + bytes(60), "InvalidHeader"),
        (b"RIFF" + bytes(4) + b"WAVE" + b"JUNK" + b"\xff" * 4 + bytes(80), "InvalidHeader"),
        (wav.encode(sine(100), 44100, 1).replace(b"\x01\x00\x01\x00", b"\x01\x00\x00\x00", 1), "InvalidChannels"),
        (wav.encode(sine(100), 44100, 1).replace(b"\x10\x00data", b"\x11\x00data"), "DecodeError"),
    ],
)
def test_wav_rejects(data, code):
    with pytest.raises(AudioError) as e:
        wav.decode(data)
    assert e.value.code == code


def test_wav_keeps_samples_of_a_partial_frame():
    data = wav.encode(sine(40), 8000, 2, "I16")[:-2]
    info, y = wav.decode(data)
    assert len(y) == 39 and info.total_samples == 19


def test_encoders_reject():
    for call, code in (
        (lambda: wav.encode(sine(4), 8000, 0), "InvalidChannels"),
        (lambda: wav.encode(sine(4), 0, 1), "InvalidSampleRate"),
        (lambda: wav.encode(sine(4), 8000, 1, "F64"), "EncodeError"),
        (lambda: aiff.encode(sine(4), 8000, 1, 12), "EncodeError"),
        (lambda: flac.encode(sine(4), 8000, 9), "InvalidChannels"),
        (lambda: flac.encode(sine(4), 8000, 2, 32), "EncodeError"),
        (lambda: opus.encode(sine(4), 44100, 1), "InvalidSampleRate"),
        (lambda: opus.encode(sine(4), 48000, 3), "InvalidChannels"),
        (lambda: opus.encode(sine(4), 48000, 1, 1000), "EncodeError"),
        (lambda: aac.encode(sine(4), 44000, 1), "InvalidSampleRate"),
        (lambda: aac.encode(sine(4), 44100, 1, 0), "EncodeError"),
    ):
        with pytest.raises(AudioError) as e:
            call()
        assert e.value.code == code


# AIFF


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_aiff_round_trip(bits):
    x = sine(101)
    info, y = aiff.decode(aiff.encode(x, 22050, 1, bits))
    assert (info.format, info.sample_rate, info.bit_depth, info.total_samples) == ("Aiff", 22050, bits, 101)
    assert np.abs(x - y).max() < (0.02 if bits == 8 else 0.001)


def test_aiff_c():
    data = aiff.encode(np.zeros(2, np.float32), 8000, 1, 16)
    comm = struct.pack(">hIh", 1, 2, 16) + aiff.float_to_ext80(8000) + b"sowt"
    body = b"AIFC" + b"COMM" + struct.pack(">I", 22) + comm + b"SSND" + struct.pack(">III", 12, 0, 0) + struct.pack("<hh", 16384, -16384)
    assert aiff.decode(b"FORM" + struct.pack(">I", len(body)) + body)[1].tolist() == [0.5, -0.5]
    for bad in (data[:11], data.replace(b"SSND", b"XXXX"), data.replace(b"AIFF", b"AIXX"), body.replace(b"sowt", b"alaw")):
        with pytest.raises(AudioError):
            aiff.decode(bad if bad[:4] == b"FORM" else b"FORM" + bytes(4) + bad)
    with pytest.raises(AudioError):
        aiff.decode(data[:-12] + struct.pack(">II", 100, 0) + data[-4:])  # SSND offset past its chunk


@pytest.mark.parametrize("rate", [8000, 11025, 22050, 44100, 48000, 96000, 192000])
def test_ext80(rate):
    assert aiff.ext80_to_float(aiff.float_to_ext80(rate)) == rate
    assert aiff.ext80_to_float(aiff.float_to_ext80(-0.1)) == -0.1


# FLAC


@pytest.mark.parametrize("channels", [1, 2, 3, 8])
@pytest.mark.parametrize("bits", [8, 12, 16, 20, 24])
def test_flac_round_trip(channels, bits):
    rng = np.random.default_rng(channels * bits)
    x = np.clip(np.repeat(sine(8292), channels) + 0.05 * rng.standard_normal(8292 * channels), -1, 1).astype(np.float32)
    data = flac.encode(x, 48000, channels, bits)
    info, y = flac.decode(data)
    assert (info.channels, info.bit_depth, info.total_samples) == (channels, bits, 8292)
    exact = flac.scaled(flac.quantise(x, bits), bits)
    assert np.array_equal(y, exact)
    for low, high in ((1000, 3000), (4000, 4200), (0, 1), (8291, 8292)):
        assert np.array_equal(flac.decode_range(data, low, high)[1], y[low * channels : high * channels])
    assert len(flac.decode_range(data, 9000, None)[1]) == 0
    assert flac.metadata(data).info.md5 == flac.md5_of(flac.quantise(x, bits), bits)


@given(st.lists(st.floats(-1, 1, width=32), max_size=60), st.integers(1, 3), st.sampled_from([4, 8, 16, 24, 31]), st.sampled_from([8000, 44100, 11000, 65500, 655350, 500001]))
@settings(max_examples=150, deadline=None)
def test_flac_any_samples(values, channels, bits, rate):
    x = np.array(values[: len(values) // channels * channels], np.float32)
    assert np.array_equal(flac.decode(flac.encode(x, rate, channels, bits))[1], flac.scaled(flac.quantise(x, bits), bits))


def test_flac_false_sync_and_noise():
    rng = np.random.default_rng(1)
    raw = np.frombuffer((b"\xff\xf8" * 4096), ">i2").astype(np.float32) / 32768  # verbatim frames full of sync codes
    x = np.where(rng.random(4096) < 0.5, raw, rng.uniform(-1, 1, 4096)).astype(np.float32)
    assert np.array_equal(flac.decode(flac.encode(np.tile(x, 3), 44100, 1, 16))[1], flac.scaled(flac.quantise(np.tile(x, 3), 16), 16))


def test_flac_corruption_is_an_error():
    data = bytearray(flac.encode(sine(5000), 44100, 1, 16))
    meta = flac.metadata(bytes(data))
    first = flac.index(bytes(data), meta)[0]
    for at in (meta.audio_at + 4, first.at + 100, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 0x5A
        with pytest.raises(AudioError):
            flac.decode(bytes(bad))
    with pytest.raises(AudioError):
        flac.decode(bytes(data[:-2]))
    with pytest.raises(AudioError):
        flac.decode(bytes(data[:30]))


def flac_file(subframe: BitSink, block: int, seek: bytes = b"") -> bytes:
    """One 16-bit mono frame around a subframe, with a seek table if given."""
    head = BitSink()
    head.uint(0xFFF8, 16)
    head.uint(7 << 4 | 9, 8)
    head.uint(4 << 1, 8)
    head.coded(0)
    head.uint(block - 1, 16)
    raw = head.bytes()
    raw += bytes([crc8(raw)]) + subframe.bytes()
    raw += crc16(raw).to_bytes(2, "big")
    start = flac.stream_head(44100, 1, 16, block, [len(raw)], bytes(16))
    if seek:
        start = start[:4] + b"\0" + start[5:] + b"\x83" + len(seek).to_bytes(3, "big") + seek
    return start + raw


def test_flac_constant_wasted_and_seek_points():
    sub = BitSink()
    sub.uint(1, 8)  # constant, wasted bits
    sub.uint(0b001, 3)  # three of them
    sub.uint(125, 13)
    seek = struct.pack(">QQH", 0, 0, 64) + struct.pack(">QQH", (1 << 64) - 1, 0, 0)
    data = flac_file(sub, 64, seek)
    assert flac.metadata(data).seek_points == [(0, 0, 64)]
    assert set(flac.decode(data)[1].tolist()) == {1000 / 32768}
    assert len(flac.decode_range(data, 10, 20)[1]) == 10


def test_flac_lpc_partitions_and_escapes():
    rng = np.random.default_rng(3)
    values = np.cumsum(rng.integers(-40, 41, 64))
    taps, shift = [7, -3, 1], 2
    full = values.tolist()
    residual = [full[n] - (sum(c * full[n - 1 - j] for j, c in enumerate(taps)) >> shift) for n in range(3, 64)]
    sub = BitSink()
    sub.uint((31 + 3) << 1, 8)
    sub.array(values[:3], 16)
    sub.uint(4 - 1, 4)
    sub.uint(shift, 5)
    sub.array(np.array(taps), 4)
    sub.uint(1 << 4 | 1, 6)  # five-bit parameters, two partitions
    sub.uint(5, 5)
    sub.rice(flac.zigzag(np.array(residual[:29])), 5)
    sub.uint(31, 5)
    sub.uint(14, 5)
    sub.array(np.array(residual[29:]), 14)
    assert np.array_equal(flac.decode(flac_file(sub, 64))[1], flac.scaled(values, 16))


@pytest.mark.parametrize("code", [8, 9, 10])
def test_decorrelate(code):
    rng = np.random.default_rng(code)
    left, right = rng.integers(-1000, 1000, (2, 50))
    a, b = {8: (left, left - right), 9: (left - right, right), 10: (left + right >> 1, left - right)}[code]
    assert np.array_equal(np.array(flac.decorrelate(a, b, code)), np.array([left, right]))


def test_md5_vectors():
    assert flac.md5_of(np.zeros(0, np.int64), 8).hex() == "d41d8cd98f00b204e9800998ecf8427e"
    assert flac.md5_of(np.array([97, 98, 99]), 8).hex() == hashlib.md5(b"abc").hexdigest()


@given(st.lists(st.integers(0, (1 << 36) - 1), min_size=1, max_size=20))
@settings(deadline=None)
def test_coded_numbers(values):
    sink = BitSink()
    for v in values:
        sink.coded(v)
    bits = Bits(sink.bytes())
    assert [bits.coded() for _ in values] == values


# Ogg and Opus


@given(st.lists(st.binary(max_size=1200), min_size=1, max_size=6))
@settings(deadline=None, max_examples=60)
def test_ogg_round_trip(packets):
    data = ogg.mux(packets, list(range(len(packets))), 5)
    assert ogg.extract_packets(data) == packets
    pages = ogg.pages(data)
    assert pages[0].flags & 2 and pages[-1].flags & 4


def test_ogg_long_packet_and_faults():
    packets = [bytes(70_000), b"", b"x" * 255]
    data = ogg.mux(packets, [1, 2, 3], 5)
    assert ogg.extract_packets(data) == packets
    bad = bytearray(data)
    bad[500] ^= 1
    with pytest.raises(AudioError):
        ogg.pages(bytes(bad))
    with pytest.raises(AudioError):
        ogg.pages(data[:-1])
    assert ogg.pages(b"junk") == [] and len(ogg.pages(data + b"junk")) == len(ogg.pages(data))
    with pytest.raises(AudioError) as e:
        ogg.decode(ogg.mux([b"\x01vorbis"], [0], 1))
    assert e.value.code == "UnsupportedFormat"


def test_opus():
    data = opus.encode(sine(96000, 48000), 48000, 2, 64000)
    info, samples = ogg.decode(data)
    assert (info.format, info.channels, info.total_samples, len(samples)) == ("Opus", 2, 48000, 0)
    packets = ogg.extract_packets(data)
    assert len(packets) == 2 + 50 and {len(p) for p in packets[2:]} == {160} and tags.opus_tags(packets[1]) == {}
    assert opus.head(packets[0])["pre_skip"] == 312
    assert ogg.decode(opus.encode(np.zeros(0, np.float32), 48000, 1))[0].total_samples == 0
    with pytest.raises(AudioError):
        opus.head(packets[0][:9] + b"\0" + packets[0][10:])


@given(st.lists(st.tuples(st.integers(0, 127), st.booleans()), max_size=200))
@settings(deadline=None, max_examples=50)
def test_range_coder(symbols):
    coder = opus.RangeEncoder()
    for s, b in symbols:
        coder.encode(s, s + 1, 128)
        coder.encode(int(b), int(b) + 1, 2)
    decoder = opus.RangeDecoder(coder.finish())
    assert [(decoder.decode([1] * 128), bool(decoder.decode([1, 1]))) for _ in symbols] == symbols


def test_opus_packet_can_be_read_back():
    bins = transform.mdct_ref(opus.frames_of(sine(960, 48000), 1) * transform.sine_window(960))
    symbols = opus.energy_symbols(opus.band_energies(bins))[0]
    packet = opus.pack_frame(symbols, bins[0], 160)
    decoder = opus.RangeDecoder(packet[1:])
    assert packet[0] == 240 and [decoder.decode([1] * 128) for _ in symbols] == symbols.tolist()
    signs = [decoder.decode([1, 1]) for _ in range(400)]
    assert signs == (bins[0] >= 0).astype(int)[:400].tolist()


# Transforms, resampling, dither


@pytest.mark.parametrize("n", [16, 64, 120, 960, 2048])
def test_mdct_is_the_direct_sum(n):
    x = np.random.default_rng(n).standard_normal((3, n))
    i, k = np.arange(n)[:, None] + 0.5 + n / 4, np.arange(n // 2) + 0.5
    assert np.allclose(transform.mdct_ref(x), x @ np.cos(np.pi / n * i * k))
    assert np.allclose(transform.mdct(x), x @ np.cos(2 * np.pi / n * i * k))
    turn = np.exp(-2j * np.pi / n * np.outer(np.arange(n), np.arange(n)))
    assert np.allclose(transform.fft(x), x @ turn)


def slow_resample(x, src, dst, quality):
    scale, h = resample.reach(src, dst, quality)
    out = []
    for o in range(-(-len(x) * dst // src)):
        c, frac = o * src // dst, (o * src % dst) / dst
        t = np.arange(max(-h, -c), min(h, len(x) - 1 - c) + 1)
        w = resample.taps(np.array([frac]), scale, h)[0][t + h]
        out.append((x[c + t] * w).sum() / w.sum() if abs(w.sum()) > 1e-10 else 0)
    return np.array(out)


@pytest.mark.parametrize("quality", ["Draft", "Good", "Best"])
@pytest.mark.parametrize(("src", "dst"), [(44100, 48000), (48000, 44100), (48000, 8000), (8000, 48000), (44100, 44101)])
def test_resample_is_the_direct_sum(quality, src, dst):
    for n in (1, 5, 300):
        x = np.random.default_rng(n).uniform(-1, 1, n).astype(np.float32)
        assert np.allclose(resample.mono(x, src, dst, quality, chunk=64), slow_resample(x, src, dst, quality), atol=1e-6)


def test_resample_there_and_back():
    x = sine(4096, gain=1.0)
    y = resample.mono(resample.mono(x, 44100, 48000, "Good"), 48000, 44100, "Good")
    assert abs(np.sqrt((y**2).mean()) / np.sqrt((x**2).mean()) - 1) < 0.1
    four = resample.interleaved(np.repeat(x[:1024], 4), 4, 44100, 48000, "Good")
    assert len(four) % 4 == 0 and np.isfinite(four).all()
    assert resample.interleaved(x, 1, 8000, 8000, "Good") is x
    for bad in ((0, 1, 1), (1, 0, 1), (1, 1, 0)):
        with pytest.raises(AudioError):
            resample.check(*bad)
    assert len(resample.mono(np.zeros(0, np.float32), 44100, 48000, "Good")) == 0


def test_dither():
    x, draws = dither.SEED, []
    for _ in range(2 * 5000):  # step by step
        x ^= x << 13 & dither.MASK
        x ^= x >> 17
        x ^= x << 5 & dither.MASK
        draws.append(np.float32(x) / np.float32(4294967295) * np.float32(2) - np.float32(1))
    slow = np.array([(a + b) * np.float32(0.5) for a, b in zip(draws[::2], draws[1::2], strict=True)], np.float32)
    for start, n in ((0, 5000), (0, 1), (0, 0), (17, 4000), (4999, 1)):
        assert np.array_equal(dither.noise_range(start, n), slow[start : start + n])
    far = dither.noise_range(3_000_000_000, 500)
    assert np.array_equal(dither.noise_range(3_000_000_100, 300), far[100:400])
    long = np.zeros(dither.PIECE + 70, np.float32)
    assert np.array_equal(dither.with_noise(long, 1.0)[-100:], dither.noise_range(dither.PIECE - 30, 100))
    assert np.array_equal(dither.with_noise(long[:90], 1.0, 55), dither.noise_table(145)[55:])
    began = time.process_time()
    dither.noise_range(0, 2_000_000)
    assert time.process_time() - began < 2
    noise = dither.noise_table(4096)
    assert np.abs(noise).max() <= 1 and abs(noise.mean()) < 0.02 and noise.std() > 0.3
    x = np.full(4096, 0.5, np.float32)
    step = dither.step_of(16)
    y = dither.shaped([x], step)[0]
    assert np.abs(y - x).max() < 0.001 and np.allclose(y / step, np.round(y / step))
    assert dither.step_of(0) == 1 and dither.step_of(99) == 2.0**-31


# MPEG, AAC, ALAC


def test_mpeg():
    frame = mpeg.header(bytes.fromhex("fffb9000"))
    assert (frame.version, frame.layer, frame.bitrate, frame.sample_rate, frame.channel_mode, frame.frame_size, frame.samples_per_frame) == ("V1", "III", 128, 44100, "Stereo", 417, 1152)
    for bad in ("fffb0000", "fffbf000", "fffb9c00", "ffeb9000", "fff99000", "00fb9000", "fffb90"):
        assert mpeg.header(bytes.fromhex(bad)) is None
    data = b"ID3\3\0\0\0\0\0\5hello" + (bytes.fromhex("fffb9000") + bytes(413)) * 3 + b"tail"
    info, _ = mpeg.decode(data)
    assert (info.total_samples, info.channels) == (3456, 2)
    with pytest.raises(AudioError):
        mpeg.decode(b"nothing here")


def test_adts():
    h = aac.header(bytes.fromhex("fff150800c8000"))
    assert (h.profile, h.sample_rate, h.channels, h.frame_length, h.header_size) == (1, 44100, 2, 100, 7)
    data = b"x" + (aac.write_header(48000, 1, 10) + bytes(10)) * 3 + aac.write_header(48000, 1, 10)
    assert [f.at for f in aac.frames(data)] == [1, 18, 35]
    for bad in (b"", b"\xff\xf1" + bytes(9), b"no sync"):
        with pytest.raises(AudioError):
            aac.decode(bad)
    info, samples = aac.decode(aac.encode(sine(44100), 44100, 1))
    assert info.total_samples == 44 * 1024 and len(samples) == 0
    assert len(aac.SCALE_CODES) == len(aac.SCALE_LENGTHS) == 121


def test_aac_scale_codes_are_prefix_free():
    words = sorted(format(c, f"0{n}b") for c, n in zip(aac.SCALE_CODES, aac.SCALE_LENGTHS, strict=True))
    assert not any(b.startswith(a) for a, b in zip(words, words[1:]))


def cookie(bits=16, channels=1, length=64):
    return struct.pack(">IBBBBBBHIII", length, 0, bits, 40, 10, 14, channels, 255, 0, 0, 44100)


@pytest.mark.parametrize("seed", range(4))
def test_alac_rice_round_trip(seed):
    rng = np.random.default_rng(seed)
    values = np.where(rng.random(500) < 0.6, 0, rng.integers(-50 * 10**seed, 50 * 10**seed, 500)).tolist()
    sink = BitSink()
    alac.write_rice_block(sink, values, 24, 10, 40, 14)
    assert alac.rice_block(Bits(sink.bytes() + bytes(4)), 500, 24, 10, 40, 14).tolist() == values


def test_alac_compressed_pair():
    rng = np.random.default_rng(5)
    left, right = np.cumsum(rng.integers(-30, 31, (2, 64)), axis=1)
    c = alac.config(cookie(channels=2))
    for taps, mix in (([], 0), ([], 3), ([160, -190, 170, -130], 3), ([1] * 31, 1)):
        sink = BitSink()
        alac.write_element(sink, [left, right], c, taps, 9, 2, mix)
        sink.uint(7, 3)
        info, y = alac.decode(cookie(channels=2) + sink.bytes())
        assert np.array_equal(y, (np.stack([left, right], 1) / 32768).astype(np.float32).ravel()) and info.total_samples == 64


@pytest.mark.parametrize("taps", [[], [500], [160, -190, 170, -130], list(range(-8, 8)), [1] * 31])
def test_alac_prediction_adapts_both_ways(taps):
    x = np.cumsum(np.random.default_rng(len(taps)).integers(-900, 901, 300)) % 30000 - 15000
    residual = alac.filtered(x, taps, 9, 16)
    assert np.array_equal(alac.unfilter(residual, taps, 9, 16), x)


def test_alac_first_order_prediction():
    values = np.cumsum(np.arange(20) % 5 - 2)
    assert np.array_equal(alac.unfilter(np.diff(values, prepend=0), [1] * 31, 0, 16), values)


def test_alac_raw_and_faults():
    sink = BitSink()
    sink.uint(0, 3 + 4 + 12)
    sink.uint(1, 1)
    sink.uint(0, 2)
    sink.uint(1, 1)
    sink.uint(4, 32)
    sink.array(np.array([1000, -1000, 500, -500]), 16)
    sink.uint(7, 3)
    assert (alac.decode(cookie() + sink.bytes())[1] * 32768).tolist() == [1000, -1000, 500, -500]
    for bad in (b"", cookie(bits=17) + sink.bytes(), cookie(channels=0), cookie() + b"\x40\0", cookie() + sink.bytes()[:6]):
        with pytest.raises(AudioError):
            alac.decode(bad)


# Tags


@pytest.mark.parametrize("version", [2, 3, 4])
def test_id3(version):
    fields = {"title": "Ä title", "artist": "B", "album": "C", "track_number": "1/9", "year": "1999", "genre": "g", "comment": "well, hello"}
    data = tags.id3_tag(fields, version)
    assert tags.id3_fields(data) == fields
    with pytest.raises(AudioError):
        tags.id3_fields(data[:-1])
    with pytest.raises(AudioError):
        tags.id3_fields(b"TAG" + data[3:])


def test_text_encodings():
    assert tags.decoded(0, b"caf\xe9\0") == "café" and tags.decoded(3, "é".encode()) == "é"
    assert tags.decoded(1, b"\xff\xfeA\0") == "A" and tags.decoded(1, b"\xfe\xff\0A") == "A" and tags.decoded(2, b"\0A\0\0") == "A"
    assert tags.decoded(1, b"x") is None and tags.decoded(9, b"x") is None and tags.decoded(0, b"\0\0") is None


def test_vorbis():
    pairs = [("title", "a"), ("TITLE", "b=c"), ("Artist", ""), ("x", "y"), ("date", "2001")]
    data = tags.vorbis_comment(pairs)
    assert tags.vorbis_fields(data) == {"title": "b=c", "year": "2001"}
    assert tags.vorbis_fields(data[:-3]) == {"title": "b=c"}
    for bad in (b"", b"\xff\0\0\0"):
        with pytest.raises(AudioError):
            tags.vorbis_fields(bad)
    assert tags.syncsafe(b"\0\0\2\1") == 257 and tags.syncsafe(b"\x7f" * 4) == 0x0FFFFFFF


def test_json_round_trip():
    info, _ = wav.decode(wav.encode(sine(10), 8000, 1))
    assert type(info)(**json.loads(json.dumps(info.__dict__))) == info


def test_recurrences_in_step_equal_those_alone():
    rng = np.random.default_rng(8)
    parts = []
    for order in (1, 4, 12, 32):
        for k in range(9):
            taps = rng.integers(-(1 << 10), 1 << 10, order)
            parts.append(flac.Predicted(rng.integers(-999, 999, order), taps, 12, rng.integers(-50, 50, 300 + (k == 0)), k % 3))
    for p, x in zip(parts, flac.restored(parts), strict=True):
        assert np.array_equal(x, flac.lpc_restore(p.warm, p.taps, p.shift, p.residual) << p.wasted)
    for order, depth in ((4, 16), (8, 24), (30, 17)):
        taps = rng.integers(-300, 300, order).tolist()
        own = [alac.Filtered(rng.integers(-200, 200, 200) * (k != 3), taps, 9, depth) for k in range(20)]
        for p, x in zip(own, alac.restored(own), strict=True):
            assert np.array_equal(x, alac.unfilter(p.residual, p.taps, p.shift, p.depth))
    clips = [rng.uniform(-1, 1, n).astype(np.float32) for n in (50, 0, 200, 50, 1)]
    for x, y in zip(clips, dither.shaped(clips, 2.0**-15), strict=True):
        assert np.array_equal(y, dither.shaped([x], 2.0**-15)[0])


def test_walk_equals_steps():
    rng = np.random.default_rng(2)
    for n, count in ((10, 1), (50, 20), (5000, 1000), (5000, 4096)):
        jump = np.minimum(np.arange(n) + rng.integers(1, 4, n), n)
        want, at = [], 0
        for _ in range(count):
            want.append(at)
            at = int(np.append(jump, n)[at])
        assert bits_walk(np.append(jump, n), count).tolist() == want


@pytest.mark.parametrize(
    ("file", "want"),
    [
        ("664c614380000022100010000000 0f00000f0ac442f0000000013e84b41807dc690307586a3dad1a2e0f fff869180000bf0358fd03128baa9a", [[25588, 10416]]),
        (
            "664c6143800000221000100000001f00001f07d0007000000018f8f9e396f5cbcfc6dc807f9977906b32 fff868020017e944004f6f313d1047d227cb6d090831452bdc2822228057a3",
            [[x] for x in (0, 79, 111, 78, 8, -61, -90, -68, -13, 42, 67, 53, 13, -27, -46, -38, -12, 14, 24, 19, 6, -4, -5, 0)],
        ),
    ],
)
def test_flac_vectors_of_the_standard(file, want):
    """Examples 1 (verbatim, stereo) and 3 (linear prediction, partitioned Rice codes) of RFC 9639."""
    raw = bytes.fromhex(file)
    meta = flac.metadata(raw)
    (frame,) = flac.index(raw, meta)
    values = flac.decode_frame(raw[frame.at : frame.at + frame.size], frame)
    assert values.tolist() == want and flac.md5_of(values, meta.info.bits) == meta.info.md5
    assert np.array_equal(flac.decode(raw)[1], flac.scaled(values, meta.info.bits).ravel())


@pytest.mark.parametrize("size", [1, 13, 1000, 100_000])
def test_scanner_finds_the_frames_of_the_index(size):
    rng = np.random.default_rng(4)
    raw = flac.encode(np.concatenate([rng.uniform(-1, 1, 9000), np.zeros(5000)]).astype(np.float32), 48000, 2)
    meta = flac.metadata(raw)
    scan, found = flac.Scanner(meta.info), []
    for i in range(meta.audio_at, len(raw), size):
        found += scan.feed(raw[i : i + size])
    found += scan.rest(meta)
    assert [x for x, _ in found] == [raw[f.at : f.at + f.size] for f in flac.index(raw, meta)] and len(found) == 2


def test_seeking_indexes_few_frames(monkeypatch):
    """A seek point at frame 6 of 10 and an end in frame 7: two frames are indexed and the header of the next is seen."""
    raw = flac.encode(np.sin(np.arange(40960) / 9).astype(np.float32), 48000, 1)
    frames = flac.index(raw)
    table = b"".join(struct.pack(">QQH", *p) for p in [(0, 0, 4096), (frames[6].start, frames[6].at - 42, 4096), ((1 << 64) - 1, 0, 0)])
    with_seek = raw[:4] + b"\0" + raw[5:42] + b"\x83" + len(table).to_bytes(3, "big") + table + raw[42:]
    meta, seen = flac.metadata(with_seek), []
    real = flac.frame_header
    monkeypatch.setattr(flac, "frame_header", lambda *a: seen.append(real(*a)) or seen[-1])
    part = flac.decode_range(with_seek, frames[6].start + 5, frames[7].start + 9)[1]
    assert sum(f is not None for f in seen) == 3
    assert np.array_equal(part, flac.decode(raw)[1][frames[6].start + 5 : frames[7].start + 9]) and len(meta.seek_points) == 2
