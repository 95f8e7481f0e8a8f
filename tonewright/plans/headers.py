"""Queries over header bit fields, packets and tags, on bytes built from integers and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonewright.functions import headers, numeric
from tonewright.functions.numeric import joined, text, to_be, to_le
from tonewright.operators import packets, tags
from tonewright.plans.catalog import query, table
from tonewright.sources import tags as tag_bytes
from tonewright.sources import udtf


def order_key():
    return F.col("o_orderkey")


def cust_key():
    return F.col("o_custkey")


PREFIXES = ["52494646", "664C6143", "4F676753", "464F524D", "49443303", "FFFB9000", "FFF15080", "FFE20000", "4D546864", "FFF9", "464F524D41424344"]
PREFIX_NAMES = ["Wav", "Flac", "Ogg", "Aiff", "Mp3", "Mp3", "Aac", "Mp3", None, None, None]


@query(
    "detect_format",
    "SELECT o_orderkey AS k, ["
    + ", ".join("NULL" if n is None else f"'{n}'" for n in PREFIX_NAMES)
    + "][(o_orderkey % 11 + 1)::INT] AS format FROM orders",
)
def detect_format(spark, sf_dir):
    """Leading bytes of each kind; two bytes alone are too short, and FORM without AIFF or AIFC is unknown."""
    head = F.unhex(F.get(F.array(*map(F.lit, PREFIXES)), (order_key() % 11).cast("int")))
    aiff = F.when(cust_key() % 2 == 0, text("AIFF")).otherwise(text("AIFC"))
    content = F.when(order_key() % 11 == 3, joined(head, to_be(cust_key(), 4), aiff)).when(order_key() % 11 == 9, head).otherwise(joined(head, F.lit(bytearray(12))))
    return table(spark, sf_dir, "orders").select(order_key().alias("k"), headers.detect_format(content).alias("format"))


@query("ext80_decode", "SELECT o_orderkey AS k, round(o_totalprice, 2) AS x FROM orders")
def ext80_decode(spark, sf_dir):
    """Prices written as extended floats and read back."""
    x = F.col("o_totalprice").cast("double")
    return table(spark, sf_dir, "orders").select(order_key().alias("k"), F.round(numeric.ext80_to_double(numeric.double_to_ext80(x)), 2).alias("x"))


@query(
    "ext80_encode",
    """WITH x AS (SELECT o_orderkey AS k, 8000 + o_orderkey % 184001 AS r FROM orders), e AS (SELECT k, r, floor(log2(r))::INT AS e FROM x)
    SELECT k, printf('%04X%08X%08X', e + 16383, (r << (31 - e))::BIGINT, 0) AS raw FROM e""",
)
def ext80_encode(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(order_key().alias("k"), F.hex(numeric.double_to_ext80((order_key() % 184001 + 8000).cast("double"))).alias("raw"))


MPEG_SQL = """WITH x AS (SELECT o_orderkey AS k, o_orderkey % 4 AS v, o_custkey % 4 AS l, o_orderkey // 4 % 16 AS b, o_custkey // 4 % 4 AS r, o_orderkey // 64 % 2 AS p, o_custkey // 16 % 4 AS m FROM orders),
  y AS (SELECT *, CASE WHEN v <> 3 AND l = 1 THEN [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0][(b + 1)::INT] ELSE [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0][(b + 1)::INT] END AS kbit,
    CASE v WHEN 3 THEN [44100, 48000, 32000, 0] WHEN 2 THEN [22050, 24000, 16000, 0] ELSE [11025, 12000, 8000, 0] END[(r + 1)::INT] AS rate FROM x WHERE v <> 1 AND l <> 0 AND r < 3)
  SELECT k, CASE v WHEN 3 THEN 'V1' WHEN 2 THEN 'V2' ELSE 'V25' END AS version, CASE l WHEN 3 THEN 'I' WHEN 2 THEN 'II' ELSE 'III' END AS layer, kbit::INT AS bitrate, rate::INT AS sample_rate,
    ['Stereo', 'JointStereo', 'DualChannel', 'Mono'][(m + 1)::INT] AS channel_mode,
    (CASE WHEN l = 3 THEN (12000 * kbit // rate + p) * 4 ELSE CASE WHEN l = 1 AND v <> 3 THEN 576 ELSE 1152 END * kbit * 1000 // (8 * rate) + p END)::BIGINT AS frame_size,
    (CASE WHEN l = 3 THEN 384 WHEN l = 1 AND v <> 3 THEN 576 ELSE 1152 END)::INT AS samples_per_frame, p = 1 AS padding FROM y WHERE kbit > 0"""


def _mpeg_word():
    v, layer, b, r = order_key() % 4, cust_key() % 4, F.floor(order_key() / 4) % 16, F.floor(cust_key() / 4) % 4
    p, m = F.floor(order_key() / 64) % 2, F.floor(cust_key() / 16) % 4
    word = F.lit(0xFFE00000).cast("long")
    for x, at in ((v, 19), (layer, 17), (b, 12), (r, 10), (p, 9), (m, 6)):
        word = word + F.shiftleft(x.cast("long"), at)
    return to_be(word, 4)


@query("mpeg_frame_header", MPEG_SQL)
def mpeg_frame_header(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(order_key().alias("k"), headers.mpeg_frame_header(_mpeg_word()).alias("h"))
    return rows.filter("h IS NOT NULL").select("k", "h.*")


@query("id3v2_skip", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 10 + (o_orderkey % 256) * 2097152 + (o_custkey % 128) * 16384 + (o_orderkey % 128) * 128 + o_custkey % 100 END AS skip FROM orders")
def id3v2_skip(spark, sf_dir):
    magic = F.when(order_key() % 3 == 0, text("XD3")).otherwise(text("ID3"))
    content = joined(magic, F.lit(bytearray(3)), to_be(order_key() % 256, 1), to_be(cust_key() % 128, 1), to_be(order_key() % 128, 1), to_be(cust_key() % 100, 1))
    # The top byte isn't masked, so bits 7 of lower bytes stay clear here and sums don't overlap.
    return table(spark, sf_dir, "orders").select(order_key().alias("k"), headers.id3v2_skip(content).alias("skip"))


@query("syncsafe", "SELECT o_orderkey AS k, (o_orderkey % 128) * 2097152 + (o_custkey % 128) * 16384 + (o_orderkey // 128 % 128) * 128 + o_custkey // 128 % 128 AS n FROM orders")
def syncsafe(spark, sf_dir):
    """With bit 7 of each byte set, which is masked."""
    content = joined(*[to_be(x % 128 + 128, 1) for x in (order_key(), cust_key(), F.floor(order_key() / 128), F.floor(cust_key() / 128))])
    return table(spark, sf_dir, "orders").select(order_key().alias("k"), numeric.syncsafe(content, 0).alias("n"))


@query(
    "adts_header",
    """WITH x AS (SELECT o_orderkey AS k, o_orderkey % 4 AS p, o_custkey % 16 AS r, o_orderkey // 4 % 8 AS c, o_custkey % 8192 AS n, o_orderkey % 2 AS a FROM orders)
    SELECT k, p::INT AS profile, [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350][(r + 1)::INT]::INT AS sample_rate,
    [0, 1, 2, 3, 4, 5, 6, 8][(c + 1)::INT]::INT AS channels, n::INT AS frame_length, CASE WHEN a = 1 THEN 7 ELSE 9 END AS header_size FROM x WHERE r < 13 AND c > 0 AND n >= 7""",
)
def adts_header(spark, sf_dir):
    word = F.lit(0xFFF << 44).cast("long")
    for x, at in ((order_key() % 2, 40), (order_key() % 4, 38), (cust_key() % 16, 34), (F.floor(order_key() / 4) % 8, 30), (cust_key() % 8192, 13)):
        word = word + F.shiftleft(x.cast("long"), at)
    rows = table(spark, sf_dir, "orders").select(order_key().alias("k"), headers.adts_header(to_be(word, 7)).alias("h"))
    return rows.filter("h IS NOT NULL").select("k", "h.*")


RATES_SQL = "[96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]"


@query(
    "adts_header_write",
    f"""WITH x AS (SELECT o_orderkey AS k, o_orderkey % 13 AS r, o_orderkey % 2 + 1 AS c, o_custkey % 8000 + 7 AS n FROM orders)
    SELECT k, printf('FFF1%02X%02X%02X%02XFC', 64 + r * 4 + c // 4, c % 4 * 64 + n // 2048, n // 8 % 256, n % 8 * 32 + 31) AS raw FROM x""",
)
def adts_header_write(spark, sf_dir):
    rate = F.get(F.array(*map(F.lit, headers.AAC_RATES)), (order_key() % 13).cast("int"))
    return table(spark, sf_dir, "orders").select(order_key().alias("k"), F.hex(headers.adts_header_write(rate, order_key() % 2 + 1, cust_key() % 8000)).alias("raw"))


OPUS_SQL = """SELECT o_orderkey AS k, 1 AS version, (o_orderkey % 8 + 1)::INT AS channel_count, (o_custkey % 65536)::INT AS pre_skip, o_orderkey * 65537 % 4294967296 AS input_sample_rate, ((o_custkey * 977) % 65536 - 32768)::INT AS output_gain, (o_orderkey % 3)::INT AS channel_mapping_family FROM orders"""


@query("opus_head", OPUS_SQL)
def opus_head(spark, sf_dir):
    gain = cust_key() * 977 % 65536 - 32768
    packet = joined(text("OpusHead"), to_be(F.lit(1), 1), to_be(order_key() % 8 + 1, 1), to_le(cust_key() % 65536, 2), to_le(order_key() * 65537, 4), to_le(gain, 2), to_be(order_key() % 3, 1))
    return table(spark, sf_dir, "orders").select(order_key().alias("k"), headers.opus_head(packet).alias("h")).select("k", "h.*")


@query("opus_head_write", "SELECT o_orderkey AS k, '4F7075734865616401' || printf('%02X%02X%02X', o_orderkey % 2 + 1, o_custkey % 256, o_custkey // 256 % 256) || '80BB0000000000' AS raw FROM orders")
def opus_head_write(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(order_key().alias("k"), F.hex(headers.opus_head_write(order_key() % 2 + 1, cust_key() % 65536, F.lit(48000))).alias("raw"))


@query("opus_tags_write", "SELECT n_nationkey AS k, '4F707573546167730A000000746F6E6577726967687400000000' AS raw FROM nation")
def opus_tags_write(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.hex(headers.opus_tags_write()).alias("raw"))


@query("opus_duration", "SELECT o_orderkey AS k, greatest(0, o_orderkey - 312) AS total_samples, round(greatest(0, o_orderkey - 312) / 48000::DOUBLE, 9) AS duration_secs FROM orders")
def opus_duration(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(order_key().alias("k"), headers.opus_duration(order_key(), F.lit(312)).alias("d"))
    return rows.select("k", "d.total_samples", F.round("d.duration_secs", 9).alias("duration_secs"))


@query(
    "alac_config",
    """SELECT o_orderkey AS k, o_orderkey * 4099 % 4294967296 AS frame_length, [16, 20, 24, 32][(o_orderkey % 4 + 1)::INT]::INT AS bit_depth, 40 AS pb, 10 AS mb, 14 AS kb, (o_custkey % 8 + 1)::INT AS num_channels, (o_custkey % 65536)::INT AS max_run,
    o_orderkey * 17 % 4294967296 AS max_frame_bytes, o_custkey * 31 % 4294967296 AS avg_bit_rate, o_orderkey % 192000 + 1 AS sample_rate FROM orders""",
)
def alac_config(spark, sf_dir):
    depth = F.get(F.array(*map(F.lit, (16, 20, 24, 32))), (order_key() % 4).cast("int"))
    raw = joined(to_be(order_key() * 4099, 4), to_be(F.lit(0), 1), to_be(depth, 1), F.lit(bytearray([40, 10, 14])), to_be(cust_key() % 8 + 1, 1), to_be(cust_key() % 65536, 2), to_be(order_key() * 17, 4), to_be(cust_key() * 31, 4), to_be(order_key() % 192000 + 1, 4))
    return table(spark, sf_dir, "orders").select(order_key().alias("k"), headers.alac_config(raw).alias("h")).select("k", "h.*")


@query(
    "wav_header",
    "SELECT o_orderkey AS k, 1 AS format_code, (o_orderkey % 8 + 1)::INT AS channels, (o_custkey + 8000)::INT AS sample_rate, ([8, 16, 24, 32][(o_orderkey % 4 + 1)::INT])::INT AS bit_depth, o_orderkey * 6 % 4000000000 AS data_bytes FROM orders",
)
def wav_header(spark, sf_dir):
    bits = F.get(F.array(*map(F.lit, (8, 16, 24, 32))), (order_key() % 4).cast("int"))
    raw = headers.wav_header_write(order_key() * 6 % 4000000000, cust_key() + 8000, order_key() % 8 + 1, bits)
    return table(spark, sf_dir, "orders").select(order_key().alias("k"), headers.wav_header(raw).alias("h")).select("k", "h.*")


# Packets: turns of a conversation, in order, as one stream.

STREAM = "p AS (SELECT conv_id AS stream, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS packet, octet_length(encode(coalesce(text, ''))) AS size FROM conversations)"
SEGS = f"{STREAM}, s AS (SELECT stream, packet, unnest(range(size // 255 + 1)) AS seg, size FROM p), l AS (SELECT stream, packet, seg::INT AS seg, CASE WHEN seg < size // 255 THEN 255 ELSE size % 255 END::INT AS lace FROM s)"


def _packets(spark, sf_dir):
    w = F.row_number().over(packets.Window.partitionBy("conv_id").orderBy("turn")) - 1
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream"), w.alias("packet"), size.alias("size"))


@query("ogg_lacing", f"WITH {SEGS} SELECT stream, packet::INT AS packet, seg, lace FROM l")
def ogg_lacing(spark, sf_dir):
    return packets.segments(_packets(spark, sf_dir), F.col("size"))


@query("ogg_packets", f"WITH {STREAM} SELECT stream, packet::BIGINT AS packet_id, (size // 255 + 1)::BIGINT AS n_segments, size::BIGINT AS size FROM p")
def ogg_packets(spark, sf_dir):
    """Segments without their packet numbers, put together again."""
    rows = packets.segments(_packets(spark, sf_dir), F.col("size"))
    rows = rows.select("stream", F.struct("packet", "seg").alias("pos"), "lace")
    return packets.packets(rows)


@query("ogg_mux", f"WITH {STREAM} SELECT stream, packet::INT AS packet, packet::INT AS page_no, (CASE WHEN packet = 0 THEN 2 ELSE 0 END + CASE WHEN packet = max(packet) OVER (PARTITION BY stream) THEN 4 ELSE 0 END)::INT AS flags FROM p")
def ogg_mux(spark, sf_dir):
    return packets.mux_flags(_packets(spark, sf_dir).select("stream", "packet"))


@query("opus_last_granule", f"WITH {STREAM} SELECT stream, max_by(size * 1000 + packet, packet)::BIGINT AS granule FROM p GROUP BY stream")
def opus_last_granule(spark, sf_dir):
    pages = _packets(spark, sf_dir).select("stream", F.col("packet").alias("page_no"), (F.col("size") * 1000 + F.col("packet")).cast("long").alias("granule"))
    return packets.last_granule(pages, ("stream",))


# Tags: texts as values.

FIELD_SQL = "['title', 'artist', 'album', 'track_number', 'year', 'genre', 'comment'][(item_id % 7 + 1)::INT]"
NAMES_SQL = "['Title', 'ARTIST', 'album', 'TRACKNUMBER', 'Date', 'genre', 'Comment']"


@query("vorbis_pair", f"SELECT item_id, upper({NAMES_SQL}[(item_id % 7 + 1)::INT]) AS field, replace(text, chr(10), '=') AS value FROM benchmark")
def vorbis_pair(spark, sf_dir):
    """Cut at the first = of several; keys of mixed case."""
    names = F.array(*map(F.lit, ("Title", "ARTIST", "album", "TRACKNUMBER", "Date", "genre", "Comment")))
    comment = F.concat(F.get(names, (F.col("item_id") % 7).cast("int")), F.lit("="), F.translate("text", "\n", "="))
    field, value = tags.pair(comment)
    return table(spark, sf_dir, "benchmark").select("item_id", field.alias("field"), value.alias("value"))


PIVOT_SQL = ", ".join(f"max_by(text, item_id) FILTER (item_id % 7 = {k}) AS {f}" for k, f in enumerate(tag_bytes.FIELDS))


def _groups(spark, sf_dir):
    """Texts of ten items as the tag of one file."""
    return table(spark, sf_dir, "benchmark").withColumn("file", F.floor(F.col("item_id") / 10)).withColumn("kind", (F.col("item_id") % 7).cast("int"))


@query("vorbis_comment", f"SELECT item_id // 10 AS file, {PIVOT_SQL} FROM benchmark GROUP BY file")
def vorbis_comment(spark, sf_dir):
    """Bytes of a block are built, split by a table function and pivoted; the last of a field wins."""
    udtf.register_all(spark)
    rows = _groups(spark, sf_dir)
    name = F.get(F.array(*map(F.lit, ("title", "Artist", "ALBUM", "tracknumber", "DATE", "genre", "comment"))), F.col("kind"))
    said = F.concat(name, F.lit("="), "text").cast("binary")
    one = F.hex(joined(to_le(F.octet_length(said), 4), said))
    blocks = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("item_id", one.alias("raw")))).alias("all"))
    raw = joined(to_le(F.lit(4), 4), text("test"), to_le(F.size("all"), 4), F.unhex(F.array_join(F.transform("all", lambda x: x["raw"]), "")))
    blocks.select("file", raw.alias("content")).createOrReplaceTempView("_vorbis_blocks")
    pairs = spark.sql("SELECT b.file, p.* FROM _vorbis_blocks b, LATERAL vorbis_pairs(b.content) p")
    return tags.from_vorbis(pairs, ("file",))


@query("opus_tags", f"SELECT item_id // 10 AS file, {PIVOT_SQL} FROM benchmark GROUP BY file")
def opus_tags(spark, sf_dir):
    """The same behind the magic of an OpusTags packet."""
    udtf.register_all(spark)
    name = F.get(F.array(*map(F.lit, ("title", "Artist", "ALBUM", "tracknumber", "DATE", "genre", "comment"))), F.col("kind"))
    said = F.concat(name, F.lit("="), "text").cast("binary")
    one = F.hex(joined(to_le(F.octet_length(said), 4), said))
    blocks = _groups(spark, sf_dir).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("item_id", one.alias("raw")))).alias("all"))
    raw = joined(text("OpusTags"), to_le(F.lit(4), 4), text("test"), to_le(F.size("all"), 4), F.unhex(F.array_join(F.transform("all", lambda x: x["raw"]), "")))
    content = blocks.select("file", raw.alias("packet")).filter(numeric.part(F.col("packet"), 0, 8) == text("OpusTags"))
    content.select("file", F.substring("packet", 9, 1 << 30).alias("content")).createOrReplaceTempView("_opus_tags")
    return tags.from_vorbis(spark.sql("SELECT b.file, p.* FROM _opus_tags b, LATERAL vorbis_pairs(b.content) p"), ("file",))


@query("id3_text", "SELECT item_id, (item_id % 3)::INT AS kind, text FROM benchmark")
def id3_text(spark, sf_dir):
    """Texts in encodings 1, 2 and 3 with a NUL at the end."""
    t = F.concat("text", F.lit("\0"))
    kind = F.col("item_id") % 3
    frame = (
        F.when(kind == 0, joined(F.lit(bytearray(b"\1\xff\xfe")), F.encode(t, "UTF-16LE")))
        .when(kind == 1, joined(F.lit(bytearray(b"\2")), F.encode(t, "UTF-16BE")))
        .otherwise(joined(F.lit(bytearray(b"\3")), t.cast("binary")))
    )
    return table(spark, sf_dir, "benchmark").select("item_id", kind.cast("int").alias("kind"), headers.id3_text(frame).alias("text"))


def _id3(spark, sf_dir, version: int):
    udtf.register_all(spark)
    names = ("TIT2", "TPE1", "TALB", "TRCK", "TYER", "TCON", "XXXX") if version > 2 else ("TT2", "TP1", "TAL", "TRK", "TYE", "TCO", "XXX")
    name = F.get(F.array(*map(F.lit, names)), F.col("kind")).cast("binary")
    body = joined(F.lit(bytearray(b"\3")), F.col("text").cast("binary"))
    n = F.octet_length(body)
    safe = joined(*[to_be(F.shiftright(n, s).bitwiseAND(F.lit(127)), 1) for s in (21, 14, 7, 0)])
    frame = joined(name, to_be(n, 3), body) if version == 2 else joined(name, safe if version == 4 else to_be(n, 4), F.lit(bytearray(2)), body)
    whole = _groups(spark, sf_dir).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("item_id", F.hex(frame).alias("raw")))).alias("all"))
    content = F.unhex(F.array_join(F.transform("all", lambda x: x["raw"]), ""))
    size = F.octet_length(content)
    head = joined(text("ID3"), F.lit(bytearray([version, 0, 0])), *[to_be(F.shiftright(size, s).bitwiseAND(F.lit(127)), 1) for s in (21, 14, 7, 0)])
    whole.select("file", joined(head, content).alias("content")).createOrReplaceTempView(f"_id3_{version}")
    return spark.sql(f"SELECT b.file, f.* FROM _id3_{version} b, LATERAL id3_frames(b.content) f")


ID3_SQL = "SELECT item_id // 10 AS file, {} FROM benchmark GROUP BY file".format(PIVOT_SQL.rsplit(", max_by", 1)[0])
FRAMES_SQL = "SELECT item_id // 10 AS file, (row_number() OVER (PARTITION BY item_id // 10 ORDER BY item_id) - 1)::INT AS frame_no, {}[(item_id % 7 + 1)::INT] AS id, octet_length(encode(text)) + 1 AS size FROM benchmark"


@query("id3v2", ID3_SQL)
def id3v2(spark, sf_dir):
    """Version 2.3; the field without a text frame is left out of the result."""
    return tags.from_id3(_id3(spark, sf_dir, 3), ("file",)).drop("comment")


@query("id3v22_frames", FRAMES_SQL.format("['TT2', 'TP1', 'TAL', 'TRK', 'TYE', 'TCO', 'XXX']"))
def id3v22_frames(spark, sf_dir):
    return _id3(spark, sf_dir, 2).select("file", "frame_no", "id", F.octet_length("body").cast("long").alias("size"))


@query("id3v23_frames", FRAMES_SQL.format("['TIT2', 'TPE1', 'TALB', 'TRCK', 'TYER', 'TCON', 'XXXX']"))
def id3v23_frames(spark, sf_dir):
    return _id3(spark, sf_dir, 3).select("file", "frame_no", "id", F.octet_length("body").cast("long").alias("size"))


@query("id3v24_frames", FRAMES_SQL.format("['TIT2', 'TPE1', 'TALB', 'TRCK', 'TYER', 'TCON', 'XXXX']"))
def id3v24_frames(spark, sf_dir):
    return _id3(spark, sf_dir, 4).select("file", "frame_no", "id", F.octet_length("body").cast("long").alias("size"))
