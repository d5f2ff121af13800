"""Media columns: baseline JPEG.

``decode_luminance`` reads baseline JPEG: it parses the markers, Huffman-decodes
the scan and rebuilds the luminance thumbnail from the DC coefficients alone
(one sample for each 8x8 block). All restart intervals of all images that share
tables are decoded in lockstep, one numpy vector lane each.

``encode_payload`` stores bytes losslessly as such images: each byte is the
level of one flat 8x8 block, so that its quantised DC coefficient (step 8) is
the byte less 128, and the DC-only thumbnail is the payload again.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import crc32, id_and_text, new_table_path, slices, utf8

UNIT = 576
INTERVAL = 64
FRAME = UNIT * 4096

# The zigzag-first quantiser step for DC; codes for the DC size classes 0 to 8; the end-of-block code.
DC_STEP = 8
DC_CLASSES = list(range(9))
DC_CODE_BITS = 4

_diff = np.arange(-255, 256)
_class = np.ceil(np.log2(np.abs(_diff) + 1)).astype(np.int64)
_extra = np.where(_diff < 0, _diff + (1 << _class) - 1, _diff)
#: By difference + 255: the code word (class, magnitude, end of block) and its length.
CODE = (((_class << _class) | _extra) << 1).astype(np.int64)
CODE_BITS = (DC_CODE_BITS + _class + 1).astype(np.int64)


def pad_payload(data: bytes) -> bytes:
    """Bytes 255 are appended up to a positive multiple of 576."""
    size = max(1, -(-len(data) // UNIT)) * UNIT
    return data + b"\xff" * (size - len(data))


def _header(size: int) -> bytes:
    across = 24 if size <= 24 * 1024 else UNIT
    height, width = size // across * 8, across * 8
    segment = lambda marker, body: bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    dc = bytes([0x00, 0, 0, 0, len(DC_CLASSES), *[0] * 12, *DC_CLASSES])
    ac = bytes([0x10, 1, *[0] * 15, 0])
    return b"".join([
        b"\xff\xd8",
        segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"),
        segment(0xDB, bytes([0, DC_STEP, *[1] * 63])),
        segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
        segment(0xC4, dc),
        segment(0xC4, ac),
        segment(0xDD, INTERVAL.to_bytes(2, "big")),
        segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def encode_payload(payloads: list[bytes]) -> list[bytes]:
    """One media value for each payload: a row of JPEG images of at most ``FRAME`` blocks, one after the other."""
    frames = [p[i : i + FRAME] for p in payloads for i in range(0, len(p), FRAME)]
    if not frames:
        return []
    level = np.frombuffer(b"".join(frames), np.uint8).astype(np.int64).reshape(-1, INTERVAL) - 128
    diff = np.diff(level, axis=1, prepend=0) + 255
    bits = CODE_BITS[diff]
    after = bits.cumsum(axis=1)
    size = (after[:, -1] + 7) >> 3
    start = np.concatenate([[0], size.cumsum()])
    at = (after - bits + 8 * start[:-1, None]).ravel()
    code = CODE[diff].ravel() << (24 - bits.ravel() - (at & 7))
    at >>= 3
    n = int(start[-1])
    out = np.zeros(n + 2)
    for k in range(3):
        out[k:] += np.bincount(at, weights=(code >> (16 - 8 * k)) & 255, minlength=n + 2)[: n + 2 - k]
    scan = out[:n].astype(np.uint8)
    pad = 8 * size - after[:, -1]
    scan[start[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    # A zero byte follows each 255, and a marker follows each interval: restart, or end of image.
    stuffed = scan == 255
    interval = np.repeat(np.arange(len(size)), size)
    place = np.arange(n) + np.cumsum(stuffed) - stuffed + 2 * interval
    total = n + int(stuffed.sum()) + 2 * len(size)
    stream = np.zeros(total, np.uint8)
    stream[place] = scan
    end = place[start[1:] - 1] + 1 + stuffed[start[1:] - 1]
    stream[end] = 0xFF
    per_frame = np.array([len(f) // INTERVAL for f in frames])
    last = per_frame.cumsum() - 1
    number = np.arange(len(size)) - np.repeat(last + 1 - per_frame, per_frame)
    stream[end + 1] = 0xD0 + number % 8
    stream[end[last] + 1] = 0xD9
    edges = [0, *(end[last] + 2).tolist()]
    coded = [_header(len(f)) + stream[a:b].tobytes() for f, a, b in zip(frames, edges, edges[1:])]
    media, k = [], 0
    for p in payloads:
        count = -(-len(p) // FRAME)
        media.append(b"".join(coded[k : k + count]))
        k += count
    return media


def _lookup(lengths: bytes, symbols: bytes) -> np.ndarray:
    """By the next 16 bits: code length * 256 + symbol; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int64)
    code = k = 0
    for length, count in enumerate(lengths, 1):
        for _ in range(count):
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The tables, dimensions and scan of the image at ``at``, and where it ends."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    image = {"quant": {}, "huffman": {}, "restart": 0}
    at += 2
    while True:
        marker = data[at + 1]
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                step = int.from_bytes(body[1 : 2 + wide], "big")
                image["quant"][body[0] & 15] = step
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                image["huffman"][body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0 or marker == 0xC1:
            image["height"], image["width"] = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline JPEG is supported")
        elif marker == 0xDD:
            image["restart"] = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            image["scan"] = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            break
        elif marker == 0xD9:
            raise ValueError("no scan")
    end = data.find(b"\xff\xd9", at)
    if end < 0:
        raise ValueError("no end of image")
    image["data"] = data[at:end]
    return image, end + 2


def _intervals(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entropy-coded bytes without stuffing and markers; where each interval starts; intervals of each scan."""
    raw = np.frombuffer(b"".join(scans) + b"\0", np.uint8)
    ends = np.cumsum([len(s) for s in scans])
    mark = raw[:-1] == 255
    restart = np.flatnonzero(mark & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7))
    keep = np.ones(len(raw) - 1, bool)
    zero = np.flatnonzero(mark & (raw[1:] == 0)) + 1
    keep[zero[zero < len(keep)]] = False
    keep[restart] = keep[restart + 1] = False
    position = np.cumsum(keep) - keep
    firsts = np.concatenate([[0], ends[:-1]])
    begin = np.sort(np.concatenate([firsts, restart + 2]))
    count = np.diff(np.searchsorted(begin, np.concatenate([firsts, ends[-1:]])))
    return raw[:-1][keep], np.concatenate([position, [keep.sum()]])[begin], count


def decode_luminance(media: list[bytes]) -> list[list[np.ndarray]]:
    """For each value, the DC-only luminance thumbnail (uint8, one sample for each 8x8 block) of each of its images."""
    result: list[list] = [[] for _ in media]
    groups = defaultdict(list)
    for k, data in enumerate(media):
        at = 0
        while at < len(data):
            image, at = parse(data, at)
            image["at"] = k, len(result[k])
            result[k].append(None)
            key = str([image[x] for x in ("quant", "huffman", "restart", "parts", "scan")])
            if not image["restart"]:
                key += f" {image['height']} {image['width']}"
            groups[key].append(image)
    for images in groups.values():
        for image, thumbnail in zip(images, _decode(images)):
            k, i = image["at"]
            result[k][i] = thumbnail
    return result


def _decode(images: list[dict]) -> list[np.ndarray]:
    first = images[0]
    parts = {p[0]: p for p in first["parts"]}
    alone = len(first["scan"]) == 1
    h, v = (1, 1) if alone else (max(p[1] for p in parts.values()), max(p[2] for p in parts.values()))
    down = lambda n, by: -(-n // by)
    units = [(down(i["width"], 8 * h), down(i["height"], 8 * v)) for i in images]
    blocks = []  # of one minimum coded unit: component, tables
    for k, (part, dc, ac) in enumerate(first["scan"]):
        blocks += [(k, _lookup(*first["huffman"][dc]), _lookup(*first["huffman"][16 + ac]))] * (1 if alone else parts[part][1] * parts[part][2])
    data, begin, count = _intervals([i["data"] for i in images])
    data = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    last = len(window) - 1
    at = begin * 8
    total = np.array([a * b for a, b in units])
    restart = first["restart"] or int(total.max())
    number = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(restart, np.repeat(total, count) - number * restart)
    lanes = np.arange(len(at))
    predicted = np.zeros((len(first["scan"]), len(at)), np.int64)
    of_luma = sum(k == 0 for k, *_ in blocks)
    level = np.zeros((restart * of_luma, len(at)), np.int64)

    def take(lane, bits):
        """The next ``bits`` bits (16 at most) of each lane; the position stays."""
        p = at[lane]
        return ((window[np.minimum(p >> 3, last)] << (p & 7)) & 0xFFFFFFFF) >> (32 - bits)

    row = 0
    for unit in range(restart):
        live = lanes if unit < length.min() else lanes[length > unit]
        for k, dc, ac in blocks:
            symbol = dc[take(live, 16)]
            at[live] += symbol >> 8
            bits = symbol & 255
            value = take(live, np.maximum(bits, 1))
            value = np.where(bits == 0, 0, value)
            at[live] += bits
            predicted[k, live] += np.where(value < (1 << bits) >> 1, value - (1 << bits) + 1, value)
            if k == 0:
                level[row, live] = predicted[0, live]
                row += 1
            left, index = live, np.ones(len(live), np.int64)
            while len(left):
                symbol = ac[take(left, 16)]
                at[left] += (symbol >> 8) + (symbol & 15)
                index = index + ((symbol & 255) >> 4) + 1
                more = ((symbol & 255) != 0) & (index < 64)
                left, index = left[more], index[more]
    step = first["quant"][parts[first["scan"][0][0]][3]]
    level = np.clip((level * step + 1028) >> 3, 0, 255).astype(np.uint8)
    thumbnails, edge = [], 0
    part = parts[first["scan"][0][0]]
    ph, pv = (1, 1) if alone else part[1:3]
    for image, (across, high), n in zip(images, units, count):
        flat = level[:, edge : edge + n].T.reshape(-1)[: across * high * ph * pv]
        edge += n
        grid = flat.reshape(high, across, pv, ph).transpose(0, 2, 1, 3).reshape(high * pv, across * ph)
        rows, columns = (down(down(image[d] * part[1 + w] , 1 if alone else m), 8) for d, w, m in (("height", 1, v), ("width", 0, h)))
        thumbnails.append(grid if alone else grid[:rows, :columns])
    return thumbnails


def thumbnail_hashes(thumbnail: np.ndarray) -> tuple[int, int]:
    """Average and difference hash of 64 bits each."""
    def shrink(rows, columns):
        y = np.arange(rows + 1) * thumbnail.shape[0] // rows
        x = np.arange(columns + 1) * thumbnail.shape[1] // columns
        area = np.zeros((thumbnail.shape[0] + 1, thumbnail.shape[1] + 1), np.int64)
        area[1:, 1:] = thumbnail.cumsum(0, np.int64).cumsum(1)
        lo_y, lo_x = np.minimum(y[:-1], thumbnail.shape[0] - 1), np.minimum(x[:-1], thumbnail.shape[1] - 1)
        hi_y, hi_x = np.maximum(y[1:], lo_y + 1), np.maximum(x[1:], lo_x + 1)
        total = area[np.ix_(hi_y, hi_x)] - area[np.ix_(lo_y, hi_x)] - area[np.ix_(hi_y, lo_x)] + area[np.ix_(lo_y, lo_x)]
        return total / np.outer(hi_y - lo_y, hi_x - lo_x)

    number = lambda bits: int.from_bytes(np.packbits(bits.ravel()).tobytes(), "big")
    square, wide = shrink(8, 8), shrink(8, 9)
    return number(square > square.mean()), number(wide[:, 1:] > wide[:, :-1])


def feature(thumbnails: list[np.ndarray]) -> str:
    """Pixel dimensions and thumbnail hashes of each image."""
    return ";".join("{}x{}:{:016x}:{:016x}".format(8 * t.shape[1], 8 * t.shape[0], *thumbnail_hashes(t)) for t in thumbnails)


MEDIA = "doc_id long, n_bytes long, media binary"


def store_media(docs: DataFrame, target: str) -> None:
    """Write ``doc_id, n_bytes, media``, each whole text as a media value, to the table ``target``. Null text is empty; repeated rows and null ids stay."""
    def run(batches):
        for batch in slices(batches):
            texts = utf8(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(encode_payload([pad_payload(t) for t in texts]), pa.binary())], ["doc_id", "n_bytes", "media"])

    # Texts have much in common, which a wide search finds in their codes as well.
    rows = id_and_text(docs).mapInArrow(run, MEDIA).write.option("compression", "zstd")
    rows.option("parquet.compression.codec.zstd.level", "9").option("parquet.page.size", str(4 << 20)).parquet(target)


def media_features(stored: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature`` of each stored row, from the stored bytes alone.

    Repeated rows and null ids stay; a media value of several images is read as one payload. No rows: no rows.
    """
    def run(batches):
        for batch in slices(batches, "media"):
            media = utf8(batch.column(2))
            rows = []
            for data, thumbnails in zip(media, decode_luminance(media)):
                payload = b"".join(t.tobytes() for t in thumbnails)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(thumbnails)))
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def jpeg_media(docs: DataFrame) -> DataFrame:
    """Each text stored as JPEG in a table of the shared folder, and read back from there: a row in, a row out.

    Null and empty texts are one block of padding. Equal texts give equal values;
    repeated rows and null ids stay; other columns are not looked at. No rows: no rows.
    """
    target = new_table_path(docs.sparkSession, "media")
    store_media(docs, target)
    return media_features(docs.sparkSession.read.schema(MEDIA).parquet(target))
