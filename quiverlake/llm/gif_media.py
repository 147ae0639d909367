"""GIF columns: writing byte payloads as GIF, and decoding GIF to timed frames with colour histograms.

The decoder reads the block structure, runs LZW code streams, fills the screen
from local or global palettes, honours transparency, interlacing and disposal,
and gives every frame its start and duration. The writer stores any bytes
losslessly as 8-bit samples of one or more frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import fold_rows, table

#: Samples in a row of a stored payload, and the most rows of one frame; longer payloads take more frames.
WIDTH, ROWS = 64, 16384
#: Bins of a colour histogram: two bits for each of red, green and blue.
BINS = 64
#: Pixels of a screen or a frame beyond which a file isn't decoded: the header of a few bytes can ask for any size.
PIXELS = 1 << 25


def lzw_codes(data: bytes) -> tuple[list[int], list[int]]:
    """LZW of 8-bit samples: runs of codes and each run's bit width, clear and end codes included."""
    codes: list[int] = [256]
    ends: list[tuple[int, int]] = []  # (number of codes so far, width that held up to here)
    table: dict[int, int] = {}
    find, put = table.get, codes.append
    free, width, top = 258, 9, 512
    it = iter(data)
    prefix = next(it)
    for b in it:
        key = prefix << 8 | b
        k = find(key)
        if k is not None:
            prefix = k
            continue
        put(prefix)
        prefix = b
        if free < 4096:
            table[key] = free
            free += 1
            if free > top:
                ends.append((len(codes), width))
                width += 1
                top <<= 1
        else:
            put(256)
            ends.append((len(codes), width))
            table.clear()
            free, width, top = 258, 9, 512
    put(prefix)
    if free < 4096 and free + 1 > top:
        ends.append((len(codes), width))
        width += 1
    put(257)
    ends.append((len(codes), width))
    return codes, ends


def packed(codes: list[int], ends: list[tuple[int, int]]) -> bytes:
    """Codes, least significant bit first, each in its width."""
    c = np.array(codes, np.uint32)
    w = np.empty(len(c), np.int64)
    last = 0
    for upto, width in ends:
        w[last:upto] = width
        last = upto
    at = np.cumsum(w) - w
    size = (int(w.sum()) + 7) // 8
    out = np.zeros(size + 4, np.uint8)
    v = c << (at & 7).astype(np.uint32)
    byte = at >> 3
    for k in range(3):
        part = ((v >> np.uint32(8 * k)) & np.uint32(255)).astype(np.float64)
        out[: size + 1] |= np.bincount(byte + k, part, minlength=size + 1)[: size + 1].astype(np.uint8)
    return out[:size].tobytes()


def blocks(data: bytes) -> bytes:
    """data cut into sub-blocks of 255 bytes and ended by an empty one."""
    whole = len(data) // 255 * 255
    body = b""
    if whole:
        a = np.empty((whole // 255, 256), np.uint8)
        a[:, 0] = 255
        a[:, 1:] = np.frombuffer(data, np.uint8, whole).reshape(-1, 255)
        body = a.tobytes()
    rest = data[whole:]
    return body + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def write_gif(payload: bytes, width: int = WIDTH, delay: int = 10) -> bytes:
    """payload, whose length is a positive multiple of `width`, as a GIF with a grey palette, losslessly; a frame has ROWS rows at most."""
    rows = len(payload) // width
    height = min(rows, ROWS)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), bytes(v for k in range(256) for v in (k, k, k))]
    for at in range(0, rows, ROWS):
        part = payload[at * width : (at + ROWS) * width]
        out.append(b"\x21\xf9\x04\x04" + struct.pack("<H", delay) + b"\0\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08" + blocks(packed(*lzw_codes(part))))
    return b"".join([*out, b"\x3b"])


def schedule(least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit offset and width of each code that follows a clear code, as long as the table can grow and a little on."""
    count = 4096 - (1 << least)
    free = (1 << least) + 2 + np.maximum(np.arange(count) - 1, 0)  # entries when the k-th code is read
    width = np.minimum(np.maximum(np.floor(np.log2(free)).astype(np.int64) + 1, least + 1), 12)
    return np.cumsum(width) - width, width


_SCHEDULES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def unlzw(data: bytes, least: int, need: int) -> bytes:
    """Samples of an LZW stream; as many as came if it ends early, `need` at most.

    Code widths depend only on the number of codes since the last clear code, so
    a run of codes is cut out of the bits at once and the table is walked after.
    """
    clear, stop = 1 << least, (1 << least) + 1
    if least not in _SCHEDULES:
        _SCHEDULES[least] = schedule(least)
    offsets, widths = _SCHEDULES[least]
    raw = np.zeros(len(data) + 4, np.uint32)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    base = [bytes([k]) for k in range(clear)] + [b"", b""]
    words, last = list(base), b""
    out: list[bytes] = []
    at, bits, got_bytes = 0, 8 * len(data), 0
    full = False  # the table can't grow: all codes have twelve bits
    while got_bytes < need:
        off, wide = (np.arange(len(offsets)) * 12, np.full(len(offsets), 12)) if full else (offsets, widths)
        n = int(np.searchsorted(off + wide, bits - at, "right"))
        if n <= 0:
            break
        pos, wide = off[:n] + at, wide[:n]
        byte, shift = pos >> 3, (pos & 7).astype(np.uint32)
        codes = (raw[byte] | raw[byte + 1] << np.uint32(8) | raw[byte + 2] << np.uint32(16)) >> shift & ((1 << wide) - 1).astype(np.uint32)
        ctrl = np.flatnonzero((codes == clear) | (codes == stop))
        run = int(ctrl[0]) if len(ctrl) else n
        put, add, broken = out.append, words.append, False
        for code in codes[:run].tolist():
            if code < len(words):
                got = words[code]
                if last and len(words) < 4096:
                    add(last + got[:1])
            elif code == len(words) and last and code < 4096:
                got = last + last[:1]
                add(got)
            else:
                broken = True
                break
            put(got)
            last = got
            got_bytes += len(got)
        if broken or (len(ctrl) and codes[run] == stop):
            break
        at = int(pos[min(run, n - 1)] + wide[min(run, n - 1)])
        if len(ctrl):
            words, last, full = list(base), b"", False
        elif n < len(off):
            break
        else:
            full = True
    return b"".join(out)[:need]


@dataclass
class Frame:
    """One shown picture: RGBA of the whole screen after this frame, its start and duration in hundredths of a second, and the samples as stored."""

    index: int
    start: int
    duration: int
    screen: np.ndarray
    samples: bytes
    box: tuple[int, int, int, int]


def read_gif(data: bytes, screens: bool = True) -> tuple[int, int, list[Frame]]:
    """(width, height, frames) of a GIF. ValueError if it isn't one; a file that breaks off gives the frames that are whole or begun."""
    frames = list(shown_frames(data, screens))
    return *struct.unpack("<HH", data[6:10]), frames


def shown_frames(data: bytes, screens: bool = True) -> Iterator[Frame]:
    """The frames of a GIF, one in memory at a time; without `screens` only their samples. ValueError for what isn't one, and where a screen or a frame has more than PIXELS."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, back = struct.unpack("<HHBB", data[6:12])
    if width * height > PIXELS:
        raise ValueError("a screen of too many pixels")
    at = 13
    common = None
    if flags & 0x80:
        n = 2 << (flags & 7)
        common = np.frombuffer(data[at : at + 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(-1, 3)
        at += 3 * n
    screen = np.zeros((height, width, 4) if screens else (0, 0, 4), np.uint8)
    index, clock, delay, clear_index, disposal = 0, 0, 0, -1, 0

    def gathered(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and (n := data[at]):
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(parts), at + 1

    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = gathered(at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay, clear_index = body[0] >> 2 & 7, body[1] | body[2] << 8, body[3] if body[0] & 1 else -1
            continue
        if kind != 0x2C or at + 10 > len(data):
            break
        x, y, w, h, f = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        palette = common
        if f & 0x80:
            n = 2 << (f & 7)
            palette = np.frombuffer(data[at : at + 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(-1, 3)
            at += 3 * n
        if at >= len(data):
            break
        least = data[at]
        body, at = gathered(at + 1)
        if w * h > PIXELS:
            raise ValueError("a frame of too many pixels")
        samples = unlzw(body, min(max(least, 1), 11), w * h)
        before = screen.copy() if disposal == 3 else None
        px = np.frombuffer(samples.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if f & 0x40:
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            px = px[np.argsort(order)]
        pal = palette if palette is not None else np.zeros((1, 3), np.uint8)
        hh, ww = max(0, min(h, len(screen) - y)), max(0, min(w, screen.shape[1] - x))
        rgb = pal[np.minimum(px[:hh, :ww], len(pal) - 1)]
        part = screen[y : y + hh, x : x + ww]
        if clear_index >= 0:
            see = px[:hh, :ww] != clear_index
            part[see, :3] = rgb[see]
            part[see, 3] = 255
        else:
            part[..., :3] = rgb
            part[..., 3] = 255
        shown = screen.copy()
        if disposal == 2:
            screen[y : y + hh, x : x + ww] = 0
        elif disposal == 3:
            screen = before
        yield Frame(index, clock, delay, shown, samples, (x, y, w, h))
        index += 1
        clock += delay
        delay, clear_index, disposal = 0, -1, 0


def histogram(screen: np.ndarray) -> np.ndarray:
    """Counts of the visible pixels by two bits of each colour."""
    p = screen[screen[..., 3] > 0]
    return np.bincount((p[:, 0] >> 6).astype(np.int64) * 16 + (p[:, 1] >> 6) * 4 + (p[:, 2] >> 6), minlength=BINS)


def gif_frames(media: DataFrame, key: str = "doc_id", column: str = "gif") -> DataFrame:
    """A row for each frame of each GIF: key, frame, start_cs, duration_cs, width, height, rgba of the screen, histogram.

    Null files, files that aren't GIFs and screens or frames of more than PIXELS
    give no row; a file that breaks off gives the frames before; repeated rows
    come out as often; other columns are ignored; an empty table gives none.
    """

    def run(batches):
        for b in batches:
            for k, data in zip(b[key], b[column]):
                try:
                    for f in shown_frames(data or b""):
                        h, w = f.screen.shape[:2]
                        yield k, f.index, f.start, f.duration, w, h, f.screen.tobytes(), histogram(f.screen).tolist()
                except ValueError:
                    continue

    return fold_rows(media.select(key, column), f"{key} long, frame int, start_cs long, duration_cs int, width int, height int, rgba binary, histogram array<long>", run, 16)


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")


def stored_payloads(docs: DataFrame) -> DataFrame:
    """Every whole text as a GIF, read back: sizes, hashes, and as a feature the number and size of the frames and the colour histogram of the composed screens.

    A null text counts as empty; equal texts give equal values; repeated rows
    come out as often; a long text has several frames; other columns are
    ignored; no documents, no rows.
    """

    def one(text):
        n, payload = payload_of(text)
        gif = write_gif(payload)
        parts, colours = [], np.zeros(BINS, np.int64)
        for f in shown_frames(gif):
            parts.append(f.samples)
            colours += histogram(f.screen)
        back = b"".join(parts)
        if back != payload:
            raise ValueError("a payload doesn't come back from its GIF")
        feature = f"{len(parts)}x{WIDTH}x{len(back) // WIDTH}:" + ",".join(f"{k}={v}" for k, v in enumerate(colours.tolist()) if v)
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(gif), hashlib.sha256(gif).hexdigest(), feature

    def run(batches):
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                yield (doc_id, *one(text))

    return fold_rows(docs.select("doc_id", "text"), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", run)


def op10_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, hashes and features of every document stored as a GIF and read back; odd rows as stored_payloads says."""
    return stored_payloads(table(spark, sf_dir, "documents"))


QUERIES = {"op10_gif": op10_gif}
ORACLE: dict = {}
