"""Byte formats: Blosc 1 chunks, TIFF pages, PNG images, per-pixel maps."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

#: Fixed values of the Blosc 1 header: flag bits and codec numbers.
SHUFFLE, MEMCPY, BITSHUFFLE = 1, 2, 4
CODECS = {1: "lz4_raw", 4: "zstd"}


def blosc_header(data: bytes) -> dict[str, int]:
    """version, codec version, flags, typesize, nbytes, blocksize and cbytes of the 16-byte header."""
    names = ("version", "versionlz", "flags", "typesize", "nbytes", "blocksize", "cbytes")
    return dict(zip(names, struct.unpack_from("<4B3I", data), strict=True))


def blosc_decode(data: bytes) -> bytes:
    """A Blosc 1 chunk with LZ4 or Zstandard blocks; bytes shuffled by type are put back.  Raises ValueError for other codecs, bit shuffling and split blocks."""
    h = blosc_header(data)
    nbytes, size, flags, width = h["nbytes"], h["blocksize"], h["flags"], h["typesize"]
    if flags & MEMCPY:
        return data[16 : 16 + nbytes]
    if flags & BITSHUFFLE:
        raise ValueError("bit shuffling is not supported")
    if flags >> 5 not in CODECS:
        raise ValueError(f"codec {flags >> 5} is not supported")
    if width > 1 and not flags & 0x10:
        raise ValueError("split blocks are not supported")
    codec = pa.Codec(CODECS[flags >> 5])
    n_blocks = -(-nbytes // size) if size else 0
    out = []
    for k, at in enumerate(struct.unpack_from(f"<{n_blocks}I", data, 16)):
        want = min(size, nbytes - k * size)
        (packed,) = struct.unpack_from("<I", data, at)
        body = data[at + 4 : at + 4 + packed]
        block = body if packed == want else codec.decompress(body, want, asbytes=True)
        if flags & SHUFFLE and width > 1:
            whole = want - want % width
            block = np.frombuffer(block[:whole], np.uint8).reshape(width, -1).T.tobytes() + block[whole:]
        out.append(block)
    return b"".join(out)


def blosc_encode(data: bytes, blocksize: int = 1 << 17, codec: str = "lz4_raw") -> bytes:
    """A Blosc 1 chunk of single bytes."""
    number = {v: k for k, v in CODECS.items()}[codec]
    pack = pa.Codec(codec)
    blocks = []
    for k in range(0, len(data), blocksize):
        raw = data[k : k + blocksize]
        packed = pack.compress(raw, asbytes=True)
        blocks.append(raw if len(packed) >= len(raw) else packed)
    at, offsets = 16 + 4 * len(blocks), []
    for b in blocks:
        offsets.append(at)
        at += 4 + len(b)
    head = struct.pack("<4B3I", 2, 1, SHUFFLE | number << 5, 1, len(data), blocksize, at)
    return head + struct.pack(f"<{len(blocks)}I", *offsets) + b"".join(struct.pack("<I", len(b)) + b for b in blocks)


def zstd_decode(data: bytes) -> bytes:
    """A whole Zstandard buffer, of one frame or several."""
    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as stream:
        return stream.read()


#: TIFF tags.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, COUNTS, PLANAR = 256, 257, 258, 259, 273, 277, 279, 284
_SIZES = {1: "B", 3: "H", 4: "I"}


def tiff_pages(data: bytes) -> list[dict[int, tuple[int, ...]]]:
    """The integer tags of each page."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    pages = []
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    while at:
        (n,) = struct.unpack_from(f"{order}H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
            if kind in _SIZES:
                spec = f"{order}{count}{_SIZES[kind]}"
                place = at + 10 + 12 * k
                if struct.calcsize(spec) > 4:
                    (place,) = struct.unpack_from(f"{order}I", data, place)
                tags[tag] = struct.unpack_from(spec, data, place)
        pages.append(tags)
        (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)
    return pages


def tiff_samples(data: bytes, width: int | None = None, height: int | None = None) -> np.ndarray:
    """(pages, height, width) 16-bit samples of uncompressed one-strip pages.  A tag that is there must fit; one that is absent passes."""
    order = "<" if data[:2] == b"II" else ">"
    out = []
    for tags in tiff_pages(data):
        for tag, want in ((BITS, 16), (COMPRESSION, 1), (SAMPLES, 1), (PLANAR, 1), (WIDTH, width), (HEIGHT, height)):
            if want is not None and tag in tags and tags[tag][0] != want:
                raise ValueError(f"tag {tag} is {tags[tag][0]}, not {want}")
        if len(tags[OFFSETS]) != 1:
            raise ValueError("more than one strip")
        w, h = tags[WIDTH][0], tags[HEIGHT][0]
        out.append(np.frombuffer(data, f"{order}u2", w * h, tags[OFFSETS][0]).reshape(h, w))
    return np.stack(out)


def tiff_encode(pages: np.ndarray) -> bytes:
    """An uncompressed little-endian TIFF of 8- or 16-bit pages, one strip each."""
    pages = pages[None] if pages.ndim == 2 else pages
    bits = pages.dtype.itemsize * 8
    out, n = bytearray(struct.pack("<2sHI", b"II", 42, 8)), len(pages)
    size = 2 + 12 * 8 + 4
    for k, page in enumerate(pages):
        h, w = page.shape
        data_at = 8 + n * size + k * page.nbytes
        tags = ((WIDTH, 4, w), (HEIGHT, 4, h), (BITS, 3, bits), (COMPRESSION, 3, 1), (262, 3, 1), (OFFSETS, 4, data_at), (SAMPLES, 3, 1), (COUNTS, 4, page.nbytes))
        out += struct.pack("<H", len(tags))
        for tag, kind, v in tags:
            out += struct.pack("<HHII", tag, kind, 1, v)
        out += struct.pack("<I", 8 + (k + 1) * size if k + 1 < n else 0)
    return bytes(out) + b"".join(np.ascontiguousarray(p).astype(f"<u{bits // 8}").tobytes() for p in pages)


def png_encode(image: np.ndarray) -> bytes:
    """A PNG of (height, width) gray or (height, width, 3) colour bytes."""
    h, w = image.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], 1)
    head = struct.pack(">2I5B", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


class PngStream:
    """A gray PNG written line by line."""

    def __init__(self, write, width: int, height: int) -> None:
        self.write, self.pack = write, zlib.compressobj()
        write(b"\x89PNG\r\n\x1a\n")
        self._chunk(b"IHDR", struct.pack(">2I5B", width, height, 8, 0, 0, 0, 0))

    def _chunk(self, kind: bytes, body: bytes) -> None:
        if body or kind == b"IEND":
            self.write(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)))

    def add(self, lines: np.ndarray) -> None:
        self._chunk(b"IDAT", self.pack.compress(np.concatenate([np.zeros((len(lines), 1), np.uint8), lines], 1).tobytes()))

    def end(self) -> None:
        self._chunk(b"IDAT", self.pack.flush())
        self._chunk(b"IEND", b"")


class TiffStream:
    """An uncompressed gray TIFF of one strip written line by line."""

    def __init__(self, write, width: int, height: int) -> None:
        self.write = write
        if width * height >= 1 << 32:
            raise ValueError("the image is too large for a TIFF file")
        tags = ((WIDTH, 4, width), (HEIGHT, 4, height), (BITS, 3, 8), (COMPRESSION, 3, 1), (262, 3, 1), (OFFSETS, 4, 8 + 2 + 12 * 8 + 4), (SAMPLES, 3, 1), (COUNTS, 4, width * height))
        write(struct.pack("<2sHIH", b"II", 42, 8, len(tags)) + b"".join(struct.pack("<HHII", t, kind, 1, v) for t, kind, v in tags) + struct.pack("<I", 0))

    def add(self, lines: np.ndarray) -> None:
        self.write(np.ascontiguousarray(lines).tobytes())

    def end(self) -> None:
        pass


#: Fixed values of baseline JPEG: the quantisation of luminance at quality 50, row by row, and the lengths and symbols of its Huffman codes.
JPEG_QUANT = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
JPEG_DC = (bytes((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)), bytes(range(12)))


def _jpeg_codes(lengths: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Code and length of each symbol: codes of a length count on from the shorter ones."""
    out, code, at = {}, 0, 0
    for size, n in enumerate(lengths, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, size)
            code += 1
        at, code = at + n, code << 1
    return out


def _jpeg_ac() -> tuple[bytes, bytes]:
    """A code for each pair of a run of zeros and a size, small ones first: the file holds the table, so any complete one will do."""
    pairs = [0x00, 0xF0, *[run << 4 | size for run in range(16) for size in range(1, 11)]]
    pairs.sort(key=lambda p: ((p >> 4) + 2 * (p & 15) if p else 3, p))
    return bytes((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125)), bytes(pairs)


JPEG_AC = _jpeg_ac()


class JpegStream:
    """A gray baseline JPEG written in strips of whole blocks but for the last one."""

    def __init__(self, write, width: int, height: int, quality: int = 75) -> None:
        scale = 5000 / quality if quality < 50 else 200 - 2 * quality
        self.quant = np.clip((np.array(JPEG_QUANT).reshape(8, 8) * scale + 50) // 100, 1, 255)
        order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))  # zigzag
        self.zigzag = np.array([y * 8 + x for y, x in order])
        k = np.arange(8)
        self.dct = np.where(k[:, None] == 0, 8**-0.5, 0.5 * np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16))
        self.dc, self.ac = _jpeg_codes(*JPEG_DC), _jpeg_codes(*JPEG_AC)
        self.write, self.width, self.last, self.bits, self.n = write, width, 0, 0, 0
        if max(width, height) >= 1 << 16:
            raise ValueError("the image is too large for a JPEG file")
        part = lambda mark, body: bytes((0xFF, mark)) + struct.pack(">H", len(body) + 2) + body
        write(b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + part(0xDB, b"\0" + bytes(self.quant.ravel()[self.zigzag].astype(np.uint8))))
        write(part(0xC0, struct.pack(">BHHB3B", 8, height, width, 1, 1, 0x11, 0)) + part(0xC4, b"\x00" + b"".join(JPEG_DC)) + part(0xC4, b"\x10" + b"".join(JPEG_AC)) + part(0xDA, bytes((1, 1, 0, 0, 63, 0))))

    def add(self, lines: np.ndarray) -> None:
        h, w = lines.shape
        whole = np.pad(lines, ((0, -h % 8), (0, -w % 8)), "edge").astype(np.float64) - 128
        blocks = whole.reshape(whole.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        coded = np.rint(self.dct @ blocks @ self.dct.T / self.quant).astype(np.int64).reshape(-1, 64)[:, self.zigzag]
        out = bytearray()
        for block in coded.tolist():
            diff, self.last = block[0] - self.last, block[0]
            self._number(out, self.dc, 0, diff)
            run, end = 0, 63
            while end and not block[end]:
                end -= 1
            for v in block[1 : end + 1]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    self._emit(out, *self.ac[0xF0])
                    run -= 16
                self._number(out, self.ac, run, v)
                run = 0
            if end < 63:
                self._emit(out, *self.ac[0])
        self.write(bytes(out))

    def _number(self, out: bytearray, codes: dict, run: int, v: int) -> None:
        size = abs(v).bit_length()
        self._emit(out, *codes[run << 4 | size])
        if size:
            self._emit(out, v if v > 0 else v + (1 << size) - 1, size)

    def _emit(self, out: bytearray, code: int, size: int) -> None:
        self.bits, self.n = self.bits << size | code, self.n + size
        while self.n >= 8:
            byte = self.bits >> (self.n - 8) & 0xFF
            out.append(byte)
            if byte == 0xFF:
                out.append(0)
            self.n -= 8
        self.bits &= (1 << self.n) - 1

    def end(self) -> None:
        out = bytearray()
        if self.n:
            self._emit(out, (1 << (8 - self.n)) - 1, 8 - self.n)
        self.write(bytes(out) + b"\xff\xd9")


STREAMS = {"png": PngStream, "tif": TiffStream, "jpg": JpegStream}


def map_header(data: bytes) -> tuple[dict[str, str], int]:
    """The `key: value` lines of a per-pixel map and where its samples begin."""
    end = data.index(b"<>\n")
    pairs = [line.split(": ", 1) for line in data[:end].decode("ascii").splitlines() if ": " in line]
    return {k.strip(): v.strip() for k, v in pairs}, end + 3


def map_encode(values: np.ndarray) -> bytes:
    """A per-pixel map of (height, width, 6) doubles."""
    h, w, _ = values.shape
    return f"width: {w}\nheight: {h}\ndim: 6\nordered: true\ntype: double\nversion: 1\n<>\n".encode() + values.astype("<f8").tobytes()
