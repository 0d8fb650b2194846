"""Decoders of compressed pixels that no library here gives: LZW and PackBits of TIFF, Blosc frames, and the checksum of chunks."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard

#: Fixed values of the formats: LZW's codes to begin anew and to end; Blosc's flags and the numbers of its compressors.
LZW_CLEAR, LZW_END, LZW_MOST = 256, 257, 12
BLOSC_SHUFFLE, BLOSC_STORED, BLOSC_BITS, BLOSC_WHOLE = 0x01, 0x02, 0x04, 0x10
BLOSC_CODES = {0: "blosclz", 1: "lz4", 2: "snappy", 3: "zlib", 4: "zstd"}
#: The reflected polynomial of Castagnoli's checksum.
CRC32C = 0x82F63B78


def lzw(data: bytes) -> bytes:
    """TIFF's variant: codes of 9 to 12 bits, highest bit first, that grow one entry early."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, out, last = list(first), 9, [], b""
    held = bits = 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == LZW_END:
            break
        if code == LZW_CLEAR:
            table, width, last = list(first), 9, b""
            continue
        if not last:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        if len(table) >= (1 << width) - 1 and width < LZW_MOST:
            width += 1
    return b"".join(out)


def packbits(data: bytes) -> bytes:
    """Runs: n < 128 copies the next n + 1 bytes, n > 128 repeats the next one 257 - n times."""
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
        else:
            at += 1
    return b"".join(out)


def _unpacked(data: bytes, size: int, code: str) -> bytes:
    if code == "lz4":
        return pa.Codec("lz4_raw").decompress(data, size).to_pybytes()
    if code == "snappy":
        return pa.Codec("snappy").decompress(data, size).to_pybytes()
    if code == "zlib":
        return zlib.decompress(data)
    if code == "zstd":
        return zstandard.ZstdDecompressor().decompress(data, size)
    raise ValueError(f"Blosc frames of {code} are not supported")


def _unshuffled(data: bytes, size: int, flags: int) -> bytes:
    """A block whose bytes, or bits, lie by their place in the element; what is no whole number of elements stands behind as it was."""
    if flags & BLOSC_SHUFFLE and size > 1:
        n = len(data) // size
        return np.frombuffer(data, np.uint8, n * size).reshape(size, n).T.tobytes() + data[n * size :]
    if flags & BLOSC_BITS:
        n = len(data) // size // 8 * 8
        planes = np.frombuffer(data, np.uint8, n * size).reshape(size * 8, n // 8)
        bits = np.unpackbits(planes, axis=1, bitorder="little").T
        return np.packbits(bits, axis=1, bitorder="little").tobytes() + data[n * size :]
    return data


def blosc(data: bytes) -> bytes:
    """A frame of Blosc's first format: a head of 16 bytes, the places of its blocks, and each block in one or several streams."""
    flags, size, total, block = data[2], data[3], *struct.unpack_from("<II", data, 4)
    if flags & BLOSC_STORED:
        return data[16 : 16 + total]
    code, out = BLOSC_CODES.get(flags >> 5, "an unknown compressor"), []
    for k, start in enumerate(struct.unpack_from(f"<{-(-total // block) if total else 0}I", data, 16)):
        own = min(block, total - k * block)
        streams = 1 if flags & BLOSC_WHOLE or own < block else size
        parts, at = [], start
        for _ in range(streams):
            n = struct.unpack_from("<I", data, at)[0]
            raw = data[at + 4 : at + 4 + n]
            parts.append(raw if n == own // streams else _unpacked(raw, own // streams, code))
            at += 4 + n
        out.append(_unshuffled(b"".join(parts), size, flags))
    return b"".join(out)


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, value >> 1 ^ np.uint32(CRC32C), value >> 1).astype(np.uint32)
    return value


_TABLE = _crc_table()


def _moved(lanes: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by what it makes of each, of many values."""
    out = np.zeros_like(lanes)
    for bit in range(32):
        out ^= np.where(lanes >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0)).astype(np.uint32)
    return out


def crc32c(data: bytes) -> int:
    """Castagnoli's checksum: lanes of the data side by side, then joined in pairs by what the following bytes do to each."""
    lanes = 1 << max(0, (len(data) // 1024).bit_length() - 1) if len(data) >= 2048 else 1
    length = -(-len(data) // lanes)
    # zeros in front change nothing if the first bytes carry the initial ones
    head = np.zeros(lanes * length, np.uint8)
    head[len(head) - len(data) :] = np.frombuffer(data, np.uint8)
    state = np.zeros(lanes, np.uint32)
    first = len(head) - len(data)
    for at, column in enumerate(np.ascontiguousarray(head.reshape(lanes, length).T)):
        if at == first % length:
            state[first // length] = np.uint32(0xFFFFFFFF)
        state = state >> np.uint32(8) ^ _TABLE[(state ^ column) & np.uint32(0xFF)]
    if not data:
        return 0
    shift = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step = shift >> np.uint32(8) ^ _TABLE[shift & np.uint32(0xFF)]  # what one zero byte does
    matrix = shift.copy()
    for bit in bin(length)[2:]:
        matrix = _moved(matrix, matrix)
        if bit == "1":
            matrix = _moved(matrix, step)
    while len(state) > 1:
        state = _moved(state[::2], matrix) ^ state[1::2]
        matrix = _moved(matrix, matrix)
    return int(state[0] ^ np.uint32(0xFFFFFFFF))
