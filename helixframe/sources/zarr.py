"""Chunks of Zarr arrays (formats 2 and 3) as numpy arrays, and back.

Only what stores of variants use: C order, one chunk per file, compressors zlib, gzip, bz2, lzma, zstd
and Blosc, fixed-width types and strings of any length.
"""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Fixed values of the Blosc format: its flags, and its compressors by number.
BLOSC_SHUFFLE, BLOSC_STORED, BLOSC_BITS, BLOSC_WHOLE = 1, 2, 4, 16
BLOSC_CODECS = {1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}
V3_TYPES = {"bool": "|b1", "int8": "|i1", "uint8": "|u1", "string": "|O", "variable_length_utf8": "|O"}


def _inflate(raw: bytes, codec: str, size: int) -> bytes:
    return zlib.decompress(raw) if codec == "zlib" else pa.decompress(raw, decompressed_size=size, codec=codec, asbytes=True)


def _unshuffle(block: bytes, width: int, bits: bool) -> bytes:
    n = len(block) // width
    if bits:
        n -= n % 8
        planes = np.unpackbits(np.frombuffer(block[: n * width], np.uint8).reshape(width, 8, n // 8), axis=2, bitorder="little")
        whole = np.packbits(planes.transpose(2, 0, 1), axis=2, bitorder="little").tobytes()
    else:
        whole = np.frombuffer(block[: n * width], np.uint8).reshape(width, n).T.tobytes()
    return whole + block[n * width :]


def blosc(raw: bytes) -> bytes:
    """The content of a Blosc (version 1) buffer."""
    _, _, flags, width, size, block_size, _ = struct.unpack_from("<BBBBIII", raw)
    if flags & BLOSC_STORED:
        return raw[16 : 16 + size]
    if flags >> 5 not in BLOSC_CODECS:
        raise NotImplementedError("chunks compressed by BloscLZ")
    codec, out = BLOSC_CODECS[flags >> 5], []
    for k in range(-(-size // block_size)):
        n = min(block_size, size - k * block_size)
        parts = width if not flags & BLOSC_WHOLE and n == block_size and n % width == 0 else 1
        (at,) = struct.unpack_from("<I", raw, 16 + 4 * k)
        pieces = []
        for _ in range(parts):
            (held,) = struct.unpack_from("<I", raw, at)
            piece = raw[at + 4 : at + 4 + held]
            pieces.append(piece if held == n // parts else _inflate(piece, codec, n // parts))
            at += 4 + held
        block = b"".join(pieces)
        out.append(_unshuffle(block, width, bool(flags & BLOSC_BITS)) if width > 1 and flags & BLOSC_SHUFFLE or flags & BLOSC_BITS else block)
    return b"".join(out)


def decompress(raw: bytes, codec: str) -> bytes:
    if codec == "zstd":
        return pa.CompressedInputStream(pa.BufferReader(raw), "zstd").read()
    plain = {"zlib": zlib.decompress, "gzip": gzip.decompress, "bz2": bz2.decompress, "lzma": lzma.decompress, "blosc": blosc}
    if codec not in plain:
        raise NotImplementedError(f"chunks coded by {codec}")
    return plain[codec](raw)


def strings(raw: bytes) -> list[bytes]:
    """Items of the variable-length coding: their number, then each one's length and bytes."""
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        (size,) = struct.unpack_from("<I", raw, at)
        out.append(raw[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def packed_strings(values: list[bytes]) -> bytes:
    return struct.pack("<I", len(values)) + b"".join(struct.pack("<I", len(v)) + v for v in values)


@dataclass
class ArrayMeta:
    """What an array's metadata says of its chunks."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    codecs: tuple[str, ...]  # in the order in which they are undone
    fill: object

    @classmethod
    def parse(cls, text: str | bytes) -> ArrayMeta:
        meta = json.loads(text)
        if meta["zarr_format"] == 2:
            if meta["order"] != "C" and len(meta["shape"]) > 1:
                raise NotImplementedError("arrays in F order")
            codecs = [c["id"] for c in [meta["compressor"], *reversed(meta.get("filters") or [])] if c]
            return cls(tuple(meta["shape"]), tuple(meta["chunks"]), meta["dtype"], tuple(codecs), meta["fill_value"])
        kind, codecs, order = meta["data_type"], [c["name"] for c in reversed(meta["codecs"])], "<"
        if isinstance(kind, dict):
            if kind["name"] != "fixed_length_utf32":
                raise NotImplementedError(f"arrays of {kind['name']}")
            kind = f"<U{kind['configuration']['length_bytes'] // 4}"
        else:
            order = next((">" for c in meta["codecs"] if c["name"] == "bytes" and (c.get("configuration") or {}).get("endian") == "big"), "<")
            kind = V3_TYPES.get(kind) or np.dtype(kind).newbyteorder(order).str
        return cls(tuple(meta["shape"]), tuple(meta["chunk_grid"]["configuration"]["chunk_shape"]), kind, tuple(c for c in codecs if c != "bytes"), meta["fill_value"])

    def decode(self, raw: bytes | None) -> np.ndarray:
        """One chunk, at its full size; an absent one holds the fill value."""
        if raw is None:
            if self.dtype.endswith("O"):
                return np.full(self.chunks, self.fill or "", object)
            fill = {"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf, None: 0}.get(self.fill, self.fill) if not isinstance(self.fill, list) else 0
            return np.full(self.chunks, fill, self.dtype)
        for codec in self.codecs:
            if codec in ("vlen-utf8", "vlen-bytes"):
                return np.array([s.decode() for s in strings(raw)], object).reshape(self.chunks)
            raw = raw[:-4] if codec == "crc32c" else decompress(raw, codec)
        found = np.frombuffer(raw, self.dtype).reshape(self.chunks)
        return np.char.decode(found, "utf-8") if found.dtype.kind == "S" else found


def encode(values: np.ndarray, chunks: tuple[int, ...], fill) -> bytes:
    """One chunk as format 2 stores it, padded to its full size and compressed by zstd."""
    full = np.full(chunks, fill, values.dtype)
    full[tuple(slice(0, n) for n in values.shape)] = values
    raw = packed_strings([str(v).encode() for v in full.ravel()]) if values.dtype == object else full.tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True)


def metadata(shape: tuple[int, ...], chunks: tuple[int, ...], dtype: np.dtype, fill, dims: list[str]) -> tuple[str, str]:
    """The metadata and attributes of an array in format 2."""
    text = dtype == object
    fill = fill if text or isinstance(fill, bool) else "NaN" if dtype.kind == "f" else int(fill)
    meta = {"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": "|O" if text else dtype.str, "compressor": {"id": "zstd", "level": 1}, "fill_value": fill, "order": "C", "filters": [{"id": "vlen-utf8"}] if text else None}
    return json.dumps(meta), json.dumps({"_ARRAY_DIMENSIONS": dims})
