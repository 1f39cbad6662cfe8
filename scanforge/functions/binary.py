"""Decoding of the binary arrays of a spectrum: raw, zlib, and the published numeric compressions of mzML."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Names of the number formats and compressions of binary arrays.
NUMBERS = {"32-bit float": "<f4", "64-bit float": "<f8", "32-bit integer": "<i4", "64-bit integer": "<i8"}
RAW, ZLIB = "no compression", "zlib compression"
LINEAR, INTEGER, LOGGED = "MS-Numpress linear prediction compression", "MS-Numpress positive integer compression", "MS-Numpress short logged float compression"
PACKED_TOO = " followed by zlib compression"


def nibble_integers(data: bytes) -> np.ndarray:
    """Signed 32-bit integers of a stream of half bytes, high half first.

    A head of 0 to 8 counts leading zero halves, of 9 to 15 leading halves of ones less 8; the other halves follow, lowest first.
    """
    halves = np.empty(2 * len(data), np.int64)
    raw = np.frombuffer(data, np.uint8)
    halves[0::2], halves[1::2] = raw >> 4, raw & 15
    stream, at, out = halves.tolist(), 0, []
    end = len(stream)
    while at < end:
        if at == end - 1 and stream[at] == 0:
            break  # the filling of the last byte
        head = stream[at]
        gone = head if head <= 8 else head - 8
        value = 0
        for k in range(8 - gone):
            value |= stream[at + 1 + k] << (4 * k)
        if head > 8:
            value |= (0xFFFFFFFF << (4 * (8 - gone))) & 0xFFFFFFFF
        out.append(value - (1 << 32) if value >= 1 << 31 else value)
        at += 1 + 8 - gone
    return np.array(out, np.int64)


def linear_prediction(data: bytes) -> np.ndarray:
    """Numbers held as differences from the line through the two before, over a fixed point."""
    if len(data) < 8:
        return np.zeros(0)
    (point,) = struct.unpack(">d", data[:8])
    first = np.frombuffer(data[8:16][: (len(data) - 8) // 4 * 4], "<i4").astype(np.int64)
    if len(first) < 2:
        return first / point
    steps = np.concatenate([[first[1] - first[0]], nibble_integers(data[16:])])
    return (first[0] + np.concatenate([[0], np.cumsum(np.cumsum(steps))])) / point


def positive_integers(data: bytes) -> np.ndarray:
    return nibble_integers(data).astype(float)


def short_logged(data: bytes) -> np.ndarray:
    """Numbers held as 16-bit logarithms of themselves plus 1, over a fixed point."""
    if len(data) < 8:
        return np.zeros(0)
    (point,) = struct.unpack(">d", data[:8])
    return np.expm1(np.frombuffer(data[8:], "<u2") / point)


NUMERIC = {LINEAR: linear_prediction, INTEGER: positive_integers, LOGGED: short_logged}


def decode_array(data: bytes, names: list[str]) -> np.ndarray:
    """The numbers of an array whose parameters are called ``names``; an unknown compression or number format is an error."""
    kinds = [n for n in names if n and "compression" in n.lower()]
    if len(kinds) > 1:
        raise ValueError(f"several compressions: {', '.join(kinds)}")
    kind = kinds[0] if kinds else RAW
    numeric = kind.removesuffix(PACKED_TOO)
    if kind == ZLIB or numeric != kind:
        data = zlib.decompress(data) if data else data
    if numeric in NUMERIC:
        return NUMERIC[numeric](data)
    if kind not in (RAW, ZLIB):
        raise ValueError(f"unknown compression: {kind}")
    formats = [NUMBERS[n] for n in names if n in NUMBERS]
    if len(formats) != 1:
        raise ValueError("an array without a known number format")
    return np.frombuffer(data, formats[0]).astype(float)
