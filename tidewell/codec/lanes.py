"""Byte rearrangements: element lanes, records, byte differences."""

from __future__ import annotations

import numpy as np

from tidewell.codec.errors import StrideMismatch, TypeMismatch


def split_lanes(data: bytes, width: int) -> bytes:
    """Byte 0 of every element, then byte 1 of every element, and so on."""
    if width < 1 or len(data) % width:
        raise TypeMismatch(f"{len(data)} bytes, elements of {width}")
    return np.frombuffer(data, np.uint8).reshape(-1, width).T.tobytes()


def join_lanes(data: bytes, width: int) -> bytes:
    """Inverse of split_lanes."""
    if width < 1 or len(data) % width:
        raise TypeMismatch(f"{len(data)} bytes, elements of {width}")
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.tobytes()


def records_to_columns(data: bytes, stride: int) -> bytes:
    """Packed records to byte columns."""
    if stride < 1 or len(data) % stride:
        raise StrideMismatch(f"{len(data)} bytes, records of {stride}")
    return split_lanes(data, stride)


def columns_to_records(data: bytes, stride: int) -> bytes:
    if stride < 1 or len(data) % stride:
        raise StrideMismatch(f"{len(data)} bytes, records of {stride}")
    return join_lanes(data, stride)


def byte_delta(data: bytes) -> bytes:
    """Each byte less its predecessor, modulo 256; the first stays."""
    return np.diff(np.frombuffer(data, np.uint8), prepend=np.uint8(0)).astype(np.uint8).tobytes()


def byte_sum(data: bytes) -> bytes:
    """Inverse of byte_delta."""
    return np.cumsum(np.frombuffer(data, np.uint8), dtype=np.uint8).tobytes()


def bits_per_byte(data: bytes, sample: int = 0) -> float:
    """Order-0 entropy of the bytes, of the first sample ones if that is given."""
    part = np.frombuffer(data[:sample] if sample else data, np.uint8)
    if not len(part):
        return 0.0
    n = np.bincount(part)
    p = n[n > 0] / len(part)
    return float(-(p * np.log2(p)).sum()) + 0.0


def ratio_estimate(data: bytes) -> float:
    """Size over order-0 size: 1 for nothing, the length for constant bytes."""
    if not data:
        return 1.0
    bits = bits_per_byte(data)
    return float(len(data)) if bits < 0.001 else 8.0 / bits
