"""Randomness as a pure hash, so that draws repeat on any engine and at any partitioning."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def hex32(*parts: Column) -> Column:
    """The first 32 bits of the MD5 of the parts joined by a bar, as eight hex digits; they sort as hash32 does."""
    return F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8)


def hash32(*parts: Column) -> Column:
    """Unsigned 32 bits of the MD5 of the parts joined by a bar."""
    return F.conv(hex32(*parts), 16, 10).cast("bigint")


def uniform(*parts: Column) -> Column:
    """A double in [0, 1)."""
    return hash32(*parts).cast("double") / F.lit(4294967296.0)


def pick(n: Column, *parts: Column) -> Column:
    """An integer in [0, n)."""
    return F.pmod(hash32(*parts), n)


def drawn_slots(seed: int, draw: int, k: int) -> np.ndarray:
    """The k slots of a draw with replacement, as pick() over hash32(seed, draw, 1 … k) gives them."""
    words = (md5(f"{seed}|{draw}|{i}".encode()).digest()[:4] for i in range(1, k + 1))
    return np.frombuffer(b"".join(words), ">u4").astype(np.int64) % max(k, 1)


def _digests(seed: int, keys: Sequence[str], blocks: int) -> np.ndarray:
    """(keys, 16 * blocks) bytes: the MD5 of seed, block and key for each block."""
    raw = b"".join(md5(f"{seed}|{b}|{k}".encode()).digest() for k in keys for b in range(blocks))
    return np.frombuffer(raw, np.uint8).reshape(len(keys), -1)


def coins(seed: int, keys: Sequence[str], draws: int) -> np.ndarray:
    """(keys, draws) of 0 and 1: a digest has the coins of 128 draws, its first bit that of the first."""
    return np.unpackbits(_digests(seed, keys, -(-draws // 128)), axis=1)[:, :draws]


def numbers(seed: int, keys: Sequence[str], draws: int) -> np.ndarray:
    """(keys, draws) of 32-bit numbers: a digest has those of four draws."""
    return np.ascontiguousarray(_digests(seed, keys, -(-draws // 4))).view(">u4")[:, :draws].astype(np.int64)
