"""Checksums and tokens that Spark has no function for, as Arrow functions: CRC-32C, XXH64 with seed 0, HMAC-SHA256."""

from __future__ import annotations

import hashlib
import hmac
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


POLYNOMIAL = 0x82F63B78
#: Bytes of a run whose remainders are taken side by side.
RUN = 4096


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(POLYNOMIAL), table >> 1)
    return table.astype(np.uint32)


@lru_cache(maxsize=16)
def _shift_tables(run: int) -> np.ndarray:
    """(4, 256) remainders of every value of each byte of a remainder after ``run`` more zero bytes."""
    table, reg = _crc_table(), (np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    for _ in range(run):
        reg = table[reg & 255] ^ reg >> 8
    return reg.reshape(4, 256)


def crc32c_all(blobs: list[bytes]) -> np.ndarray:
    """CRC-32C of each blob. All are cut into runs whose remainders are computed side by side, a byte of all runs at a time; the
    remainders of a blob's runs are then joined, which is linear."""
    table, n = _crc_table(), len(blobs)
    sizes = np.array([max(len(b), 4) for b in blobs], np.int64)
    run = RUN if n and sizes.max() > RUN else 1 << int(max(sizes.max() if n else 4, 4) - 1).bit_length()
    runs = -(-sizes // run)
    starts = np.cumsum(runs) - runs
    data = np.zeros(int(runs.sum()) * run, np.uint8)
    for i, blob in enumerate(blobs):
        if len(blob) >= 4:
            # Zeros ahead change nothing while the register starts at 0; inverting four bytes stands for a start of ones.
            at = int(starts[i] + runs[i]) * run - len(blob)
            data[at : at + len(blob)] = np.frombuffer(blob, np.uint8)
            data[at : at + 4] ^= 255
    columns = np.ascontiguousarray(data.reshape(-1, run).T)
    reg = np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        reg = table[(reg ^ column) & 255] ^ reg >> 8
    out, shift = np.zeros(n, np.uint32), _shift_tables(run)
    for k in range(int(runs.max()) if n else 0):
        some = np.flatnonzero(runs > k)
        held = out[some]
        out[some] = shift[0][held & 255] ^ shift[1][held >> 8 & 255] ^ shift[2][held >> 16 & 255] ^ shift[3][held >> 24] ^ reg[starts[some] + k]
    out ^= np.uint32(0xFFFFFFFF)
    for i, blob in enumerate(blobs):
        if len(blob) < 4:
            crc = 0xFFFFFFFF
            for b in blob:
                crc = int(table[(crc ^ b) & 255]) ^ crc >> 8
            out[i] = crc ^ 0xFFFFFFFF
    return out


def crc32c_of(data: bytes) -> int:
    return int(crc32c_all([data])[0])


def crc32c(data: Column) -> Column:
    @F.pandas_udf(T.LongType())
    def run(s: pd.Series) -> pd.Series:
        out = pd.Series(pd.NA, index=s.index, dtype="Int64")
        held, size = [], 0
        for i, b in s.dropna().items():
            held.append((i, bytes(b)))
            size += len(b)
            if size > 64 << 20:
                out.loc[[i for i, _ in held]] = crc32c_all([b for _, b in held]).astype(np.int64)
                held, size = [], 0
        if held:
            out.loc[[i for i, _ in held]] = crc32c_all([b for _, b in held]).astype(np.int64)
        return out

    return run(data)


def xxh64(data: Column) -> Column:
    """XXH64 with seed 0 as 16 hexadecimal signs."""
    import xxhash

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else xxhash.xxh64_hexdigest(bytes(b)))

    return run(data)


def index_token(value: Column, secret: bytes) -> Column:
    """HMAC-SHA256 of a text as hexadecimal signs, for equality over encrypted fields."""
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else hmac.new(secret, v.encode(), hashlib.sha256).hexdigest())

    return run(value)


def sortable_hex(value) -> str:
    """Hexadecimal signs of a bool, int, float or string that sort as the values of one kind do."""
    if isinstance(value, bool):
        return "01" if value else "00"
    if isinstance(value, int):
        return f"{value + (1 << 63):016x}"
    if isinstance(value, float):
        bits = struct.unpack(">Q", struct.pack(">d", value))[0]
        return f"{bits ^ 0xFFFFFFFFFFFFFFFF if bits >> 63 else bits | 1 << 63:016x}"
    return value.encode().hex()


def encrypted(value: Column, key: Column) -> Column:
    return F.aes_encrypt(value, key, F.lit("GCM"))


def decrypted(value: Column, key: Column) -> Column:
    return F.try_aes_decrypt(value, key, F.lit("GCM"))


def hkdf(secret: bytes, length: int = 32, salt: bytes = b"", info: bytes = b"") -> bytes:
    """A key of ``length`` bytes from a secret: HKDF with SHA-256, as in RFC 5869."""
    if not 0 <= length <= 255 * 32:
        raise ValueError("HKDF gives at most 8,160 bytes")
    inner = hmac.new(salt or bytes(32), secret, hashlib.sha256).digest()
    out, block = b"", b""
    for i in range(1, -(-length // 32) + 1):
        block = hmac.new(inner, block + info + bytes([i]), hashlib.sha256).digest()
        out += block
    return out[:length]
