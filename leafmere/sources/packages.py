"""Vault packages: a compressed archive of one document and the blobs it refers to.

Layout (fixed values): the magic KVLT, a version, then entries of path length (2 bytes), path, data length (8 bytes) and
data, big-endian, and an empty path at the end; the whole as Zstandard. Archives without compression are read too.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from leafmere.operators.blobs import SCHEME

MAGIC, VERSION, LONGEST_PATH = b"KVLT", 1, 4095


def write_package(document: dict, blobs: list[tuple[str, bytes]], scheme: str = SCHEME, compress: bool = True) -> bytes:
    """An archive of a document and (name, bytes) blobs; with blobs, the document must refer to one of them or more."""
    import zstandard

    text = json.dumps(document, ensure_ascii=False, indent=2)
    hashes = [hashlib.sha256(b).hexdigest() for _, b in blobs]
    if blobs and not any(scheme + h in text for h in hashes):
        raise ValueError("the document refers to none of the attached blobs")
    entries = [("document.json", text.encode())]
    for i, ((name, data), sha) in enumerate(zip(blobs, hashes)):
        entries.append((f"vault/{i}/manifest.json", json.dumps({"sha256": sha, "size": len(data), "originalName": name}).encode()))
        entries.append((f"vault/{i}/{name or 'blob'}", data))
    out = io.BytesIO()
    out.write(MAGIC + struct.pack(">I", VERSION))
    for path, data in entries:
        raw = path.encode()
        if len(raw) > LONGEST_PATH:
            raise ValueError(f"path of {len(raw)} bytes")
        out.write(struct.pack(">H", len(raw)) + raw + struct.pack(">Q", len(data)) + data)
    out.write(struct.pack(">H", 0))
    return zstandard.ZstdCompressor().compress(out.getvalue()) if compress else out.getvalue()


def read_package(data: bytes) -> tuple[dict, list[tuple[str, bytes]]]:
    """(document, blobs); ValueError for a malformed archive."""
    import zstandard

    if data[:4] != MAGIC:
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if data[:4] != MAGIC or struct.unpack(">I", data[4:8])[0] != VERSION:
        raise ValueError("not a package of a known version")
    at, document, blobs = 8, None, []
    while True:
        (n,) = struct.unpack_from(">H", data, at)
        at += 2
        if not n:
            break
        path = data[at : at + n].decode()
        (size,) = struct.unpack_from(">Q", data, at + n)
        at += n + 8
        if at + size > len(data):
            raise ValueError("a cut off entry")
        content, at = data[at : at + size], at + size
        if path == "document.json":
            document = json.loads(content)
        elif not path.endswith("/manifest.json"):
            blobs.append((path.rpartition("/")[2], content))
    if not isinstance(document, dict):
        raise ValueError("no document")
    return document, blobs


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """(path, document, name, sha256, bytes, error): a row a blob, or one of the document alone, of all packages there."""
    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for where, data in zip(part["path"], part["content"]):
                try:
                    document, blobs = read_package(bytes(data))
                    body = json.dumps(document, ensure_ascii=False)
                    out += [(where, body, name, hashlib.sha256(b).hexdigest(), b, None) for name, b in blobs] or [(where, body, None, None, None, None)]
                except Exception as e:
                    out.append((where, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "document", "name", "sha256", "bytes", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, "path string, document string, name string, sha256 string, bytes binary, error string")
