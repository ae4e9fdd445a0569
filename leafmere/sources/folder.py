"""A shared folder as a sync target: list, read, write, delete, compare-and-swap and leases of small files on any Hadoop file
system.

A file is kept as numbered versions, each created once and never overwritten, with a checksum at its end. The newest whole
version is the file; of two writers that saw the same version only one can create the next, so a swap is lost by nobody
unseen. A reader never meets a moment without a file, nor half of one.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time

from pyspark.sql import SparkSession

VERSION = re.compile(r"(.+)~(\d{8})")
#: Seconds after which a version that was begun and not ended counts as given up.
GIVEN_UP = 60.0


class Folder:
    """Files of one folder, read and written whole; meant for states, manifests and marks, not for tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(""))
        self.local = re.sub("^file:(//)?(?=/)", "", self.path) if self.fs.getUri().getScheme() == "file" else None

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _versions(self, name: str | None = None) -> dict[str, dict[int, float]]:
        """Versions by file name, each with the time it was changed last."""
        out: dict[str, dict[int, float]] = {}
        for f in self.fs.listStatus(self._path("")):
            if f.isFile() and (m := VERSION.fullmatch(f.getPath().getName())) and name in (None, m[1]):
                out.setdefault(m[1], {})[int(m[2])] = f.getModificationTime() / 1000
        return out

    def list(self, prefix: str = "") -> list[str]:
        return sorted(n for n in self._versions() if n.startswith(prefix))

    def _whole(self, name: str, version: int) -> bytes | None:
        """What a version holds; None if it was not ended or is gone meanwhile."""
        try:
            stream = self.fs.open(self._path(f"{name}~{version:08d}"))
        except Exception:
            return None
        try:
            data = bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        return data[:-32] if len(data) >= 32 and hashlib.sha256(data[:-32]).digest() == data[-32:] else None

    def _current(self, name: str) -> tuple[bytes | None, int, float]:
        """(content, the last version's number, seconds since an unended version was begun, else infinity)."""
        versions = self._versions(name).get(name, {})
        waiting = float("inf")
        for v in sorted(versions, reverse=True):
            data = self._whole(name, v)
            if data is not None:
                return data, max(versions), waiting
            waiting = min(waiting, time.time() - versions[v])
        return None, max(versions, default=0), waiting

    def read(self, name: str) -> bytes | None:
        return self._current(name)[0]

    def write(self, name: str, data: bytes) -> str:
        """Put a file in place, whatever it was before; its etag is returned."""
        for _ in range(1000):
            if self.swap(name, data, self.etag(name)):
                return hashlib.sha256(data).hexdigest()
            time.sleep(0.01)
        raise OSError(f"{name} could not be put in place")

    def delete(self, name: str) -> bool:
        versions = self._versions(name).get(name, {})
        for v in versions:
            self.fs.delete(self._path(f"{name}~{v:08d}"), False)
        return bool(versions)

    def etag(self, name: str) -> str | None:
        data = self.read(name)
        return None if data is None else hashlib.sha256(data).hexdigest()

    def swap(self, name: str, data: bytes, expected: str | None) -> bool:
        """Write only if the file's etag is still ``expected`` (None: only if there is none); of several writers one wins."""
        held, last, waiting = self._current(name)
        if (None if held is None else hashlib.sha256(held).hexdigest()) != expected or waiting < GIVEN_UP:
            return False
        if not self._create(f"{name}~{last + 1:08d}", data + hashlib.sha256(data).digest()):
            return False
        for v in self._versions(name).get(name, {}):
            if v < last:
                self.fs.delete(self._path(f"{name}~{v:08d}"), False)
        return True

    def _create(self, name: str, data: bytes) -> bool:
        """Create a file that must not exist yet."""
        if self.local is not None:
            # Hadoop's local file system looks first and creates then; the operating system does both at once.
            try:
                with open(os.open(f"{self.local}/{name}", os.O_CREAT | os.O_EXCL | os.O_WRONLY), "wb") as f:
                    f.write(data)
            except FileExistsError:
                return False
            return True
        try:
            out = self.fs.create(self._path(name), False)
        except Exception:
            return False
        out.write(bytearray(data))
        out.close()
        return True

    def lease(self, name: str, owner: str, seconds: float, now: float | None = None) -> bool:
        """Take or renew a lease: True for ``owner`` until the seconds are over, unless another holds it."""
        now = time.time() if now is None else now
        held = self.read(name)
        if held is not None:
            other = json.loads(held)
            if other["owner"] != owner and other["until"] > now:
                return False
        return self.swap(name, json.dumps({"owner": owner, "until": now + seconds}).encode(), None if held is None else hashlib.sha256(held).hexdigest())

    def release(self, name: str, owner: str) -> bool:
        """Give a lease back, if ``owner`` holds it."""
        held = self.read(name)
        if held is None or json.loads(held)["owner"] != owner:
            return False
        return self.swap(name, json.dumps({"owner": owner, "until": 0}).encode(), hashlib.sha256(held).hexdigest())
