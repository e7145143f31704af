"""Small metadata documents beside a table, on any file system Spark can reach."""

from __future__ import annotations

import contextlib
import json
import os
import threading
import time
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession

from .files import local_path


class Store:
    """JSON and text documents under ``root``; writes replace a document by one rename."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def uri(self, name: str = "") -> str:
        return self._fs.makeQualified(self._path(name)).toString()

    def read_bytes(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read_text(self, name: str) -> str:
        return self.read_bytes(name).decode()

    def read_json(self, name: str, default: Any = None) -> Any:
        return json.loads(self.read_text(name)) if self.exists(name) else default

    def write_text(self, name: str, text: str) -> None:
        temp = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(temp, True)
        try:
            out.write(bytearray(text.encode()))
            out.hsync()
        finally:
            out.close()
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        flags = self.spark.sparkContext._gateway.new_array(kind, 1)
        flags[0] = kind.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(temp, self._path(name), flags)

    def write_json(self, name: str, value: Any) -> None:
        self.write_text(name, json.dumps(value, ensure_ascii=False, indent=1, default=str))

    def append_line(self, name: str, line: str) -> None:
        """Add a line to the file's end; call it under ``lock``. Earlier lines aren't rewritten where the store can append."""
        raw = (line + "\n").encode()
        path = local_path(self.uri(name))
        if path is not None:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with contextlib.suppress(FileNotFoundError):  # Hadoop's checksum of the file as it was
                os.remove(f"{os.path.dirname(path)}/.{os.path.basename(path)}.crc")
            with open(path, "ab") as f:
                f.write(raw)
                f.flush()
                os.fsync(f.fileno())
            return
        out = None
        if self.exists(name):
            with contextlib.suppress(Exception):  # a store without appends
                out = self._fs.append(self._path(name))
        if out is None:
            self.write_text(name, (self.read_text(name) if self.exists(name) else "") + line + "\n")
            return
        try:
            out.write(bytearray(raw))
            out.hsync()
        finally:
            out.close()

    def last_line(self, name: str, step: int = 1 << 16) -> str | None:
        """The last line that isn't empty, from the file's end; None without one."""
        if not self.exists(name):
            return None
        size, tail = self._fs.getFileStatus(self._path(name)).getLen(), b""
        stream = self._fs.open(self._path(name))
        try:
            at = size
            while at > 0 and tail.rstrip(b"\n").count(b"\n") == 0:
                at = max(0, at - step)
                stream.seek(at)
                n = size - at - len(tail)
                tail = bytes(self._jvm.org.apache.commons.io.IOUtils.readFully(stream, n)) + tail
        finally:
            stream.close()
        lines = [x for x in tail.split(b"\n") if x]
        return lines[-1].decode() if lines else None

    def names(self, folder: str) -> list[str]:
        """Documents of a folder, sorted."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)) if not s.getPath().getName().endswith((".tmp", ".crc")))

    def files(self, folder: str = "") -> list[tuple[str, int]]:
        """(name, bytes) of all files below a folder, relative to the root, sorted."""
        if not self.exists(folder):
            return []
        if (top := local_path(self.uri())) is not None:
            at = f"{top}/{folder}".rstrip("/")
            found = ((f"{d}/{n}", n) for d, _, names in os.walk(at) for n in names if not n.endswith((".tmp", ".crc")))
            return sorted((path.removeprefix(top + "/"), os.path.getsize(path)) for path, _ in found)
        base, out = self.uri() + "/", []
        it = self._fs.listFiles(self._path(folder), True)
        while it.hasNext():
            s = it.next()
            name = s.getPath().toString().removeprefix(base)
            if not name.endswith((".tmp", ".crc")):
                out.append((name, s.getLen()))
        return sorted(out)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    @contextlib.contextmanager
    def lock(self, name: str = "meta/.lock", wait: float = 30.0, lease: float = 600.0) -> Iterator[None]:
        """One writer at a time: an exclusively created file that its holder touches.

        A file that nobody touched for ``lease`` seconds was left by a writer that died, and is taken away.
        """
        path, until = self._path(name), time.time() + wait
        while True:
            try:
                self._fs.create(path, False).close()
                break
            except Exception:
                if not self._fs.exists(path) or self._broken(path, lease) or time.time() < until:
                    time.sleep(0.05)
                    continue
                raise TimeoutError(f"{self.root}: another writer holds {name}") from None
        done = threading.Event()

        def touch() -> None:
            while not done.wait(lease / 5):
                with contextlib.suppress(Exception):
                    self._fs.setTimes(path, int(time.time() * 1000), -1)

        threading.Thread(target=touch, daemon=True).start()
        try:
            yield
        finally:
            done.set()
            self._fs.delete(path, False)

    def _broken(self, path, lease: float) -> bool:
        """Take away a lock that its holder no longer touches. Only one of several waiting writers can move it aside."""
        try:
            if time.time() * 1000 - self._fs.getFileStatus(path).getModificationTime() < lease * 1000:
                return False
            aside = self._path(f"meta/.{uuid.uuid4().hex}.tmp")
            if not self._fs.rename(path, aside):
                return False
            if time.time() * 1000 - self._fs.getFileStatus(aside).getModificationTime() < lease * 1000:
                self._fs.rename(aside, path)  # a fresh one that another writer made in between
                return False
            self._fs.delete(aside, False)
            return True
        except Exception:
            return False
