"""File, environment and interface inventories for audits: small, bounded, made on the driver; a binary-file source for lakes."""

from __future__ import annotations

import os
import socket
import stat
import struct
import tempfile
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bounds of a walk, what it skips, and how much of a file is read.
MAX_FILES, MAX_DEPTH, MAX_BYTES = 200, 4, 2 * 1024 * 1024
SKIPPED = frozenset(("node_modules", ".git", "dist", "build", ".venv", "venv"))
CONFIG_EXTENSIONS = (".yml", ".yaml", ".json", ".toml", ".env", ".ini", ".conf")

FILES = "path string, rel string, name string, ext string, depth int, mode int, size long, content string"
ENTRIES = "area string, dir string, name string, ord int, size long, content string"


def read_text(path: str, most: int = MAX_BYTES) -> str | None:
    """A file's text; None if it isn't a file, is too large or can't be read."""
    try:
        found = os.stat(path)
        if not stat.S_ISREG(found.st_mode) or found.st_size > most:
            return None
        with open(path, encoding="utf-8", errors="replace", newline="") as f:
            return f.read()
    except OSError:
        return None


def walk(root: str, max_files: int = MAX_FILES, max_depth: int = MAX_DEPTH) -> list[tuple[str, int]]:
    """(path, depth) of at most ``max_files`` files, by path. A directory's files come before its directories,
    which are entered last name first, so the cut is the same each time; links are left out."""
    found: list[tuple[str, int]] = []
    pending = [(root, 0)]
    while pending and len(found) < max_files:
        at, depth = pending.pop()
        if depth > max_depth:
            continue
        try:
            with os.scandir(at) as it:
                entries = sorted(it, key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            if len(found) >= max_files:
                break
            if e.is_dir(follow_symlinks=False):
                if e.name not in SKIPPED:
                    pending.append((os.path.join(at, e.name), depth + 1))
            elif e.is_file(follow_symlinks=False):
                found.append((os.path.join(at, e.name), depth))
    return sorted(found)


def _mode(path: str) -> int | None:
    try:
        return os.stat(path).st_mode
    except OSError:
        return None


def files(spark: SparkSession, root: str, max_files: int = MAX_FILES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The inventory of a tree, with permission bits and contents."""
    rows = []
    for path, depth in walk(root, max_files, max_depth):
        name = os.path.basename(path)
        mode = _mode(path)
        size = os.path.getsize(path) if mode is not None else None
        rows.append((path, os.path.relpath(path, root), name, path[path.rfind(".") :] if "." in path else path[-1:], depth, mode, size, read_text(path)))
    return spark.createDataFrame(rows, FILES)


def lake_files(spark: SparkSession, path: str, most: int = MAX_BYTES) -> DataFrame:
    """The same columns from any store that Spark reads (no permission bits there): the size bound is pushed to the listing."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= most)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select("path", F.col("path").alias("rel"), name.alias("name"), F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1)).alias("ext"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("int").alias("mode"), F.col("length").alias("size"), F.decode("content", "utf-8").alias("content"))


def targets(spark: SparkSession, *paths: str | None) -> DataFrame:
    """ord, path, mode of paths that exist."""
    return spark.createDataFrame([(i, p, m) for i, p in enumerate(paths) if p and (m := _mode(p)) is not None], "ord int, path string, mode int")


def sessions(spark: SparkSession, root: str) -> tuple[DataFrame, bool]:
    """The entries of ``root``/sessions in name order, with their text; and whether the directory is there."""
    at = os.path.join(root, "sessions")
    try:
        names = sorted(os.listdir(at))
    except OSError:
        return spark.createDataFrame([], ENTRIES), False
    return spark.createDataFrame([("sessions", at, n, i, None, read_text(os.path.join(at, n)) if i < 500 else None) for i, n in enumerate(names)], ENTRIES), True


def _dirs(at: str, hidden: bool = True) -> list[str]:
    try:
        with os.scandir(at) as it:
            return sorted(e.name for e in it if e.is_dir(follow_symlinks=False) and (hidden or not e.name.startswith(".")))
    except OSError:
        return []


def manifests(spark: SparkSession, root: str, vendor: str) -> DataFrame:
    """The package manifests under the plugin roots: area (root), name (scoped names in two parts), ord, content."""
    roots = [os.path.join(root, "plugins"), os.path.join(root, "node_modules", vendor)]
    try:
        with os.scandir(os.path.join(root, "profiles")) as it:
            profiles = [e.name for e in it if e.is_dir(follow_symlinks=False) and not e.name.startswith(".")]
    except OSError:
        profiles = []
    roots += [os.path.join(root, "profiles", p, "node_modules") for p in profiles]
    rows: list[tuple] = []
    for r in roots:
        for d in _dirs(r, hidden=False):
            own = os.path.join(r, d)
            for at in [own] if read_text(os.path.join(own, "package.json"), 128 * 1024) is not None else [os.path.join(own, s) for s in _dirs(own, hidden=False)]:
                text = read_text(os.path.join(at, "package.json"), 128 * 1024)
                if text is not None:
                    parts = at.split(os.sep)
                    rows.append((r, at, "/".join(parts[-2:]) if parts[-2].startswith("@") else parts[-1], len(rows), len(text), text))
    return spark.createDataFrame(rows, ENTRIES)


def environment(spark: SparkSession, env: Mapping[str, str]) -> DataFrame:
    """ord, key, value."""
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(env.items())], "ord int, key string, value string")


def active_interfaces() -> int:
    """IPv4 addresses of this host's interfaces that aren't loopback: by the kernel's list of interfaces where it has one, else by the host's name."""
    found = set()
    try:
        import fcntl

        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for _, name in socket.if_nameindex():
                try:  # SIOCGIFADDR
                    found.add(socket.inet_ntoa(fcntl.ioctl(s.fileno(), 0x8915, struct.pack("256s", name.encode()[:15]))[20:24]))
                except OSError:  # an interface without an address
                    continue
    except (ImportError, OSError):
        try:
            found = {a[4][0] for a in socket.getaddrinfo(socket.gethostname(), None, socket.AF_INET)}
        except OSError:
            return 0
    return sum(not a.startswith("127.") for a in found)


def in_temp(path: str) -> bool:
    return path.startswith(tempfile.gettempdir())
