"""Binary files of a store as DataFrames: write-ahead logs and sorted runs.

A log is read in one task as a whole, as its records can only be found one after the other; many files are read in parallel. Sorted runs are
written in tasks under a catalogue, and read by their footers, indexes and filters, block by block.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.functions.codecs import FOOTER_MAGIC, read_block
from keytide.operators.runs import bloom_sizes
from keytide.operators.sliced import bins_between

#: Fixed values of the formats: greatest length of a log record, size of a footer.
LONGEST_RECORD, FOOTER_SIZE = 64 * 1024 * 1024, 40


def wal_blob(records: list[bytes]) -> bytes:
    """Bytes of a log that holds the records: for each a checksum of length and data, the length, the data."""
    bodies = [struct.pack("<I", len(r)) + r for r in records]
    return b"".join(struct.pack("<I", zlib.crc32(b)) + b for b in bodies)


def wal_records(blob: bytes, strict: bool = False) -> Iterator[bytes]:
    """Records of a log up to the first that is damaged or cut; ``strict`` raises ValueError there.

    Fewer bytes than a header at the end are a clean end either way.
    """
    at = 0
    while at + 8 <= len(blob):
        checksum, size = struct.unpack_from("<II", blob, at)
        body = blob[at + 4 : at + 8 + size]
        if size > LONGEST_RECORD or len(body) < 4 + size or zlib.crc32(body) != checksum:
            if strict:
                raise ValueError(f"the record at byte {at} is damaged")
            return
        yield body[4:]
        at += 8 + size


def read_wal(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(path, seq, data) of all records of the log files under a path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, blob in zip(frame["path"], frame["content"], strict=True):
                records = list(wal_records(bytes(blob), strict))
                yield pd.DataFrame({"path": name, "seq": range(len(records)), "data": records})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, seq long, data binary")


SEGMENTS = "file string, first_seq bigint, last_seq bigint, records bigint, bytes bigint"


def write_wal_files(records: DataFrame, path: str) -> DataFrame:
    """Write records (seq, data) as segments of a log, in tasks, and give their catalogue (as of SEGMENTS), which is written last and once.

    A segment holds a range of seq in order. Names are new in every attempt; segments that the catalogue does not name do not count. Null data is no record.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        name, first, last, count, size = f"{uuid.uuid4().hex}.wal", None, None, 0, 0
        out = None
        for frame in frames:
            if not len(frame):
                continue
            out = out or system.open_output_stream(f"{root}/{name}")
            blob = wal_blob([bytes(d) for d in frame["data"]])
            out.write(blob)
            first, last = int(frame["seq"].iloc[0]) if first is None else first, int(frame["seq"].iloc[-1])
            count, size = count + len(frame), size + len(blob)
        if out:
            out.close()
            yield pd.DataFrame([(f"{path}/{name}", first, last, count, size)], columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    rows = records.where(F.col("data").isNotNull()).select(F.col("seq").cast("long").alias("seq"), "data").repartitionByRange("seq").sortWithinPartitions("seq")
    rows.mapInPandas(write, SEGMENTS).write.parquet(f"{path}/catalogue")
    return records.sparkSession.read.schema(SEGMENTS).parquet(f"{path}/catalogue")


def read_wal_files(catalogue: DataFrame, strict: bool = True) -> DataFrame:
    """(first_seq, at, data) of the records of a catalogue's segments, by their place in the segment; ``strict`` as of wal_records."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            for uri, first in zip(frame["file"], frame["first_seq"], strict=True):
                system, name = fs.FileSystem.from_uri(uri)
                with system.open_input_file(name) as source:
                    records = list(wal_records(source.read(), strict))
                yield pd.DataFrame({"first_seq": first, "at": range(len(records)), "data": records})

    return catalogue.select("file", "first_seq").repartition("file").mapInPandas(run, "first_seq bigint, at bigint, data binary")


def _positions(key: bytes, bits: int, hashes: int) -> list[int]:
    """Bits of a key in a run's filter, from two halves of one hash."""
    digest = hashlib.blake2b(key, digest_size=16).digest()
    first, step = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little") | 1
    return [(first + i * step) % bits for i in range(hashes)]


def bloom_bytes(keys: list[bytes], rate: float = 0.01) -> tuple[bytes, int]:
    """A filter of keys, its number of bits before it, and its number of hashes."""
    bits, hashes = bloom_sizes(len(keys), rate)
    held = bytearray(-(-bits // 8))
    for key in keys:
        for at in _positions(key, bits, hashes):
            held[at >> 3] |= 1 << (at & 7)
    return struct.pack("<Q", bits) + bytes(held), hashes


def bloom_holds(blob: bytes, hashes: int, key: bytes) -> bool:
    """Whether a filter may hold a key; False is sure."""
    (bits,) = struct.unpack_from("<Q", blob)
    return all(blob[8 + (at >> 3)] >> (at & 7) & 1 for at in _positions(key, bits, hashes))


def run_blob(entries: list[tuple[str, str | None]], block_size: int = 4096) -> bytes:
    """Bytes of a sorted run of (key, value or None), in the order of keys: blocks, an index of their first keys,
    a filter of the keys, and a footer."""
    blocks: list[tuple[str, bytes]] = []
    held: list[bytes] = []
    first, size = "", 0

    def close() -> None:
        nonlocal held, size
        if held:
            blocks.append((first, b"".join(held) + struct.pack("<I", len(held))))
        held, size = [], 0

    for key, value in entries:
        k, v = key.encode(), None if value is None else value.encode()
        if not held:
            first = key
        held.append(struct.pack("<II", len(k), 0xFFFFFFFF if v is None else len(v)) + k + (v or b""))
        size += len(held[-1])
        if size >= block_size:
            close()
    close()
    data, index = b"", struct.pack("<I", len(blocks))
    for key, block in blocks:
        k = key.encode()
        index += struct.pack("<I", len(k)) + k + struct.pack("<QQ", len(data), len(block))
        data += block
    bloom, hashes = bloom_bytes([k.encode() for k, _ in entries])
    footer = struct.pack("<QQQQII", len(data), len(index), len(data) + len(index), len(bloom), hashes, FOOTER_MAGIC)
    return data + index + bloom + footer


class RunFile:
    """A sorted run, read where it is needed: footer and index when opened, the filter and blocks when asked for.

    ``read_at``: a function of an offset and a number of bytes. ValueError if the footer, the index or a block is damaged.
    """

    def __init__(self, size: int, read_at: Callable[[int, int], bytes]) -> None:
        if size < FOOTER_SIZE:
            raise ValueError("the run is cut")
        at, n, self._bloom_at, self._bloom_size, self._hashes, magic = struct.unpack("<QQQQII", read_at(size - FOOTER_SIZE, FOOTER_SIZE))
        if magic != FOOTER_MAGIC or max(at + n, self._bloom_at + self._bloom_size) > size:
            raise ValueError("the run's footer is damaged")
        index = read_at(at, n)
        (blocks,), pos = struct.unpack_from("<I", index), 4
        self.firsts: list[bytes] = []
        self._places: list[tuple[int, int]] = []
        for _ in range(blocks):
            (k,) = struct.unpack_from("<I", index, pos)
            self.firsts.append(index[pos + 4 : pos + 4 + k])
            self._places.append(struct.unpack_from("<QQ", index, pos + 4 + k))
            pos += 20 + k
        self._read_at, self._bloom, self.blocks_read = read_at, None, 0

    def block(self, number: int) -> list[tuple[str, str | None]]:
        self.blocks_read += 1
        return read_block(self._read_at(*self._places[number]))

    def get(self, key: str) -> tuple[bool, str | None]:
        """Whether the run has the key, and its value (None: a tombstone). One block is read at most, none if the filter knows better."""
        raw = key.encode()
        if self._bloom is None:
            self._bloom = self._read_at(self._bloom_at, self._bloom_size)
        number = bisect.bisect_right(self.firsts, raw) - 1
        if number < 0 or not bloom_holds(self._bloom, self._hashes, raw):
            return False, None
        for k, v in self.block(number):
            if k == key:
                return True, v
        return False, None

    def scan(self, start: str | None = None, end: str | None = None) -> Iterator[tuple[str, str | None]]:
        """Entries with start <= key < end; only blocks that can hold them are read."""
        low = 0 if start is None else max(0, bisect.bisect_right(self.firsts, start.encode()) - 1)
        high = len(self.firsts) if end is None else bisect.bisect_left(self.firsts, end.encode())
        for number in range(low, high):
            for k, v in self.block(number):
                if (start is None or k.encode() >= start.encode()) and (end is None or k.encode() < end.encode()):
                    yield k, v


def run_entries(blob: bytes) -> Iterator[tuple[str, str | None]]:
    """(key, value) of a run's entries; ValueError if its footer, index or a block is damaged."""
    yield from RunFile(len(blob), lambda at, n: blob[at : at + n]).scan()


@contextmanager
def open_run(uri: str) -> Iterator[RunFile]:
    """A run in any file system that pyarrow knows."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as source:

        def read_at(at: int, n: int) -> bytes:
            source.seek(at)
            return source.read(n)

        yield RunFile(source.size(), read_at)


CATALOGUE = "sst_id bigint, level int, file string, min_key string, max_key string, entries bigint, tombstones bigint, bytes bigint"


def write_run_files(entries: DataFrame, path: str, target_bytes: int = 64 << 20, block_size: int = 4096) -> DataFrame:
    """Write entries (sst_id, level, key, value) as files of sorted runs, in tasks, and give their catalogue.

    A file holds a range of one run's keys, about ``target_bytes`` at most; a task holds one file's entries. Names are new in every attempt, and
    the catalogue, written last and once, names those that count: files of lost attempts are never read. Each (sst_id, key) must come once.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        held: list[tuple[str, str | None]] = []
        of, size = None, 0

        def close() -> pd.DataFrame:
            blob, name = run_blob(held, block_size), f"{uuid.uuid4().hex}.sst"
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(blob)
            return pd.DataFrame([(*of, f"{path}/{name}", held[0][0], held[-1][0], len(held), sum(v is None for _, v in held), len(blob))], columns=[c.split()[0] for c in CATALOGUE.split(", ")])

        for frame in frames:
            for sst_id, level, key, value in zip(*(frame[c] for c in ("sst_id", "level", "key", "value")), strict=True):
                if held and ((sst_id, level) != of or size >= target_bytes):
                    yield close()
                    held, size = [], 0
                of = (sst_id, level)
                held.append((key, value if isinstance(value, str) else None))
                size += len(key) + len(held[-1][1] or "") + 8
        if held:
            yield close()

    rows = entries.where(F.col("key").isNotNull()).select("sst_id", "level", "key", "value").repartitionByRange("sst_id", "key").sortWithinPartitions("sst_id", "level", "key")
    rows.mapInPandas(write, CATALOGUE).write.parquet(f"{path}/catalogue")
    return entries.sparkSession.read.schema(CATALOGUE).parquet(f"{path}/catalogue")


def scan_run_files(catalogue: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """(sst_id, level, key, value) of the runs with start <= key < end: files outside are not opened, and of the others only the blocks that can
    hold such keys are read. A null value is a tombstone."""
    files = catalogue
    if start is not None:
        files = files.where(F.col("max_key") >= start)
    if end is not None:
        files = files.where(F.col("min_key") < end)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for sst_id, level, uri in zip(frame["sst_id"], frame["level"], frame["file"], strict=True):
                with open_run(uri) as source:
                    entries = source.scan(start, end)
                    while part := list(itertools.islice(entries, 20_000)):
                        yield pd.DataFrame({"sst_id": sst_id, "level": level, "key": [k for k, _ in part], "value": pd.array([v for _, v in part], dtype=object)})

    return files.select("sst_id", "level", "file").repartition("file").mapInPandas(run, "sst_id bigint, level int, key string, value string")


def get_from_run_files(catalogue: DataFrame, keys: DataFrame, bins: int = 512) -> DataFrame:
    """For each of ``keys`` (key) what the newest run that has it holds: key, state (value, tombstone, missing), value.

    Keys meet the files whose range holds them through bins of keys, each file is opened once in a task with all its keys in order, and a key
    costs a look at the filter and a block at most. Repeated keys are answered once; a null key is missing.
    """
    cuts = sorted(r.min_key for r in catalogue.select("min_key").distinct().orderBy(F.xxhash64("min_key"), "min_key").limit(bins - 1).collect())
    bin_of = bins_between(cuts)
    asked = keys.select("key").distinct()
    placed = asked.withColumn("bin", bin_of(F.col("key")))
    spans = catalogue.select("sst_id", "level", "file", "min_key", "max_key", F.explode(F.sequence(bin_of(F.col("min_key")), bin_of(F.col("max_key")))).alias("bin"))
    wanted = placed.join(spans, "bin").where((F.col("key") >= F.col("min_key")) & (F.col("key") <= F.col("max_key"))).select("sst_id", "level", "file", "key")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ExitStack() as stack:
            at, source = None, None
            for frame in frames:
                found = []
                for sst_id, level, uri, key in zip(*(frame[c] for c in ("sst_id", "level", "file", "key")), strict=True):
                    if uri != at:
                        stack.close()
                        at, source = uri, stack.enter_context(open_run(uri))
                    has, value = source.get(key)
                    if has:
                        found.append((sst_id, level, key, value))
                yield pd.DataFrame(found, columns=["sst_id", "level", "key", "value"]).astype({"key": object, "value": object})

    hits = wanted.repartition("file").sortWithinPartitions("file", "key").mapInPandas(run, "sst_id bigint, level int, key string, value string")
    newest = hits.groupBy("key").agg(F.max(F.struct((-F.col("level")).alias("rank"), "sst_id", "value")).alias("v"))
    state = F.when(F.col("v").isNull(), "missing").when(F.col("v.value").isNull(), "tombstone").otherwise("value")
    return asked.join(newest, "key", "left").select("key", state.alias("state"), F.col("v.value").alias("value"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value) of all entries of the run files under a path; a null value is a tombstone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, blob in zip(frame["path"], frame["content"], strict=True):
                entries = list(run_entries(bytes(blob)))
                yield pd.DataFrame({"path": name, "key": [k for k, _ in entries], "value": pd.array([v for _, v in entries], dtype=object)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, key string, value string")
