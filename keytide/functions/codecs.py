"""Binary, JSON and text formats of the store as column expressions.

Integers are little-endian unless said otherwise; lengths take 4 bytes. A null part makes the whole null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the formats.
TAG_PUT, TAG_DELETE = "01", "02"
ENTRY_TYPES = {"Normal": 0, "ConfigChange": 1, "Noop": 2}
FOOTER_MAGIC, TOMBSTONE_LENGTH = 0x5354424C, 0xFFFFFFFF


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def big_endian(n: Column, size: int = 8) -> Column:
    """The last ``size`` bytes of an integer, highest first."""
    return F.unhex(F.right(F.lpad(F.hex(n.cast("long")), 16, "0"), F.lit(2 * size)))


def little_endian(n: Column, size: int = 8) -> Column:
    """The last ``size`` bytes of an integer, lowest first."""
    digits = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(size))))


def read_little_endian(data: Column, start: int | Column, size: int = 8, signed: bool = True) -> Column:
    """The integer in ``size`` bytes from ``start`` (1: the first byte); null if they are not all there."""
    start = F.lit(start) if isinstance(start, int) else start

    def of(digits: Column) -> Column:
        turned = F.concat(*(F.substring(digits, 2 * size - 1 - 2 * i, 2) for i in range(size)))
        return F.when(F.length(digits) == 2 * size, F.conv(turned, 16, -10 if signed and size == 8 else 10).cast("long"))

    return let(F.hex(F.substring(data, start, F.lit(size))), of)


def encode_key(key: Column, revision: Column) -> Column:
    """Key bytes, then the revision with all bits turned, highest byte first: newer versions sort first."""
    return F.concat(F.encode(key, "utf-8"), big_endian(F.bitwise_not(revision.cast("long"))))


def decode_key(data: Column) -> Column:
    """struct(key, revision) of an encoded key; null if it is shorter than a revision."""
    n = F.octet_length(data)
    revision = F.bitwise_not(F.conv(F.hex(F.substring(data, n - 7, F.lit(8))), 16, -10).cast("long"))
    return F.when(n >= 8, F.struct(F.decode(F.substring(data, F.lit(1), n - 8), "utf-8").alias("key"), revision.alias("revision")))


def sized(data: Column) -> Column:
    """A string's bytes after their length."""
    raw = F.encode(data, "utf-8")
    return F.concat(little_endian(F.octet_length(raw), 4), raw)


def encode_value(value: Column, create_revision: Column, mod_revision: Column, lease_id: Column, ttl: Column) -> Column:
    """A versioned value: a tag, the sized value unless it is null (a delete marker), then four integers."""
    head = F.when(value.isNull(), F.unhex(F.lit(TAG_DELETE))).otherwise(F.concat(F.unhex(F.lit(TAG_PUT)), sized(value)))
    return F.concat(head, *(little_endian(c) for c in (create_revision, mod_revision, lease_id, ttl)))


def decode_value(data: Column) -> Column:
    """struct(value, create_revision, mod_revision, lease_id, ttl) of an encoded value."""
    names = ("create_revision", "mod_revision", "lease_id", "ttl")

    def of(n: Column) -> Column:  # size of the value, -5 without one
        value = F.when(n >= 0, F.decode(F.substring(data, F.lit(6), n), "utf-8"))
        return F.struct(value.alias("value"), *(read_little_endian(data, n + 6 + 8 * i + F.when(n < 0, 1).otherwise(0)).alias(c) for i, c in enumerate(names)))

    return let(F.when(F.hex(F.substring(data, 1, 1)) == TAG_PUT, read_little_endian(data, 2, 4)).otherwise(-5).cast("int"), of)


def encode_wal_op(op: Column, key: Column, value: Column) -> Column:
    """A logged write: tag, sized key, and for puts the sized value."""
    return F.when(op == "put", F.concat(F.unhex(F.lit(TAG_PUT)), sized(key), sized(value))).otherwise(F.concat(F.unhex(F.lit(TAG_DELETE)), sized(key)))


def decode_wal_op(data: Column) -> Column:
    """struct(op, key, value) of a logged write; null for an unknown tag."""
    tag = F.hex(F.substring(data, 1, 1))

    def of(n: Column) -> Column:
        value = F.when(tag == TAG_PUT, F.decode(F.substring(data, n + 10, read_little_endian(data, n + 6, 4).cast("int")), "utf-8"))
        return F.struct(F.when(tag == TAG_PUT, "put").otherwise("delete").alias("op"), F.decode(F.substring(data, F.lit(6), n), "utf-8").alias("key"), value.alias("value"))

    return F.when(tag.isin(TAG_PUT, TAG_DELETE), let(read_little_endian(data, 2, 4).cast("int"), of))


def wal_record(data: Column) -> Column:
    """A record of the log: checksum of length and data, length, data."""
    body = F.concat(little_endian(F.octet_length(data), 4), data)
    return F.concat(little_endian(F.crc32(body), 4), body)


def encode_entry(log_index: Column, term: Column, entry_type: Column, data: Column) -> Column:
    """An entry of the replicated log: index, term, type (one byte), sized data."""
    kinds = F.create_map(*(F.lit(x) for kv in ENTRY_TYPES.items() for x in kv))
    return F.concat(little_endian(log_index), little_endian(term), little_endian(F.element_at(kinds, entry_type), 1), sized(data))


def decode_entry(data: Column) -> Column:
    """struct(log_index, term, entry_type, data); null if too short or of an unknown type."""
    names = F.create_map(*(F.lit(x) for k, v in ENTRY_TYPES.items() for x in (v, k)))
    kind = F.try_element_at(names, read_little_endian(data, 17, 1).cast("int"))
    n = read_little_endian(data, 18, 4).cast("int")
    return F.when((F.octet_length(data) >= 21) & kind.isNotNull(), F.struct(read_little_endian(data, 1).alias("log_index"), read_little_endian(data, 9).alias("term"), kind.alias("entry_type"), F.decode(F.substring(data, F.lit(22), n), "utf-8").alias("data")))


def encode_footer(index_offset: Column, index_size: Column, bloom_offset: Column, bloom_size: Column, hashes: Column) -> Column:
    """The 40 bytes at the end of a sorted run."""
    return F.concat(*(little_endian(c) for c in (index_offset, index_size, bloom_offset, bloom_size)), little_endian(hashes, 4), little_endian(F.lit(FOOTER_MAGIC), 4))


def decode_footer(data: Column) -> Column:
    """struct of a footer's five numbers; null if its size or its mark is wrong."""
    good = (F.octet_length(data) == 40) & (read_little_endian(data, 37, 4) == FOOTER_MAGIC)
    names = ("index_offset", "index_size", "bloom_offset", "bloom_size")
    return F.when(good, F.struct(*(read_little_endian(data, 1 + 8 * i).alias(c) for i, c in enumerate(names)), read_little_endian(data, 33, 4).alias("hashes")))


def encode_block(entries: Column) -> Column:
    """A block of array<struct<key, value>>: key and value sizes, both texts, per entry; then the number of entries. A null value is a tombstone."""
    size = lambda e: F.when(e["value"].isNull(), F.lit(TOMBSTONE_LENGTH)).otherwise(F.octet_length(F.encode(e["value"], "utf-8")))
    one = lambda e: F.hex(F.concat(little_endian(F.octet_length(F.encode(e["key"], "utf-8")), 4), little_endian(size(e), 4), F.encode(e["key"], "utf-8"), F.encode(F.coalesce(e["value"], F.lit("")), "utf-8")))
    return F.concat(F.unhex(F.array_join(F.transform(entries, one), "")), little_endian(F.size(entries), 4))


def read_block(data: bytes) -> list[tuple[str, str | None]]:
    """(key, value) of a block's entries; raises ValueError if it is cut or has bytes left over."""
    count, at, out = int.from_bytes(data[-4:], "little"), 0, []
    end = len(data) - 4
    for _ in range(count):
        k, v = int.from_bytes(data[at : at + 4], "little"), int.from_bytes(data[at + 4 : at + 8], "little")
        gone = v == TOMBSTONE_LENGTH
        stop = at + 8 + k + (0 if gone else v)
        if stop > end:
            raise ValueError("the block is cut")
        out.append((data[at + 8 : at + 8 + k].decode(), None if gone else data[at + 8 + k : stop].decode()))
        at = stop
    if end < 0 or at != end:
        raise ValueError("the block has other bytes")
    return out


COMMAND = "type string, key string, value string, lease_id bigint, id bigint, ttl bigint"
#: The same with the type as the tag around its parts, and keys and values as arrays of bytes.
TAGGED_COMMAND = "Put struct<key:array<int>,value:array<int>,lease_id:bigint,ttl_seconds:bigint>, Delete struct<key:array<int>>, LeaseGrant struct<lease_id:bigint,ttl:bigint>, LeaseRevoke struct<lease_id:bigint>"
JOINT = "old array<struct<id:bigint,address:string>>, new array<struct<id:bigint,address:string>>"


def text_of_bytes(values: Column) -> Column:
    """The UTF-8 text of an array of byte values; null for null."""
    return F.decode(F.unhex(F.array_join(F.transform(values, lambda b: F.lpad(F.hex(b), 2, "0")), "")), "utf-8")


def bytes_of_text(text: Column) -> Column:
    """A text's UTF-8 bytes as a JSON array of numbers."""
    digits = F.hex(F.encode(text, "utf-8"))
    values = F.transform(F.sequence(F.lit(0), F.octet_length(text) - 1), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10))
    return F.concat(F.lit("["), F.when(F.octet_length(text) > 0, F.array_join(values, ",")).otherwise(""), F.lit("]"))


def decode_command(data: Column) -> Column:
    """struct(type, key, value, lease_id, ttl) of a command in JSON, in either shape; null if it cannot be read or lacks what its type needs.

    A put without lease_id or ttl has 0.
    """
    flat, tagged = F.from_json(data, COMMAND + ", ttl_seconds bigint"), F.from_json(data, TAGGED_COMMAND)
    zero = F.lit(0).cast("long")

    def of(kind: str, key: Column, value: Column, lease: Column, ttl: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), key.cast("string").alias("key"), value.cast("string").alias("value"), lease.cast("long").alias("lease_id"), ttl.cast("long").alias("ttl"))

    def read(both: Column) -> Column:
        f, t, none = both["f"], both["t"], F.lit(None)
        lease = F.coalesce(f["lease_id"], f["id"])
        put, delete, grant, revoke = t["Put"], t["Delete"], t["LeaseGrant"], t["LeaseRevoke"]
        return (
            F.when(put["key"].isNotNull() & put["value"].isNotNull(), of("Put", text_of_bytes(put["key"]), text_of_bytes(put["value"]), F.coalesce(put["lease_id"], zero), F.coalesce(put["ttl_seconds"], zero)))
            .when(delete["key"].isNotNull(), of("Delete", text_of_bytes(delete["key"]), none, none, none))
            .when(grant["lease_id"].isNotNull() & grant["ttl"].isNotNull(), of("LeaseGrant", none, none, grant["lease_id"], grant["ttl"]))
            .when(revoke["lease_id"].isNotNull(), of("LeaseRevoke", none, none, revoke["lease_id"], none))
            .when((f["type"] == "Put") & f["key"].isNotNull() & f["value"].isNotNull(), of("Put", f["key"], f["value"], F.coalesce(lease, zero), F.coalesce(f["ttl_seconds"], f["ttl"], zero)))
            .when((f["type"] == "Delete") & f["key"].isNotNull(), of("Delete", f["key"], none, none, none))
            .when((f["type"] == "LeaseGrant") & lease.isNotNull() & f["ttl"].isNotNull(), of("LeaseGrant", none, none, lease, f["ttl"]))
            .when((f["type"] == "LeaseRevoke") & lease.isNotNull(), of("LeaseRevoke", none, none, lease, none))
        )

    return let(F.struct(flat.alias("f"), tagged.alias("t")), read)


def leader_hint(message: Column) -> Column:
    """The node a refusal names as leader, or null."""
    found = F.regexp_extract(message, r"Some\((\d+)\)", 1)
    return F.when(found != "", found).cast("long")


def parse_peers(text: Column) -> Column:
    """map(id, address) of 'id=address,...'; parts without a number or '=' are left out, of repeated ids the last counts."""
    parts = F.filter(F.split(text, ","), lambda p: F.trim(p).rlike(r"^\d+\s*=.*$"))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.split(p, "=", 2)[0]).cast("long").alias("id"), F.trim(F.split(p, "=", 2)[1]).alias("address")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["id"] == p["id"]))
    return F.map_from_entries(last)


def run_name(number: Column) -> Column:
    """File name of a run."""
    return F.concat(F.lpad(number.cast("string"), 8, "0"), F.lit(".sst"))


def snapshot_name(index: Column) -> Column:
    """Name of a snapshot."""
    return F.concat(F.lit("snapshot-"), F.lpad(index.cast("string"), 20, "0"))


def election_timeout(low: int, high: int, seed: int, *cols: str) -> Column:
    """A whole number in [low, high] from a hash of columns, as of a node and its term: the same for the same row."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *cols)), 1, 8)
    return F.lit(low) + F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(high - low + 1))
