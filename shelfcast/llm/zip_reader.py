"""Reading the directory of a ZIP file, with its ZIP64 forms, through a reader of byte ranges.

Only the end of the file, the central directory and the local header of a wanted member are
read. A stored member is then a range of the file.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

# Fixed values of the format.
END, END_64, LOCATOR_64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR_SIZE, END_64_SIZE, CENTRAL_SIZE, LOCAL_SIZE = 22, 20, 56, 46, 30
MOST_COMMENT = 0xFFFF
FULL_16, FULL_32 = 0xFFFF, 0xFFFFFFFF
EXTRA_64 = 1
STORED = 0

# Reads ``size`` bytes from ``offset`` on.
ReadAt = Callable[[int, int], bytes]


class BadZip(ValueError):
    """The file does not hold what its directory says."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored_size: int
    header: int  # offset of the local header


def _unpack(form: str, data: bytes, at: int = 0) -> tuple:
    if len(data) < at + struct.calcsize(form):
        raise BadZip("cut off")
    return struct.unpack_from(form, data, at)


def directory_range(read_at: ReadAt, size: int) -> tuple[int, int, int]:
    """(offset, size, number of members) of the central directory."""
    tail_at = max(0, size - END_SIZE - MOST_COMMENT)
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0:  # the comment may hold the signature: its length must reach the end
        if at + END_SIZE <= len(tail) and at + END_SIZE + _unpack("<H", tail, at + 20)[0] == len(tail):
            break
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise BadZip("no end record")
    members, length, offset = _unpack("<HII", tail, at + 10)
    before = tail_at + at - LOCATOR_SIZE
    if (members == FULL_16 or length == FULL_32 or offset == FULL_32) and before >= 0:
        locator = read_at(before, LOCATOR_SIZE)
        if locator[:4] == LOCATOR_64:
            record = read_at(_unpack("<Q", locator, 8)[0], END_64_SIZE)
            if record[:4] != END_64:
                raise BadZip("no ZIP64 end record where its locator points")
            members, length, offset = _unpack("<QQQ", record, 32)
    return offset, length, members


def _wide(extra: bytes, size: int, stored: int, header: int) -> tuple[int, int, int]:
    """Sizes and offset, with those that did not fit taken from the ZIP64 field, in its order."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == EXTRA_64:
            field = extra[at + 4 : at + 4 + length]
            values = iter(struct.unpack(f"<{len(field) // 8}Q", field[: len(field) // 8 * 8]))
            try:
                size = next(values) if size == FULL_32 else size
                stored = next(values) if stored == FULL_32 else stored
                header = next(values) if header == FULL_32 else header
            except StopIteration:
                raise BadZip("short ZIP64 field") from None
        at += 4 + length
    return size, stored, header


def members(read_at: ReadAt, size: int) -> dict[str, Member]:
    """The members of the file by name; of equal names the last."""
    offset, length, count = directory_range(read_at, size)
    data, at, found = read_at(offset, length), 0, {}
    for _ in range(count):
        if data[at : at + 4] != CENTRAL:
            raise BadZip("central directory is cut off")
        flags, method = _unpack("<HH", data, at + 8)
        stored, full, n_name, n_extra, n_comment = _unpack("<IIHHH", data, at + 20)
        header = _unpack("<I", data, at + 42)[0]
        name_at = at + CENTRAL_SIZE
        name = data[name_at : name_at + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[name_at + n_name : name_at + n_name + n_extra]
        full, stored, header = _wide(extra, full, stored, header)
        found[name] = Member(name, method, full, stored, header)
        at = name_at + n_name + n_extra + n_comment
    return found


def stored_range(read_at: ReadAt, member: Member) -> tuple[int, int]:
    """(offset, size) of the bytes of a stored member."""
    if member.method != STORED:
        raise BadZip(f"{member.name} is compressed; only stored members can be read in ranges")
    local = read_at(member.header, LOCAL_SIZE)
    if local[:4] != LOCAL:
        raise BadZip(f"no local header of {member.name}")
    n_name, n_extra = _unpack("<HH", local, 26)
    return member.header + LOCAL_SIZE + n_name + n_extra, member.size
