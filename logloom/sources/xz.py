"""xz files block by block: a file of many blocks is the work of many tasks.

The index at the end of an xz stream lists its blocks, each of which can be decoded alone
behind the stream's header. Ranges of blocks share a file like Hadoop's splits share a text:
a range owns the lines that start behind its first byte and up to its last one, and decodes
on into the next block where its last line goes on.
"""

from __future__ import annotations

import lzma
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

_HEAD, _FOOT = b"\xfd7zXZ\x00", b"YZ"  # fixed values of the file format
#: Decoded bytes of a range, about, and packed bytes that are read at once.
RANGE_BYTES, _READ = 64 << 20, 1 << 20


@dataclass(frozen=True)
class Block:
    """Where a block lies, packed and decoded, and the header of its stream."""

    at: int
    size: int
    start: int
    length: int
    header: bytes


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, and the place behind it."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not byte & 0x80:
            return value, at


def blocks(f: BinaryIO) -> list[Block]:
    """All blocks of a file in order, from the indexes of its streams; raises ``lzma.LZMAError`` for other files."""
    end, streams = f.seek(0, os.SEEK_END), []
    while end > 0:
        f.seek(end - 4)
        if f.read(4) == b"\0\0\0\0":  # padding between streams
            end -= 4
            continue
        f.seek(max(0, end - 12))
        foot = f.read(12)
        if len(foot) < 12 or foot[10:] != _FOOT:
            raise lzma.LZMAError("no xz stream ends here")
        size = 4 * (int.from_bytes(foot[4:8], "little") + 1)
        f.seek(end - 12 - size)
        index = f.read(size)
        count, at = _number(index, 1)
        records = []
        for _ in range(count):
            packed, at = _number(index, at)
            plain, at = _number(index, at)
            records.append((-(-packed // 4) * 4, plain))
        begin = end - 12 - size - sum(p for p, _ in records) - 12
        f.seek(max(0, begin))
        header = f.read(12)
        if begin < 0 or header[:6] != _HEAD:
            raise lzma.LZMAError("no xz stream begins where its index says")
        streams.append((begin, header, records))
        end = begin
    out, start = [], 0
    for begin, header, records in reversed(streams):
        at = begin + 12
        for packed, plain in records:
            out.append(Block(at, packed, start, plain, header))
            at, start = at + packed, start + plain
    return out


def ranges(found: list[Block], least: int = RANGE_BYTES) -> list[tuple[int, int]]:
    """Consecutive blocks (first, behind the last) of at least ``least`` decoded bytes."""
    out, first, size = [], 0, 0
    for i, b in enumerate(found):
        size += b.length
        if size >= least or i == len(found) - 1:
            out.append((first, i + 1))
            first, size = i + 1, 0
    return out


def _decoded(f: BinaryIO, found: list[Block]) -> Iterator[bytes]:
    for b in found:
        decoder, left = lzma.LZMADecompressor(lzma.FORMAT_XZ), b.size
        decoder.decompress(b.header)
        f.seek(b.at)
        while left:
            data = f.read(min(_READ, left))
            if not data:
                raise EOFError("the file ends within a block")
            left -= len(data)
            # what one read holds may be very long: it comes out in pieces
            yield decoder.decompress(data, _READ)
            while not decoder.needs_input and not decoder.eof:
                yield decoder.decompress(b"", _READ)


def _split(pieces: Iterator[bytes], start: int) -> Iterator[tuple[int, bytes]]:
    """Lines that end at \\n, \\r\\n or \\r, each with its place. Bytes know no other line ends."""
    rest, at = b"", start
    for piece in pieces:
        done = (rest + piece).splitlines(keepends=True)
        rest = done.pop() if done and not done[-1].endswith(b"\n") else b""  # it may go on; a \r may have its \n yet
        for line in done:
            yield at, _bare(line)
            at += len(line)
    if rest:
        yield at, _bare(rest)


def _bare(line: bytes) -> bytes:
    return line[:-2] if line.endswith(b"\r\n") else line[:-1] if line.endswith((b"\n", b"\r")) else line


def lines(path: str, first: int, last: int) -> Iterator[bytes]:
    """The lines that a range of blocks owns."""
    with open(path, "rb") as f:
        found = blocks(f)
        start, end = found[first].start, found[last - 1].start + found[last - 1].length
        each = _split(_decoded(f, found[first:]), start)
        if first:
            next(each, None)  # the range before owns the line that this one begins in
        for at, line in each:
            if at > end:
                return
            yield line
