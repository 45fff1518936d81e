"""Files read by ranges of bytes, from any store that executors reach by its URI: zip members and WAV headers."""

from __future__ import annotations

import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote

PIECE = 1 << 20  # bytes in memory at a time
STORED, DEFLATED = 0, 8


def store_of(uri: str):
    """(file system, path) of a URI or of a local path."""
    from pyarrow import fs

    local = re.fullmatch(r"file:(?://)?(/.*)", uri) or re.fullmatch(r"(/.*)", uri)
    if local:
        return fs.LocalFileSystem(), local[1]
    scheme, rest = uri.split("://", 1)
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/:@')}")


def open_ranged(uri: str):
    """A seekable stream over a file; what is not asked for is not read."""
    filesystem, path = store_of(uri)
    return filesystem.open_input_file(path)


@contextmanager
def whole_file(folder: str, name: str):
    """A stream to a file that gets its name when it is complete, so that a lost task leaves no torn one."""
    filesystem, path = store_of(folder)
    filesystem.create_dir(path, recursive=True)
    attempt = f"{path}/.{name}-{uuid.uuid4().hex}"
    with filesystem.open_output_stream(attempt) as stream:
        yield stream
    filesystem.move(attempt, f"{path}/{name}")


def archive_members(stream) -> Iterator[tuple[str, int, int, int]]:
    """(name, offset, compressed size, method) of an archive's members, from the directory at its end."""
    with zipfile.ZipFile(stream) as z:
        for info in z.infolist():
            if not info.is_dir():
                if info.flag_bits & 1 or info.compress_type not in (STORED, DEFLATED):
                    raise ValueError(f"{info.filename}: encrypted or packed by method {info.compress_type}")
                yield info.filename, info.header_offset, info.compress_size, info.compress_type


def member_bytes(stream, offset: int, size: int, method: int) -> Iterator[bytes]:
    """A member's content piece by piece, read from its place in the archive on."""
    stream.seek(offset)
    head = stream.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at {offset}")
    name, extra = struct.unpack_from("<HH", head, 26)
    stream.seek(offset + 30 + name + extra)
    unpack = zlib.decompressobj(-15) if method == DEFLATED else None
    while size:
        piece = stream.read(min(size, PIECE))
        if not piece:
            raise ValueError(f"member at {offset} ends early")
        size -= len(piece)
        while piece:
            # a piece may unpack to far more than it is
            yield unpack.decompress(piece, PIECE) if unpack else piece
            piece = unpack.unconsumed_tail if unpack else b""
    if unpack:
        yield unpack.flush()


def lines_of(pieces: Iterator[bytes]) -> Iterator[str]:
    """Lines of a content that comes in pieces, without their ends."""
    rest: list[bytes] = []
    for piece in pieces:
        *whole, last = piece.split(b"\n")
        for line in whole:
            yield b"".join([*rest, line]).decode("utf-8").rstrip("\r\n")
            rest = []
        rest.append(last)
    end = b"".join(rest)
    if end:
        yield end.decode("utf-8").rstrip("\r\n")


def wav_header(stream, length: int) -> tuple[int, int, int, int] | None:
    """(channels, bytes per sample, rate, frames), hopping from the head of a chunk to the next; None when unreadable."""
    head = stream.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= length:
        stream.seek(at)
        name, size = struct.unpack("<4sI", stream.read(8))
        if name == b"fmt " and at + 24 <= length:
            _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", stream.read(16))
            form = (channels, bits // 8, rate)
        elif name == b"data" and form:
            width = form[0] * form[1]
            return (*form, size // width if width else 0)
        at += 8 + size + (size & 1)
    return None
