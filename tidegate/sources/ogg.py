"""Ogg pages: packets to pages and back, piece by piece."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
#: Flags of a page: it goes on with the packet before it, begins or ends its stream.
GOES_ON, BEGINS, ENDS = 1, 2, 4


def checksum(data: bytes) -> int:
    """The format's 32-bit CRC, which takes bits from the top: zlib's on bytes and result with their bits reversed."""
    crc = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{crc:032b}"[::-1], 2)


def pages(packet: bytes, serial: int, number: int, granule: int, flags: int = 0) -> tuple[bytes, int]:
    """Pages with one packet, and the number of the next page. A page has 255 lacing values at most."""
    lacing = [255] * (len(packet) // 255) + [len(packet) % 255]
    out, at = [], 0
    for k in range(0, len(lacing), 255):
        own = lacing[k : k + 255]
        last = k + 255 >= len(lacing)
        bits = (GOES_ON if k else 0) | (flags & BEGINS if not k else 0) | (flags & ENDS if last else 0)
        head = _HEAD.pack(b"OggS", 0, bits, granule if last else -1, serial, number, 0, len(own)) + bytes(own)
        body = packet[at : at + sum(own)]
        at += len(body)
        crc = checksum(head + body)
        out.append(head[:22] + struct.pack("<I", crc) + head[26:] + body)
        number += 1
    return b"".join(out), number


def head_packets(rate: int, channels: int) -> list[bytes]:
    """The two packets that begin an Opus stream."""
    vendor = b"tidegate"
    return [b"OpusHead" + struct.pack("<BBHIhB", 1, channels, 0, rate, 0, 0), b"OpusTags" + struct.pack("<I", len(vendor)) + vendor + struct.pack("<I", 0)]


@dataclass
class PageReader:
    """Packets of a stream that arrives in pieces of any size; holds one page and one packet."""

    held: bytes = b""
    packet: bytes = b""
    out: list[tuple[bytes, int]] = field(default_factory=list)

    def feed(self, data: bytes) -> list[tuple[bytes, int]]:
        """Packets that are whole by now, each with its page's granule position."""
        self.held += data
        self.out = []
        while True:
            at = self.held.find(b"OggS")
            if at < 0:
                self.held = self.held[-3:]
                return self.out
            self.held = self.held[at:]
            if len(self.held) < _HEAD.size:
                return self.out
            _, _, bits, granule, _, _, crc, count = _HEAD.unpack_from(self.held)
            begin = _HEAD.size + count
            lacing = self.held[_HEAD.size : begin]
            end = begin + sum(lacing)
            if len(lacing) < count or len(self.held) < end:
                return self.out
            page = self.held[:end]
            if checksum(page[:22] + b"\0" * 4 + page[26:]) != crc:
                self.held = self.held[4:]  # not a page, or a broken one: look for the next
                self.packet = b""
                continue
            self.held = self.held[end:]
            if not bits & GOES_ON:
                self.packet = b""
            at = begin
            for n in lacing:
                self.packet += page[at : at + n]
                at += n
                if n < 255:
                    if self.packet:
                        self.out.append((self.packet, granule))
                    self.packet = b""
