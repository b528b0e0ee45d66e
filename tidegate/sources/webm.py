"""The parts of a WebM stream of one Opus track: a head, and a cluster for each packet."""

from __future__ import annotations

import struct

from tidegate.sources.ogg import head_packets

#: Elements by name, as the format numbers them.
ELEMENTS = {
    "EBML": 0x1A45DFA3, "DocType": 0x4282, "DocTypeVersion": 0x4287, "DocTypeReadVersion": 0x4285,
    "Segment": 0x18538067, "Info": 0x1549A966, "TimecodeScale": 0x2AD7B1, "MuxingApp": 0x4D80, "WritingApp": 0x5741,
    "Tracks": 0x1654AE6B, "TrackEntry": 0xAE, "TrackNumber": 0xD7, "TrackUID": 0x73C5, "TrackType": 0x83, "CodecID": 0x86, "CodecPrivate": 0x63A2,
    "Audio": 0xE1, "SamplingFrequency": 0xB5, "Channels": 0x9F,
    "Cluster": 0x1F43B675, "Timecode": 0xE7, "SimpleBlock": 0xA3,
}


def element(name: str, body: bytes | int | float | str | None) -> bytes:
    """An element with its size in front; None stands for a size that isn't known, of what goes on to the stream's end."""
    code = ELEMENTS[name]
    out = code.to_bytes((code.bit_length() + 7) // 8, "big")
    if body is None:
        return out + b"\x01" + b"\xff" * 7
    if isinstance(body, int):
        body = body.to_bytes(max((body.bit_length() + 7) // 8, 1), "big")
    elif isinstance(body, float):
        body = struct.pack(">d", body)
    elif isinstance(body, str):
        body = body.encode()
    return out + (len(body) | 1 << 56).to_bytes(8, "big") + body


def head(rate: int, channels: int) -> bytes:
    kind = element("DocType", "webm") + element("DocTypeVersion", 4) + element("DocTypeReadVersion", 2)
    info = element("TimecodeScale", 1_000_000) + element("MuxingApp", "tidegate") + element("WritingApp", "tidegate")
    sound = element("SamplingFrequency", float(rate)) + element("Channels", channels)
    track = element("TrackNumber", 1) + element("TrackUID", 1) + element("TrackType", 2) + element("CodecID", "A_OPUS") + element("CodecPrivate", head_packets(rate, channels)[0]) + element("Audio", sound)
    return element("EBML", kind) + element("Segment", None) + element("Info", info) + element("Tracks", element("TrackEntry", track))


def cluster(at_ms: int, packet: bytes) -> bytes:
    block = b"\x81" + struct.pack(">hB", 0, 0x80) + packet
    return element("Cluster", element("Timecode", at_ms) + element("SimpleBlock", block))
