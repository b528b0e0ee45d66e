"""Pin types and which of them may be connected."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PinType:
    """A packet kind with fields. A field's wildcard (0, or none for a format) fits any value."""

    kind: str
    fields: tuple[tuple[str, object], ...] = ()

    def get(self, name: str) -> object:
        return dict(self.fields).get(name)


ANY, PASSTHROUGH = PinType("Any"), PinType("Passthrough")
TEXT, TRANSCRIPTION, BINARY, OPUS = PinType("Text"), PinType("Transcription"), PinType("Binary"), PinType("OpusAudio")
#: Which value of a field fits all others.
WILDCARDS: dict[str, dict[str, object]] = {"RawAudio": {"sample_rate": 0, "channels": 0}}
PACKET_TYPES = ("RawAudio", "OpusAudio", "Text", "Transcription", "Custom", "Binary", "Any")


def raw_audio(sample_rate: int = 0, channels: int = 0, sample_format: str = "F32") -> PinType:
    return PinType("RawAudio", (("channels", channels), ("sample_format", sample_format), ("sample_rate", sample_rate)))


def custom(type_id: str) -> PinType:
    return PinType("Custom", (("type_id", type_id),))


def can_connect(output: PinType, accepted: PinType) -> bool:
    if ANY.kind in (output.kind, accepted.kind):
        return True
    if output.kind != accepted.kind or output.kind == PASSTHROUGH.kind:
        return False
    wild = WILDCARDS.get(output.kind, {})
    mine, theirs = dict(output.fields), dict(accepted.fields)
    return all(mine.get(f) == theirs.get(f) or (f in wild and wild[f] in (mine.get(f), theirs.get(f))) for f in {*mine, *theirs})


def can_connect_any(output: PinType, accepted: "list[PinType] | tuple[PinType, ...]") -> bool:
    return any(can_connect(output, a) for a in accepted)


@dataclass(frozen=True)
class InputPin:
    name: str
    accepts: tuple[PinType, ...] = (ANY,)
    #: one: a single connection; dynamic: any number, as name_0, name_1 and so on.
    cardinality: str = "one"


@dataclass(frozen=True)
class OutputPin:
    name: str = "out"
    produces: PinType = ANY


@dataclass(frozen=True)
class Pins:
    inputs: tuple[InputPin, ...] = field(default_factory=tuple)
    outputs: tuple[OutputPin, ...] = field(default_factory=tuple)
