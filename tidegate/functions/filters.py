"""Predicates that nodes apply before they work on a packet, and allow-lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The first bytes of header packets, and the size below which a packet has no audio.
HEADERS = ("OpusHead", "OpusTags")
SMALLEST = 10


def audio_packet(data: Column) -> Column:
    """Neither a header nor too small to hold a frame."""
    return (F.octet_length(data) >= SMALLEST) & ~F.substring(data, 1, 8).isin([F.encode(F.lit(h), "UTF-8") for h in HEADERS])


def default_track(track: Column, default: int = 0) -> Column:
    return track == default


def _glob(pattern: str) -> str:
    """A pattern of * (any characters) and ? (one) as a regular expression."""
    import re

    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def url_allowed(url: Column, rules: list[str], method: Column | None = None, methods: list[str] | None = None) -> Column:
    """Rules are `scheme://host/path` with * and ? in host and path; one without a path allows all, one without a port any
    port. A method is compared without case; no list of methods allows all. No rule: all are denied."""

    def one(rule: str) -> Column:
        scheme, _, rest = rule.partition("://")
        host, slash, path = rest.partition("/")
        if not scheme or not host:
            return F.lit(False)  # not a rule
        own = F.parse_url(url, F.lit("AUTHORITY")) if ":" in host else F.parse_url(url, F.lit("HOST"))
        there = F.coalesce(F.nullif(F.parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
        return (F.lower(F.parse_url(url, F.lit("PROTOCOL"))) == scheme.lower()) & own.rlike(_glob(host)) & there.rlike(_glob(f"/{path}" if slash else "/*"))

    found = reduce(lambda a, b: a | b, [F.coalesce(one(r), F.lit(False)) for r in rules]) if rules else F.lit(False)
    if method is not None and methods:
        found = found & F.coalesce(F.lower(method).isin([m.lower() for m in methods]), F.lit(False))
    return found


def read_allowed(path: Column, rules: list[str], root: str) -> Column:
    """Whether a path may be read: `..` and `.` are resolved against root first, then a rule (relative ones below root, with
    * and ?) must match. No rule: all are denied."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    parts = F.filter(F.split(whole, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    real = F.concat(F.lit("/"), F.array_join(kept, "/"))
    tests = [real.rlike(_glob(r if r.startswith("/") else f"{root.rstrip('/')}/{r}")) for r in rules]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False)) if tests else F.lit(False)


def write_allowed(path: Column, rules: list[str], root: str) -> Column:
    """As read_allowed, but a path with `..` may never be written."""
    return ~F.array_contains(F.split(path, "/"), "..") & read_allowed(path, rules, root)


# The states of a node and which may follow each.
LIFECYCLE = {
    "Initializing": ("Ready", "Failed", "Stopped"),
    "Ready": ("Running", "Failed", "Stopped"),
    "Running": ("Recovering", "Degraded", "Failed", "Stopped"),
    "Recovering": ("Running", "Degraded", "Failed", "Stopped"),
    "Degraded": ("Running", "Recovering", "Failed", "Stopped"),
    "Failed": (),
    "Stopped": (),
}


def may_follow(before: Column, after: Column, allowed: dict[str, tuple[str, ...]]) -> Column:
    """Whether a state may follow another; the first state of a node may be any."""
    tests = [(before == a) & after.isin(list(b)) for a, b in allowed.items() if b]
    return F.coalesce(reduce(lambda x, y: x | y, tests), F.lit(True)) if tests else before.isNull()


def admit(df: DataFrame, kinds: list[str], policy: str = "ignore") -> DataFrame:
    """Packets of the kinds that a node takes, with handled true, and what it does with others: `ignore` and `discard` leave
    them out (discarded ones are counted by discards), `forward` keeps them with handled false, `error` fails."""
    if policy not in ("ignore", "discard", "forward", "error"):
        raise ValueError(f"unknown policy '{policy}'")
    rows = df.withColumn("handled", F.coalesce(F.lower("kind").isin([k.lower() for k in kinds]), F.lit(False)))
    if policy == "forward":
        return rows
    if policy == "error":
        wrong = F.raise_error(F.concat(F.lit("unexpected packet of kind "), F.coalesce("kind", F.lit("null")))).cast("boolean")
        return rows.withColumn("handled", F.when(F.col("handled"), F.lit(True)).otherwise(wrong))
    return rows.where("handled")


def discards(df: DataFrame, kinds: list[str]) -> DataFrame:
    """received and discarded packets of each stream."""
    return df.groupBy("stream_id").agg(F.count("*").alias("received"), F.count_if(~F.coalesce(F.lower("kind").isin([k.lower() for k in kinds]), F.lit(False))).alias("discarded"))


# The words of session names, and the offset and prime of the hash that picks them.
ADJECTIVES = "ancient brave calm clever dapper eager fancy gentle happy jolly kind lively mighty noble proud quick quiet shiny silly swift wise".split()
NOUNS = "antelope badger beaver bison cougar dolphin dragon eagle falcon fox gecko heron ibis koala lemur lynx otter panther puma raven tiger yak".split()
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3


def session_name(session: Column) -> Column:
    """adjective-noun-hhhh by the 64-bit hash of a session's id, in two halves of 32 bits, which longs hold without overflow:
    times 2^40 + r, the high half gains the low one shifted by 8."""
    mask, r = F.lit(0xFFFFFFFF), PRIME - (1 << 40)
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(session)), lambda i: F.conv(F.hex(F.substring(F.encode(session, "UTF-8"), i, F.lit(1))), 16, 10).cast("long"))
    start = F.struct(F.lit(OFFSET >> 32).alias("hi"), F.lit(OFFSET & 0xFFFFFFFF).alias("lo"))

    def step(h: Column, b: Column) -> Column:
        lo = h["lo"].bitwiseXOR(b)
        low = lo * r
        return F.struct((h["hi"] * r + F.shiftright(low, 32) + lo * 256).bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    whole = F.aggregate(F.when(F.octet_length(session) > 0, codes).otherwise(F.array().cast("array<bigint>")), start, step)

    def name(h: Column) -> Column:
        # h mod n, and h >> 8 mod n, from the halves.
        mod = lambda hi, lo, n: (hi % n * ((1 << 32) % n) + lo % n) % n
        noun = mod(F.shiftright(h["hi"], 8), F.shiftright(h["lo"], 8) + h["hi"].bitwiseAND(F.lit(255)) * (1 << 24), len(NOUNS))
        pick = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (k + 1).cast("int"))
        tail = F.lower(F.lpad(F.hex(F.shiftright(h["lo"], 16)), 4, "0"))
        return F.concat_ws("-", pick(ADJECTIVES, mod(h["hi"], h["lo"], len(ADJECTIVES))), pick(NOUNS, noun), tail)

    return F.transform(F.array(whole), name)[0]
