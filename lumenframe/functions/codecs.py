"""Value codecs: named pairs of column functions that store a logical type in another."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CodecError(ValueError):
    pass


@dataclass(frozen=True)
class Codec:
    id: str
    version: int
    logical: str
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]

    @property
    def key(self) -> tuple[str, int]:
        return self.id, self.version


def json_codec(schema: T.StructType, id: str = "json-text", binary: bool = False) -> Codec:
    if binary:
        return Codec(id, 1, schema.simpleString(), lambda c: F.to_json(c).cast("binary"), lambda c: F.from_json(c.cast("string"), schema))
    return Codec(id, 1, schema.simpleString(), F.to_json, lambda c: F.from_json(c, schema))


EPOCH = 2440587.5

STANDARD = (
    Codec("date-text", 1, "timestamp", lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), lambda c: F.try_to_timestamp(c)),
    Codec("date-millis", 1, "timestamp", lambda c: F.round(F.unix_micros(c) / 1000.0).cast("bigint"), lambda c: F.timestamp_millis(c)),
    Codec("date-seconds", 1, "timestamp", lambda c: F.unix_micros(c) / 1e6, lambda c: F.timestamp_micros(F.round(c * 1e6).cast("bigint"))),
    Codec("date-julian", 1, "timestamp", lambda c: F.unix_micros(c) / 86_400_000_000.0 + EPOCH, lambda c: F.timestamp_micros(F.round((c - EPOCH) * 86_400_000_000.0).cast("bigint"))),
    Codec("uuid-text", 1, "string", lambda c: F.lower(c), lambda c: F.lower(c)),
    Codec("uuid-blob", 1, "string", lambda c: F.unhex(F.replace(c, F.lit("-"), F.lit(""))), lambda c: F.regexp_replace(F.lower(F.hex(c)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")),
)


@dataclass
class Registry:
    """Codecs by key, and a default for a logical type; a type with several codecs and no default is ambiguous."""

    codecs: dict = field(default_factory=dict)
    defaults: dict = field(default_factory=dict)

    def register(self, codec: Codec, default: bool = False) -> None:
        if codec.key in self.codecs:
            raise CodecError(f"{codec.key} is already registered")
        self.codecs[codec.key] = codec
        if default:
            self.defaults[codec.logical] = codec.key

    def find(self, logical: str, key: tuple[str, int] | None = None) -> Codec:
        if key is not None:
            if key not in self.codecs:
                raise CodecError(f"no codec {key}")
            return self.codecs[key]
        if logical in self.defaults:
            return self.codecs[self.defaults[logical]]
        fitting = [c for c in self.codecs.values() if c.logical == logical]
        if len(fitting) != 1:
            raise CodecError(f"{len(fitting)} codecs for {logical}: name one")
        return fitting[0]


def standard() -> Registry:
    out = Registry()
    for c in STANDARD:
        out.register(c, default=c.id in ("date-text", "uuid-text"))
    return out


def apply(df: DataFrame, registry: Registry, decode: bool = True) -> DataFrame:
    """Decodes (or encodes) the columns whose field metadata names a codec: {"codec": id, "codec_version": version}."""
    cols = []
    for f in df.schema.fields:
        key = f.metadata.get("codec") if f.metadata else None
        c = F.col(f"`{f.name}`")
        if key:
            codec = registry.find("", (key, int(f.metadata.get("codec_version", 1))))
            c = (codec.decode if decode else codec.encode)(c).alias(f.name, metadata=f.metadata)
        cols.append(c)
    return df.select(*cols)


def checked_enum(x: Column, values, name: str = "enum") -> Column:
    """The raw value; reading an unknown one fails, null stays null."""
    bad = F.raise_error(F.concat(F.lit(f"invalid value for {name}: "), x.cast("string"))).cast("string")
    return F.when(x.isNull() | x.isin(list(values)), x).otherwise(bad)


def enum_codec(values, name: str = "enum") -> Codec:
    """Raw values of an enumeration; an unknown one fails either way."""
    check = lambda c: checked_enum(c, values, name)
    return Codec(f"enum-raw:{name}", 1, "string", check, check)
