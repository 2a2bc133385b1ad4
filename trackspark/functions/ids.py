"""Packed 64-bit identifiers. Always ``BIGINT``: a double drops the low bits of 19-digit ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bit offset and width of each field of the packed surface id.
SURFACE_FIELDS = {
    "volume": (56, 0xFF),
    "layer": (36, 0xFFF),
    "module": (8, 0xFFFFF),
    "ring": (0, 0xFF),
}
# Bit offset of each field of the packed particle id.
PARTICLE_SHIFTS = {
    "vertex_primary": 48,
    "vertex_secondary": 32,
    "particle": 16,
    "generation": 8,
    "sub_particle": 0,
}


def _long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def surface_field(surface_id: Column | str, field: str) -> Column:
    shift, mask = SURFACE_FIELDS[field]
    return F.shiftrightunsigned(_long(surface_id), shift).bitwiseAND(F.lit(mask).cast("long"))


def decode_surface(surface_id: Column | str, prefix: str = "") -> list[Column]:
    """``volume_id, layer_id, module_id`` of a packed surface id."""
    return [
        surface_field(surface_id, f).alias(f"{prefix}{f}_id") for f in ("volume", "layer", "module")
    ]


def clear_ring(surface_id: Column | str) -> Column:
    """Surface id with its lowest byte set to zero."""
    return _long(surface_id).bitwiseAND(F.lit(~0xFF).cast("long"))


def encode_surface(volume: Column | str, layer: Column | str, module: Column | str) -> Column:
    parts = zip((volume, layer, module), ("volume", "layer", "module"))
    return _pack([(c, SURFACE_FIELDS[f][0]) for c, f in parts])


def encode_particle(primary, secondary, particle, generation, sub) -> Column:
    cols = (primary, secondary, particle, generation, sub)
    return _pack(list(zip(cols, PARTICLE_SHIFTS.values())))


def _pack(fields: list[tuple[Column | str, int]]) -> Column:
    packed = F.lit(0).cast("long")
    for c, shift in fields:
        packed = packed.bitwiseOR(F.shiftleft(_long(c), shift))
    return packed
