"""A planar hexagonal cell system: ids with a resolution, parents by bit operations, rings and disks.

Ids are 64-bit and positive: 4 bits of resolution (0 to 15), then row and column of an axial lattice (28 bits each, offset so that
they are not negative). Each resolution halves the spacing of the one before. Ids are not those of any published
grid; neighbourhoods, parents and rings have the same meaning. With no cell, 0 or null, nothing matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS, HALF = 28, 1 << 27
#: Degrees between neighbouring columns at resolution 0, and kilometres of a cell's edge there.
SPACING, EDGE_KM = 12.8, 800.0
RING = ((0, 0), (1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))
#: Most cells that a filter may have.
FILTER_MOST = 4096


class CellError(ValueError):
    """A place that cannot be made into cells."""


def pack(res: int, q: int, r: int) -> int:
    return (res << (2 * BITS)) | ((q + HALF) << BITS) | (r + HALF)


def unpack(cell: int) -> tuple[int, int, int]:
    return cell >> (2 * BITS), ((cell >> BITS) & ((1 << BITS) - 1)) - HALF, (cell & ((1 << BITS) - 1)) - HALF


def res_of(cell: Column) -> Column:
    return F.shiftright(cell, 2 * BITS).cast("int")


def q_of(cell: Column) -> Column:
    return F.shiftright(cell, BITS).bitwiseAND(F.lit((1 << BITS) - 1)) - HALF


def r_of(cell: Column) -> Column:
    return cell.bitwiseAND(F.lit((1 << BITS) - 1)) - HALF


def make(res: Column, q: Column, r: Column) -> Column:
    return F.shiftleft(res.cast("long"), 2 * BITS) + F.shiftleft((q + HALF).cast("long"), BITS) + (r + HALF).cast("long")


def cell_of(lat: Column, lon: Column, res: int) -> Column:
    """The cell of a place; null beyond the ranges of latitude and longitude."""
    step = SPACING / (1 << res)
    r = F.round(lat / F.lit(step)).cast("long")
    q = F.round(lon / F.lit(step) - r / 2.0).cast("long")
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), make(F.lit(res), q, r))


def cell_at(lat: float, lon: float, res: int) -> int:
    if not (-90 <= lat <= 90 and -180 <= lon <= 180):
        raise CellError("no such place")
    step = SPACING / (1 << res)
    away = lambda x: math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)
    r = away(lat / step)
    return pack(res, away(lon / step - r / 2.0), r)


def centre(cell: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a cell's middle."""
    step = F.lit(SPACING) / F.pow(F.lit(2.0), res_of(cell))
    return r_of(cell) * step, (q_of(cell) + r_of(cell) / 2.0) * step


def centre_of(cell: int) -> tuple[float, float]:
    res, q, r = unpack(cell)
    step = SPACING / (1 << res)
    return r * step, (q + r / 2.0) * step


def parent(cell: Column, res: int) -> Column:
    """The coarser cell that holds this one; the cell itself where it is as coarse already; null for malformed cells."""
    d = res_of(cell) - res
    up = make(F.lit(res), F.expr("0") + shift_down(q_of(cell), d), shift_down(r_of(cell), d))
    return F.when(cell.isNull() | (cell <= 0), None).when(d <= 0, cell).otherwise(up)


def shift_down(v: Column, d: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), d)).cast("long")


def parent_of(cell: int, res: int) -> int:
    own, q, r = unpack(cell)
    return cell if res >= own else pack(res, q >> (own - res), r >> (own - res))


def ring(cell: Column) -> Column:
    """The cell and its six neighbours."""
    return F.array(*(make(res_of(cell), q_of(cell) + dq, r_of(cell) + dr) for dq, dr in RING))


def disk_of(cell: int, k: int) -> list[int]:
    res, q, r = unpack(cell)
    return [pack(res, q + a, r + b) for a in range(-k, k + 1) for b in range(max(-k, -a - k), min(k, -a + k) + 1)]


def edge_km(res: int) -> float:
    return EDGE_KM / (1 << res)


def filter_cells(lat: float, lon: float, radius_km: float) -> tuple[int, list[int]]:
    """Resolution and cells that cover a circle: fine cells for small radii, coarse ones for large."""
    radius = min(max(radius_km, 0.1), 250.0)
    if radius <= 8:
        res, got = 7, disk_of(cell_at(lat, lon, 7), math.ceil(radius / edge_km(7)))
    elif radius <= 30:
        six = disk_of(cell_at(lat, lon, 6), math.ceil(radius / edge_km(6)))
        res, got = 7, sorted({pack(7, 2 * q + a, 2 * r + b) for _, q, r in map(unpack, six) for a in (0, 1) for b in (0, 1)})
    else:
        res, got = 5, disk_of(cell_at(lat, lon, 5), math.ceil(radius / edge_km(5)))
    if len(got) > FILTER_MOST:
        raise CellError("too many cells")
    return res, got


def cells_for(cell: int) -> tuple[int, list[int]]:
    """Cells that a filter by one cell takes: finer ones go up to 7, 6 goes down to 7, coarse ones to 5."""
    res, q, r = unpack(cell)
    target = 7 if res >= 6 else 5
    if res >= target:
        return target, [parent_of(cell, target)]
    n = 1 << (target - res)
    if n * n > FILTER_MOST:
        raise CellError("too many cells")
    return target, [pack(target, q * n + a, r * n + b) for a in range(n) for b in range(n)]


def parse_cell(text: str) -> int:
    """A cell's literal: hexadecimal before decimal."""
    try:
        return int(text, 16)
    except ValueError:
        raise CellError("not a cell") from None
