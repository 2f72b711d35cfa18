"""Scalar functions of the voxel model as Column expressions: addresses, colours, filters, zoom, labels, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import idiv, to_u8


def block_index(x: Column, y: Column, z: Column) -> Column:
    """Byte of a voxel in a 64-cube tile stored as 4-cubes."""
    block = idiv(z, 4) * 256 + idiv(y, 4) * 16 + idiv(x, 4)
    return block * 64 + z.bitwiseAND(3) * 16 + y.bitwiseAND(3) * 4 + x.bitwiseAND(3)


def c_order_index(x: Column, y: Column, z: Column, edges: tuple[int, int, int]) -> Column:
    """Element of a chunk whose axes are z, y, x and whose last axis runs fastest; edges in the order x, y, z."""
    return (z * edges[1] + y) * edges[0] + x


def page_address(x: Column, y: Column, z: Column) -> Column:
    """Hierarchical address: 16-cubes of voxels in 16-cubes of lines in pages, for coordinates below 8192."""
    b = lambda c, mask: c.cast("bigint").bitwiseAND(mask)
    page = F.shiftleft(b(z, 0x1F00), 2).bitwiseOR(F.shiftright(b(y, 0x1F00), 3)).bitwiseOR(F.shiftright(b(x, 0x1F00), 8))
    line = F.shiftleft(b(z, 0xF0), 4).bitwiseOR(b(y, 0xF0)).bitwiseOR(F.shiftright(b(x, 0xF0), 4))
    voxel = F.shiftleft(b(z, 0xF), 8).bitwiseOR(F.shiftleft(b(y, 0xF), 4)).bitwiseOR(b(x, 0xF))
    return F.shiftleft(page, 24).bitwiseOR(F.shiftleft(line, 12)).bitwiseOR(voxel)


def byte_at(data: Column, index: Column) -> Column:
    """Byte `index` (from 0) of a BINARY, 0 to 255; null beyond its end."""
    got = F.substring(data, index.cast("int") + 1, F.lit(1))
    return F.when((index >= 0) & (index < F.octet_length(data)), F.conv(F.hex(got), 16, 10).cast("int"))


def high_byte(v: Column) -> Column:
    """A 16-bit sample as 8 bits."""
    return F.shiftright(v, 8)


def bit_mask(quant: Column | int, shift: Column | int) -> Column:
    """The mask of `quant` high bits (8 if it isn't 1 to 8), shifted right."""
    quant = quant if isinstance(quant, Column) else F.lit(quant)
    shift = shift if isinstance(shift, Column) else F.lit(shift)
    out = F.lit(255)
    for q in range(1, 8):
        out = F.when(quant == q, (0xFF << (8 - q)) & 0xFF).otherwise(out)
    return F.call_function("shiftright", out, shift)


def filters_active(enabled: Column, low: Column, high: Column, quant: Column, shift: Column) -> Column:
    return enabled & ((low > 0) | (high > 0) | (quant < 8) | (shift > 0))


def contrast(v: Column, low: int, high: int) -> Column:
    """Stretches the values between `low` and 255 - `high` to 0..255, in integers."""
    return F.least(F.lit(255), idiv(F.greatest(F.lit(0), v - low) * 255, 255 - (low + high))).cast("int")


def masked(v: Column, mask: Column) -> Column:
    """The masked bits of a value, rescaled to 0..255."""
    return to_u8(v.bitwiseAND(mask).cast("double") / mask.cast("double") * 255.0)


#: The colours of four labels; all other values are blue.
FOUR_COLORS = {1: (255, 0, 0), 2: (0, 255, 0), 3: (255, 255, 0)}


def four_colors(v: Column) -> list[Column]:
    out = []
    for k in range(3):
        c = F.lit((0, 0, 255)[k])
        for value, rgb in FOUR_COLORS.items():
            c = F.when(v == value, rgb[k]).otherwise(c)
        out.append(c)
    return out


def hsb_to_rgb(h: Column, s: Column, b: Column) -> list[Column]:
    """Red, green and blue (0 to 255) of hue (degrees), saturation and brightness."""
    h = h % 360.0
    s, b = (F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) for c in (s, b))
    c = b * s
    x = c * (1.0 - F.abs((h / 60.0) % 2.0 - 1.0))
    sextant, zero = F.floor(h / 60.0), F.lit(0.0)
    table = ((c, x, zero), (x, c, zero), (zero, c, x), (zero, x, c), (x, zero, c))
    out = []
    for k in range(3):
        v = (c, zero, x)[k]
        for i, row in enumerate(table):
            v = F.when(sextant == i, row[k]).otherwise(v)
        out.append(F.floor((v + (b - c)) * 255.0 + 0.5).cast("int"))
    return out


def component_color(component: Column) -> list[Column]:
    """One of 60 colours: 30 hues in two brightnesses."""
    i = component % 60
    return hsb_to_rgb(idiv(i, 2).cast("double") / 30.0 * 360.0, F.lit(1.0), (i % 2).cast("double") / 2.0 + 0.5)


def paint_zoom(zoom: Column) -> Column:
    """World voxels for each pixel: 1 from zoom 1 on, else 1 / zoom rounded up, 32 at most."""
    return F.when(zoom >= 1.0, 1).otherwise(F.least(F.greatest(F.ceil(1.0 / zoom), F.lit(1)), F.lit(32))).cast("int")


def level_of(zoom: Column, most: int = 4) -> Column:
    """The pyramid level of a zoom: the bit length of 1 / zoom cut to an integer."""
    n = F.floor(1.0 / zoom).cast("bigint")
    return F.least(F.when(n <= 0, 0).otherwise(F.length(F.bin(n))), F.lit(most)).cast("int")


def level_of_downsampling(d: Column) -> Column:
    """The trailing zero bits of a downsampling factor: other numbers than powers of two go to a finer level."""
    return (F.length(F.bin(d.bitwiseAND(-d))) - 1).cast("int")


def valid_target(x: Column, y: Column, z: Column) -> Column:
    """Whether views may follow to a place: it lies on no negative coordinate; unknown places are none."""
    return F.coalesce((x >= 0) & (y >= 0) & (z >= 0), F.lit(False))


def align_down(v: Column, step: int) -> Column:
    return idiv(v, step) * step


def align_up(v: Column, step: int) -> Column:
    return idiv(v + (step - 1), step) * step


def tile_path(x: Column, y: Column, z: Column, downsampling: Column, mask: int = 255) -> Column:
    """Where the tile of a key lies below its volume's folder or URL."""
    return F.format_string(f"64-4/d%02d/z%03d/xyz-%03d-%03d-%03d-b{mask:03d}-d%02d.bin", downsampling, z, x, y, z, downsampling)


def scroll_label(is_fragment: Column, num: Column, scroll_id: Column) -> Column:
    return F.concat(F.when(is_fragment, "Fragment ").otherwise("Scroll "), num, F.lit(" - "), scroll_id)


def area_label(area: Column) -> Column:
    """An area to one decimal (ties to even), or an empty string."""
    return F.when(area.isNotNull(), F.format_string("%.1f", F.bround(area, 1))).otherwise("")


def cache_name(url: Column) -> Column:
    """The cache folder of a URL: the SHA-256 of the URL without one slash at its end."""
    return F.sha2(F.regexp_replace(url, "/$", ""), 256)


CROP = r"^(\d+)\+(\d+)-(\d+)x(\d+)$"


def crop_parts(crop: Column) -> list[Column]:
    """left, top, width and height of LEFT+TOP-WIDTHxHEIGHT; null if it isn't one."""
    return [F.when(crop.rlike(CROP), F.regexp_extract(crop, CROP, k)).cast("int") for k in (1, 2, 3, 4)]


def n_blocks(nbytes: Column, blocksize: Column) -> Column:
    return idiv(nbytes + blocksize - 1, blocksize)
