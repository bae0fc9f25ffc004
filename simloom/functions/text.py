"""Column expressions over ids, addresses and sizes of images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def image_path(uid: Column) -> Column:
    """Path of a stored image: first character / second character / rest.jpg."""
    return F.concat(F.substring(uid, 1, 1), F.lit("/"), F.substring(uid, 2, 1), F.lit("/"), F.substr(uid, F.lit(3)), F.lit(".jpg"))


def without_scheme(url: Column) -> Column:
    """A URL after ``scheme://``."""
    return F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")


def unquoted(text: Column) -> Column:
    """Percent codes decoded; a plus sign stays one."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def url_safe_base64(text: Column) -> Column:
    """Bytes of URL-safe base64."""
    return F.unbase64(F.translate(text, "-_", "+/"))


def file_stem(path: Column) -> Column:
    """Name of a file without folders and last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def source_kind(text: Column, kinds: list[tuple[str, str]]) -> Column:
    """The kind of the first mark that the text holds; a text without any is an error."""
    out = None
    for mark, kind in kinds:
        out = F.when(text.contains(mark), kind) if out is None else out.when(text.contains(mark), kind)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown source: "), F.coalesce(text, F.lit("null")))))


def fitted_size(width: Column, height: Column, longest: int, enlarge: bool = True) -> Column:
    """(width, height) with the longest side at ``longest``; other side cut to an integer. A square counts as upright."""
    top = F.lit(longest)
    wide = width > height
    fitted = F.struct(
        F.when(wide, top).otherwise((width * longest / height).cast("int")).alias("width"),
        F.when(wide, (height * longest / width).cast("int")).otherwise(top).alias("height"),
    )
    if enlarge:
        return fitted
    same = F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))
    return F.when(F.greatest(width, height) <= longest, same).otherwise(fitted)


def stepped_size(height: Column, width: Column, longest: int, step: int) -> Column:
    """(height, width, pad_height, pad_width): scaled so that the longest side is ``longest``, sides rounded half to even to multiples of ``step``, at least one step."""
    ratio = longest / F.greatest(height, width)

    def side(x: Column) -> Column:
        return F.greatest(F.lit(step), (F.bround(x * ratio / step) * step).cast("int"))

    return F.struct(side(height).alias("height"), side(width).alias("width"), (longest - side(height)).alias("pad_height"), (longest - side(width)).alias("pad_width"))


def grid_side(side: Column, input_side: Column, map_side: Column) -> Column:
    """Cells of a feature map that a side of an image covers."""
    return F.bround(side / (input_side / map_side)).cast("int")


def pyramid_size(sizes: Column, width: Column, height: Column, wanted: int = 1024) -> Column:
    """Size to ask an image server for: the least listed width with both sides over ``wanted``; else ``full`` if both are under, else the longer side at ``wanted``."""
    large = F.filter(sizes, lambda s: (s["width"] > wanted) & (s["height"] > wanted))
    least = F.array_min(F.transform(large, lambda s: s["width"]))
    other = F.when((width < wanted) & (height < wanted), "full").when(width > height, f"{wanted},").otherwise(f",{wanted}")
    return F.when(least.isNotNull(), F.concat(least.cast("string"), F.lit(","))).otherwise(other)


def aspect_ok(width: Column, height: Column, low: float = 0.11, high: float = 9.0) -> Column:
    """Whether the ratio of the sides lies strictly between two bounds."""
    ratio = width / height
    return F.coalesce((ratio > low) & (ratio < high), F.lit(False))
