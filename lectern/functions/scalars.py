"""Scalar rules on documents, pages and cache entries, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ticks (100 ns) between 0001-01-01 and 1970-01-01, both UTC: a fixed value.
EPOCH_TICKS = 621355968000000000
#: Bytes of a file that its fingerprint reads, and the flag and zoom of recognised layers: fixed values.
HEAD_BYTES = 65536
OCR_FLAGS, OCR_ZOOM = 0x100, 0


def micros_to_ticks(micros: Column) -> Column:
    return micros * 10 + F.lit(EPOCH_TICKS)


def ticks_to_micros(ticks: Column) -> Column:
    """Exact; a tick digit below the microsecond is dropped."""
    since = ticks - F.lit(EPOCH_TICKS)
    return ((since - F.pmod(since, F.lit(10))).cast("decimal(20,0)") / 10).cast("long")


def ts_to_ticks(ts: Column) -> Column:
    return micros_to_ticks(F.unix_micros(ts))


def ticks_to_ts(ticks: Column) -> Column:
    return F.timestamp_micros(ticks_to_micros(ticks))


def fingerprint(content: Column, size: Column, ticks: Column) -> Column:
    """sha256, in hex, of the file's head and ``|size|ticks``."""
    tail = F.encode(F.concat(F.lit("|"), size.cast("string"), F.lit("|"), ticks.cast("string")), "UTF-8")
    return F.sha2(F.concat(F.substring(content, 1, HEAD_BYTES), tail), 256)


def cache_key(fp: Column, page: Column, engine: Column, zoom: Column, flags: Column) -> Column:
    return F.format_string("%s_%d_%d_%d_%d.bin", fp, page, engine, zoom, flags)


def render_flags(annotations: Column, theme: Column) -> Column:
    """Bit 0: annotations are drawn; the theme's ordinal above it."""
    return F.shiftleft(theme.cast("int"), 1).bitwiseOR(annotations.cast("int"))


def zoom_bucket(zoom: Column) -> Column:
    """Zoom in per cent, to the nearest 25; halves go to the even quarter."""
    return F.bround(zoom * 100 / 25).cast("int") * 25


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(height == 0, F.lit(0.0)).otherwise(width / height)


def rotate_size(width: Column, height: Column, quarter_turns: Column) -> tuple[Column, Column]:
    even = quarter_turns % 2 == 0
    return F.when(even, width).otherwise(height), F.when(even, height).otherwise(width)


def pixel_size(points: Column, zoom: Column, most: Column | None = None) -> Column:
    """Pixels at 96 dpi of a length in points, at least 1 and at most ``most``."""
    px = points * zoom * 96 / 72
    if most is not None:
        px = F.least(px, F.coalesce(most.cast("double"), px))
    return F.greatest(F.lit(1), F.bround(px).cast("int"))


def parse_pdf_date(raw: Column) -> Column:
    """The day of a ``D:yyyyMMdd...`` string at midnight; null for anything else."""
    day = F.substring(F.regexp_replace(raw, "^D:", ""), 1, 8)
    return F.when(day.rlike("^[0-9]{8}$"), F.try_to_timestamp(day, F.lit("yyyyMMdd")))


def non_blank(value: Column) -> Column:
    """The value as it stands, or null if it is blank."""
    return F.when(F.trim(F.regexp_replace(value, r"\s", " ")) != "", value)


def normalize_metadata(title: Column, author: Column, subject: Column) -> Column:
    return F.struct(non_blank(title).alias("title"), non_blank(author).alias("author"), non_blank(subject).alias("subject"), F.create_map().cast("map<string,string>").alias("custom"))


#: What a path in its normal form doesn't hold; most paths need no fold.
_NOT_NORMAL = r"\\|//|(?:^|/)\.\.?(?:/|$)"


def normal_path(path: Column) -> Column:
    """A path with `/` for `\\`, without `.` and doubled slashes, and with `..` carried out (beyond the root it does
    nothing, at the start of a relative path it stays); null if blank. Its case and a slash at its end are kept.
    What is left of a relative path that leads nowhere is `.`."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.split(slashed, "/", -1)

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        top = last.isNull() | (last == "..") | last.endswith(":")
        up = F.when(last == "", done).when(top, F.concat(done, F.array(x))).otherwise(F.slice(done, F.lit(1), F.size(done) - 1))
        # an empty part counts at the very start and after a scheme (http://)
        empty = F.when((F.size(done) == 0) | F.coalesce(last.endswith(":"), F.lit(False)), F.concat(done, F.array(x))).otherwise(done)
        return F.when(x == "", empty).when(x == ".", done).when(x == "..", up).otherwise(F.concat(done, F.array(x)))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    # an array of one, so that the fold is carried out once a path
    whole = F.transform(F.array(joined), lambda j: F.when(j == "", F.when(slashed.startswith("/"), "/").otherwise(".")).when(slashed.endswith("/") & ~j.endswith("/"), F.concat(j, F.lit("/"))).otherwise(j))
    return F.when(non_blank(path).isNotNull(), F.when(path.rlike(_NOT_NORMAL), whole[0]).otherwise(path))


def path_key(path: Column) -> Column:
    """Identity of a path: its normal form in any case; null if blank."""
    return F.lower(normal_path(path))


def merge_form_values(old: Column, new: Column) -> Column:
    """Form values of a document after an import: new ones replace old ones of the same name."""
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(new, k))
    return F.when(new.isNull(), old).otherwise(F.map_concat(kept, new))
