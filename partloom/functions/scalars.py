"""Column builders: tokens, domains, dates, header fields, units, kernels, paths, geometry of intervals and axes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize_token(c: Column) -> Column:
    """Lower-case token of ``a-z0-9_-.``: blanks to ``_``, anything else to ``-``; null, NaN text and blank give ``NA``."""
    t = F.trim(c)
    clean = F.regexp_replace(F.regexp_replace(F.lower(t), r"\s+", "_"), r"[^a-z0-9_\-.]", "-")
    return F.when(c.isNull() | (t == "") | (F.lower(t) == "nan"), "NA").otherwise(clean)


def build_domain(**parts: Column) -> Column:
    """``domain:k=token|k=token`` over the given columns in order; ``domain=unknown`` without any."""
    if not parts:
        return F.lit("domain=unknown")
    return F.concat(F.lit("domain:"), F.concat_ws("|", *[F.concat(F.lit(f"{k}="), sanitize_token(c)) for k, c in parts.items()]))


def _date(y: Column, m: Column, d: Column) -> Column:
    part = lambda c: F.try_to_number(F.nullif(c, F.lit("")), F.lit("9999")).cast("int")
    return F.to_date(F.try_make_timestamp(part(y), part(m), part(d), F.lit(0), F.lit(0), F.lit(0)))


# Dates of this century in a text, tried in this order, with the groups of year, month and day.
_DAY, _MONTH = r"(3[01]|[12]\d|0?[1-9])", r"(1[0-2]|0?[1-9])"
TEXT_DATES = (
    (rf"(20\d{{2}})[-_/.]{_MONTH}[-_/.]{_DAY}", (1, 2, 3)),
    (r"(20\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])", (1, 2, 3)),
    (rf"{_DAY}[-_/.]{_MONTH}[-_/.](20\d{{2}})", (3, 2, 1)),
)


def date_from_text(c: Column) -> Column:
    """First date of this century in a text: year-month-day with ``-_/.``, then ``yyyymmdd``, then day-month-year; what
    cannot be a month or a day is passed over, and where the date found is none (30 February) the next form is tried."""
    return F.coalesce(*[_date(*[F.regexp_extract(c, p, g) for g in groups]) for p, groups in TEXT_DATES])


# Formats of explicit timestamps, in the order they are tried on the text before its first point.
EXPLICIT_FORMATS = ("yyyy-M-d", "yyyy/M/d", "yyyy-M-d H:mm:ss", "yyyy/M/d H:mm:ss", "d-M-yyyy", "d/M/yyyy")
# Formats of the lenient reading (month first), tried after these on the text without weekday, fraction and zone.
LENIENT_FORMATS = (
    "yyyy-M-d'T'H:mm:ss", "yyyy-M-d H:mm:ss", "yyyy/M/d H:mm:ss", "yyyy-M-d'T'H:mm", "yyyy-M-d H:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "d/M/yyyy H:mm", "M-d-yyyy H:mm:ss",
    "d/M/yyyy H:mm:ss", "d-M-yyyy H:mm:ss", "d MMM yyyy H:mm:ss", "d MMM yyyy", "d MMMM yyyy H:mm:ss", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy",
)


def explicit_date(c: Column) -> Column:
    """Date of a timestamp text: by the first fitting format of :data:`EXPLICIT_FORMATS`, else by a lenient reading.

    The lenient reading drops a weekday in front, a fraction and a zone mark behind, and takes the date as written; it
    knows :data:`LENIENT_FORMATS` and the packed forms ``yyyyMMdd`` and ``yyyyMMddTHHmmss``. Other texts give null.
    """
    first = F.regexp_replace(F.trim(F.split(c, r"\.").getItem(0)), r"\s+", " ")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), r"\s+", " "), r"^[A-Za-z]{3,9}, ", ""), r"(?:\.\d+)? ?(?:Z|UTC|GMT|[+-]\d{2}:?\d{2})?$", "")
    read = lambda x, f: F.to_date(F.try_to_timestamp(x, F.lit(f)))
    packed = F.when(t.rlike(r"^\d{8}(T\d{6})?$"), read(F.substring(t, 1, 8), "yyyyMMdd"))
    return F.coalesce(*[read(first, f) for f in EXPLICIT_FORMATS], packed, *[read(t, f) for f in LENIENT_FORMATS])


# Fixed value: the date and time texts of the ISO form, with the groups of date, hour, minute, second, fraction and offset.
ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2})(?::(\d{2})(?::(\d{2})(?:\.(\d{3}|\d{6}))?)?)?([+-]\d{2}:\d{2})?)?$"
PACKED = r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})$"


def iso_time(c: Column) -> tuple[Column, Column]:
    """``(time, aware)`` of an ISO or packed text: in UTC if it has an offset, else as written; null for other texts."""
    t = F.regexp_replace(F.trim(c), PACKED, "$1-$2-$3T$4:$5:$6")
    part = lambda k, empty: F.coalesce(F.nullif(F.regexp_extract(t, ISO, k), F.lit("")), F.lit(empty))
    text = F.concat(part(1, ""), F.lit(" "), part(2, "00"), F.lit(":"), part(3, "00"), F.lit(":"), part(4, "00"), F.lit("."), F.rpad(part(5, "0"), 6, "0"))
    zone = F.regexp_extract(t, ISO, 6)
    minutes = (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1)
    local = F.when(t.rlike(ISO), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")))
    shifted = F.timestamp_micros(F.unix_micros(local) - F.coalesce(minutes, F.lit(0)).cast("long") * 60_000_000)
    return shifted, F.length(zone) > 0


def header_datetime(c: Column) -> Column:
    """ISO text of a header's date and time: with ``+00:00`` where the text had an offset, as written where it had none."""
    time, aware = iso_time(c)
    text = F.regexp_replace(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
    return F.when(time.isNotNull(), F.concat(text, F.when(aware, "+00:00").otherwise("")))


def tolerance_degrees(dot: float) -> float:
    """The angle in degrees at which two unit axes have a product of ``dot``."""
    return math.degrees(math.acos(max(-1.0, min(1.0, dot))))


def dated(stamps: list[Column], path: Column | None = None, release: Column | None = None) -> tuple[Column, Column]:
    """``(date, source)``: the first explicit timestamp, else a date in the path, else the data set's release date."""
    explicit = F.coalesce(*[explicit_date(s) for s in stamps])
    from_path = date_from_text(path) if path is not None else F.lit(None).cast("date")
    released = release if release is not None else F.lit(None).cast("date")
    tag = F.when(explicit.isNotNull(), "explicit").when(from_path.isNotNull(), "path").when(released.isNotNull(), "dataset_map").otherwise("none")
    return F.coalesce(explicit, from_path, released), tag


def step_header(text: Column) -> Column:
    """Struct of the exchange file's header: ``created``, ``authors`` (joined by a bar), ``system``, ``schema``."""
    arg = r"'((?:[^']|'')*)'"
    listed = r"\(([^()]*)\)"
    name = rf"(?is)FILE_NAME\s*\(\s*{arg}\s*,\s*{arg}\s*,\s*{listed}\s*,\s*{listed}\s*,\s*{arg}\s*,\s*{arg}\s*,\s*{arg}"
    authors = F.array_join(F.filter(F.transform(F.split(F.regexp_extract(text, name, 3), ","), lambda a: F.trim(F.regexp_replace(a, "'", ""))), lambda a: a != ""), "|")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.struct(
        blank(F.regexp_extract(text, name, 2)).alias("created"),
        blank(authors).alias("authors"),
        blank(F.regexp_extract(text, name, 6)).alias("system"),
        blank(F.regexp_extract(text, r"(?is)FILE_SCHEMA\s*\(\s*\(\s*'([^']*)'", 1)).alias("schema"),
    )


def infer_unit(text: Column) -> Column:
    """``inch``, ``mm`` or ``m`` by the words in a header; INCH anywhere wins, then MILLI with METRE."""
    t = F.upper(text)
    return F.when(t.contains("INCH"), "inch").when(t.contains("MILLI") & t.contains("METRE"), "mm").when(t.contains("METRE"), "m")


def normalise_unit(c: Column) -> Column:
    """``mm`` or ``in`` for their usual spellings, other texts in lower case, null kept."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("mm", "millimeter", "millimetre", "millimeters", "millimetres"), "mm").when(t.isin("in", "inch", "inches", '"'), "in").otherwise(t)


# Words of an originating system and the geometry kernel behind it, in the order they are tried.
KERNEL_WORDS = {"Parasolid": ("parasolid", "nx", "solidworks"), "ACIS": ("acis", "autocad", "inventor"), "CGM": ("catia", "cgm", "3dexperience", "solidedge")}


def guess_kernel(file_format: Column, system: Column) -> Column:
    """Kernel by format and originating system: BREP is OpenCascade, STEP by :data:`KERNEL_WORDS`, else the format."""
    s = F.lower(F.coalesce(system, F.lit("")))
    out = F.when(file_format == "BREP", "OpenCascade")
    for kernel, words in KERNEL_WORDS.items():
        for w in words:
            out = out.when((file_format == "STEP") & s.contains(w), kernel)
    return out.when(file_format == "STEP", "STEP").otherwise("UNKNOWN")


def path_dataset(path: Column) -> Column:
    """First segment of a path with separators, else ``unknown``."""
    return F.when(path.contains("/"), F.split(path, "/").getItem(0)).otherwise("unknown")


def path_repo(path: Column) -> Column:
    """Second segment of a path, which may be the file name; null without one."""
    return F.try_element_at(F.split(path, "/"), F.lit(2))


def file_format(ext: Column) -> Column:
    e = F.lower(ext)
    return F.when(e.isin(".step", ".stp", ".stpz"), "STEP").when(e.isin(".brep", ".brp"), "BREP").otherwise("UNKNOWN")


def timestamp_source(header: Column, mtime: Column) -> Column:
    return F.when(header.isNotNull() & (F.trim(header) != ""), "header").when(mtime.isNotNull() & (F.trim(mtime) != ""), "mtime").otherwise("none")


def classify_error(message: Column) -> Column:
    m = F.lower(message)
    return (
        F.when(m.isNull(), None)
        .when(m.contains("read") & (m.contains("fail") | m.contains("error")), "read_fail")
        .when(m.contains("timeout") | m.contains("timed out"), "timeout")
        .when(m.contains("no such file") | m.contains("missing"), "missing_file")
        .otherwise("other_error")
    )


def short_md5(c: Column, n: int = 16) -> Column:
    return F.substring(F.md5(c), 1, n)


def flat_name(c: Column) -> Column:
    """An id as a file name: separators become a double underscore."""
    return F.replace(c, F.lit("/"), F.lit("__"))


def interval_iou(h1: Column, h2: Column) -> Column:
    """Overlap over union of ``[0, h1]`` and ``[0, h2]``; negatives count as 0, an empty union gives 0."""
    a, b = F.greatest(h1, F.lit(0.0)), F.greatest(h2, F.lit(0.0))
    return F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(0.0)


def axis_angle(x1: Column, y1: Column, z1: Column, x2: Column, y2: Column, z2: Column) -> Column:
    """Angle in degrees of two vectors; 180 if either is zero."""
    n = F.sqrt(x1 * x1 + y1 * y1 + z1 * z1) * F.sqrt(x2 * x2 + y2 * y2 + z2 * z2)
    c = (x1 * x2 + y1 * y2 + z1 * z2) / F.nullif(n, F.lit(0.0))
    return F.coalesce(F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))), F.lit(180.0))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share, clamped to [0, 1]; (0, 0) for ``n`` = 0."""
    p, m = hits / F.nullif(n, F.lit(0)), F.nullif(n, F.lit(0))
    mid, half, den = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)), 1 + z * z / m
    zero = lambda c: F.when(n > 0, c).otherwise(0.0)
    return zero(F.greatest(F.lit(0.0), (mid - half) / den)), zero(F.least(F.lit(1.0), (mid + half) / den))


def cut_offs(m: Column, train: float, calib: float) -> tuple[Column, Column]:
    """Last train and last calib position of ``m`` ordered units: at least one each, the rest test if any is left."""
    a = F.greatest(F.lit(1), F.floor(m * train)).cast("long")
    b = F.greatest(F.lit(1), F.floor(m * calib)).cast("long")
    full = (m - a - b) < 1
    b2 = F.when(full & (b > 1), b - 1).otherwise(b)
    a2 = F.when(full & (b <= 1) & (a > 1), a - 1).otherwise(a)
    return a2, a2 + b2


def seeded_order(*cols: Column, seed: int = 42) -> Column:
    """A reproducible random order that other engines compute alike: md5 of the seed and the columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))
