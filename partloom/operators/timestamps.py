"""Problem 4: timestamps of mixed formats, precisions and zones as one UTC instant.

Method: every text is reduced to a character-class shape mask; each distinct mask is mapped to a parser once; the fields
of all texts of a mask are converted together through zone transition tables that carry the version of the zone data.
"""

from __future__ import annotations

import functools
import importlib
import re
from datetime import UTC, datetime, timedelta
from pathlib import Path
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.session import table

# Month names (English, German, Spanish), longer forms; three-letter forms follow from them.
MONTHS = (
    "january february march april may june july august september october november december",
    "januar februar märz april mai juni juli august september oktober november dezember",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
)
# Usual zone abbreviations and their minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "KST": 540, "HKT": 480, "SGT": 480, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

_CLASSES = {**{ord(c): "9" for c in "0123456789"}, ord("−"): "-", ord("–"): "-"}


def _month_numbers() -> dict[str, int]:
    out: dict[str, int] = {}
    for names in MONTHS:
        for k, name in enumerate(names.split(), 1):
            out[name] = k
            out.setdefault(name[:3], k)
    return out | {"sept": 9, "mrz": 3}


_MONTH = _month_numbers()
_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"\s+")


def shape_mask(text: str) -> str:
    """Digits as ``9``, runs of letters as ``a``, runs of blanks as one blank, all other characters as they are."""
    return _GAP.sub(" ", _WORD.sub("a", text.translate(_CLASSES)))


_TIME = r"(?P<h>9{1,2}):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9{1,9}))?)?"
_ZONE = r"(?: ?(?P<z>[-+]9{2}(?::?9{2})?|a(?:[/_\-+]a|[/_\-+]9+)*))?(?P<zn>\[a(?:[/_\-+]a|[/_\-+]9+)*\])?"
_CLOCK = rf"{_TIME}(?: ?(?P<w1>a))?{_ZONE}"
#: Layouts over masks, first fit. Groups: y m d numbers; a b first and second of a year-last date; mon a month name;
#: w words without meaning; w1 am/pm, clock word or zone; n bare number; j wrapped milliseconds.
LAYOUTS = [re.compile(f"{p}$") for p in (
    rf"(?P<y>9999)[-/.](?P<m>9{{1,2}})[-/.](?P<d>9{{1,2}})(?:(?: ?,? |(?P<t>a)){_CLOCK})?",
    r"(?P<n>-?9{9,18}(?:\.9+)?)",
    rf"(?P<y>9999)(?P<m>99)(?P<d>99)(?:(?:(?P<t>a)| )(?P<h>99)(?P<mi>99)(?:(?P<s>99)(?:[.,](?P<f>9{{1,9}}))?)?{_ZONE})?",
    r"/(?P<w>a)\((?P<j>-?9+)(?:[-+]9999)?\)/",
    rf"(?P<a>9{{1,2}})[-/.](?P<b>9{{1,2}})[-/.](?P<y>9999|99)(?:,? {_CLOCK})?",
    rf"(?:(?P<wd>a)\.?,? )?(?P<d>9{{1,2}})\.?[ -](?:(?P<w>a) )?(?P<mon>a)\.?[ -](?:(?P<w2>a) )?(?P<y>9999),?(?: {_CLOCK})?",
    rf"(?:(?P<wd>a),? )?(?P<mon>a)\.? (?P<d>9{{1,2}}),? (?P<y>9999),?(?: {_CLOCK})?",
    rf"(?P<wd>a) (?P<mon>a) (?P<d>9{{1,2}}) {_TIME}(?: (?P<z>a|[-+]9{{2}}:?9{{2}}))? (?P<y>9999)",
)]


@functools.lru_cache(maxsize=100_000)
def parser_for(mask: str) -> tuple[tuple[str, int, int], ...] | None:
    """``(field, start, end)`` per field of the mask's layout as positions in mask tokens, or None if no layout fits.

    Words and blanks have one token in the mask however long they are in the text, so positions count tokens.
    """
    for layout in LAYOUTS:
        if m := layout.match(mask):
            return tuple((k, *m.span(k)) for k, v in m.groupdict().items() if v is not None)
    return None


_TOKEN = re.compile(r"[^\W\d_]+|\s+|.", re.DOTALL)


# --- zones -------------------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=1)
def zone_version() -> str:
    """Version of the zone data that the transition tables come from."""
    try:
        return importlib.import_module("tzdata").IANA_VERSION
    except ImportError:
        for p in (Path("/usr/share/zoneinfo/+VERSION"), Path("/usr/share/zoneinfo/tzdata.zi")):
            if p.exists():
                return p.read_text(errors="replace")[:40].split("\n")[0].lstrip("# version").strip()
    return "system"


@functools.lru_cache(maxsize=2_000)
def transitions(zone: str) -> tuple[np.ndarray, np.ndarray] | None:
    """``(instants, offsets)`` in seconds: ``offsets[i]`` holds from ``instants[i - 1]`` on; None for an unknown zone.

    Found once per zone by halving between weekly probes of the public zone data, 1880 to 2100.
    """
    try:
        z = ZoneInfo(zone)
    except (KeyError, ValueError, OSError):
        return None
    zero = datetime(1970, 1, 1, tzinfo=UTC)
    off = lambda t: int((zero + timedelta(seconds=t)).astimezone(z).utcoffset().total_seconds())
    lo, hi, week = -2_840_140_800, 4_102_444_800, 7 * 86_400
    at, offs = [], [off(lo)]
    for t in range(lo, hi, week):
        a, b = t, t + week
        while off(b) != offs[-1]:
            x, y = a, b
            while y - x > 1:
                mid = (x + y) // 2
                x, y = (mid, y) if off(mid) == offs[-1] else (x, mid)
            at.append(y)
            offs.append(off(y))
            a = y
    return np.array(at, np.int64), np.array(offs, np.int64)


def local_to_utc(local: np.ndarray, zone: str) -> tuple[np.ndarray, np.ndarray]:
    """``(utc, instants)``: seconds since 1970 of local times, and how many instants each could be (0 skipped, 2 twice)."""
    found = transitions(zone)
    if found is None:
        return local, np.full(len(local), -1)
    at, offs = found
    first, last = np.searchsorted(at, local - 93_600, "right"), np.searchsorted(at, local + 93_600, "right")
    utc, n = np.zeros_like(local), np.zeros(len(local), np.int64)
    for step in range(int((last - first).max(initial=0)) + 1):
        k = np.minimum(first + step, last)
        u = local - offs[k]
        holds = (first + step <= last) & (np.searchsorted(at, u, "right") == k)
        utc, n = np.where(holds, u, utc), n + holds
    return utc, n


# --- conversion ----------------------------------------------------------------------------------------------------

def _number(values: list[str], fill: int) -> np.ndarray:
    return np.array([int(v) if v else fill for v in values], np.int64)


def _fields(texts: list[str], spans) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {k: [] for k, _, _ in spans}
    for t in texts:
        tok = _TOKEN.findall(t)
        for k, a, b in spans:
            out[k].append("".join(tok[a:b]))
    return out


def _convert(texts: list[str], spans, zones: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds and status of texts of one mask, all at once."""
    n = len(texts)
    g = _fields(texts, spans)
    status = np.full(n, "ok", object)
    if "j" in g:
        good = np.array([w == "Date" for w in g["w"]])
        return np.array([int(v) for v in g["j"]], np.int64) * 1000, np.where(good, "ok", "none")
    if "n" in g:
        whole = [v.partition(".")[0] for v in g["n"]]
        digits = len(whole[0].lstrip("-"))
        scale = 1_000_000 if digits <= 11 else 1000 if digits <= 14 else 1
        extra = np.zeros(n, np.int64)
        if "." in g["n"][0]:
            cut = {1_000_000: 6, 1000: 3, 1: 0}[scale]
            extra = _number([(v.partition(".")[2] + "000000")[:cut] for v in g["n"]], 0)
            extra = np.where([v.startswith("-") for v in g["n"]], -extra, extra)
        if digits > 17:
            status[:] = "none"
        return np.array([int(v) for v in whole], np.int64) * scale + extra, status

    year = _number(g["y"], 0)
    if len(g["y"][0]) == 2:
        year = year + 2000
    if "a" in g:
        a, b = _number(g["a"], 0), _number(g["b"], 0)
        month, day = np.where(orders == "mdy", a, b), np.where(orders == "mdy", b, a)
        status[~np.isin(orders, ["dmy", "mdy"])] = "order"
    elif "mon" in g:
        month, day = np.array([_MONTH.get(w.lower(), 0) for w in g["mon"]], np.int64), _number(g["d"], 0)
    else:
        month, day = _number(g["m"], 0), _number(g["d"], 0)
    zero = [""] * n
    hour, minute, second = (_number(g.get(k, zero), 0) for k in ("h", "mi", "s"))
    micro = _number([(v + "000000")[:6] if v else "" for v in g.get("f", zero)], 0)

    # the word after a time is am/pm, a word for "o'clock", or a zone
    zone_text = list(g.get("z", zero))
    if "w1" in g:
        word = [w.lower() for w in g["w1"]]
        half = np.array([{"am": 0, "pm": 12}.get(w, -1) for w in word])
        wrong = (half >= 0) & ((hour < 1) | (hour > 12))
        hour = np.where(half >= 0, hour % 12 + half, hour)
        status[wrong] = "impossible"
        zone_text = [z or (g["w1"][i] if half[i] < 0 and word[i] not in ("uhr", "h", "hrs") else "") for i, z in enumerate(zone_text)]
    if "t" in g:
        status[[t not in ("T", "t") for t in g["t"]]] = "none"

    fine = (month >= 1) & (month <= 12) & (day >= 1) & (day <= 31) & (hour <= 23) & (minute <= 59) & (second <= 59) & (year >= 1)
    m0 = (np.where(fine, year, 1970) - 1970) * 12 + np.where(fine, month, 1) - 1
    date = m0.astype("datetime64[M]").astype("datetime64[D]") + np.where(fine, day - 1, 0)
    fine &= date.astype("datetime64[M]").astype(np.int64) == m0
    status[~fine & (status == "ok")] = "impossible"
    local = date.astype(np.int64) * 86_400 + hour * 3600 + minute * 60 + second

    # what fixes the zone: an offset or abbreviation in the text, a zone name in the text, the zone of the source
    offset, name = np.zeros(n, np.int64), np.array(zones, object)
    fixed = np.zeros(n, bool)
    for i, z in enumerate(zone_text):
        z = z.strip()
        if not z:
            continue
        if z[0] in "+-−–":
            hh, mm = int(z[1:3]), int(z[-2:]) if len(z) > 3 else 0
            offset[i], fixed[i] = (hh * 60 + mm) * (1 if z[0] == "+" else -1), True
            if hh > 18 or mm > 59:
                status[i] = "impossible"
        elif z.upper() in ABBREVIATIONS:
            offset[i], fixed[i] = ABBREVIATIONS[z.upper()], True
            if z.upper() == "CST" and zones[i] == "Asia/Shanghai":
                offset[i] = 480
        else:
            name[i] = z
    for i, z in enumerate(g.get("zn", zero)):
        if z and not fixed[i]:
            name[i] = z[1:-1]
    utc = local - offset * 60
    for zone in {z for z in name[~fixed] if z is not None}:
        at = np.flatnonzero(~fixed & (name == zone))
        utc[at], count = local_to_utc(local[at], zone)
        for word, k in (("skipped", 0), ("twice", 2), ("zone", -1)):
            status[at[(count == k) & (status[at] == "ok")]] = word
    status[~fixed & np.equal(name, None) & (status == "ok")] = "zone"
    return utc * 1_000_000 + micro, status


def to_utc_frame(text: pd.Series, zone: pd.Series, order: pd.Series) -> pd.DataFrame:
    """``utc_us``, ``status`` and ``tz_version`` of each text; see :func:`to_utc`."""
    out = pd.DataFrame({"utc_us": pd.array([pd.NA] * len(text), "Int64"), "status": "none", "tz_version": zone_version()})
    values = text.astype(object).where(text.notna(), "").map(str.strip).to_numpy(object)
    zones = zone.astype(object).where(zone.notna(), None).to_numpy(object)
    orders = order.astype(object).where(order.notna(), "").map(str.lower).to_numpy(object)
    codes, masks = pd.factorize(np.array([shape_mask(v) for v in values], object))
    micros, status = np.zeros(len(values), np.int64), np.full(len(values), "none", object)
    by_mask = np.split(np.argsort(codes, kind="stable"), np.cumsum(np.bincount(codes, minlength=len(masks)))[:-1]) if len(values) else []
    for mask, at in zip(masks, by_mask, strict=True):
        if spans := parser_for(mask):
            micros[at], status[at] = _convert(list(values[at]), spans, zones[at], orders[at])
    out["status"] = status
    out["utc_us"] = pd.array(micros, "Int64")
    out.loc[status != "ok", "utc_us"] = pd.NA
    return out


def to_utc(text: Column, zone: Column, order: Column) -> Column:
    """Struct ``(utc_us, status, tz_version)`` of a timestamp text, the zone of its source and its day-month order.

    ``utc_us`` is set only where the text fixes exactly one instant; ``tz_version`` is the version of the zone data of the
    executor that read it. ``status`` says why not: ``none`` (null, blank, or no known layout), ``order`` (year-last numbers without a known order), ``impossible`` (no such
    date or time), ``skipped`` and ``twice`` (a local time its zone leaves out or repeats), ``zone`` (no zone known).
    """
    convert = F.pandas_udf(to_utc_frame, "utc_us long, status string, tz_version string")
    return convert(text.cast("string"), zone.cast("string"), order.cast("string"))


def normalise(df: DataFrame, text: str, source: str, sites: DataFrame, sites_key: str = "source_dataset") -> DataFrame:
    """``df`` with a struct ``instant`` (``utc_us``, ``status``, ``tz_version``) for the text column; other columns stay,
    a column already named ``instant`` is replaced. Rows whose source is null or not among the sites have no zone."""
    site = sites.select(F.col(sites_key).alias("_site"), F.col("tz_name").alias("_tz"), F.col("date_order").alias("_order")).filter(F.col("_site").isNotNull()).dropDuplicates(["_site"])
    joined = df.join(site, df[source] == F.col("_site"), "left").withColumn("instant", to_utc(F.col(text), F.col("_tz"), F.col("_order")))
    return joined.drop("_site", "_tz", "_order")


def _fields_of(spark, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "source_sites")
    metas = table(spark, sf_dir, "metas").select("part_id", F.lit("created_at_header").alias("field"), F.col("created_at_header").alias("text"), F.col("src").alias("source"))
    index = table(spark, sf_dir, "part_index_for_split").select("part_id", F.lit("timestamp").alias("field"), F.col("timestamp").alias("text"), F.col("source_dataset").alias("source"))
    return normalise(metas.unionByName(index), "text", "source", sites)


def p4_found(spark, sf_dir: str) -> DataFrame:
    found = _fields_of(spark, sf_dir).select("part_id", "field", F.col("instant.utc_us").alias("utc_us"))
    return found.filter(F.col("part_id").isNotNull() & F.col("utc_us").isNotNull()).distinct()


def p4_status(spark, sf_dir: str) -> DataFrame:
    """How many values of each field and source fix an instant, and why the others do not."""
    rows = _fields_of(spark, sf_dir)
    return rows.groupBy("field", "source", F.col("instant.status").alias("status"), F.col("instant.tz_version").alias("tz_version")).agg(F.count("*").alias("n_values"))
