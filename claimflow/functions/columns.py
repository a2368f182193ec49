"""Column expressions of the location-claim domain: paths, times, lists, regions, similarity.

All are JVM-side built-ins, so they stay inside whole-stage code generation
where Spark allows it. A value that does not parse gives null (or an empty
list), never an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sentinel of an unknown signal strength, the largest usable cell id, the floor of a missing cell.
INVALID_RSSI = 2147483647
LARGEST_CELL_ID = 10000
MISSING_RSSI = -110.0
REGION_ROWS = "abcdef"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it: inside higher-order functions an expression is worked out again for each item."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- paths ------------------------------------------------------------------


def slashes(path: Column | str) -> Column:
    return F.regexp_replace(F.trim(_c(path)), r"\\", "/")


def file_name(path: Column | str) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(slashes(path), "/"), -1)


def folder_name(path: Column | str) -> Column:
    """The last but one part; null where there is none."""
    parts = F.split(slashes(path), "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2))


def stem(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), r"(?i)\.csv$", "")


def merged_name(name: Column | str) -> Column:
    """``x``, ``x.csv`` and ``x_merged.csv`` all give ``x_merged.csv``."""
    return F.concat(F.regexp_replace(stem(name), r"_merged$", ""), F.lit("_merged.csv"))


def merged_path(path: Column | str) -> Column:
    """``folder/stem_merged.csv`` of a claim path; null where there is no folder."""
    return F.concat(folder_name(path), F.lit("/"), merged_name(file_name(path)))


def sample_key(path: Column | str) -> Column:
    """Folder and bare stem: traces of different folders stay apart."""
    bare = F.regexp_replace(stem(file_name(path)), r"_merged$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^sensor_claim_\d+_", ""), "sensor_", "")
    return F.concat_ws("/", folder_name(path), bare)


def file_kind(name: Column | str) -> Column:
    low = F.lower(_c(name))
    return F.when(low.startswith("sensor"), "sensor").when(low.startswith("signal"), "signal")


def paired_name(name: Column | str) -> Column:
    """The signal file that goes with a sensor file."""
    return F.regexp_replace(_c(name), "sensor", "signal")


def feature_id(name: Column | str) -> Column:
    return F.regexp_extract(_c(name), r"anchor_feature_(\d+)\.csv$", 1).try_cast("int")


# -- times ------------------------------------------------------------------


def time_of_day_ms(text: Column | str) -> Column:
    """Milliseconds since midnight of ``HH:MM:SS:mmm``; anything else, or a field out of range, is null."""
    part = lambda i: F.regexp_extract(_c(text), r"^(\d{2}):(\d{2}):(\d{2}):(\d{3})$", i).try_cast("bigint")
    h, m, s, ms = (part(i) for i in range(1, 5))
    return F.when((h < 24) & (m < 60) & (s < 60), ((h * 60 + m) * 60 + s) * 1000 + ms)


def elapsed_seconds(text: Column | str) -> Column:
    """Seconds of ``HH:MM:SS``."""
    part = lambda i: F.regexp_extract(_c(text), r"^(\d+):(\d+):(\d+)$", i).try_cast("bigint")
    return part(1) * 3600 + part(2) * 60 + part(3)


def elapsed_text(seconds: Column | str) -> Column:
    """``HH:MM:SS`` of rounded seconds, at least 0."""
    s = F.greatest(F.round(_c(seconds)).cast("bigint"), F.lit(0))
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("bigint"), ((s % 3600) / 60).cast("bigint"), s % 60)


def clock_duration(first_ms: Column | str, last_ms: Column | str) -> Column:
    """Seconds between two times of day; an end before the start is on the next day."""
    return F.round(F.pmod(_c(last_ms) - _c(first_ms), F.lit(86_400_000)) / 1000.0, 3)


def between_clock(ms: Column, start: Column, end: Column) -> Column:
    """Inside a window of the day that may pass midnight."""
    return F.when(start <= end, ms.between(start, end)).otherwise((ms >= start) | (ms <= end))


# -- lists ------------------------------------------------------------------


def string_list(text: Column | str) -> Column:
    """A list literal; what does not parse is an empty list."""
    return F.coalesce(F.from_json(_c(text), "array<string>"), F.array().cast("array<string>"))


def int_list(text: Column | str) -> Column:
    """A list of integers without its nulls; what does not parse is an empty list."""
    return F.filter(F.coalesce(F.from_json(_c(text), "array<int>"), F.array().cast("array<int>")), lambda x: x.isNotNull())


def scan_cells(types: Column | str, ids: Column | str, rssi: Column | str) -> Column:
    """Cells of one scan from three parallel lists, cut to the shortest: LTE cells with a known strength."""
    t, i, r = F.from_json(_c(types), "array<string>"), F.from_json(_c(ids), "array<int>"), F.from_json(_c(rssi), "array<int>")
    blank = F.from_json(F.lit("[]"), "array<struct<type:string,id:int,rssi:int>>")

    def cells(x: Column) -> Column:
        n = F.least(F.size(x["t"]), F.size(x["i"]), F.size(x["r"]))
        zipped = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.lower(F.get(x["t"], k)).alias("type"), F.get(x["i"], k).alias("id"), F.get(x["r"], k).alias("rssi")))
        kept = F.filter(zipped, lambda x: (x["type"] == "lte") & (x["rssi"].isNull() | (x["rssi"] != INVALID_RSSI)))
        return F.when(n > 0, kept).otherwise(blank)

    return bound(F.struct(t.alias("t"), i.alias("i"), r.alias("r")), cells)


def small_ids(cells: Column | str) -> Column:
    return F.filter(_c(cells), lambda x: x["id"] <= LARGEST_CELL_ID)


def fit_length(values: Column | str, n: int, front: bool = False) -> Column:
    """A list cut or filled with nulls to ``n`` items; ``front`` fills before the values."""
    v = _c(values)
    blank = F.array_repeat(F.lit(None), n)
    if front:
        return F.slice(F.concat(F.slice(blank, F.lit(1), F.greatest(F.lit(n) - F.size(v), F.lit(0))), F.slice(v, 1, n)), 1, n)
    return F.slice(F.concat(v, blank), 1, n)


def zero_missing_ids(ids: Column | str, rssi: Column | str) -> Column:
    """An id whose strength is missing counts as 0."""
    return F.zip_with(_c(ids), _c(rssi), lambda i, r: F.when(r.isNull(), F.lit(0)).otherwise(i))


def last_wins(keys: Column, values: Column) -> Column:
    """A map from two parallel lists in which the last of equal keys wins, whatever the session does with equal keys."""

    def built(x: Column) -> Column:
        return bound(F.array_distinct(x["k"]), lambda d: F.map_from_arrays(d, F.transform(d, lambda k: F.get(x["v"], (F.array_position(x["k"], k) - 1).cast("int")))))

    return bound(F.struct(F.reverse(keys).alias("k"), F.reverse(values).alias("v")), built)


def resampled(values: Column | str, n: int) -> Column:
    """``n`` points of a list by linear interpolation, both ends kept."""
    v = _c(values)

    def point(k: Column) -> Column:
        at = k * (F.size(v) - 1) / F.lit(max(n - 1, 1))
        low = F.floor(at).cast("int")
        a = F.element_at(v, low + 1)
        b = F.element_at(v, F.least(low + 2, F.size(v)))
        return a + (b - a) * (at - low)

    return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point))


# -- positions and regions ----------------------------------------------------


def position(text: Column | str, least_width: int | None = None, strict: bool = True) -> Column:
    """``(start,end)`` as a struct. Strict: end beyond start; with ``least_width`` also start from 0 on and that wide."""
    start = F.regexp_extract(_c(text), r"\(\s*(-?\d+)\s*,\s*(-?\d+)\s*\)", 1).try_cast("int")
    end = F.regexp_extract(_c(text), r"\(\s*(-?\d+)\s*,\s*(-?\d+)\s*\)", 2).try_cast("int")
    ok = start.isNotNull() & end.isNotNull()
    if strict:
        ok = ok & (end > start)
    if least_width is not None:
        ok = ok & (start >= 0) & (end - start >= least_width)
    return F.when(ok, F.struct(start.alias("start"), end.alias("end")))


def clipped(pos: Column, n: Column) -> Column:
    """A position inside a trace of ``n`` rows; null where nothing is left."""
    start, end = F.greatest(pos["start"], F.lit(0)), F.least(pos["end"], n.cast("int"))
    return F.when(pos.isNotNull() & (end > start), F.struct(start.alias("start"), end.alias("end")))


def region_list(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(_c(text), ","), lambda x: F.trim(x)), lambda x: x != "")


def region_set(text: Column | str) -> Column:
    """Distinct regions of a list literal or of text split at commas, semicolons, their wide forms, or spaces."""
    parts = F.coalesce(F.from_json(_c(text), "array<string>"), F.split(_c(text), r"[,;，、\s]+"))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def grid_cell(region: Column | str) -> Column:
    """Row and column of a region such as ``c4``; null for any other text."""
    low = F.lower(F.trim(_c(region)))
    ok = low.rlike("^[a-f][1-6]$")
    return F.when(ok, F.struct((F.ascii(low) - 97).cast("int").alias("r"), (F.substring(low, 2, 1).try_cast("int") - 1).alias("c")))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared of all; two empty sets are equal."""
    both, either = F.size(F.array_intersect(_c(a), _c(b))), F.size(F.array_union(_c(a), _c(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def _lcs(left: Column, right: Column, same) -> Column:
    """Length of the longest common subsequence: one row of the table for each item of ``left``."""
    blank = F.transform(F.concat(F.array(F.lit(0)), F.transform(right, lambda _: F.lit(0))), lambda x: x)

    def row(before: Column, x: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            best = F.when(same(x, F.element_at(right, j)), F.element_at(before, j) + 1).otherwise(F.greatest(F.element_at(before, j + 1), F.element_at(done, -1)))
            return F.concat(done, F.array(best))

        return F.when(F.size(right) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(right), F.lit(1))), F.array(F.lit(0)), cell)).otherwise(before)

    return F.element_at(F.aggregate(left, blank, row), -1)


def lcs_ratio(a: Column | str, b: Column | str) -> Column:
    """Longest common subsequence over the longer list; two empty lists are equal."""
    a, b = _c(a), _c(b)
    n = F.greatest(F.size(a), F.size(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(_lcs(a, b, lambda x, y: x == y) / n)


def marked(items: Column | str) -> Column:
    """A list (items, n) with a word of bits for each of its items (masks: the places where it stands) and one for all places, for :func:`marked_ratio`; longer ones than a word have none."""
    v = _c(items)
    n = F.size(v)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))
    known = F.array_distinct(F.filter(v, lambda x: x.isNotNull()))
    places = lambda x: F.aggregate(F.transform(v, lambda y, i: F.when(x == y, bit(i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    return F.struct(v.alias("items"), n.alias("n"), F.when(n <= 60, F.map_from_arrays(known, F.transform(known, places))).alias("masks"), F.when(n <= 60, bit(n) - 1).alias("whole"))


def marked_ratio(a: Column | str, b: Column) -> Column:
    """:func:`lcs_ratio` with a list that is :func:`marked`: a step takes one item of ``a`` and all of ``b`` at once."""
    a, zero = _c(a), F.lit(0).cast("bigint")
    masks = F.transform(a, lambda x: F.coalesce(F.try_element_at(b["masks"], x), zero))
    # A bit that is still set is a place of b that no common subsequence has used.
    left = F.aggregate(masks, b["whole"], lambda v, m: (v + v.bitwiseAND(m)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(b["whole"]))
    n = F.greatest(F.size(a), b["n"])
    short = F.when(n == 0, F.lit(1.0)).otherwise((b["n"] - F.bit_count(left)) / n)
    return F.when(b["whole"].isNotNull(), short).otherwise(lcs_ratio(a, b["items"]))


def lcs_candidates(claimed: Column | str, detected: Column | str) -> Column:
    """As :func:`lcs_ratio`, each detected place being a list of regions that would do."""
    a, b = _c(claimed), _c(detected)
    n = F.greatest(F.size(a), F.size(b))
    return F.when(n == 0, F.lit(0.0)).otherwise(_lcs(a, b, lambda x, y: F.array_contains(y, x)) / n)


def region_jumps(cells: Column | str) -> Column:
    """Grid steps between consecutive cells (null where one is unknown)."""
    v = _c(cells)
    pairs = F.zip_with(F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), lambda a, b: F.abs(a["r"] - b["r"]) + F.abs(a["c"] - b["c"]))
    return F.when(F.size(v) > 1, pairs).otherwise(F.array().cast("array<int>"))


def jump_penalty(jump: Column) -> Column:
    return F.when(jump <= 1, F.lit(0.0)).when(jump == 2, F.lit(0.25)).otherwise(F.least(F.lit(1.0), 0.25 + 0.25 * (jump - 2)))


def array_mean(values: Column, empty: float = 0.0) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(F.lit(empty))


def route_score(cells: Column | str) -> Column:
    """1 less the mean jump penalty, scaled down by half the share of unknown regions."""

    def score(v: Column, known: Column) -> Column:
        bad = F.when(F.size(v) > 0, (F.size(v) - F.size(known)) / F.size(v)).otherwise(1.0)
        return F.greatest(F.lit(0.0), (1 - bound(F.transform(region_jumps(known), jump_penalty), array_mean)) * (1 - 0.5 * bad))

    return bound(_c(cells), lambda v: bound(F.filter(v, lambda x: x.isNotNull()), lambda known: score(v, known)))


# -- numbers ------------------------------------------------------------------


def floored_mod(a: Column | str, b: float) -> Column:
    """``a`` less ``b`` times the floor of their quotient, step by step as SQL's fmod: a remainder below zero is lifted, and one of a few last bits is rounded with it."""
    a = _c(a)
    q = a / F.lit(b)
    # A bigint holds no quotient beyond its range, and no negative zero.
    return a - F.lit(b) * F.when((F.abs(q) < 2.0**53) & (q != 0), F.floor(q).cast("double")).otherwise(q)


def rounded(x: Column | str, n: int) -> Column:
    """Rounded to ``n`` places; what is below zero keeps its sign where it becomes 0, as in SQL."""
    x = _c(x)
    r = F.round(x, n)
    return F.when((r == 0) & (x < 0), F.lit(-0.0)).otherwise(r)


def wrap180(degrees: Column | str) -> Column:
    """From -180 up to 180: a turn that is 180 but for its last bits is -180 from both sides, as adding 360 rounds these away."""
    return floored_mod(floored_mod(_c(degrees) + 180.0, 360.0) + 360.0, 360.0) - 180.0


def circular_difference(a: Column | str, b: Column | str) -> Column:
    return F.abs(wrap180(_c(a) - _c(b)))


def circular_mean(degrees: Column | str) -> Column:
    """An aggregate: the mean direction from 0 to 360."""
    r = F.radians(_c(degrees))
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))), F.lit(360.0))


def unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def relative_score(a: Column | str, b: Column | str) -> Column:
    """1 less the difference over the larger magnitude, between 0 and 1: how well two durations or lengths agree."""
    a, b = _c(a), _c(b)
    return unit(1 - F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9)))


def similarity(distance: Column | str) -> Column:
    d = _c(distance)
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(0.0)).otherwise(1 / (1 + d))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def topology_break(distance: Column | str, threshold: int = 4) -> Column:
    d = _c(distance)
    return F.when(d.isNull(), F.lit(0.0)).when(d <= threshold, F.lit(1.0)).otherwise(F.pow(F.lit(float(threshold)) / d, F.lit(2.0)))


def stable_noise(key: Column | str, scale: float = 0.035) -> Column:
    """Noise from the first four bytes, little-endian, of a key's SHA-256."""
    h = F.sha2(_c(key), 256)
    swapped = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    return (F.conv(swapped, 16, 10).cast("double") / 4294967296.0 - 0.5) * 2 * scale


def keyed(n: Column | int, *parts: Column | str) -> Column:
    """A reproducible draw from 0 to n - 1: the MD5 of the parts joined by '|'."""
    h = F.md5(F.concat_ws("|", *[_c(p).cast("string") for p in parts]))
    return F.pmod(F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint"), n if isinstance(n, Column) else F.lit(n))


def euclidean(a: Column | str, b: Column | str, by_dimension: bool = False) -> Column:
    a, b = _c(a), _c(b)
    d = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    return d / F.sqrt(F.size(a)) if by_dimension else d


def fused_distance(meg: Column | str, lte: Column | str, alpha: float = 0.3) -> Column:
    return F.sqrt(F.pow(_c(meg) * alpha, F.lit(2.0)) + F.pow(_c(lte) * (1 - alpha), F.lit(2.0)))


# The regions that a true walk passes before so many seconds, and after the last of them.
TRUE_REGIONS = ((50, ("e4",)), (100, ("d3", "d4")), (150, ("d3", "c4")), (None, ("d4",)))


def time_bucket_regions(seconds: Column | str) -> Column:
    """The regions that a true walk passes at a time."""
    s = _c(seconds)
    listed = [(end, F.array(*[F.lit(x) for x in regions])) for end, regions in TRUE_REGIONS]
    out = listed[-1][1]
    for end, regions in reversed(listed[:-1]):
        out = F.when(s < end, regions).otherwise(out)
    return out
