"""Column expressions for coordinates as text, NMEA sentences, names and typed fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._cols import Num, c


def nmea_checksum(line: Num) -> Column:
    """XOR of the characters between $ (or !) and *, as two hexadecimal digits."""
    body = F.regexp_extract(c(line), r"^[$!]([^*]*)", 1)
    xor = F.aggregate(F.filter(F.split(body, ""), lambda x: x != ""), F.lit(0), lambda s, x: s.bitwiseXOR(F.ascii(x)))
    return F.lpad(F.upper(F.hex(xor)), 2, "0")


def nmea_valid(line: Num) -> Column:
    """Whether the stated checksum is there and right."""
    stated = F.upper(F.regexp_extract(c(line), r"\*([0-9A-Fa-f]{2})\s*$", 1))
    return (stated != "") & (stated == nmea_checksum(line))


def nmea_fields(line: Num) -> Column:
    """talker, sentence and the comma-separated fields."""
    body = F.regexp_extract(c(line), r"^[$!]([^*]*)", 1)
    parts = F.split(body, ",")
    head = F.element_at(parts, 1)
    return F.struct(F.substring(head, 1, 2).alias("talker"), F.substring(head, 3, 10).alias("sentence"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("fields"))


def nmea_sentence(body: Num) -> Column:
    """A body as a whole sentence."""
    line = F.concat(F.lit("$"), c(body))
    return F.concat(line, F.lit("*"), nmea_checksum(F.concat(line, F.lit("*"))))


def to_float(x: Num) -> Column:
    """Null for blanks and anything else that is no number."""
    return F.when(F.trim(c(x)) != "", c(x).try_cast("double"))


def to_int(x: Num) -> Column:
    return F.when(F.trim(c(x)) != "", c(x).try_cast("int"))


def nmea_degrees(value: Num, letter: Num) -> Column:
    """ddmm.mmm with its letter, in degrees."""
    v = c(value).try_cast("double")
    d = F.floor(v / 100.0)
    return F.when(c(letter).isin("S", "W"), -1.0).otherwise(1.0) * (d + (v - d * 100.0) / 60.0)


def parse_degrees(text: Num) -> Column:
    """Degrees from decimal, degrees-minutes or degrees-minutes-seconds text; S and W are negative."""
    t = F.upper(F.trim(c(text)))
    nums = F.transform(F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))
    size = F.abs(F.coalesce(F.get(nums, F.lit(0)), F.lit(0.0)) + F.coalesce(F.get(nums, F.lit(1)), F.lit(0.0)) / 60.0 + F.coalesce(F.get(nums, F.lit(2)), F.lit(0.0)) / 3600.0)
    sign = F.when(t.startswith("-"), -1.0).otherwise(1.0) * F.when(t.rlike("[SW]"), -1.0).otherwise(1.0)
    return F.when(F.size(nums) > 0, sign * size)


def format_dms(deg: Num, positive: str, negative: str, digits: int = 2) -> Column:
    """Degrees, minutes, seconds and letter; seconds that round to 60 carry over."""
    units = F.round(F.abs(c(deg)) * 3600.0 * 10**digits).cast("long")
    per = 10**digits
    s, m, d = units % (60 * per), F.floor(units / (60 * per)) % 60, F.floor(units / (3600 * per))
    text = F.format_string(f"%d°%02d'%0{3 + digits}.{digits}f\"", d, m.cast("long"), s / float(per))
    return F.concat(text, F.when(c(deg) < 0, negative).otherwise(positive))


def format_ddm(deg: Num, positive: str, negative: str, digits: int = 3) -> Column:
    """Degrees, decimal minutes and letter."""
    per = 10**digits
    units = F.round(F.abs(c(deg)) * 60.0 * per).cast("long")
    text = F.format_string(f"%d°%0{3 + digits}.{digits}f'", F.floor(units / (60 * per)), (units % (60 * per)) / float(per))
    return F.concat(text, F.when(c(deg) < 0, negative).otherwise(positive))


def text_or_empty(x: Num) -> Column:
    return F.coalesce(c(x).cast("string"), F.lit(""))


def blank_to_null(x: Num) -> Column:
    return F.when(F.trim(c(x)) != "", F.trim(c(x)))


def capital_first(x: Num) -> Column:
    return F.concat(F.upper(F.substring(c(x), 1, 1)), F.substring(c(x), 2, 1 << 30))


def file_name(path: Num) -> Column:
    return F.regexp_extract(c(path), r"([^/\\]*)$", 1)


def file_stem(path: Num) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def file_extension(path: Num) -> Column:
    return F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1)


def with_prefix(path: Num, prefix: Num) -> Column:
    """The same folder, the name behind a prefix."""
    return F.concat(F.regexp_extract(c(path), r"^(.*[/\\])?", 1), c(prefix), file_name(path))


# Prefixes of the two kinds of provenance strings.
CDI, CPRD = "SDN:CDI:LOCAL:", "SDN:CPRD:LOCAL:"


def provenance(x: Num, prefix: str) -> Column:
    """What follows the prefix, else null."""
    return F.when(c(x).startswith(prefix), F.substring(c(x), len(prefix) + 1, 1 << 30))


def date_in_name(path: Num) -> Column:
    """First yyyymmdd or yyyy-mm-dd of a file name."""
    m = F.regexp_replace(F.regexp_extract(file_name(path), r"((?:19|20)\d{2}[-_]?\d{2}[-_]?\d{2})", 1), "[-_]", "")
    return F.try_to_timestamp(F.when(m != "", m), F.lit("yyyyMMdd")).cast("date")


def seconds_to_ns(s: Num) -> Column:
    return F.round(c(s) * 1e9).cast("long")


def ns_to_timestamp(ns: Num) -> Column:
    return F.timestamp_micros(F.floor(c(ns).cast("decimal(20,0)") / F.lit(1000)).cast("long"))


def array_histogram(values: Column, lo: float, hi: float, n: int) -> Column:
    """Counts of an array's values in n even bins, the last closed."""
    width = (hi - lo) / n
    at = lambda x: F.least(F.floor((x - lo) / width), F.lit(n - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.size(F.filter(values, lambda x: x.between(lo, hi) & (at(x) == i))))


def json_key(text: Num, key: str, kind: str = "string") -> Column:
    """A top-level key of a JSON text; null if the text is no JSON or lacks it."""
    return F.get_json_object(c(text), f"$.{key}").cast(kind)
