"""Scalar functions on columns; all stay in the JVM. Session time zone UTC is assumed where instants are formatted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16
#: Seconds between 1904-01-01 and 1970-01-01.
QT_EPOCH = 2082844800
NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan|INF|NaN|Infinity)\s*$"
# Brands of formats; those of M4A count as major brands only.
HEIF_BRANDS = [b"heic", b"heix", b"hevc", b"heim", b"heis", b"mif1", b"msf1", b"avif", b"avis"]
M4A_BRANDS = [b"M4A ", b"M4B ", b"M4P "]
MP4_BRANDS = [b"isom", b"iso2", b"mp41", b"mp42", b"avc1", b"M4V ", b"3gp4", b"3gp5", b"3g2a"]


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def parse_double(s: Column) -> Column:
    """A number in plain or scientific notation; suffixes like 1d are not numbers here."""
    t = trimmed(s)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def normalize_exif_datetime(s: Column) -> Column:
    """YYYY:MM:DD hh:mm:ss... to YYYY-MM-DDThh:mm:ss; anything else as it is."""
    shaped = s.rlike(r"(?s)^.{4}:.{2}:.{2} .{8}")
    iso = F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 6, 2), F.lit("-"), F.substring(s, 9, 2), F.lit("T"), F.substring(s, 12, 8))
    return F.when(shaped, iso).otherwise(s)


def normalize_timestamp(s: Column) -> Column:
    return F.when(F.contains(s, F.lit("T")), s).otherwise(normalize_exif_datetime(s))


def compose_timestamp(base: Column, subsec: Column, offset: Column) -> Column:
    """Base with subseconds and offset; null if there is an offset without a sign."""
    part = F.regexp_replace(trimmed(subsec), r"^\.+", "")
    off = trimmed(offset)
    whole = F.concat(normalize_exif_datetime(base), F.when(part != "", F.concat(F.lit("."), part)).otherwise(""), F.coalesce(off, F.lit("")))
    return F.when(off.isNull() | off.rlike("^[+-]"), whole)


_WALL = r"(?s)^(.{4}-.{2}-.{2}[T ].{2}:.{2}:.{2})(.*)$"


def wall_clock(s: Column) -> Column:
    """The first 19 characters of an ISO date and time; null if s is not one or has an unreadable rest."""
    rest = F.regexp_extract(s, _WALL, 2)
    ok = s.rlike(_WALL) & rest.rlike(r"^(|Z|[+-]\d{2}:?\d{2})$")
    return F.when(ok, F.regexp_extract(s, _WALL, 1))


def offset_minutes(s: Column) -> Column:
    """Offset of an ISO date and time in minutes; null without one."""
    rest = F.regexp_extract(s, _WALL, 2)
    size = F.regexp_extract(rest, r"^[+-](\d{2}):?(\d{2})$", 1).try_cast("int") * 60 + F.regexp_extract(rest, r"^[+-](\d{2}):?(\d{2})$", 2).try_cast("int")
    return F.when(rest == "Z", 0).when(rest.rlike(r"^[+-]\d{2}:?\d{2}$"), F.when(F.startswith(rest, F.lit("-")), -size).otherwise(size))


def relative_mismatch(a: Column, b: Column, tolerance: float = 0.005) -> Column:
    top = F.greatest(F.abs(a), F.abs(b))
    return F.coalesce((top != 0) & (F.try_divide(F.abs(a - b), top) > tolerance), F.lit(False))


def dms_to_decimal(rationals: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds as three rationals; null on a zero denominator or fewer than three; S and W are negative."""
    part = lambda k: F.try_divide(F.get(rationals, k)["numerator"].cast("double"), F.get(rationals, k)["denominator"].cast("double"))
    plain = part(0) + part(1) / 60 + part(2) / 3600
    return F.when(F.upper(trimmed(ref)).isin("S", "W"), -plain).otherwise(plain)


def iso6709(s: Column) -> Column:
    """Numbers of +lat-lon+alt text, in order."""
    return F.transform(F.regexp_extract_all(s, F.lit(r"[+-][^+-]*"), F.lit(0)), lambda x: F.regexp_replace(x, "/$", "").try_cast("double"))


def qt_seconds_to_iso(seconds: Column) -> Column:
    at = seconds - QT_EPOCH
    return F.when(at >= 0, F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss"))


def duration_seconds(duration: Column, timescale: Column) -> Column:
    return F.try_divide(duration.cast("double"), timescale.cast("double"))


def bitrate(size: Column, seconds: Column) -> Column:
    """Bits a second, rounded half up; null outside 1 to 2**32 - 1."""
    raw = F.floor(F.try_divide(size.cast("double") * 8, seconds.cast("double")) + 0.5)
    return F.when((seconds > 0) & (raw >= 1) & (raw <= 4294967295), raw.cast("long"))


def find_text(text: Column, *names: str) -> Column:
    """First of: attribute name="...", element <name>...</name>, for each name in turn."""
    out = []
    for n in names:
        for pattern in (rf'(?s){n}="([^"]*)"', rf"(?s)<{n}>(.*?)</{n}>"):
            out.append(F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)))
    return F.coalesce(*out)


def find_list(text: Column, item: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{item}[^>]*>(.*?)</{item}>"), F.lit(1))


def xml_unescape(s: Column) -> Column:
    # The five entities, the ampersand's last.
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def detect_format(content: Column) -> Column:
    """Format by leading bytes; null if none fits. DNG is TIFF with a DNG version among the tags of its first directory."""
    at = lambda k, n: F.substring(content, k + 1, n)
    is_ = lambda k, b: at(k, len(b)) == F.lit(b)
    ftyp = is_(4, b"ftyp")
    number = lambda k, n: F.conv(F.hex(at(k, n)), 16, 10).try_cast("bigint")
    whole = F.octet_length(content).cast("bigint")
    # Size 1: 64 bits after the kind; size 0: to the end.
    size = F.least(F.coalesce(F.when(number(0, 4) == 1, number(8, 8)).when(number(0, 4) > 0, number(0, 4)), whole), whole)
    places = F.sequence(F.lit(16).cast("int"), F.greatest(size - 4, F.lit(16)).cast("int"), F.lit(4))
    has = lambda names: at(8, 4).isin(*(F.lit(n) for n in names)) | F.exists(places, lambda k: (k + 4 <= size) & F.substring(content, k + 1, 4).isin(*(F.lit(n) for n in names)))
    major = lambda names: at(8, 4).isin(*(F.lit(n) for n in names))
    little = is_(0, b"II*\0")
    octet = lambda k: F.hex(F.substring(content, k + 1, F.lit(1)))
    word = lambda k, n: F.conv(F.when(little, F.concat(*(octet(k + i) for i in reversed(range(n))))).otherwise(F.concat(*(octet(k + i) for i in range(n)))), 16, 10).try_cast("bigint")
    ifd = F.least(word(F.lit(4), 4), whole).cast("int")
    tags = F.coalesce(word(ifd, 2), F.lit(0)).cast("int")
    fits = (tags > 0) & (ifd + 2 + 12 * tags <= whole)
    dng = F.coalesce(F.exists(F.sequence(F.lit(0), F.greatest(F.when(fits, tags).otherwise(1) - 1, F.lit(0))), lambda i: fits & (word(ifd + 2 + 12 * i, 2) == 0xC612)), F.lit(False))
    # Signatures and brands.
    return (
        F.when(is_(0, b"\xff\xd8"), "jpeg")
        .when(is_(0, b"\x89PNG\r\n\x1a\n"), "png")
        .when(little | is_(0, b"MM\0*"), F.when(dng, "dng").otherwise("tiff"))
        .when(is_(0, b"RIFF") & is_(8, b"WEBP"), "webp")
        .when(is_(0, b"fLaC"), "flac")
        .when(is_(0, b"FORM") & (is_(8, b"AIFF") | is_(8, b"AIFC")), "aiff")
        .when(is_(0, b"OggS"), "ogg")
        .when(ftyp & has(HEIF_BRANDS), "heif")
        .when(ftyp & major([b"qt  "]), "mov")
        .when(ftyp & major(M4A_BRANDS), "m4a")
        .when(ftyp & has(MP4_BRANDS), "mp4")
    )


# --- tagged values ------------------------------------------------------------------------------


def string_value(v: Column) -> Column:
    return F.when(v["kind"].isin("string", "timestamp"), v["s"])


def numeric_value(v: Column) -> Column:
    return F.when(v["kind"] == "float", v["d"]).when(v["kind"] == "integer", v["i"].cast("double")).when(v["kind"] == "rational", F.try_divide(v["r"]["numerator"].cast("double"), v["r"]["denominator"].cast("double")))


def typed_equal(a: Column, b: Column) -> Column:
    text = (a["kind"].isin("string", "timestamp")) & (b["kind"].isin("string", "timestamp"))
    same = lambda k: (a["kind"] == k) & (b["kind"] == k)
    return F.coalesce(
        F.when(text, normalize_timestamp(a["s"]) == normalize_timestamp(b["s"]))
        .when(same("integer"), a["i"] == b["i"])
        .when(same("float"), ~F.isnan(a["d"]) & ~F.isnan(b["d"]) & (F.abs(a["d"] - b["d"]) < EPSILON))
        .when(same("rational"), (a["r"]["numerator"] == b["r"]["numerator"]) & (a["r"]["denominator"] == b["r"]["denominator"])),
        F.lit(False),
    )
