"""Reconciliation and validation rules, as data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces preferred, in order; without one of them the first entry wins.
EXIF, XMP, XMP_QT, QT, ICC, DJI = ["exif"], ["xmp"], ["xmp", "quicktime"], ["quicktime"], ["icc"], ["dji"]

# Fixed values: (field, chooser, tag names, preference), in order of emission.
RULES = [
    ("captured_at", "timestamp", ["DateTimeOriginal", "CreateDate"], EXIF),
    ("created_at", "timestamp", ["CreateDate"], EXIF),
    ("modified_at", "timestamp", ["ModifyDate"], EXIF),
    ("device.make", "string", ["Make"], EXIF),
    ("device.model", "string", ["Model"], EXIF),
    ("software", "string", ["Software"], EXIF),
    ("author", "string", ["Author"], XMP_QT),
    ("copyright", "string", ["Copyright"], XMP),
    ("headline", "string", ["Headline"], XMP),
    ("description", "string", ["Description"], XMP),
    ("color.profile.name", "string", ["ProfileDescription"], ICC),
    ("color.profile.class", "string", ["ProfileClass"], ICC),
    ("color.space", "string", ["ColorSpace"], ICC),
    ("orientation", "integer", ["Orientation"], EXIF),
    ("dimensions.width", "integer", ["ImageWidth"], EXIF),
    ("dimensions.height", "integer", ["ImageHeight"], EXIF),
    ("exposure.iso", "integer", ["ISO", "ISOSpeedRatings"], EXIF),
    ("exposure.aperture", "rational", ["FNumber"], EXIF),
    ("exposure.shutter_speed", "rational", ["ExposureTime"], EXIF),
    ("exposure.focal_length_mm", "float_like", ["FocalLength"], EXIF),
    ("lens.model", "string", ["LensModel"], EXIF),
    ("lens.make", "string", ["LensMake"], EXIF),
    ("duration", "float", ["DurationSeconds"], QT),
    ("video.framerate", "float", ["VideoFrameRate"], QT),
    ("video.bitrate", "integer", ["VideoBitrate"], QT),
    ("codec.video", "string", ["VideoCodec"], QT),
    ("codec.audio", "string", ["AudioCodec"], QT),
    ("audio.channels", "integer", ["AudioChannels"], QT),
    ("audio.sample_rate", "integer", ["AudioSampleRate"], QT),
    ("audio.bit_depth", "integer", ["AudioBitDepth"], QT),
    ("device.serial_number", "string", ["SerialNumber"], EXIF),
    ("drone.flight.pitch_deg", "float", ["FlightPitchDegree"], DJI),
    ("drone.flight.yaw_deg", "float", ["FlightYawDegree"], DJI),
    ("drone.flight.roll_deg", "float", ["FlightRollDegree"], DJI),
    ("drone.gimbal.pitch_deg", "float", ["GimbalPitchDegree"], DJI),
    ("drone.gimbal.yaw_deg", "float", ["GimbalYawDegree"], DJI),
    ("drone.gimbal.roll_deg", "float", ["GimbalRollDegree"], DJI),
    ("drone.speed.x_mps", "float", ["SpeedX"], DJI),
    ("drone.speed.y_mps", "float", ["SpeedY"], DJI),
    ("drone.speed.z_mps", "float", ["SpeedZ"], DJI),
]

# Members (namespace, tag name) of the groups that validation compares.
SEMANTIC = [
    ("captured_at", [("exif", "DateTimeOriginal"), ("xmp", "CreateDate"), ("quicktime", "CreationDate")]),
    ("device.make", [("exif", "Make"), ("xmp", "Make"), ("quicktime", "Make")]),
    ("device.model", [("exif", "Model"), ("xmp", "Model"), ("quicktime", "Model")]),
    ("copyright", [("exif", "Copyright"), ("xmp", "Copyright"), ("iptc", "Copyright")]),
]
NUMERIC = [
    ("exposure.iso", [("exif", "ISO"), ("exif", "ISOSpeedRatings"), ("xmp", "ISO"), ("xmp", "ISOSpeedRatings")]),
    ("exposure.aperture", [("exif", "FNumber"), ("xmp", "FNumber")]),
    ("exposure.focal_length_mm", [("exif", "FocalLength"), ("xmp", "FocalLength")]),
    ("exposure.shutter_speed", [("exif", "ExposureTime"), ("xmp", "ExposureTime")]),
]
FOLDED = ("device.make", "device.model")
TOLERANCE = 0.005


def rule_column(rules=RULES) -> Column:
    """The rules as one array column: (rule_ord, field, chooser, tags, prefs)."""
    texts = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    return F.array(*(F.struct(F.lit(k).alias("rule_ord"), F.lit(field).alias("field"), F.lit(chooser).alias("chooser"), texts(tags).alias("tags"), texts(prefs).alias("prefs")) for k, (field, chooser, tags, prefs) in enumerate(rules)))


def group_column(groups) -> Column:
    """Groups as one array column: (group_ord, field, keys), a key being namespace, tab, tag name."""
    return F.array(*(F.struct(F.lit(k).alias("group_ord"), F.lit(field).alias("field"), F.array(*(F.lit(f"{ns}\t{tag}") for ns, tag in members)).alias("keys")) for k, (field, members) in enumerate(groups)))
