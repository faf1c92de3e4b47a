"""What file names and paths say, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The media type of each known extension.
EXTENSIONS = {
    "Image": ".jpg .jpeg .png .gif .webp .bmp .heic .heif .svg .eps",
    "Video": ".mp4 .3gp .mkv .mov .webm",
    "Audio": ".opus .ogg .mp3 .m4a .aac .wav .amr .flac",
    "Document": ".pdf .doc .docx .xls .xlsx .ppt .pptx .txt .csv .rtf .zip .vcf .7z .rar .json .md .sql",
}
#: Fixed value: the source type whose names carry dates.
DATED_SOURCE = "WhatsAppMediaDirectory"
#: Bands of candidate counts and of summaries, as (label, largest value).
CANDIDATE_BANDS = (("0", 0), ("1", 1), ("2", 2), ("3-5", 5), ("6-10", 10), ("11-25", 25), ("26-50", 50), (">50", None))
COUNT_BANDS = (("1", 1), ("2", 2), ("3-5", 5), ("6-10", 10), ("11-25", 25), (">25", None))
GAP_BANDS = (("0", 0), ("1", 1), ("2", 2), ("3-5", 5), ("6-10", 10), (">10", None))
TOKEN_BANDS = (("0000", 0), ("0001-0002", 2), ("0003-0005", 5), ("0006-0010", 10), ("0011-0025", 25), ("0026-0050", 50), ("0051-0100", 100), ("0101+", None))
SLACK_BANDS = (("<0", -1), ("0", 0), ("1", 1), ("2", 2), ("3-5", 5), ("6-10", 10), ("11-25", 25), (">25", None))
SHORTFALL_BANDS = (("1-5", 5), ("6-10", 10), ("11-25", 25), (">25", None))
ASSIGNMENT_BANDS = (("0", 0), ("1", 1), ("2-10", 10), ("11-100", 100), ("101-1000", 1000), ("1001-1000000", 1_000_000), (">1000000", None))


def band(value: Column, bands: tuple[tuple[str, int | None], ...]) -> Column:
    """The label of the first band that reaches ``value``."""
    out = None
    for label, most in bands:
        test = F.lit(True) if most is None else value <= most
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out


def extension(name: Column) -> Column:
    """From the last dot on, in lower case; null if there is none or nothing follows it."""
    return F.nullif(F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1)), F.lit(""))


def media_type(ext: Column, size: Column | None = None) -> Column:
    """Image, Video, Audio, Document or Unknown; an empty file is Unknown whatever its name."""
    out = F.when(size == 0, "Unknown") if size is not None else None
    for kind, known in EXTENSIONS.items():
        test = F.coalesce(ext, F.lit("")).isin(known.split())
        out = out.when(test, kind) if out is not None else F.when(test, kind)
    return out.otherwise("Unknown")


def under_sent(path: Column) -> Column:
    """Whether a whole directory of the path (never the file name) reads ``Sent`` in any case."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: F.upper(s) == "SENT")


#: Eight digits that are a date of the Gregorian calendar; year 0 is none.
_LEAP = "(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:0[48]|[2468][048]|[13579][26])00)"
_DAY = "(?:(?:0[13578]|1[02])(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)(?:0[1-9]|[12][0-9]|30)|02(?:0[1-9]|1[0-9]|2[0-8]))"
REAL_DATE = f"(?:(?!0000)[0-9]{{4}}{_DAY}|{_LEAP}0229)"
#: The first marker whose digits are a date, and what follows it.
MARKER = rf"(?s)-({REAL_DATE})-WA(.*)\z"


def marker_digits(name: Column) -> Column:
    """The digits of the first ``-YYYYMMDD-WA`` that is a real date, or null."""
    return F.nullif(F.regexp_extract(name, MARKER, 1), F.lit(""))


def marker_date(name: Column) -> Column:
    return F.to_date(marker_digits(name), "yyyyMMdd")


def file_date(source_type: Column, name: Column) -> Column:
    """The date in a name, for sources whose names carry one."""
    return F.when(source_type == DATED_SOURCE, marker_date(name))


def has_marker_shape(name: Column, invalid_only: bool = False) -> Column:
    """Whether ``-dddddddd-WA`` occurs; with ``invalid_only``, with digits that are no date."""
    return name.rlike(rf"-(?!{REAL_DATE}-)[0-9]{{8}}-WA" if invalid_only else "-[0-9]{8}-WA")


def suffix(name: Column, ext: Column) -> Column:
    """What follows the marker, without the extension if the whole name ends with it in any case; null without a marker."""

    def without(rest: Column) -> Column:
        ends = F.coalesce(F.endswith(F.upper(rest), F.upper(ext)), F.lit(False))
        return F.when(ends, F.substring(rest, F.lit(1), F.length(rest) - F.length(ext))).otherwise(rest)

    # of an array of one, so that the name is searched once
    return F.when(name.rlike(MARKER), F.transform(F.array(F.regexp_extract(name, MARKER, 2)), without)[0])


def token(suffix_: Column) -> Column:
    """The suffix as a number if it is exactly four digits, else null."""
    return F.when(suffix_.rlike(r"\A[0-9]{4}\z"), suffix_.cast("int"))


def once(**columns: Column) -> Column:
    """The columns, worked out once for each row however often later steps name them: the optimizer doesn't copy what a
    generator makes."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def suffix_class(s: Column) -> Column:
    digits = F.regexp_extract(s, r"\A[0-9]*", 0)
    return F.when(s == "", "Empty").when(digits == "", "NonNumeric").when(F.length(digits) == F.length(s), "PurelyNumeric").when(s.isNotNull(), "NumericPrefixWithTrailingDecoration")


def canonical_value(digits: Column) -> Column:
    """Without leading zeros; one digit stays."""
    return F.regexp_replace(digits, r"\A0+(?=[0-9])", "")


def shape_signature(s: Column) -> Column:
    """Runs of letters, digits and other characters as A, D and X with their length; ``-_.()[] `` stand for themselves.

    Other characters are counted in UTF-16 units.
    """
    runs = F.regexp_extract_all(s, F.lit(r"([A-Za-z]+|[0-9]+|[-_.()\[\] ]|[^A-Za-z0-9\-_.()\[\] ]+)"), 1)

    def said(run: Column) -> Column:
        units = (F.octet_length(F.encode(run, "UTF-16BE")) / 2).cast("int")
        return (
            F.when(run.rlike(r"\A[A-Za-z]"), F.concat(F.lit("A"), F.length(run)))
            .when(run.rlike(r"\A[0-9]"), F.concat(F.lit("D"), F.length(run)))
            .when(run.rlike(r"\A[-_.()\[\] ]"), run)
            .otherwise(F.concat(F.lit("X"), units))
        )

    return F.array_join(F.transform(runs, said), "")


def name_features(name: Column) -> dict[str, Column]:
    """Seven yes-or-no features of names without a date."""
    return {
        "eight_digits": name.rlike("[0-9]{8}"),
        "hyphen_eight_digits": name.rlike("-[0-9]{8}"),
        "real_date": name.rlike(REAL_DATE),
        "wa_literal": F.contains(name, F.lit("-WA")),
        "wa_digit": name.rlike("WA[0-9]"),
        "marker_shape": has_marker_shape(name),
        "impossible_marker": has_marker_shape(name, invalid_only=True),
    }
