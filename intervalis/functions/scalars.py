"""Scalar derivations: time, names, ids, bands. All stay in the JVM but ``ascii_name``'s folding of accents."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intervalis.operators.scoring import ladder


def frames(seconds: Column, fps: Column | float, kind: str = "int") -> Column:
    """Whole frames of a non-negative time; times on a project's timeline may need a long."""
    return (seconds * fps).cast(kind)


def timecode(seconds: Column, fps: int = 30) -> Column:
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, F.floor((seconds - whole) * fps))


def human_duration(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return ladder(
        (seconds < 60, F.format_string("%.1fs", seconds)), (seconds < 3600, F.format_string("%dm %ds", F.floor(whole / 60), whole % 60)),
        otherwise=F.format_string("%dh %dm", F.floor(whole / 3600), F.floor(whole / 60) % 60),
    )


def relative_age(then: Column, now: Column) -> Column:
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    days = F.floor(seconds / 86400)
    return ladder(
        (seconds < 3600, F.format_string("Hace %d min", F.floor(seconds / 60))), (seconds < 86400, F.format_string("Hace %dh", F.floor(seconds / 3600))), (days == 1, F.lit("Ayer")),
        (days < 7, F.format_string("Hace %d días", days)), otherwise=F.date_format(then, "dd MMM"),
    )


def estimate_seconds(duration: Column) -> Column:
    """Expected seconds to analyse a video."""
    made = ladder(
        (duration <= 0, F.lit(5)), (duration < 10, F.greatest(F.lit(5), (1.2 * duration).cast("int") + 2)), (duration < 60, (0.85 * duration).cast("int") + 2), otherwise=(0.75 * duration).cast("int") + 2
    )
    return F.greatest(made, F.lit(3))


def frame_rate(average: Column, real: Column) -> Column:
    """A fraction such as 30000/1001 as fps: rounded, snapped to the first usual rate within 0.1; 30 where there is none."""
    def value(text: Column) -> Column:
        top, bottom = F.try_element_at(F.split(text, "/"), F.lit(1)), F.coalesce(F.try_element_at(F.split(text, "/"), F.lit(2)), F.lit("1"))
        return F.try_divide(top.try_cast("double"), bottom.try_cast("double"))

    rate = F.bround(F.coalesce(F.when(value(average) > 0, value(average)), value(real)), 2)
    usual = [(F.abs(rate - r) <= 0.1, F.lit(r)) for r in (24, 25, 30, 48, 50, 60)]
    return F.coalesce(ladder(*usual, otherwise=F.bround(rate).cast("int")), F.lit(30))


@F.pandas_udf(T.StringType())
def _ascii(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def ascii_name(name: Column) -> Column:
    """A file name of letters, digits, dot, dash and underscore; accents are folded first."""
    return F.regexp_replace(_ascii(name), r"[^a-zA-Z0-9_.-]", "_")


def clean_name(name: Column) -> Column:
    return F.replace(F.regexp_replace(name, r"[^\p{L}\p{N}\-_ ]", ""), F.lit(" "), F.lit("_"))


def file_id(path: Column) -> Column:
    return F.concat(F.lit("f_"), F.substring(F.md5(path), 1, 8))


def plain_id(name: Column) -> Column:
    return F.translate(name, ". -", "___")


def thumbnail_id(filename: Column, start: Column) -> Column:
    return F.substring(F.md5(F.format_string("%s_%.2f", filename, start)), 1, 12)


def upload_id(path: Column) -> Column:
    return F.concat(F.lit("upload_"), F.substring(F.md5(path), 1, 10))


def file_url(path: Column) -> Column:
    """file://localhost URL of a path; slashes and colons stay, blanks become %20."""
    coded = F.url_encode(path)
    for code, char in (("+", "%20"), ("%2F", "/"), ("%3A", ":"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(code), F.lit(char))
    return F.concat(F.lit("file://localhost"), F.when(path.startswith("/"), "").otherwise("/"), coded)


def movement_band(motion: Column) -> Column:
    return ladder((motion < 0.5, "none"), (motion < 2, "slight"), (motion < 5, "moderate"), (motion < 10, "high"), otherwise="extreme")


def vibration_band(pct: Column) -> Column:
    return ladder((pct < 5, "none"), (pct < 15, "slight"), (pct < 40, "moderate"), otherwise="high")


def exposure_band(brightness: Column) -> Column:
    return ladder((brightness < 0.2, "very_dark"), (brightness < 0.35, "dark"), (brightness < 0.65, "normal"), (brightness < 0.8, "bright"), otherwise="very_bright")


def focus_band(sharpness: Column) -> Column:
    return ladder((sharpness >= 100, "sharp"), (sharpness >= 50, "soft"), otherwise="blurry")


def framing_position(h: Column, v: Column) -> Column:
    """Where a picture leans, from balances in percent; the larger deviation wins."""
    dh, dv = h - 50, v - 50
    across = F.abs(dh) >= F.abs(dv)
    return ladder((F.greatest(F.abs(dh), F.abs(dv)) <= 8, "centre"), (across & (dh > 0), "right"), (across, "left"), (dv > 0, "down"), otherwise="up")


def tier_action(tier: Column) -> Column:
    t = F.lower(tier)
    return ladder((t == "gold", "Usar"), (t == "silver", "Usable"), (t == "bronze", "Revisar"), otherwise="Descartar")


def clip_text(tier: Column, score: Column, motion: Column, sharpness: Column, brightness: Column) -> Column:
    """Marker text of a clip, its lines joined by pipes, XML-escaped."""
    text = F.concat_ws(
        " | ", F.format_string("%s %.1f · %s", F.upper(tier), score, tier_action(tier)), F.concat(F.lit("motion "), movement_band(motion)), F.concat(F.lit("focus "), focus_band(sharpness)), F.concat(F.lit("light "), exposure_band(brightness))
    )
    return xml_escape(text)


def xml_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


PRIORITY_TAGS = ("entrevista", "rostro", "persona", "primer_plano", "accion", "movimiento", "contraluz")


def leading_tags(tags: Column, n: int = 4, words: tuple[str, ...] = PRIORITY_TAGS) -> Column:
    """Tags with a priority word first, each part in its order; n at most."""
    hit = lambda t: F.exists(F.array(*map(F.lit, words)), lambda w: t.contains(w))
    return F.slice(F.concat(F.filter(tags, hit), F.filter(tags, lambda t: ~hit(t))), 1, n)


def display_class() -> Column:
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return F.when(yes("is_garbage"), "garbage").when(yes("is_key_moment"), "key-moment").when(yes("is_best_take"), "best-take").when(yes("is_repeated_take"), "repeated-take").otherwise(F.lower("tier"))
