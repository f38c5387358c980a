"""Text, label and path expressions on columns; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers of a missing value, lower case (fixed values).
MISSING = ("", "nan", "none", "null", "unknown", "n/a", "na", "?")
#: Language names and codes with their two-letter code (fixed values).
LANGUAGES = {
    "english": "en", "eng": "en", "en-us": "en", "en-gb": "en", "japanese": "ja", "jpn": "ja", "jp": "ja", "german": "de", "deu": "de",
    "french": "fr", "fra": "fr", "spanish": "es", "spa": "es", "italian": "it", "ita": "it", "polish": "pl", "pol": "pl",
    "russian": "ru", "rus": "ru", "ukrainian": "uk", "ukr": "uk",
}
#: Substrings of an architecture's name, in the order they are tried (fixed values).
ARCHITECTURES = (
    ("multibandmelgan", "multibandmelgan"), ("mbmelgan", "multibandmelgan"), ("fullbandmelgan", "fullbandmelgan"), ("fbmelgan", "fullbandmelgan"),
    ("parallelwavegan", "parallelwavegan"), ("pwg", "parallelwavegan"), ("hifigan", "hifigan"), ("stylemelgan", "stylemelgan"), ("melgan", "melgan"), ("griffinlim", "griffinlim"),
)
#: Substrings of a family's name, in the order they are tried (fixed values).
FAMILIES = (
    ("codec", "Neural codec decoder"), ("vits", "Integrated GAN/VITS"), ("integrated", "Integrated GAN/VITS"), ("phase", "Classical phase reconstruction"),
    ("griffin", "Classical phase reconstruction"), ("gan", "GAN vocoder"), ("diff", "Diffusion vocoder"), ("flow", "Flow-based vocoder"), ("autoregressive", "Autoregressive vocoder"),
)
#: Labels of one family that differ between stages (fixed values).
FAMILY_LABELS = {"Classical phase rebuild": "Classical phase reconstruction", "GAN": "GAN vocoder", "Integrated GAN (VITS)": "Integrated GAN/VITS"}


def clean_text(c: Column) -> Column:
    """Trimmed, inner white space as one blank; null gives ''."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def is_present(c: Column) -> Column:
    """Not one of the markers of a missing value."""
    return ~F.lower(clean_text(c)).isin(*MISSING)


def parse_bool(c: Column) -> Column:
    """true, 1, yes / false, 0, no; anything else is null."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("true", "1", "yes"), F.lit(True)).when(low.isin("false", "0", "no"), F.lit(False))


def language_code(c: Column) -> Column:
    """Two-letter code by alias, else the part before the first hyphen."""
    low = F.regexp_replace(F.lower(F.trim(c)), "_", "-")
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, low), F.split_part(low, F.lit("-"), F.lit(1)))


def _first_contained(c: Column, table: tuple[tuple[str, str], ...], otherwise: Column) -> Column:
    out = otherwise
    for part, value in reversed(table):
        out = F.when(F.contains(c, F.lit(part)), F.lit(value)).otherwise(out)
    return out


def architecture_key(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    return _first_contained(bare, ARCHITECTURES, bare)


def family_key(c: Column) -> Column:
    return _first_contained(F.lower(c), FAMILIES, c)


def family_label(c: Column) -> Column:
    """One label for each family, whatever the stage wrote."""
    name = F.trim(c)
    known = F.create_map(*[F.lit(x) for pair in FAMILY_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), name)


def strip_suffix(c: Column) -> Column:
    """A file stem without ``_gen`` or ``_generated``."""
    return F.regexp_replace(c, "_(generated|gen)$", "")


def speaker_prefix(c: Column) -> Column:
    """Text before the first underscore, else null."""
    return F.when(F.contains(c, F.lit("_")), F.split_part(c, F.lit("_"), F.lit(1)))


def clean_path(c: Column) -> Column:
    """Forward slashes, without leading dots and slashes."""
    return F.regexp_replace(F.translate(c, "\\", "/"), "^[./]+", "")


def rewrite_prefix(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The first rule (old, new) whose old prefix fits is applied."""
    out = c
    for old, new in reversed(rules):
        out = F.when(c.startswith(old), F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 30))).otherwise(out)
    return out


def speaker_from_path(c: Column, marker: str = "by_book") -> Column:
    """The folder behind ``marker``, else 'unknown'."""
    parts = F.split(c, "/")
    at = F.array_position(parts, marker)
    return F.coalesce(F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int"))), F.lit("unknown"))


def reason_tokens(c: Column) -> Column:
    """Sorted distinct non-empty tokens of a ';' list."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def append_reason(c: Column, reason: str) -> Column:
    """``reason`` added to a ';' list unless it is in it."""
    known = F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x) != "")
    return F.array_join(F.array_union(known, F.array(F.lit(reason))), ";")


def clean_hash(c: Column) -> Column:
    """Lower-cased and trimmed; markers of a missing value give null."""
    low = F.lower(F.trim(c))
    return F.when(~low.isin(*MISSING, "<na>"), low)


def joined_set(c: Column) -> Column:
    """Aggregate: sorted distinct values joined by '|'."""
    return F.array_join(F.array_sort(F.collect_set(c)), "|")
