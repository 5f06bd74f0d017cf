"""Identities of facts, as Columns: percent-encoded paths under a fixed scheme."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of identities.
ARTIFACT, SEMANTIC = "can://artifact/", "can://iac/"


def encode_segment(text: Column) -> Column:
    """A path segment: letters, digits and ``-._~`` stand, other bytes are encoded."""
    # What forms encode otherwise: a space is a plus there, a star stands and a tilde doesn't; their signs come from nothing else.
    form = F.url_encode(text)
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def decode_segment(text: Column) -> Column:
    """What a percent-encoded segment stands for; null where an escape is broken or the bytes are no UTF-8."""
    whole = text.rlike(r"^(?:[^%]|%[0-9A-Fa-f]{2})*+\z")
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("25(3.|4.|6.)(3.|4.|6.)|(..)"), F.lit(0))
    raw = F.unhex(F.array_join(F.transform(pairs, lambda h: F.when(F.length(h) == 6, F.decode(F.unhex(F.substring(h, 3, 4)), "UTF-8")).otherwise(h)), ""))
    return F.when(whole, F.try_validate_utf8(raw.cast("string")))


def application_of(identity: Column) -> Column:
    """The application that an artifact's or a fact's identity was made for; null where it is none."""
    return F.nullif(decode_segment(F.regexp_extract(identity, "^can://(?:artifact|iac)/([^/@]+)", 1)), F.lit(""))


def encode_value_segment(text: Column) -> Column:
    """A key of a value path: as a segment, with the dot encoded too."""
    return F.replace(encode_segment(text), F.lit("."), F.lit("%2E"))


def value_path(keys: Column) -> Column:
    """The path of an array of keys."""
    return F.array_join(F.transform(keys, encode_value_segment), ".")


def is_relative_path(path: Column) -> Column:
    """Whether a path may name an artifact: relative, no volume, no empty, ``.`` or ``..`` segment, no NUL."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = F.exists(F.split(clean, "/"), lambda s: s.isin("", ".", ".."))
    return F.coalesce(~bad & ~clean.rlike("^[A-Za-z]:/") & ~F.contains(clean, F.lit("\x00")), F.lit(False))


def artifact_id(app: Column, path: Column) -> Column:
    """The identity of a file of an application; null where the path can't have one."""
    parts = F.transform(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), encode_segment)
    return F.when(is_relative_path(path) & (app != ""), F.concat(F.lit(ARTIFACT), F.concat_ws("/", encode_segment(app), F.array_join(parts, "/"))))


def semantic_id(app: Column, dialect: str, *segments: Column) -> Column:
    return F.concat(F.lit(SEMANTIC), F.concat_ws("/", encode_segment(app), F.lit(dialect), *(encode_segment(s) for s in segments)))


def anonymous_id(parent: Column, kind: str, line: Column, column: Column, nth: Column | None = None) -> Column:
    """A fact known by its place; the n-th (from 1) at one place, beyond the first, carries its number."""
    place = F.concat(parent, F.lit(f"/{kind}@"), line.cast("string"), F.lit(":"), column.cast("string"))
    return place if nth is None else F.when(nth > 1, F.concat(place, F.lit(":"), nth.cast("string"))).otherwise(place)


def config_key_id(artifact: Column, path: Column) -> Column:
    """A key in a file; the path is encoded already, and so once more."""
    return F.concat(artifact, F.lit("@key/"), encode_segment(path))


def parent_dir(path: Column) -> Column:
    """The folder of a path, ``.`` at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ancestors(path: Column) -> Column:
    """Every folder above a path, nearest first, ``.`` last."""
    parts = F.split(path, "/")
    return F.transform(F.reverse(F.sequence(F.lit(0), F.size(parts) - 1)), lambda n: F.when(n == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))
