"""Path, name and text helpers as Spark SQL text."""

from __future__ import annotations

# Patterns of source file names.
LENIENT_SOURCE = r"^([A-Za-z0-9_-]{11})(?:_\\d+(?:_\\d+)?|)$"
STRICT_SOURCE = r"^([A-Za-z0-9_-]{11})(?:_\\d+_\\d+)?$"


def parts(path: str) -> str:
    """Path components with either separator, without trailing separators."""
    return f"split(rtrim('/', replace({path}, '\\\\', '/')), '/')"


def clip_key(path: str) -> str:
    """Last two path components: class folder and file name."""
    return f"array_join(slice({parts(path)}, -least(2, size({parts(path)})), 2), '/')"


def parent_name(path: str) -> str:
    return f"element_at({parts(path)}, -2)"


def stem(path: str) -> str:
    return f"regexp_replace(element_at({parts(path)}, -1), '(?<=.)[.][^.]*$', '')"


def source_id(path: str, strict: bool = False) -> str:
    """Original video id of a clip: 11 characters before an optional time span. The lenient form
    falls back to the clip key, the strict form raises an error."""
    pattern = STRICT_SOURCE if strict else LENIENT_SOURCE
    found = f"regexp_extract({stem(path)}, '{pattern}', 1)"
    otherwise = f"raise_error(concat('cannot identify source: ', {path}))" if strict else clip_key(path)
    return f"CASE WHEN {found} <> '' THEN {found} ELSE {otherwise} END"


def canon(name: str) -> str:
    """Lower case, runs of other characters to one blank, trimmed."""
    return f"trim(regexp_replace(lower({name}), '[^a-z0-9]+', ' '))"


def has_any(text: str, markers) -> str:
    """Does the whole text contain any marker, ignoring case?"""
    return "(" + " OR ".join(f"contains(lower({text}), '{m.lower()}')" for m in markers) + ")"


def is_finite_or_null(value: str) -> str:
    return f"CASE WHEN NOT isnan({value}) AND abs({value}) <> double('Infinity') THEN {value} END"
