"""Identities, paths, names and labels as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pair_id(left: Col, right: Col) -> Column:
    """The identity of an unordered pair of fingerprints."""
    return F.concat_ws(":", F.least(_c(left), _c(right)), F.greatest(_c(left), _c(right)))


def location_key(path: Col, start_line: Col, end_line: Col, language: Col, name: Col) -> Column:
    """Sortable key of a location; lines are padded to nine digits."""
    return F.format_string("%s:%09d:%09d:%s:%s", _c(path), _c(start_line), _c(end_line), _c(language), _c(name))


def size_upper_bound(a: Col, b: Col) -> Column:
    """The largest similarity that bags of these sizes can have; 0 if either is empty."""
    a, b = _c(a), _c(b)
    return F.when((a > 0) & (b > 0), F.least(a, b).cast("double") / F.greatest(a, b)).otherwise(F.lit(0.0))


# Names that say nothing about what a fragment does.
GENERIC_NAMES = ("main", "init", "deinit", "new", "constructor", "lambda", "closure")


def is_distinctive_name(name: Col) -> Column:
    value = F.lower(F.trim(_c(name)))
    return F.coalesce((value != "") & ~value.startswith("anonymous@") & ~value.isin(*GENERIC_NAMES), F.lit(False))


def parent_dir(path: Col) -> Column:
    """Directory of a path, ``.`` for a bare name."""
    path = _c(path)
    head = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(~path.contains("/"), ".").when(head == "", "/").otherwise(head)


def base_name(path: Col) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def extension(path: Col) -> Column:
    """Lower-case extension with its dot, empty for none."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def glob_regex(pattern: str) -> str:
    """A doublestar glob as a regular expression for whole paths.

    ``**/`` stands for any directories or none, ``/**`` at the end for the directory itself and all below, ``*`` and
    ``?`` stay within a segment, ``{a,b}`` are alternatives and ``[...]`` classes.
    """
    out, k, depth = "", 0, 0
    while k < len(pattern):
        rest = pattern[k:]
        if rest.startswith("**/") and (k == 0 or pattern[k - 1] == "/"):
            out, k = out + "(?:[^/]+/)*", k + 3
        elif rest == "/**":
            out, k = out + "(?:/.*)?", k + 3
        elif rest == "**":
            out, k = out + ".*", k + 2
        elif rest[0] == "*":
            out, k = out + "[^/]*", k + 1
        elif rest[0] == "?":
            out, k = out + "[^/]", k + 1
        elif rest[0] == "[" and "]" in rest[2:]:
            end = rest.index("]", 2)
            body = rest[1:end]
            body = "^" + body[1:] if body[0] in "!^" else body
            out, k = out + f"[{body}]", k + end + 1
        elif rest[0] == "{":
            out, k, depth = out + "(?:", k + 1, depth + 1
        elif rest[0] == "}" and depth:
            out, k, depth = out + ")", k + 1, depth - 1
        elif rest[0] == "," and depth:
            out, k = out + "|", k + 1
        elif rest[0] == "\\" and len(rest) > 1:
            out, k = out + re.escape(rest[1]), k + 2
        else:
            out, k = out + re.escape(rest[0]), k + 1
    return f"^{out}$"


def glob_match(pattern: str, path: Col) -> Column:
    return _c(path).rlike(glob_regex(pattern))


def path_uri(path: Col) -> Column:
    """A path with its segments percent-encoded."""
    return F.array_join(F.transform(F.split(_c(path), "/"), lambda s: F.regexp_replace(F.url_encode(s), r"\+", "%20")), "/")


def short_digest(text: Col, length: int = 12) -> Column:
    """The first characters of an id or digest."""
    return F.substring(_c(text), 1, length)


def terminal_safe(text: Col) -> Column:
    """Control and format characters as ``\\uXXXX``, or ``\\UXXXXXXXX`` above 0xFFFF; only texts that hold some are taken apart."""
    text = _c(text)
    # A code point is read from its four bytes of UTF-32.
    code = lambda c: F.ltrim(F.hex(F.encode(c, "UTF-32")), F.lit("0"))
    escape = lambda c: F.when(F.length(code(c)) <= 4, F.concat(F.lit("\\u"), F.lpad(code(c), 4, "0"))).otherwise(F.concat(F.lit("\\U"), F.lpad(code(c), 8, "0")))
    shown = F.transform(F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1)), lambda c: F.when(c.rlike(r"[\p{Cc}\p{Cf}]"), escape(c)).otherwise(c))
    return F.when(text.rlike(r"[\p{Cc}\p{Cf}]"), F.array_join(shown, "")).otherwise(text)


def clean_name(name: Col, longest: int = 80) -> Column:
    """Blanks collapsed; names of more than ``longest`` characters are cut and end in dots."""
    flat = F.trim(F.regexp_replace(_c(name), r"\s+", " "))
    return F.when(F.length(flat) > longest, F.concat(F.substring(flat, 1, longest - 3), F.lit("..."))).otherwise(flat)


def fallback_name(name: Col, start_line: Col, kind: Col) -> Column:
    """A cleaned name, or ``query@line`` or ``anonymous@line`` where there is none."""
    label = F.when(_c(kind) == "query", "query").otherwise("anonymous")
    clean = clean_name(F.coalesce(_c(name), F.lit("")))
    return F.when(clean == "", F.concat_ws("@", label, _c(start_line).cast("string"))).otherwise(clean)


def query_label(comment: Col) -> Column:
    """The label X of a line that is exactly ``-- name: X :mode``, with single blanks, else null."""
    found = F.regexp_extract(_c(comment), r"^-- name: ([A-Za-z_][A-Za-z0-9_]*) :[A-Za-z_][A-Za-z0-9_]*\z", 1)
    return F.when(found != "", found)


def label_above(content: Col, start_byte: Col) -> Column:
    """The label in the line right above the one where a fragment begins; only blanks may stand before the fragment."""
    before = F.substring(_c(content).cast("binary"), F.lit(1), _c(start_byte).cast("int")).cast("string")
    line = F.regexp_extract(before, r"(?:^|\n)([^\n]*?)\r?\n[ \t]*\z", 1)
    return query_label(line)
