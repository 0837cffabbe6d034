"""Comments, build directives and embed patterns, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identity import _col

#: Directive prefixes (fixed values).
DIRECTIVE, EXPORT, LINKNAME, EMBED = "go:", "export ", "go:linkname", "go:embed"
NOT_BUILD_AFFECTING = ("go:generate", "go:embed", "go:build")


def normalized(comment: Column | str) -> Column:
    """A comment's text without its marks and outer white space."""
    c = F.trim(_col(comment))
    c = F.regexp_replace(c, r"^//", "")
    c = F.regexp_replace(c, r"^/\*", "")
    c = F.regexp_replace(c, r"\*/$", "")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_build_affecting(directive: Column | str) -> Column:
    d = _col(directive)
    other = F.lit(False)
    for prefix in NOT_BUILD_AFFECTING:
        other = other | F.startswith(d, F.lit(prefix))
    return (F.startswith(d, F.lit(DIRECTIVE)) & ~other) | F.startswith(d, F.lit(EXPORT))


def is_package_wide(directive: Column | str) -> Column:
    d = _col(directive)
    return F.startswith(d, F.lit(LINKNAME)) | F.startswith(d, F.lit(EXPORT))


def embed_patterns(text: Column | str) -> Column:
    """The patterns of an embed directive: bare, or in double or back quotes."""
    body = F.regexp_replace(_col(text), r"^go:embed\s*", "")
    tokens = F.regexp_extract_all(body, F.lit(r'("(?:[^"\\]|\\.)*"|`[^`]*`|[^\s"`]+)'), F.lit(1))
    bare = F.transform(tokens, lambda t: F.regexp_replace(F.regexp_replace(t, r'^["`]|["`]$', ""), r'\\(["\\])', "$1"))
    return F.when(F.startswith(_col(text), F.lit(EMBED)), bare).otherwise(F.array().cast("array<string>"))


#: Parts of a path pattern: an escaped character, a class, or one character.
_GLOB_PART = r"(?s)(\\.|\[\^?(?:\\.|[^\]\\])+\]|.)"


def glob_regex(pattern: Column | str) -> Column:
    """A path pattern as a regular expression; stars don't cross slashes, a
    backslash takes the special meaning from a character, also within a class.
    A pattern with an open class or a last backslash matches nothing."""
    parts = F.regexp_extract_all(F.regexp_replace(_col(pattern), r"^all:", ""), F.lit(_GLOB_PART), F.lit(1))

    def one(t: Column) -> Column:
        in_class = F.regexp_replace(F.substr(t, F.lit(2)), r"(?<!\\)([\[&])", r"\\$1")
        escaped = F.regexp_replace(t, r"([^A-Za-z0-9\\s])", r"\\$1")
        return (
            F.when(t == "*", "[^/]*").when(t == "?", "[^/]")
            .when(F.startswith(t, F.lit("\\")), F.concat(F.lit("\\Q"), F.substr(t, F.lit(2)), F.lit("\\E")))
            .when(F.startswith(t, F.lit("[")) & (F.length(t) > 1), F.concat(F.lit("["), in_class))
            .otherwise(escaped)
        )

    bad = F.exists(parts, lambda t: t.isin("[", "\\"))
    return F.when(bad, F.lit("(?!)")).otherwise(F.concat(F.lit("^"), F.array_join(F.transform(parts, one), ""), F.lit("$")))


def ancestors(path: Column | str) -> Column:
    """A path and all the folders it lies in."""
    parts = F.split(_col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
