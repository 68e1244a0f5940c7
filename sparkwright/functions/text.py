"""Functions on names, lines and paths, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a comment line, and how an import begins.
COMMENT_MARKS = ("///", "//!", "//", "/*", "*/", "*", "#", "--")
IMPORTS = ("import ", "import(", "use ", "from ")


def words(name: Column | str) -> Column:
    """Lower-case words of an identifier: at _ and -, from lower to upper case, and before an acronym's last capital."""
    cut = F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"(\p{Ll})(\p{Lu})", "$1_$2")
    cut = F.regexp_replace(cut, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1_$2")
    return F.filter(F.split(F.lower(cut), "[_-]+"), lambda w: w != "")


def name_key(name: Column | str) -> Column:
    return F.array_join(words(name), "_")


def snake(name: Column | str) -> Column:
    """Lower case with _ at word boundaries; marks that are there stay."""
    cut = F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"(\p{Ll})(\p{Lu})", "$1_$2")
    return F.lower(F.regexp_replace(cut, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1_$2"))


def squash(text: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def file_stem(path: Column | str) -> Column:
    """The last part of a path without its extension; a leading dot is no extension."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def position(line: Column | str, col: Column | str) -> Column:
    """Line and column in one ordered number."""
    return F.shiftleft(F.col(line).cast("long") if isinstance(line, str) else line.cast("long"), 20) + (F.col(col) if isinstance(col, str) else col)


def lines(text: Column | str) -> Column:
    """Lines without a last empty one, and without carriage returns at their ends."""
    parts = F.split(text, "\n")
    trailing = F.element_at(parts, -1) == ""
    kept = F.when(trailing, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(kept, lambda x: F.regexp_replace(x, "\r$", ""))


def unbreakable(line: Column) -> Column:
    """Whether a trimmed line is an import, a comment that is one address, or one string literal."""
    starts = F.lit(False)
    for mark in IMPORTS:
        starts = starts | line.startswith(mark)
    marks = "|".join(re.escape(m) for m in COMMENT_MARKS)
    body = F.trim(F.regexp_replace(F.trim(F.regexp_replace(line, f"^(?:{marks})", "")), r"(?:\*/)+$", ""))
    address = line.rlike(f"^(?:{marks})") & body.rlike(r"^\S*://\S+$")
    literal = line.rlike('^(?:"[^"]*"|`[^`]*`)[,;]?$')
    return starts | F.when(line.rlike(f"^(?:{marks})"), address).otherwise(literal)


def line_widths(text: Column | str) -> Column:
    """array of (line, width, exempt); widths count characters."""
    return F.transform(
        lines(text),
        lambda x, i: F.struct((i + 1).cast("long").alias("line"), F.char_length(x).cast("long").alias("width"), unbreakable(F.trim(x)).alias("exempt")),
    )


def glob_pattern(glob: str) -> str:
    """A path glob as an anchored regular expression: * stays in a segment, ** is any number of segments, :: is /."""
    segments = glob.replace("::", "/").split("/")
    if set(segments) == {"**"}:
        return "^.*$"
    out, lead = "", ""
    for segment in segments:
        if segment == "**":
            out += "(?:/[^/]*)*" if lead else "(?:[^/]*/)*"
        else:
            out += lead + "[^/]*".join(map(re.escape, segment.split("*")))
            lead = "/"
    return f"^{out}$"


def glob_matches(path: Column | str, glob: str) -> Column:
    return F.regexp_replace(path, "::", "/").rlike(glob_pattern(glob))


def limited_replace(text: Column | str, pattern: str, replacement: str, count: int) -> Column:
    """Replace the first ``count`` matches: the pieces between matches are joined with what replaces them."""
    col = F.col(text) if isinstance(text, str) else text
    replacement = re.sub(r"\\(\d)", r"$\1", replacement)
    found = F.transform(F.regexp_extract_all(col, F.lit(pattern), F.lit(0)), lambda m, i: F.when(i < count, F.regexp_replace(m, f"^(?:{pattern})$", replacement)).otherwise(m))
    pieces = F.split(col, pattern, -1)
    return F.concat(pieces[0], F.coalesce(F.array_join(F.transform(F.arrays_zip(found.alias("m"), F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))).alias("p")), lambda x: F.concat(x["m"], x["p"])), ""), F.lit("")))


def fingerprint(rule: Column, path: Column, snippet: Column) -> Column:
    """Identity of a finding: rule, path and the snippet without white space differences."""
    zero = F.lit("\0")
    return F.sha2(F.concat(rule, zero, F.regexp_replace(path, r"\\", "/"), zero, squash(snippet)), 256)
