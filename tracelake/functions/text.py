"""Column functions over source text. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[a-zA-Z0-9\p{L}\p{N}]++(?:_[a-zA-Z0-9\p{L}\p{N}]++)*+"
#: A line with its break. Breaks are CRLF, LF and a lone CR; the Unicode separators, VT and FF are none.
LINE = r"[^\n\r]*+(?:\r\n|\n|\r)|[^\n\r]++"
#: Also what ``\s`` lacks: the four information separators.
BLANK = r"^[\s\p{Z}\x1C-\x1F\x85]*$"


def source_lines(text: Column) -> Column:
    """Lines with their breaks; an empty text has none, a final break adds none."""
    return F.regexp_extract_all(text, F.lit(LINE), 0)


def line_count(text: Column) -> Column:
    return F.size(source_lines(text))


def is_blank(text: Column) -> Column:
    return text.rlike(BLANK)


def slice_text(lines: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` (from 1, inclusive) as one text."""
    return F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "")


def terms(text: Column) -> Column:
    """Lower-case words, each followed by its snake and camel parts if it has several."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)

    def parts(word):
        camel = F.regexp_replace(F.regexp_replace(word, r"([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z0-9])([A-Z])", "$1_$2")
        split = F.filter(F.split(F.lower(camel), "_"), lambda x: x != "")
        whole = F.lower(word)
        # Few words have parts; the others are spared two more regular expressions.
        several = word.rlike("_|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]")
        return F.when(several & (F.size(split) > 1), F.concat(F.array(whole), split)).otherwise(F.array(whole))

    # A text none of whose words has parts is lowered at once; two letters are lowered by more than themselves.
    some = text.rlike("[_\u0130\u03a3]|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]")
    return F.when(~some, F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)).otherwise(F.flatten(F.transform(words, parts)))


def fence_width(text: Column) -> Column:
    """Backticks that fence a text: three, or one more than its longest run."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), F.length)
    return F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1)


def module_names(path: Column) -> Column:
    """Dotted names by which a Python file can be imported: as it lies, and without a leading ``src``."""
    bare = F.regexp_replace(F.regexp_replace(path, r"(?i)\.pyi?$", ""), r"(^|/)__init__$", "")
    dotted = F.replace(bare, F.lit("/"), F.lit("."))
    return F.filter(F.array_distinct(F.array(dotted, F.regexp_replace(dotted, r"^src\.", ""))), lambda x: x != "")


def code_fence(text: Column) -> Column:
    """Content of the first fenced block, empty if there is none."""
    return F.regexp_extract(text, r"(?s)```(?:python)?\s*\n(.*?)```", 1)


def unsafe_path(path: Column) -> Column:
    """Absolute, empty or not normalised paths, and those with a backslash or NUL."""
    return path.isNull() | (path == "") | path.rlike(r"^/|\\|\x00|(^|/)\.{0,2}(/|$)")


def redacted(text: Column, roots: dict[str, str]) -> Column:
    """Every root path replaced by its label, longer roots first."""
    for root in sorted(roots, key=len, reverse=True):
        text = F.replace(text, F.lit(root), F.lit(roots[root]))
    return text
