"""String functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_replacement(replacement: str) -> str:
    r"""A replacement with ``\1`` references in Java's ``$1`` notation; a plain ``$`` stays one."""
    return re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))


def regrep(c: Column, pattern: str, replacement: str) -> Column:
    """Substitute in every line; ``^`` and ``$`` match at line ends, ``\\1`` refers to a group."""
    return F.regexp_replace(c, F.lit(f"(?m){pattern}"), F.lit(java_replacement(replacement)))


def replace_first(c: Column, pattern: str, replacement: str, n: int) -> Column:
    """Replace the first ``n`` matches by a plain text; all of them where ``n`` is 0 or less."""
    return F.array_join(F.split(c, pattern, n + 1 if n > 0 else -1), replacement)


def insert_at(c: Column, pattern: str, text: str, before: bool = False) -> Column:
    """Insert a text before or after every match."""
    own = text.replace("\\", "\\\\").replace("$", r"\$")
    return F.regexp_replace(c, F.lit(pattern), F.lit(own + "$0" if before else "$0" + own))


def upper_first(c: Column) -> Column:
    """The first letter a-z in upper case, wherever it stands."""
    head, rest = F.regexp_extract(c, "(?s)^([^a-zA-Z]*[a-zA-Z]?)", 1), F.regexp_extract(c, "(?s)^[^a-zA-Z]*[a-zA-Z]?(.*)$", 1)
    return F.concat(F.upper(head), rest)


def upper_words(c: Column) -> Column:
    """Letters that follow a character that is neither letter nor dot, and the first letter, in upper case."""
    parts = F.regexp_extract_all(upper_first(c), F.lit("(?s)([^a-zA-Z.][a-zA-Z]|.)"), 1)
    return F.array_join(F.transform(parts, lambda x: F.when(F.length(x) == 2, F.upper(x)).otherwise(x)), "")


def spaces_for_tabs(line: Column, width: int = 4) -> Column:
    """Each tab of a line as blanks up to the next multiple of ``width``."""
    cells = F.split(line, "\t")
    first, rest = F.element_at(cells, 1), F.slice(cells, F.lit(2), F.size(cells))
    return F.aggregate(rest, first, lambda acc, x: F.concat(acc, F.repeat(F.lit(" "), F.lit(width) - F.length(acc) % width), x))


def tidy(text: Column) -> Column:
    """No blanks at line ends, no more than one empty line in a row, one line end at the end.

    Line ends of any form (``\\r\\n``, ``\\r``) become ``\\n``, as where a file is read as text.
    """
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.regexp_replace(t, "(?dm) +$", "")  # lines end at \\n only
    return F.concat(F.regexp_replace(F.regexp_replace(t, "\n\n+", "\n\n"), "\n+\\z", ""), F.lit("\n"))


def wrap(text: Column, width: int) -> Column:
    """Words on lines of at most ``width`` characters, as far as words allow; lines do not begin with a blank."""
    words = F.filter(F.split(F.regexp_replace(text, r"\s+", " "), " "), lambda w: w != "")
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def add(acc: Column, w: Column) -> Column:
        fits = F.length(acc["line"]) + F.length(w) + 1 <= width
        return F.when(acc["line"] == "", F.struct(acc["done"].alias("done"), w.alias("line"))).otherwise(
            F.struct(
                F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], acc["line"], F.lit("\n"))).alias("done"),
                F.when(fits, F.concat(acc["line"], F.lit(" "), w)).otherwise(w).alias("line"),
            )
        )

    return F.aggregate(words, start, add, lambda acc: F.concat(acc["done"], acc["line"]))


def middle_ellipsis(c: Column, width: int) -> Column:
    """A text longer than ``width`` as its first three quarters and last quarter of the width."""
    head = width * 3 // 4
    return F.when(F.length(c) > width, F.concat(F.left(c, F.lit(head)), F.lit(" ... "), F.right(c, F.lit(width - head)))).otherwise(c)


def natural_key(c: Column, digits: int = 20) -> Column:
    """A sort key under which embedded numbers compare as numbers; equal keys: compare the text too."""
    parts = F.regexp_extract_all(c, F.lit("([0-9]+|[^0-9]+)"), 1)
    plain = F.transform(parts, lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
    return F.array_join(F.transform(plain, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, digits, "0")).otherwise(x)), "")


def members_digest(members: Column) -> Column:
    """One digest for a set of ids, whatever their order."""
    return F.md5(F.array_join(F.array_sort(members), ""))


def boxed(title: Column, width: int = 80) -> Column:
    """A comment box around a title."""
    rule = F.lit("#" * width)
    return F.concat(rule, F.lit("\n# "), F.rpad(title, width - 4, " "), F.lit(" #\n"), rule)


def hidden_spaces(c: Column) -> Column:
    """Byte order marks, non-breaking blanks and carriage returns in plain form."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\uFEFF", ""), "\u00A0", " "), "\r\n?", "\n")


#: The look commands that a history leaves out.
LOOK_COMMANDS = ("ls", "la", "ll", "hs", "js", "cat", "head", "tail")


def kept_command(command: Column, skipped: tuple[str, ...] = LOOK_COMMANDS) -> Column:
    """A command as it enters a history, null where it does not: commands that begin with a look command stay out unless piped.

    ``:;`` in front overrides that and is taken off.
    """
    look = command.rlike(f"^(?:{'|'.join(skipped)}) *") & ~command.contains("|")
    return F.when(~look, F.when(command.startswith(":;"), F.trim(F.substr(command, F.lit(3)))).otherwise(command))


def routed(c: Column, routes: list[tuple[str, object]]) -> Column:
    """The value of the first pattern that a text matches; a text that matches none is an error when its row is read."""
    out = None
    for pattern, value in routes:
        out = F.when(c.rlike(pattern), F.lit(value)) if out is None else out.when(c.rlike(pattern), F.lit(value))
    wrong = F.raise_error(F.concat(F.lit("no route for "), F.coalesce(c, F.lit("null"))))
    return wrong if out is None else out.otherwise(wrong)


def replaced_by(c: Column, pattern: str, function) -> Column:
    """Every match replaced by what a Python function makes of it (a match object), in Arrow batches."""
    import re

    compiled = re.compile(pattern)

    @F.pandas_udf("string")
    def run(texts):  # type: ignore[no-untyped-def]
        return texts.map(lambda t: compiled.sub(function, t), na_action="ignore")

    return run(c)


def repaired_encoding(c: Column) -> Column:
    """A text whose UTF-8 bytes were read as Latin-1, read again as UTF-8; any other text as it is."""
    again = F.encode(c, "ISO-8859-1")
    latin = F.when(~c.rlike("[^\\x00-\\xff]"), F.try_validate_utf8(again.cast("string")))
    return F.coalesce(latin, c)
