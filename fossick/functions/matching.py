"""Predicates over lines and file names: literals, regular expressions, whole words and globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(text: Column, term: str, case_sensitive: bool = False) -> Column:
    return text.contains(term) if case_sensitive else F.lower(text).contains(term.lower())


def quoted(term: str) -> str:
    """A term as a Java pattern that matches it alone."""
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def regex(text: Column, pattern: str, case_sensitive: bool = False) -> Column:
    return text.rlike(("" if case_sensitive else "(?iu)") + pattern)


def whole_word(text: Column, term: str, case_sensitive: bool = False) -> Column:
    flags = "(?U)" if case_sensitive else "(?iuU)"
    return text.rlike(rf"{flags}(?<!\w){quoted(term)}(?!\w)")


def predicate(text: Column, term: str, *, mode: str = "literal", case_sensitive: bool = False) -> Column:
    """``mode``: literal, regex or word."""
    return {"literal": literal, "regex": regex, "word": whole_word}[mode](text, term, case_sensitive)


def any_of(text: Column, terms: list[str], *, case_sensitive: bool = False) -> Column:
    """One alternation of the escaped terms."""
    return regex(text, "|".join(f"(?:{quoted(t)})" for t in terms), case_sensitive)


def glob_pattern(glob: str) -> str:
    """A glob as a pattern for a whole path: ``*`` and ``?`` stay within a name, ``**`` crosses folders."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def is_glob(pattern: str) -> bool:
    return any(c in pattern for c in "*?[")


def in_globs(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a path, or its name where the glob has no slash, is included and not excluded."""
    name = F.element_at(F.split(path, "/"), -1)

    def one(g: str) -> Column:
        return (path if "/" in g else name).rlike(glob_pattern(g))

    ok = F.lit(True)
    if include:
        ok = ok & F.greatest(*[one(g) for g in include], F.lit(False))
    if exclude:
        ok = ok & ~F.greatest(*[one(g) for g in exclude], F.lit(False))
    return ok


def depth(path: Column, root: str) -> Column:
    """Folders between ``root`` and the file."""
    return F.size(F.split(path, "/")) - len(root.rstrip("/").split("/"))


def inside(path: Column, base: Column) -> Column:
    """Whether ``path`` is ``base`` or below it."""
    return (path == base) | path.startswith(F.concat(F.rtrim(base, F.lit("/")), F.lit("/")))
