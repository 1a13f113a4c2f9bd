"""Globs as one regular expression per list, so that a list is one ``rlike`` in the scan."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import fixed


def glob_to_regex(glob: str) -> str:
    """An anchored regular expression, valid in Java and RE2. Hidden files match like others."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"no closing bracket in glob {glob!r}")
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "{":
            end = glob.find("}", i)
            if end < 0:
                raise ValueError(f"no closing brace in glob {glob!r}")
            out, i = out + "(?:" + "|".join(glob_to_regex(g)[1:-1] for g in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def validate(globs: list[str]) -> None:
    """Raises ValueError for a glob that can't be compiled."""
    for g in globs:
        re.compile(glob_to_regex(g))


def globs_to_regex(globs: list[str]) -> str | None:
    """One expression that matches what any of the globs matches; None for no globs."""
    return "|".join(f"(?:{glob_to_regex(g)})" for g in globs) or None


def matches(path: Column, globs: list[str]) -> Column:
    rx = globs_to_regex(globs)
    return path.rlike(rx) if rx else F.lit(False)


def should_index(path: Column, include: list[str] | None = None, exclude: list[str] | None = None, blacklist: list[str] | None = None, whitelist: list[str] | None = None) -> Column:
    """Whether a path is indexed: included, not excluded, and without a part of ``blacklist``. No include globs, nothing is. Null paths give null.

    ``blacklist`` has entries as the blacklist keeps them, parts of paths or globs; a path with a part of
    ``whitelist`` isn't held back by them.
    """
    include = fixed.INCLUDE_GLOBS if include is None else include
    exclude = fixed.EXCLUDE_GLOBS if exclude is None else exclude
    out = matches(path, exclude)
    if blacklist:
        # entries are written with slashes around them, which the first and the last name of a relative path lack
        whole = F.concat(F.lit("/"), path, F.lit("/"))
        listed = blacklisted(whole, blacklist, []) | matches(path, blacklist_to_globs(blacklist))
        out = out | (listed & ~blacklisted(whole, whitelist or [], []))
    return ~out & matches(path, include)


def blacklisted(path: Column, blacklist: list[str] | None = None, whitelist: list[str] | None = None) -> Column:
    """Whether a path holds a part of the blacklist and none of the whitelist."""
    bad, good = F.lit(False), F.lit(False)
    for part in fixed.BLACKLIST if blacklist is None else blacklist:
        bad = bad | path.contains(part)
    for part in whitelist or []:
        good = good | path.contains(part)
    return bad & ~good


def is_safe(path: Column, **lists) -> Column:
    """No step up and nothing blacklisted."""
    return ~path.contains("..") & ~blacklisted(path, **lists)


def has_prefix(path: Column, prefix: str) -> Column:
    """Case-sensitive; reaches the Parquet scan."""
    return path.startswith(prefix)


def ignore_lines_to_globs(lines: list[str]) -> list[str]:
    """Globs of an ignore file: comments and blanks dropped, folders made recursive, bare names found anywhere."""
    out = []
    for line in (x.strip() for x in lines):
        if not line or line.startswith("#"):
            continue
        if line.endswith("/"):
            out.append(line + "**")
        elif "/" in line or "*" in line:
            out.append(line)
        else:
            out.append(f"**/{line}")
    return out


def blacklist_to_globs(entries: list[str]) -> list[str]:
    """Globs of blacklist entries: an end such as '.pem' and globs stay, folders become recursive."""
    out = []
    for e in (x.strip() for x in entries):
        if not e:
            continue
        if e.startswith(".") and "/" not in e:
            out.append(e)
            continue
        part = e.removeprefix("/").removesuffix("/")
        out.append(part if "*" in part else f"**/{part}/**")
    return out
