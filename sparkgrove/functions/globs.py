"""Path globs as patterns of the Java dialect.

``*`` and ``?`` also match a slash; ``**`` must be a whole component and matches any number of them; ``[...]`` and
``[!...]`` are classes; everything is case-sensitive and matches whole paths.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkgrove.functions.text import java_quote


class GlobError(ValueError):
    """The glob isn't well-formed."""


def glob_to_regex(glob: str) -> str:
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        if c == "*":
            stars = len(glob[k:]) - len(glob[k:].lstrip("*"))
            if stars > 2:
                raise GlobError("more than two stars in a row")
            if stars == 2:
                after = glob[k + 2 : k + 3]
                if (k and glob[k - 1] != "/") or after not in ("", "/"):
                    raise GlobError("** isn't a whole component")
                out.append("(?:.*/)?" if after else ".*")
                k += 2 + bool(after)
            else:
                out.append(".*")
                k += 1
        elif c == "?":
            out.append(".")
            k += 1
        elif c == "[":
            negated = glob[k + 1 : k + 2] == "!"
            begin = k + 1 + negated
            end = glob.find("]", begin + 1)
            if end < 0:
                raise GlobError("a class isn't closed")
            out.append(_class(glob[begin:end], negated))
            k = end + 1
        else:
            out.append(java_quote(c))
            k += 1
    return "(?s)^" + "".join(out) + "\\z"


def _class(body: str, negated: bool) -> str:
    items, k = [], 0
    while k < len(body):
        if body[k + 1 : k + 2] == "-" and k + 2 < len(body):
            if body[k] <= body[k + 2]:
                items.append(f"{java_quote(body[k])}-{java_quote(body[k + 2])}")
            k += 3
        else:
            items.append(java_quote(body[k]))
            k += 1
    if not items:
        return "." if negated else "(?!)"
    return f"[{'^' * negated}{''.join(items)}]"


def matches_glob(path: Column, glob: str) -> Column:
    return path.rlike(glob_to_regex(glob))


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether any glob matches. Globs that aren't well-formed are left out, as excludes are in the configuration."""
    found = F.lit(False)
    for glob in globs:
        try:
            found = found | matches_glob(path, glob)
        except GlobError:
            continue
    return found
