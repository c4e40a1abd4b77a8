"""Query plans: what to look for, and what trigrams a file must have for it.

``strict`` plans behave as trigram engines commonly do: literals that ignore case look up lower-case trigrams among those
of the raw text, and of a regular expression the trigrams of all its fragments, alternatives and optional parts included,
must be there; files can be missed. ``exact`` plans never miss a file: they keep alternatives apart, use trigrams of the
lower-cased text if case is ignored, and scan if no trigram is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from sparkgrove.functions.trigrams import extract
from sparkgrove.plans import regex
from sparkgrove.plans.regex import Formula, InvalidRegex

MAX_QUERY_BYTES = 4096


class QueryError(ValueError):
    """The query can't be answered."""


class TooShort(QueryError):
    """A literal of under three bytes."""


class NoTrigrams(QueryError):
    """A regular expression without any literal of three bytes."""


class TooLong(QueryError):
    """More bytes than a query may have."""


class BadRegex(QueryError, InvalidRegex):
    """The regular expression isn't well-formed."""


@dataclass(frozen=True)
class SearchPlan:
    pattern: str
    is_regex: bool
    ignore_case: bool
    mode: str
    needs: Formula
    lowered: bool  # the trigrams are those of the lower-cased text
    java: str | None = None
    least_width: int = 1

    @property
    def trigrams(self) -> list[int]:
        """All trigrams that are needed in any case, ascending and once each."""
        return sorted(self.needs.need)

    @property
    def can_use_index(self) -> bool:
        return not self.needs.true


def plan(query: str, is_regex: bool = False, ignore_case: bool = False, mode: str = "exact") -> SearchPlan:
    if mode not in ("exact", "strict"):
        raise ValueError(mode)
    if len(query.encode("utf-8", "surrogatepass")) > MAX_QUERY_BYTES:
        raise TooLong(f"query too long: more than {MAX_QUERY_BYTES} bytes")
    return _regex_plan(query, ignore_case, mode) if is_regex else _literal_plan(query, ignore_case, mode)


def _literal_plan(query: str, ignore_case: bool, mode: str) -> SearchPlan:
    pattern = query.lower() if ignore_case else query
    found = frozenset(extract(pattern.encode("utf-8", "surrogatepass")))
    if not found:
        raise TooShort("a query needs three bytes at least")
    return SearchPlan(pattern, False, ignore_case, mode, Formula(found), ignore_case and mode == "exact")


def _regex_plan(query: str, ignore_case: bool, mode: str) -> SearchPlan:
    try:
        node, java = regex.compile_regex(query, ignore_case)
        width = regex.least_width(node)
        if not width:
            regex.for_python(java, ignore_case)
    except InvalidRegex as e:
        raise BadRegex(f"invalid regex: {e}") from e
    found = regex.fragments(node)
    if ignore_case and mode == "strict":
        # letters become classes, so only runs without cased letters are fragments
        found = regex.fragments(regex.joined(_uncased(node)))
    if not found:
        raise NoTrigrams("the regular expression has no literal of three bytes")
    if mode == "strict":
        needs = Formula(frozenset(t for x in found for t in extract(x.encode())))
    else:
        needs = regex.formula(regex.case_folded(node) if ignore_case else node)
    return SearchPlan(query, True, ignore_case, mode, needs, ignore_case and mode == "exact", java, width)


def _uncased(node: regex.Node) -> regex.Node:
    if node.kind == "literal":
        return regex.Node("concat", parts=[regex.Node("literal", c) if c.lower() == c.upper() else regex.Node("any") for c in node.text])
    return regex.Node(node.kind, node.text, [_uncased(p) for p in node.parts], node.least, node.width)


def effective_limit(asked: int, server: int) -> int:
    """0 asks for as many as the server gives; the server's limit is never passed."""
    return server if asked == 0 else min(asked, server)
