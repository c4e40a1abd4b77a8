import random
import re

import pytest

from sparkgrove.functions.trigrams import extract
from sparkgrove.plans import regex
from sparkgrove.plans.planner import BadRegex, NoTrigrams, TooLong, TooShort, effective_limit, plan


def holds(needs, found):
    return needs.need <= found and all(any(holds(f, found) for f in branch) for branch in needs.either)


def grams(text):
    return set(extract(text.encode()))


def test_literals():
    assert plan("foobar").trigrams == sorted(grams("foobar")) and plan("日").can_use_index
    assert plan("FooBar", ignore_case=True).pattern == "foobar"
    for short in ("ab", "", "é"):
        with pytest.raises(TooShort):
            plan(short)
    with pytest.raises(TooLong):
        plan("a" * 4097)
    assert plan("a" * 4096)


@pytest.mark.parametrize("pattern", [".*", "a|b", "[abc]+", "(a|b)c", "^$"])
def test_no_trigrams(pattern):
    with pytest.raises(NoTrigrams):
        plan(pattern, is_regex=True)


@pytest.mark.parametrize("pattern", ["(unclosed", "a)", "*abc", "(?=abc)", "(?!abc)", "(?<=abc)d", r"(abc)\1", "abc[", r"abc\k", "abc{3,1}", "(?>abc)", "abc\\"])
def test_bad_patterns(pattern):
    with pytest.raises(BadRegex):
        plan(pattern, is_regex=True)


def test_fragments_and_formulas():
    node, _ = regex.compile_regex(r"foo(bar)?baz|quxx+", False)
    assert sorted(regex.fragments(node)) == ["bar", "baz", "foo", "qux"]
    needs = regex.formula(node)
    assert holds(needs, grams("foobaz") | grams("foo") | grams("baz")) and holds(needs, grams("quxx")) and not holds(needs, grams("foo"))
    strict = plan("foobar|bazqux", is_regex=True, mode="strict")
    assert strict.trigrams == sorted(grams("foobar") | grams("bazqux"))
    assert plan("foo.*", is_regex=True).trigrams == sorted(grams("foo"))
    assert not plan("(foo)?.", is_regex=True).can_use_index


def test_case_is_ignored():
    with pytest.raises(NoTrigrams):
        plan(r"fn\s+main", is_regex=True, ignore_case=True, mode="strict")
    assert plan("ab123", is_regex=True, ignore_case=True, mode="strict").trigrams == sorted(grams("123"))
    assert plan("zebra", is_regex=True, ignore_case=True).lowered


@pytest.mark.parametrize(("pattern", "java"), [(r"a\.b", r"a\.b"), ("(?P<n_a>abc)", "(?<nUa>abc)"), (r"\p{Greek}abc", r"\p{IsGreek}abc"), (r"\u{1F600}abc", r"\x{1F600}abc"), ("abcd++", "abc(?:d+)+")])
def test_dialect(pattern, java):
    got = plan(pattern, is_regex=True).java
    assert got == "(?dU)" + java


def test_exact_plans_lose_nothing():
    rng = random.Random(1)

    def made(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.45:
            return rng.choice(["abc", "bcab", "cab", "ba", "a", "[ab]", ".", "cabc"])
        if kind < 0.6:
            return f"({made(depth - 1)}|{made(depth - 1)})"
        if kind < 0.75:
            return f"({made(depth - 1)}){rng.choice('?*+')}"
        return made(depth - 1) + made(depth - 1)

    texts = ["".join(rng.choice("abcABC") for _ in range(rng.randint(0, 14))) for _ in range(150)]
    tried = 0
    for _ in range(300):
        pattern = made(3)
        for fold in (False, True):
            try:
                found = plan(pattern, is_regex=True, ignore_case=fold)
            except NoTrigrams:
                continue
            tried += 1
            for t in texts:
                if re.search(pattern, t, re.IGNORECASE if fold else 0):
                    assert holds(found.needs, grams(t.lower() if found.lowered else t)), (pattern, t)
    assert tried > 100


def test_limits():
    assert (effective_limit(0, 50), effective_limit(10, 50), effective_limit(99, 50)) == (50, 10, 50)
