import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkgrove.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def ok(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in text.split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


def base(text):
    s = pii.listed(pii.spans(text), pii.BASE)
    return s.split(",") if s else []


@given(st.text(st.sampled_from(list("a.@-+%_1 29().5"))))
@settings(max_examples=1500, deadline=None)
def test_scans_equal_the_patterns(text):
    assert base(text) == brute(text)


def test_cards_and_others():
    text = "pay 4111 1111-1111 1111, é 4111111111111112 +1 (555) 010-9999 a.b+c@d-e.f.g@h.i 1.2.3.4.5.6.7.8 300.1.1.1"
    assert base(text) == brute(text)
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    found = pii.spans("iban GB82 WEST 1234 5698 7654 32, amex 378282246310005; 378282246310005 alone" + " " * 60 + "378282246310005" + " " * 60 + "social security 123-45-6789")
    assert [len(found[k]) for k in pii.ADDED] == [1, 2, 1, 0]
    assert pii.redact("write to a@b.co now") == "write to <EMAIL> now"


def test_context_words_are_whole_words():
    run = "cf1d64a9a4cd9723e1f4eafc27395915e6868ffa"
    for text, kinds in [("antisocialite 123-45-6789", []), ("social 123-45-6789", ["ssn"]), ("x" * 60 + "social 123-45-6789", []), (f'token = "{run}"', ["secret"]), (f"tokens of {run}", []), ("key " + "a" * 40, []), (f"é {run} (KEY)", ["secret"])]:
        assert [k for k, v in pii.spans(text).items() if v] == kinds, text


@pytest.mark.parametrize("name", ["documents", "odd_documents"])
def test_query(request, name):
    docs = request.getfixturevalue(name)
    want = sorted(((r.doc_id is not None, r.doc_id or 0), hashlib.sha256(",".join(brute(r.text)).encode()).hexdigest()) for r in docs.collect())
    rows = pii.find_pii(docs).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.base_sha256) for r in rows) == want
    for r in rows:
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len([x for x in r.spans.split(",") if x.startswith(k + ":")]) for k in pii.BASE]


def test_long_runs_are_linear(no_documents):
    pii.spans("9" * 300_000 + "a" * 300_000 + "@" + "b" * 300_000 + "+1" + "(" * 300_000)
    assert pii.find_pii(no_documents).count() == 0
