"""Personal data: patterns propose, checks confirm, words nearby adjust the score.

E-mail addresses, IP addresses, card and phone numbers are the base kinds; what fails its check is dropped and not tried
again. The method adds IBANs (mod-97), short card numbers of 13 to 15 digits (Luhn), social security numbers and secrets
(long runs of letters and digits of high entropy), which are reported only if their score, with the whole words around them,
reaches ``THRESHOLD``.

All scans are linear in the text: an e-mail address is grown from its @ to both sides, and a run of digits is entered at
its first digit only; both find just what the leftmost greedy patterns find.

Defined results: a null text is empty and has no spans; ends are exclusive and count code points; repeated rows give
repeated results; no rows give no rows; other columns of the input are not carried.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from sparkgrove.llm.common import id_text, map_batches, texts_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "card_short", "ssn", "secret")
THRESHOLD = 0.5
NEAR = 48  # code points on either side in which words count
# The patterns and the words that speak for each kind.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,128}(?![A-Za-z0-9+/_-])")
WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("address", "host", "ip", "server"),
    "card": ("amex", "card", "credit", "visa"),
    "phone": ("call", "phone", "mobile", "tel"),
    "iban": ("account", "bank", "iban", "konto"),
    "card_short": ("amex", "card", "credit", "diners"),
    "ssn": ("security", "social", "ssn"),
    "secret": ("apikey", "bearer", "key", "password", "secret", "token"),
}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.8, "card_short": 0.3, "ssn": 0.3, "secret": 0.3}
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, and more if one of its words stands whole within NEAR code points of the span."""
    low, high = max(0, start - NEAR), min(len(text), end + NEAR)
    before = [m[0] for m in WORD.finditer(text, low, start) if m.start() > low or not low or not text[low - 1].isalpha()]
    after = [m[0] for m in WORD.finditer(text, end, high) if m.end() < high or high == len(text) or not text[high].isalpha()]
    return min(1.0, PRIOR[kind] + (0.4 if any(w.lower() in WORDS[kind] for w in (*before, *after)) else 0.0))


def entropy(run: str) -> float:
    """Bits a character."""
    return -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values())


def spans(text: str) -> dict[str, list[tuple[int, int, float]]]:
    """The spans of each kind from left to right, with scores."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE, *ADDED)}
    found["email"] = emails(text) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            n = len(digits := _digits(m[0]))
            if 13 <= n <= 19 and luhn(digits):
                found["card" if n >= 16 else "card_short"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                found["phone"].append(m.span())
    for m in IBAN.finditer(text):
        if 15 <= len(m[0].replace(" ", "")) <= 34 and mod97(m[0]):
            found["iban"].append(m.span())
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            found["ssn"].append(m.span())
    for m in SECRET.finditer(text):
        if any("0" <= c <= "9" for c in m[0]) and any(c.isalpha() for c in m[0]) and entropy(m[0]) >= 3:
            found["secret"].append(m.span())
    scored = {k: [(a, b, score(text, k, a, b)) for a, b in v] for k, v in found.items()}
    return {k: v if k in BASE else [x for x in v if x[2] >= THRESHOLD] for k, v in scored.items()}


def listed(found: dict[str, list[tuple[int, int, float]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b, _ in found[k])


def redact(text: str) -> str:
    """The text with each span as <KIND>; of overlapping spans the first, longest one counts."""
    out, at = [], 0
    for a, b, kind in sorted(((a, b, k) for k, v in spans(text).items() for a, b, _ in v), key=lambda x: (x[0], -x[1])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
            at = b
    return "".join([*out, text[at:]])


DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their spans, all spans and their scores."""

    def run(batch):
        keys = batch.column("doc_id").to_pylist()
        found = [spans(x) for x in texts_of(batch)]
        yield {
            "doc_id": keys,
            **{f"n_{k}": [len(x[k]) for x in found] for k in BASE},
            "base_sha256": [hashlib.sha256(listed(x, BASE).encode()).hexdigest() for x in found],
            "spans": [listed(x, (*BASE, *ADDED)) for x in found],
            "scores": [",".join(f"{s:.2f}" for k in (*BASE, *ADDED) for _, _, s in x[k]) for x in found],
        }

    return map_batches(id_text(docs), run, DIGEST)
