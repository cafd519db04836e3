"""Secret scans with multipart credential linking.

Base patterns stand for themselves.  Weak parts (identifiers, secret-looking
values, endpoints) are reported only where complementary parts meet: an
interval join within a scope (lines without a blank line between them) links
a secret with an identifier or endpoint at most ``reach`` characters away.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame

from .common import map_texts, narrow

#: The base patterns.  Matches that fail their length are dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of hex digits is one match, so shorter runs drop out as a whole
BASE_KINDS = ("assign", "access", "hex")

#: Weak parts.
IDENT = re.compile(r"""(?:user(?:_?name)?|login|account|(?:client|access|key)_?id)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9._@+-]{3,}""", re.I | re.A)
WEAK = re.compile(r"""(?:pwd|pass|auth|credential|signature|private_?key)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9+/_.=-]{4,}""", re.I | re.A)
NOISE = re.compile(r"[A-Za-z0-9+/_-]{16,}")
ENDPOINT = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\s\"'<>]+")
NAMED_ENDPOINT = re.compile(r"""(?:host|endpoint|server)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9.:-]{3,}""", re.I | re.A)
LINK_KINDS = ("link_ident", "link_secret", "link_endpoint")
BLANK = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str, lowered: str) -> list[Span]:
    spans: list[Span] = []
    if any(word in lowered for word in ("password", "passwd", "secret", "token", "api_key", "apikey")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def entropy(value: str) -> float:
    """Bits per character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _noisy(value: str, least_bits: float) -> bool:
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= least_bits


def weak_spans(text: str, lowered: str, least_bits: float) -> list[Span]:
    """Identifiers (0), secret-looking values (1) and endpoints (2)."""
    spans: list[Span] = []
    if "=" in text or ":" in text:
        if any(w in lowered for w in ("user", "login", "account", "_id", "clientid", "accessid", "keyid")):
            spans += [(m.start(), 0, m.end()) for m in IDENT.finditer(text)]
        if any(w in lowered for w in ("pwd", "pass", "auth", "credential", "signature", "private")):
            spans += [(m.start(), 1, m.end()) for m in WEAK.finditer(text)]
        if "://" in text:
            spans += [(m.start(), 2, m.end()) for m in ENDPOINT.finditer(text)]
        if any(w in lowered for w in ("host", "endpoint", "server")):
            spans += [(m.start(), 2, m.end()) for m in NAMED_ENDPOINT.finditer(text)]
    spans += [(m.start(), 1, m.end()) for m in NOISE.finditer(text) if _noisy(m.group(), least_bits)]
    return spans


class _Parts:
    """Parts of one kind in one scope: is one within ``reach`` of an interval?"""

    def __init__(self, spans: list[Span]):
        spans = sorted(spans)
        self.starts = [s for s, _, _ in spans]
        self.ends, top = [], -1
        for _, _, e in spans:
            top = max(top, e)
            self.ends.append(top)

    def near(self, start: int, end: int, reach: int) -> bool:
        """Any part that starts before end + reach and ends after start - reach."""
        i = bisect_left(self.starts, end + reach)
        return i > 0 and self.ends[i - 1] > start - reach


def linked_spans(text: str, base: list[Span], weak: list[Span], reach: int) -> list[Span]:
    """The weak spans that have a complement: identifiers and endpoints need a secret, secrets one of those."""
    weak = [w for w in weak if not any(w[0] < e and s < w[2] for s, _, e in base)] if base else weak
    if not weak:
        return []
    cuts = [m.start() for m in BLANK.finditer(text)]
    scopes: dict[int, tuple[list[Span], list[Span]]] = {}
    for spans, side in ((base, 0), (weak, 1)):
        for s in spans:
            scopes.setdefault(bisect_left(cuts, s[0] + 1), ([], []))[side].append(s)
    found = []
    for strong, loose in scopes.values():
        parts = [_Parts([s for s in loose if s[1] == k] + [s for s in strong if (s[1] == 1) == (k == 0)] * (k != 2)) for k in range(3)]
        for s in loose:
            wanted = (parts[1],) if s[1] != 1 else (parts[0], parts[2])
            if any(p.near(s[0], s[2], reach) for p in wanted):
                found.append((s[0], s[1] + len(BASE_KINDS), s[2]))
    return sorted(set(found))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200,
                 least_bits: float = 3.5) -> DataFrame:
    """Secrets in each text: id, and spans as an array of (kind, start, end) in code points.

    Base kinds come from the fixed patterns, leftmost and non-overlapping per
    kind; ``link_*`` kinds from linking.  Null and empty texts have none.
    There is a row for each input row; its other columns are left out.
    """
    kind = dict(docs.dtypes)[id_col]
    names = BASE_KINDS + LINK_KINDS

    def work(texts, batch):
        found = []
        for text in texts:
            if not text:
                found.append([])
                continue
            lowered = text.lower()
            base = base_spans(text, lowered)
            spans = base + linked_spans(text, base, weak_spans(text, lowered, least_bits), reach)
            found.append([{"kind": names[k], "start": s, "end": e} for s, k, e in sorted(spans)])
        return {"id": batch.column(0), "spans": found}

    out = map_texts(narrow(docs, id=id_col, text=text_col), "text",
                    f"id {kind}, spans array<struct<kind:string,start:long,end:long>>", work)
    return out.withColumnRenamed("id", id_col)
