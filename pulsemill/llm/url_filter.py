"""URL rules as one bit-parallel wildcard automaton.

All globs are packed into multiword Shift-And masks: a bit for each literal of
each glob, a mask of literals per character, and a mask of self loops per
character for the wildcards.  One pass over a canonical URL advances every
glob at once, and numpy advances all URLs of a batch together.

Glob syntax: ``?`` is one character, ``*`` any run without ``/``, ``**`` any run.
A canonical URL is ``.host/path``, so that ``*.example.org/`` names a host and
its subdomains.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, narrow

#: Host and path rules, the longest that fits decides.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: What decides where no rule fits, in this order; otherwise a URL is allowed.
GLOBS = [
    ("block", "**.exe"),
    ("block", "**.zip"),
    ("block", "**/wp-login.php"),
    ("block", "*.ads.*/**"),
]

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null and where ``://`` is missing."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    end = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    cut = end if slash < 0 else slash
    return rest[:cut].translate(_LOWER), rest[cut:end]


@dataclass
class Automaton:
    """Packed masks: ``step`` and ``loop`` per character class, ``first`` and ``last`` bits of the globs."""

    codes: dict[str, int]
    step: np.ndarray
    loop: np.ndarray
    first: np.ndarray
    last: list[tuple[int, int]]


def compile_globs(globs: Sequence[str]) -> Automaton:
    """One automaton for all globs.  Class 0 stands for every character no glob names."""
    codes = {c: i + 1 for i, c in enumerate(sorted({c for g in globs for c in g if c not in "*?"} | {"/"}))}
    size = sum(len(g.replace("*", "")) + 1 for g in globs)
    words = max(1, -(-size // 64))
    step, loop = (np.zeros((len(codes) + 1, words), np.uint64) for _ in range(2))
    first, last, bit = np.zeros(words, np.uint64), [], 0

    def put(mask: np.ndarray, at: int) -> None:
        mask[..., at // 64] |= np.uint64(1 << at % 64)

    for glob in globs:
        put(first, bit)
        at = 0
        while at < len(glob):
            if glob[at] == "*":
                double = glob.startswith("**", at)
                keep = loop[codes["/"]].copy()
                put(loop, bit)
                if not double and not keep[bit // 64] >> np.uint64(bit % 64) & np.uint64(1):
                    loop[codes["/"]] = keep
                at += 1 + double
            else:
                bit += 1
                put(step if glob[at] == "?" else step[codes[glob[at]]], bit)
                at += 1
        last.append((bit // 64, bit % 64))
        bit += 1
    return Automaton(codes, step, loop, first, last)


def match_globs(automaton: Automaton, texts: Sequence[str]) -> np.ndarray:
    """Which globs match which whole texts, as a Boolean matrix (text, glob)."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    points = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = np.zeros(max([int(points.max(initial=0)), *map(ord, automaton.codes)]) + 1, np.int32)
    for c, k in automaton.codes.items():
        classes[ord(c)] = k
    chars = classes[points]
    state = np.repeat(automaton.first[None, :], len(texts), axis=0)
    active = len(texts)
    for t in range(int(lengths.max(initial=0))):
        while active and lengths[active - 1] <= t:
            active -= 1
        c, now = chars[starts[:active] + t], state[:active]
        moved = now << np.uint64(1)
        moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
        state[:active] = moved & automaton.step[c] | now & automaton.loop[c]
    hits = np.empty((len(texts), len(automaton.last)), bool)
    for g, (word, bit) in enumerate(automaton.last):
        hits[order, g] = state[:, word] >> np.uint64(bit) & np.uint64(1) == 1
    return hits


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, globs: Sequence[tuple[str, str]] = GLOBS,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict on each URL: id, host, path, rule, verdict, pattern (of the glob).

    A rule fits its host and all subdomains, if the path starts with the
    rule's; the longest wins, the first of equals.  Where none fits, the first
    matching glob decides, and else the URL is allowed.  Null, empty and
    malformed URLs have an empty host and path, fit no rule and are allowed.
    Repeated rows are judged one by one; other columns are left out.
    """
    rules, globs = list(rules), list(globs)
    patterns = [f"*.{h}{p}**" for _, h, p in rules] + [g for _, g in globs]
    best_first = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), i))
    kind = dict(pages.dtypes)[id_col]
    built: list[Automaton] = []

    def work(urls, batch):
        if not built:
            built.append(compile_globs(patterns))
        parts = [split_url(u) for u in urls]
        hits = match_globs(built[0], ["." + h + p for h, p in parts])
        rule, verdict, glob = [], [], []
        for row in hits:
            i = next((i for i in best_first if row[i]), None)
            g = next((j for j in range(len(globs)) if row[len(rules) + j]), None) if i is None else None
            rule.append(None if i is None else rules[i][1] + rules[i][2])
            glob.append(None if g is None else globs[g][1])
            verdict.append(rules[i][0] if i is not None else globs[g][0] if g is not None else "allow")
        return {"id": batch.column(0), "host": [h for h, _ in parts], "path": [p for _, p in parts],
                "rule": rule, "verdict": verdict, "pattern": glob}

    out = map_texts(narrow(pages, id=id_col, url=url_col), "url",
                    f"id {kind}, host string, path string, rule string, verdict string, pattern string", work)
    return out.withColumnRenamed("id", id_col)
