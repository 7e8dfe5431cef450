"""Secret scans that link credentials kept in several parts.

Strong patterns (labelled values, access keys, long hex runs) are the base spans and always stand. Weak candidates say
little by themselves: identifiers (client ids, users), secrets (short or loosely labelled values, random-looking tokens),
endpoints (hosts, addresses with ports). They are reported only where complementary parts stand together. A scope is the
stretch of REACH code points on both sides of an identifier or endpoint within its block (blank lines part blocks);
candidates are joined to scopes as intervals: scopes find their run of candidates by binary search in the sorted starts,
prefix sums tell which roles a run holds, and a difference array carries a scope's verdict back to its candidates. Time
is n log n in a batch's candidates, whatever the texts repeat; nothing is shuffled and no pairs are made.

Complementary are: a labelled secret with an identifier or an endpoint; a bare token with an identifier; an identifier
with any secret; an endpoint with an identifier and any secret. Base spans count as parts (access keys are identifiers,
labelled values and hex runs are secrets), so a hex run confirms the user name beside it.

Cases: null and empty texts have no spans; spans are half-open, in code points; base kinds may overlap each other, added
spans overlap neither base spans nor each other (identifier before secret before endpoint, then the earlier, then the
longer); patterns run in linear time on long runs; repeated rows count each; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

BASE = ("assign", "access", "hex")
ADDED = ("identifier", "secret", "endpoint")
#: Code points that a scope goes on either side of its identifier or endpoint.
REACH = 300
#: Bits per character from which a token looks random, and the shortest such token.
RANDOM_BITS, RANDOM_LENGTH = 3.5, 16

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

#: Roles of candidates, as bits.
IDENTIFIER, LABELLED, TOKEN, ENDPOINT = 1, 2, 4, 8
#: What a role needs beside it: one role of each of these sets.
NEEDS = {IDENTIFIER: (LABELLED | TOKEN,), LABELLED: (IDENTIFIER | ENDPOINT,), TOKEN: (IDENTIFIER,), ENDPOINT: (IDENTIFIER, LABELLED | TOKEN)}
_KIND = {IDENTIFIER: "identifier", LABELLED: "secret", TOKEN: "secret", ENDPOINT: "endpoint"}

_GLUE = r"""["']?\x20*[:=]\x20*["']?"""
_WEAK = {
    IDENTIFIER: re.compile(rf"(?<![A-Za-z0-9])(?:client_?id|app_?id|tenant_?id|account(?:_?id)?|access_?key(?:_?id)?|key_?id|user(?:_?name|_?id)?|login){_GLUE}([A-Za-z0-9@._+-]{{3,}})", re.A | re.I),
    LABELLED: re.compile(rf"(?<![A-Za-z0-9])(?:pass(?:phrase|code|word|wd)?|pwd|pin|private_?key|(?:secret_?)?access_?key|client_?secret|secret(?:_?key)?|credentials?|auth(?:_?key)?|bearer|signature|token|key){_GLUE}([^\s\"'<>,;]{{4,}})", re.A | re.I),
    TOKEN: re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{RANDOM_LENGTH},}}"),
    ENDPOINT: re.compile(rf"(?<![A-Za-z0-9])(?:host(?:_?name)?|server|endpoint|base_?url|addr(?:ess)?){_GLUE}([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{{2,5}})?|localhost)|(?<![0-9.])([0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}:[0-9]{{2,5}})(?![0-9])", re.A | re.I),
}
#: A URL's authority: scheme, user and secret if given, host.
_URL = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,15}://(?:([^\x00-\x20\"'<>/:@]+)(?::([^\x00-\x20\"'<>/@]+))?@)?([A-Za-z0-9.-]+(?::[0-9]{2,5})?)")
_BLOCK = re.compile(r"\n[ \t\r]*\n")
_PLACEHOLDER = re.compile(r"(?i)\A(?:null|none|true|false|required|optional|string|value|example|changeme|x+|\*+|\.+|<.*)\Z")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of the strong patterns, leftmost and non-overlapping by kind; failing matches are dropped, not retried."""
    return {
        "assign": [m.span() for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 8],
        "access": [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16],
        "hex": [m.span() for m in _HEX.finditer(text)],
    }


def _random(token: str) -> bool:
    """Letters and digits of some variety, evenly enough spread."""
    kinds = sum(any(test(c) for c in token) for test in (str.islower, str.isupper, str.isdigit))
    if kinds < 2 or not any(c.isdigit() for c in token):
        return False
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values()) > RANDOM_BITS


def weak_parts(text: str) -> list[tuple[int, int, int]]:
    """(start, end, role) of candidates that only count in company."""
    out = []
    for role, pattern in _WEAK.items():
        for m in pattern.finditer(text):
            at = m.lastindex or 0
            if role == TOKEN and not _random(m.group()) or role == LABELLED and _PLACEHOLDER.match(m.group(1)):
                continue
            out.append((*m.span(at), role))
    for m in _URL.finditer(text):
        out += [(*m.span(g), role) for g, role in ((1, IDENTIFIER), (2, LABELLED), (3, ENDPOINT)) if m.group(g)]
    return out


def linked(start: np.ndarray, role: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which parts, sorted by start, share a scope [low, high) with what their role needs."""
    first, last = np.searchsorted(start, low), np.searchsorted(start, high)
    holds = np.zeros(len(low), dtype=np.int64)
    for bit in NEEDS:
        upto = np.concatenate([[0], np.cumsum(role == bit)])
        holds |= np.where(upto[last] > upto[first], bit, 0)
    out = np.zeros(len(start), dtype=bool)
    for bit, needs in NEEDS.items():
        whole = np.all([holds & n != 0 for n in needs], axis=0)
        cover = np.zeros(len(start) + 1, dtype=np.int64)
        np.add.at(cover, first[whole], 1)
        np.add.at(cover, last[whole], -1)
        out |= (np.cumsum(cover[:-1]) > 0) & (role == bit)
    return out


def _scan(texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of each text, by start, then kind; all texts lie on one axis for the join of intervals."""
    found, parts, blocks, begin = [], [], [], [0]
    for i, text in enumerate(texts):
        text, at = text or "", begin[-1]
        base = base_spans(text)
        found.append([(kind, s, e) for kind in BASE for s, e in base[kind]])
        strong = {"assign": LABELLED, "access": IDENTIFIER, "hex": LABELLED}
        parts += [(at + s, at + e, strong[kind], 1, i) for kind, s, e in found[-1]]
        weak = weak_parts(text)
        parts += [(at + s, at + e, role, 0, i) for s, e, role in weak]
        blocks.append(at)
        if weak:
            blocks += [at + m.end() for m in _BLOCK.finditer(text)]
        begin.append(at + len(text) + 1)
    if parts:
        start, end, role, strong, row = np.array(sorted(parts), dtype=np.int64).T
        edges = np.array([*blocks, begin[-1]], dtype=np.int64)
        anchor = (role == IDENTIFIER) | (role == ENDPOINT)
        block = np.searchsorted(edges, start[anchor], side="right")
        low = np.maximum(start[anchor] - REACH, edges[block - 1])
        high = np.minimum(end[anchor] + REACH, edges[block])
        keep = linked(start, role, low, high) & (strong == 0)
        by_row: dict[int, list] = {}
        for s, e, r, i in zip(start[keep].tolist(), end[keep].tolist(), role[keep].tolist(), row[keep].tolist()):
            by_row.setdefault(i, []).append((ADDED.index(_KIND[r]), s - begin[i], e - begin[i]))
        for i, added in by_row.items():
            found[i] += _apart(found[i], added)
    order = {kind: k for k, kind in enumerate((*BASE, *ADDED))}
    return [sorted(x, key=lambda span: (span[1], order[span[0]], span[2])) for x in found]


def _apart(base: list[tuple[str, int, int]], added: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """Added spans that overlap neither base spans nor an added span before them in priority."""
    taken: list[tuple[int, int]] = []

    def enter(s: int, e: int) -> None:
        """Keeps taken sorted and disjoint."""
        i = bisect_right(taken, (s, s))
        j = i
        if i and taken[i - 1][1] > s:
            i -= 1
        while j < len(taken) and taken[j][0] < e:
            j += 1
        if i < j:
            s, e = min(s, taken[i][0]), max(e, taken[j - 1][1])
        taken[i:j] = [(s, e)]

    for _, s, e in base:
        enter(s, e)
    out = []
    for kind, s, e in sorted(set(added), key=lambda x: (x[0], x[1], -x[2])):
        i = bisect_right(taken, (s, s))
        free = not (i and taken[i - 1][1] > s) and not (i < len(taken) and taken[i][0] < e)
        if free:
            enter(s, e)
            out.append((ADDED[kind], s, e))
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): array of (kind, start, end, token) of every text, by start, then kind."""

    def work(batches):
        for batch in batches:
            for block in pieces(batch):
                texts = block.column("text").to_pylist()
                spans = [[{"kind": k, "start": s, "end": e, "token": text[s:e]} for k, s, e in found] for text, found in zip(texts, _scan(texts))]
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(spans, _SPANS)], names=["doc_id", "found"])

    ids = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, f"doc_id {ids}, found array<struct<kind:string,start:int,end:int,token:string>>")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("token", pa.string())]))


def digest(found: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of some kinds, comma-joined in their order."""
    of = F.filter(found, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")
