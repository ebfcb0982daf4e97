"""Secret scan with multipart credential linking.

Strong patterns are reported wherever they occur. Weak candidates (bare key material,
endpoints) say nothing alone: they are reported only where an interval join inside one
scope finds the complementary parts next to them: an access identifier, a secret and an
endpoint make up a credential, and two of them with at least one secret or identifier do.
Scopes end at blank lines, and parts further than ``reach`` code points apart (240, a
parameter) are not of one credential. Each join looks at running maxima of span ends, so
the scan takes n log n steps whatever the spans' lengths.

Defined cases: a null text counts as empty; an empty table gives no rows; repeated rows
are each reported; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "key", "endpoint")
_RANK = {k: i for i, k in enumerate(KINDS)}
#: How far apart, in code points, two parts of one credential may lie.
REACH = 240
PLACEHOLDER = "[REDACTED]"

# The base patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

_KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{4,}", re.A)
_SCOPE_END = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Strong spans (start, end, kind), in code points, by start then kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], _RANK[s[2]]))


def _mixed(token: str) -> bool:
    """Key-like: digits, and letters of both cases."""
    return any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token)


class _Parts:
    """Spans by start, with the running maximum of their ends inside each scope."""

    def __init__(self, spans: list[Span], scopes: list[int]) -> None:
        spans = sorted(spans)
        self.scopes = scopes
        self.starts = [s[0] for s in spans]
        self.scope = [bisect.bisect_right(scopes, a) for a in self.starts]
        self.last: list[int] = []
        for i, span in enumerate(spans):
            carried = self.last[-1] if i and self.scope[i] == self.scope[i - 1] else -1
            self.last.append(max(carried, span[1]))

    def near(self, span: Span, reach: int) -> bool:
        """Whether a part of the span's scope lies within ``reach`` of it."""
        at = bisect.bisect_right(self.starts, span[1] + reach) - 1
        scope = bisect.bisect_right(self.scopes, span[0])
        while at >= 0 and self.scope[at] > scope:
            at = bisect.bisect_left(self.scope, self.scope[at]) - 1
        return at >= 0 and self.scope[at] == scope and self.last[at] >= span[0] - reach

    def over(self, span: Span) -> bool:
        """Whether a part and the span overlap; scopes are one here."""
        at = bisect.bisect_left(self.starts, span[1]) - 1
        return at >= 0 and self.last[at] > span[0]


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak spans that complementary parts in the same scope confirm.

    A bare key needs an access identifier nearby, or an endpoint that it is no part of. An
    endpoint needs a secret nearby: an assigned one, a confirmed key or, beside an access
    identifier, a strong one of any kind.
    """
    access, linkable = [s for s in base if s[2] == "access"], "://" in text
    if not access and not linkable:
        return []
    scopes = [m.end() for m in _SCOPE_END.finditer(text)]
    ends = [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)] if linkable else []
    ids, places, taken, within = _Parts(access, scopes), _Parts(ends, scopes), _Parts(base, []), _Parts(ends, [])
    keys = []
    for m in _KEY.finditer(text) if access or ends else ():
        span = (m.start(), m.end(), "key")
        if (ids.near(span, reach) or (places.near(span, reach) and not within.over(span))) and not taken.over(span) and _mixed(m.group()):
            keys.append(span)
    strong = _Parts([s for s in base if s[2] != "access"] + keys, scopes)
    told = _Parts([s for s in base if s[2] == "assign"] + keys, scopes)
    return keys + [s for s in ends if told.near(s, reach) or (ids.near(s, reach) and strong.near(s, reach))]


def all_spans(text: str, reach: int = REACH) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and linked spans together."""
    base = base_spans(text)
    more = linked_spans(text, base, reach)
    return base, sorted(base + more, key=lambda s: (s[0], _RANK[s[2]])) if more else base


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span, overlaps merged, replaced by the placeholder."""
    out, at, end = [], 0, -1
    for start, stop, _ in spans:
        if start >= end:
            if end >= 0:
                at = end
            out += [text[at:start], PLACEHOLDER]
            end = stop
        else:
            end = max(end, stop)
    return "".join([*out, text[end:]]) if end >= 0 else text


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: its id, and all spans as an array of (kind, start, end, base)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in slices(batches, 512):
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = all_spans(text or "", reach)
                strong = set(base)
                rows.append([{"kind": k, "start": a, "end": b, "base": (a, b, k) in strong} for a, b, k in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["id", "spans"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(
        scan, f"id {id_type}, spans array<struct<kind string, start bigint, end bigint, base boolean>>"
    )


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", reach: int = REACH) -> DataFrame:
    """The same rows and columns, with secrets replaced and the length column brought up to date.

    A null text stays null; a length column that is missing, or null, is left so.
    """
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts = columns[text_col].to_pylist()
            changed = False
            for i, text in enumerate(texts):
                if text:
                    new = redact(text, all_spans(text, reach)[1])
                    if new is not text:
                        texts[i], changed = new, True
            if changed:
                if length_col in columns:
                    old = columns[length_col].to_pylist()
                    sizes = [n if n is None or t is None else len(t) for n, t in zip(old, texts)]
                    columns[length_col] = pa.array(sizes, columns[length_col].type)
                columns[text_col] = pa.array(texts, columns[text_col].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in batch.schema.names], schema=batch.schema)

    return docs.select(*names).mapInArrow(clean, docs.schema)
