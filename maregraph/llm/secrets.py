"""Secret scans with multipart credential linking.

Access identifiers, secrets and endpoints are intervals of a text. A weak candidate
(a bare random-looking string, an endpoint) is reported only where an interval join
finds its complementary parts in the same scope: the text within SCOPE code points of
an access identifier.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from maregraph.llm.common import row_chunks

#: Code points on either side of an access identifier.
SCOPE = 300
#: The order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "weak_secret", "endpoint")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
# '=' may stand before (NAME=value) but not after, where it is padding of something else or makes a name of it
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
URL = re.compile(r"https?://[^\s\"'<>]+")
# a host name is read once from its first label on, so a long one costs what it is long
HOST = re.compile(r"(?<![A-Za-z0-9_.-])[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)+")
NAME_GOES_ON = re.compile(r"[A-Z_]")
#: Last labels of a host that is an endpoint without a scheme.
ENDPOINT_ENDS = (".amazonaws.com", ".internal")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Spans of the three strong kinds, whole matches, leftmost and not overlapping within a kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # a run of 16 or more is a whole leftmost match that passes, so shorter runs needn't be visited
    out += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return out


def endpoints(text: str) -> list[tuple[int, int]]:
    """URLs, and host names up to their last label of ENDPOINT_ENDS, not overlapping."""
    urls = [m.span() for m in URL.finditer(text)]
    starts, out = [s for s, _ in urls], list(urls)
    for m in HOST.finditer(text):
        host, s = m.group(), m.start()
        if NAME_GOES_ON.match(text, m.end()):
            host = host[: host.rindex(".")]
        n = max((at + len(end) for end in ENDPOINT_ENDS if (at := (host + ".").rfind(end + ".")) > 0), default=0)
        k = bisect_right(starts, s) - 1
        if n and (k < 0 or urls[k][1] <= s):
            out.append((s, s + n))
    return sorted(out)


def linked_spans(text: str, base: list[Span], scope: int = SCOPE) -> list[Span]:
    """Weak candidates with a complementary part within the scope of an access identifier.

    A bare 40-character string needs the identifier; an endpoint needs the identifier
    and a secret (bare or assigned) in that identifier's scope. A candidate inside a
    base span is no candidate.
    """
    access = sorted((s, e) for s, e, kind in base if kind == "access")
    if not access:
        return []
    assigned = [(s, e) for s, e, kind in base if kind == "assign"]
    starts, ends = [s for s, _ in access], [e for _, e in access]
    base_starts, reach = [], []  # how far the base spans that begin up to there go
    for s, e in sorted((s, e) for s, e, _ in base):
        base_starts.append(s)
        reach.append(max(e, reach[-1] if reach else 0))

    def near(s: int, e: int) -> range:
        """Access identifiers whose scope meets [s, e)."""
        return range(bisect_left(ends, s - scope), bisect_right(starts, e + scope))

    def inside(s: int, e: int) -> bool:
        k = bisect_right(base_starts, s)
        return k > 0 and reach[k - 1] >= e

    weak = [(s, e) for s, e in (m.span() for m in WEAK_SECRET.finditer(text)) if near(s, e) and not inside(s, e)]
    with_secret = {i for s, e in [*weak, *assigned] for i in near(s, e)}
    out = [(s, e, "weak_secret") for s, e in weak]
    if with_secret:
        out += [(s, e, "endpoint") for s, e in endpoints(text) if any(i in with_secret for i in near(s, e)) and not inside(s, e)]
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def secret_scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows `id, n_assign, n_access, n_hex, n_weak, base_sha256, spans`, one for each row of docs.

    `spans` lists kind:start:end by start and then kind, in code points, ends exclusive.
    `base_sha256` is the digest of that list for the strong kinds alone. Null counts as
    the empty text, which has an empty list; an empty table gives no rows. Whole texts
    are read, in time in proportion to their length; repeated rows, and rows with null
    ids, are each scanned; other columns are ignored. No shuffle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_chunks(batch, 1):
                rows = []
                for text in part.column(1).to_pylist():
                    base = base_spans(text or "")
                    more = linked_spans(text or "", base, scope) if base else []
                    kinds = [kind for _, _, kind in base]
                    rows.append((*(kinds.count(k) for k in KINDS[:3]), len(more), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in columns[:4]), *(pa.array(x, pa.string()) for x in columns[4:])], [id_col, *names])

    names = ["n_assign", "n_access", "n_hex", "n_weak", "base_sha256", "spans"]
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in names[:4]), *(T.StructField(c, T.StringType()) for c in names[4:])])
    return docs.select(id_col, text_col).mapInArrow(scan, schema)
