"""Secrets in texts: assigned values, access keys, long hex runs, and strings that tokenize badly.

The first three kinds are patterns. The fourth is a token-efficiency test: a vocabulary learned
from text spends few tokens on words and names but almost one token per one or two characters on
random strings, so a low number of characters per token exposes them. Digests of known lengths,
identifiers (UUIDs, numbers, words joined by signs) and everything a pattern has found already are left out
of that test: what lies between such spans is tested. Strings of letters of one case need an even lower number.

Spans are (kind, start, end) in code points, the end exclusive; they come in order of start, then
in the order of KINDS. Defined cases: a missing or empty text has no spans; rows are scanned one
by one and whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .byte_bpe import ROWS, Ranks, read_ranks
from .tokens import with_fields

# The patterns of the contract and their least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_CUES = ("passw", "secret", "token", "api")
ASSIGN_LENGTH = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LENGTH = 20
HEX = re.compile(r"[0-9a-f]{24,}")
# Every access key and hex run, and every string worth a test, lies in such a run.
LONG_RUN = re.compile(r"[!-~]{20,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# Characters per token below which a candidate counts as random: English and other prose has 3 to
# 5, names in code 2.5 and more, base64 about 1.6.
RANDOM_RATIO = 2.0
# For strings of letters of one case, which long words are too: words have 2.5 and more, random letters about 1.6.
ONE_CASE_RATIO = 1.8
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
HEX_ANY_CASE = re.compile(r"[0-9A-Fa-f]+")
IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[_/=+-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[_/=+-]*|[_/=+-]+")

ONE_CASE = re.compile(r"[a-z]+|[A-Z]+")

Span = tuple[str, int, int]


class Scanner:
    """Finds the spans of one text."""

    def __init__(self, ranks: Ranks, pattern: str, ratio: float = RANDOM_RATIO):
        self.ratio = ratio
        self.tokens = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def random(self, value: str) -> bool:
        """Whether a string is neither a known digest nor an identifier and tokenizes badly."""
        if UUID.fullmatch(value) or (len(value) in DIGEST_LENGTHS and HEX_ANY_CASE.fullmatch(value)):
            return False
        if ONE_CASE.fullmatch(value):
            return len(value) < min(self.ratio, ONE_CASE_RATIO) * len(self.tokens(value))
        if IDENTIFIER.fullmatch(value):
            return False
        return len(value) < self.ratio * len(self.tokens(value))

    def spans(self, text: str | None) -> list[Span]:
        if not text:
            return []
        found: list[Span] = []
        low = text.lower()
        if any(cue in low for cue in ASSIGN_CUES):
            found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
        runs = [m.span() for m in LONG_RUN.finditer(text)]
        for start, end in runs:
            found += [("access", *m.span()) for m in ACCESS.finditer(text, start, end) if m.end() - m.start() >= ACCESS_LENGTH]
            found += [("hex", *m.span()) for m in HEX.finditer(text, start, end)]
        if runs:
            for start, end in _between(runs, sorted((s, e) for _, s, e in found)):
                found += [("random", *m.span()) for m in CANDIDATE.finditer(text, start, end) if self.random(m[0])]
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _between(runs: list[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of some runs, in order, that no span of `taken` touches."""
    following = iter([*taken, (1 << 62, 1 << 62)])
    start, end = next(following)
    free = 0  # the end of all spans so far
    for low, high in runs:
        at = max(low, free)
        while start < high:
            if at < start:
                yield at, start
            free = max(free, end)
            at = max(at, free)
            start, end = next(following)
        if at < high:
            yield at, high


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with every span, overlaps as one, replaced by a mark."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ratio: float = RANDOM_RATIO) -> DataFrame:
    """Columns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, one row per row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    base_kinds = [kind for kind in KINDS if kind != "random"]
    names = ["doc_id", *[f"n_{kind}" for kind in base_kinds], "base_sha256", "spans", "n_random"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, pattern, ratio)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                spans = [scanner.spans(t) for t in part.column(text).to_pylist()]
                base = [joined([s for s in own if s[0] != "random"]) for own in spans]

                def counted(kind: str, spans: list[list[Span]] = spans) -> pa.Array:
                    return pa.array([sum(s[0] == kind for s in own) for own in spans], pa.int64())

                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        *[counted(kind) for kind in base_kinds],
                        pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]),
                        pa.array([joined(own) for own in spans]),
                        counted("random"),
                    ],
                    names=names,
                )

    source = docs.select("doc_id", f"`{text}`")
    fields = ", ".join(f"{name} {'bigint' if name.startswith('n_') else 'string'}" for name in names[1:])
    schema = with_fields(source.select("doc_id"), fields)
    return source.mapInArrow(find, schema)


def redact(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ratio: float = RANDOM_RATIO) -> DataFrame:
    """`docs` with every span replaced by a mark; all rows and columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    place = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, pattern, ratio)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [t and redacted(t, scanner.spans(t)) for t in part.column(place).to_pylist()]
                columns = [*part.columns]
                columns[place] = pa.array(texts, pa.string())
                yield pa.record_batch(columns, names=part.schema.names)

    return docs.mapInArrow(clean, docs.schema)
