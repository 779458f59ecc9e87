"""Secret scans: keyword automaton, anchored patterns near its hits, then checksum validation.

An Aho-Corasick automaton over all literal keywords finds where a secret may begin. Only there the
anchored pattern of that keyword is tried. Token kinds that embed a checksum are kept only if it is
right. Hex digests have no keyword; one run of the character class finds them.

Defined results: a null text is read as empty; empty texts give zero counts and no spans; repeated
rows give repeated results; null doc_id is passed through; other columns are ignored, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import re
import string
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgatlas.llm.shared import sliced

#: Kinds in listed order, keyword literals (lower case) and anchored patterns.
BASE_KINDS = ("assign", "access", "hex")
EXTRA_KINDS = ("github", "npm", "jwt", "private_key", "slack")
KINDS = BASE_KINDS + EXTRA_KINDS
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "private_key": ("-----begin ",),
    "slack": ("xoxb-", "xoxp-", "xoxa-"),
}
PATTERNS = {
    "assign": r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "github": r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "npm": r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}",
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}-----END (?:[A-Z]+ )*PRIVATE KEY-----",
    "slack": r"xox[bpa]-[0-9]{8,}-[A-Za-z0-9-]{16,}",
}
HEX = re.compile(r"[0-9a-f]{32,}")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase

RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long"


@functools.cache
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, literals in KEYWORDS.items():
        for literal in literals:
            found.add_word(literal, (kind, len(literal)))
    found.make_automaton()
    return found, {kind: re.compile(p) for kind, p in PATTERNS.items()}


def checksum_holds(token: str) -> bool:
    """The last six characters are the CRC-32 of the random part in base 62, as in public token formats."""
    body, given = token[token.index("_") + 1 : -6], token[-6:]
    value, out = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out.rjust(6, "0") == given


def valid(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[1]) >= 8
    if kind == "access":
        return match.end() - match.start() >= 16
    if kind in ("github", "npm"):
        return checksum_holds(match[0])
    return True


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of every secret, in order; leftmost, not overlapping per kind."""
    keywords, patterns = automaton()
    out, ends = [], {}
    lower = text.lower() if text.isascii() else text.translate(LOWER)
    for last, (kind, length) in keywords.iter(lower):
        start = last - length + 1
        if start < ends.get(kind, 0):
            continue
        match = patterns[kind].match(text, start)
        if match:
            ends[kind] = match.end()
            if valid(kind, match):
                out.append((start, KINDS.index(kind), match.end()))
    for match in HEX.finditer(text):
        out.append((match.start(), KINDS.index("hex"), match.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        rows = []
        for text in batch.column(1).to_pylist():
            spans = find_secrets(text or "")
            kinds = [k for _, k, _ in spans]
            base = joined([s for s in spans if s[1] < len(BASE_KINDS)])
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(base.encode()).hexdigest(), joined(spans), sum(k >= len(BASE_KINDS) for k in kinds)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64())] + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans. One map stage, no shuffle."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scan, RESULT)


def redact(text: str) -> str:
    """The text with every secret replaced by its kind; overlapping spans are replaced as one."""
    out, at = [], 0
    for start, kind, end in find_secrets(text):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with secrets in ``column`` replaced by a placeholder; all columns and rows stay."""
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t if t is None else redact(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
