"""Credentials in texts, and weak candidates that count only beside their complementary parts."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import extended, releasing, segments, text_buffer

# The three base kinds with the least length of what must be long.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

# Weak parts: alone they prove nothing. A secret has no greatest length; its run is taken at once, so long runs are scanned once.
WEAK_ID = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|key_?id|access_?key(?:_?id)?)["']?[ \t]*[:=][ \t]*["']?([A-Za-z0-9+/_.@-]{3,})""", re.IGNORECASE | re.ASCII)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}+(?![A-Za-z0-9+/_=-])")
# A host name is taken at once and only from its first label, so that runs of labels are scanned once.
ENDPOINT = re.compile(r"(?:[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{4,}|(?<![a-z0-9_-])(?<![a-z0-9_-]\.)[a-z0-9-]++(?:\.[a-z0-9-]++)++:[0-9]{2,5}\b)", re.IGNORECASE | re.ASCII)
#: A scope is a paragraph; within it two parts belong together up to this many code points apart.
REACH = 400
#: Bits per character that a weak secret must have.
LEAST_ENTROPY = 3.5


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of the kind, end, kind) of base findings, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found)


def linked_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Weak identifiers, secrets and endpoints that meet a complementary part within their scope.

    Parts are intervals widened by ``REACH`` and cut at the paragraph; an identifier needs a secret, a secret needs an
    identifier or an endpoint, an endpoint needs both. The join runs over sorted starts, so it is linear but for output.
    """
    ids = [(m.start(1), m.end(1)) for m in WEAK_ID.finditer(text)] if ":" in text or "=" in text else []
    ends = [(m.start(), m.end()) for m in ENDPOINT.finditer(text)] if ":" in text else []
    strong_ids = [(a, b) for a, _, b, kind in base if kind == "access"]
    strong_secrets = [(a, b) for a, _, b, kind in base if kind != "access"]
    if not (ids or ends or strong_ids):
        return []
    taken = sorted(strong_ids + strong_secrets + ends)
    starts = np.array([a for a, _ in taken], np.int64)
    reach = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else starts

    def free(a, b):
        k = int(np.searchsorted(starts, b)) - 1
        return k < 0 or reach[k] <= a

    named = set(ids)
    secrets = [
        (m.start(), m.end()) for m in WEAK_SECRET.finditer(text)
        if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]) and free(m.start(), m.end()) and m.span() not in named and entropy(m[0]) >= LEAST_ENTROPY
    ]
    ids = [x for x in ids if free(*x)]
    breaks = np.array([m.start() for m in re.finditer(r"\n[ \t]*\n", text)], np.int64)

    def near(parts, others):
        """For each part: does one of the others lie within reach and in the same paragraph?"""
        if not parts or not others:
            return [False] * len(parts)
        others = sorted(others)
        at, to = np.array([a for a, _ in others]), np.array([b for _, b in others])
        furthest = np.maximum.accumulate(to)
        out = []
        for a, b in parts:
            k = int(np.searchsorted(breaks, a, "right"))
            low = max(a - REACH, int(breaks[k - 1]) if k else 0)
            high = min(b + REACH, int(breaks[k]) if k < len(breaks) else len(text))
            last = int(np.searchsorted(at, high, "right"))
            out.append(last > 0 and furthest[last - 1] > low)
        return out

    all_ids, all_secrets = ids + strong_ids, secrets + strong_secrets
    found = [(a, 3, b, "linked_id") for (a, b), yes in zip(ids, near(ids, all_secrets)) if yes]
    with_id, with_end = near(secrets, all_ids), near(secrets, ends)
    found += [(a, 4, b, "linked_secret") for (a, b), x, y in zip(secrets, with_id, with_end) if x or y]
    both = zip(ends, near(ends, all_ids), near(ends, all_secrets))
    return found + [(a, 5, b, "linked_endpoint") for (a, b), x, y in both if x and y]


def listed(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


def findings(text: str) -> tuple[list, list]:
    """(base findings, all findings) of a text, each as sorted (start, rank of the kind, end, kind)."""
    base = base_spans(text)
    return base, sorted(base + linked_spans(text, base))


def by_size(batch: pa.RecordBatch, where: int):
    """The batch in slices of about 1 MB of text, so that memory does not grow with the texts of a batch."""
    _, offsets = text_buffer(batch.column(where))
    for first, last in segments(offsets):
        yield batch.slice(first, last - first)


def scan_secrets(documents: DataFrame) -> DataFrame:
    """Findings in every whole text; adds n_assign, n_access, n_hex, n_linked, base_spans and spans to the rows.

    Spans are "kind:start:end" in code points, end exclusive, by start and then kind (assign, access, hex, linked_id,
    linked_secret, linked_endpoint), joined by commas. Null text is empty and has none. Repeated rows are answered each by
    itself; a column with one of the added names is replaced; an empty table gives no rows. Every pattern takes time in
    proportion to the text, however long its runs are. Texts are only read where they lie, nothing is shuffled.
    """
    added = ["n_assign", "n_access", "n_hex", "n_linked", "base_spans", "spans"]
    documents = documents.drop(*added)
    where = documents.columns.index("text")

    def scan(batches):
        for batch in (part for whole in batches for part in by_size(whole, where)):
            out = {k: [] for k in added}
            for text in batch.column(where).to_pylist():
                base, every = findings(text or "")
                kinds = Counter(kind for *_, kind in every)
                linked = sum(n for kind, n in kinds.items() if kind.startswith("linked"))
                for k, v in zip(added, (kinds["assign"], kinds["access"], kinds["hex"], linked, listed(base), listed(every))):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in out.items())], names=[*batch.schema.names, *added])

    return documents.mapInArrow(releasing(scan), extended(documents.schema, ", ".join(f"{k} {'long' if k[:2] == 'n_' else 'string'}" for k in added)))


def secret_digest(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans; the hash is of ``scan_secrets``' base_spans.

    Null and empty texts, and texts without findings, have zeros and the hash of nothing; null doc_ids and repeated rows are
    answered each by itself.
    """
    found = scan_secrets(documents.select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_linked")


def masked(text: str, spans: list, mask: str) -> str:
    out, done = [], 0
    for a, _, b, _ in spans:
        if a >= done:
            out += [text[done:a], mask]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact_secrets(documents: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """Every document, with each run of found spans replaced by ``mask``; n_chars, where there is one, follows the text.

    Texts without findings, null texts among them, stay as they are. Scan and mask are one pass over the text.
    """
    where = documents.columns.index("text")
    sized = documents.columns.index("n_chars") if "n_chars" in documents.columns else None

    def redact(batches):
        for batch in (part for whole in batches for part in by_size(whole, where)):
            texts, columns, changed = batch.column(where).to_pylist(), list(batch.columns), []
            for i, text in enumerate(texts):
                spans = findings(text)[1] if text else []
                changed.append(bool(spans))
                if spans:
                    texts[i] = masked(text, spans, mask)
            if any(changed):
                columns[where] = pa.array(texts, batch.schema.field(where).type)
                if sized is not None:
                    lengths = pa.array([len(t) if c else None for t, c in zip(texts, changed)], pa.int64()).cast(batch.schema.field(sized).type)
                    columns[sized] = pc.if_else(pa.array(changed), lengths, columns[sized])
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return documents.mapInArrow(releasing(redact), documents.schema)
