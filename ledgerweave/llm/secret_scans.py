"""Secret scans by assignment-aware lexing.

Every text is scanned for three fixed shapes of secrets (`base`), and then read as source or configuration text:
name-literal pairs are lexed around each `=`, `:`, `:=` and `=>`, constants that a name was given earlier are
propagated through references and `+`, and each literal is scored by how sensitive the names are that it
reaches and by how much it looks like a chosen value. Literals that score enough are added as `pair` spans;
spans that overlap a base span are not repeated.

Null and empty texts have no spans. Rows are handled one by one, so repeated rows give repeated results.
Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerweave.llm.batches import frugal, id_and_text, over_batches, texts_of

KINDS = ("assign", "access", "hex", "pair")
# The shapes that the result must contain.
_ASSIGN = re.compile("(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
_HEX = re.compile("[0-9a-f]{24,}")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: How much a part of a name says that its value is a secret.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 3.0, "secret": 3.0, "token": 3.0, "apikey": 3.0,
    "credential": 3.0, "credentials": 3.0, "auth": 2.0, "authorization": 2.0, "private": 1.5, "access": 1.5,
    "signing": 1.5, "encryption": 1.5, "client": 0.5, "session": 1.0, "key": 1.5, "pass": 2.0, "salt": 1.5,
}
_STEMS = tuple(sorted({stem.encode() for stem in SENSITIVE}))
#: Parts of a name that say that the value only describes a secret.
HARMLESS = {"length", "len", "count", "type", "name", "url", "uri", "path", "file", "header", "field", "label", "id", "expiry", "ttl", "max", "min", "policy"}
#: Values that stand in for a secret.
_PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|-+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|none|null|true|false|todo|change_?me|example|placeholder|your[-_ ].*|test|dummy|redacted|password|secret|token)$")
THRESHOLD = 4.0

_MARK = re.compile(r":=|=>|[:=]")
_NAME = re.compile(r"([A-Za-z_][A-Za-z0-9_.\-]*)[\"'`]?\]?[ \t]*$")
_TERM = re.compile(r"[ \t]*(?:(?P<quote>[\"'`])(?P<body>(?:\\.|(?!(?P=quote))[^\\\n])*)(?P=quote)|(?P<bare>[A-Za-z0-9_+/.$!@#%^&*~{}<>-]+={0,2}))")
_PLUS = re.compile(r"[ \t]*\+[ \t]*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_BEHIND = 120  # a name ends directly before its mark; longer names count by their tail


def base_spans(text: str, lowered: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three fixed shapes."""
    found = []
    if any(word in lowered for word in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"akia" in lowered:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def name_score(name: str) -> float:
    """Sum of the weights of a name's parts; 0 if a part says that the value is no secret."""
    parts = [p.lower() for p in _PARTS.findall(name.rpartition(".")[2] or name)]
    if HARMLESS & set(parts[-1:]):
        return 0.0
    joined = {a + b for a, b in zip(parts, parts[1:])}
    return sum(SENSITIVE.get(p, 0.0) for p in {*parts, *joined})


def literal_score(value: str) -> float:
    """How much a literal looks like a chosen or generated value."""
    if len(value) < 6 or _PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return -10.0
    size = len(value)
    entropy = -sum(n / size * math.log2(n / size) for n in Counter(value).values())
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    return 0.4 * entropy + 0.5 * (kinds - 1) + (0.5 if size >= 16 else 0.0)


def pairs(text: str):
    """(name, literals, references) of each assignment in order; a literal is (start, end, value)."""
    done = 0
    for mark in _MARK.finditer(text):
        if mark.start() < done:
            continue
        name = _NAME.search(text, max(0, mark.start() - _BEHIND), mark.start())
        if not name:
            continue
        literals, references, at = [], [], mark.end()
        while term := _TERM.match(text, at):
            if term["quote"]:
                literals.append((*term.span("body"), term["body"]))
            else:
                bare = term["bare"]
                references.append((*term.span("bare"), bare))
            at = term.end()
            if not (plus := _PLUS.match(text, at)):
                break
            at = plus.end()
        if literals or references:
            done = at
            yield name[1], literals, references


def pair_spans(text: str) -> list[tuple[int, int]]:
    """Literals whose own score and that of the most sensitive name they reach make up the threshold."""
    # what a name stands for: its own literals, what other names stood for then, and the weight it was reached with
    values: dict[str, tuple[list, list, list[float]]] = {}
    score: dict[tuple[int, int, str], float] = {}
    for name, literals, references in pairs(text):
        own, below = list(literals), []
        for start, end, bare in references:
            # a known constant stands for its literals; another bare word is a literal of a configuration file
            if bare in values:
                below.append(values[bare])
            elif any(c.isdigit() for c in bare):
                own.append((start, end, bare))
        if not own and not below:
            values.pop(name, None)
            continue
        values[name] = (own, below, [0.0])
        weight, waiting = name_score(name), [values[name]]
        while waiting:
            own, below, reached = waiting.pop()
            if reached[0] < weight:  # else all below has that weight already
                reached[0] = weight
                for literal in own:
                    score[literal] = max(score.get(literal, 0.0), weight)
                waiting += below
    return sorted((start, end) for (start, end, value), weight in score.items() if weight + literal_score(value) >= THRESHOLD)


def spans_of(raw: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text."""
    text, lowered = raw.decode("utf-8", "replace"), raw.lower()
    base = base_spans(text, lowered)
    if (b"=" not in raw and b":" not in raw) or not any(stem in lowered for stem in _STEMS):
        return base, base
    more, k, last = [], 0, 0
    for start, end in pair_spans(text):
        while k < len(base) and base[k][0] < end:
            last = max(last, base[k][2])
            k += 1
        if last <= start:
            more.append((start, 3, end))
            last = end
    return base, sorted(base + more)


def _listed(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""

    def work(batch: pa.RecordBatch) -> dict:
        found = [spans_of(text) for text in texts_of(batch)]
        base = [b for b, _ in found]
        return {
            "doc_id": batch.column("doc_id"),
            **{f"n_{KINDS[k]}": pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(3)},
            "base_sha256": [hashlib.sha256(_listed(b).encode()).hexdigest() for b in base],
            "spans": [_listed(a) for _, a in found],
        }

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return over_batches(id_and_text(docs, id_col, text_col), work, schema)


def _redacted(raw: bytes, mark: str) -> str:
    text, out, at = raw.decode("utf-8", "replace"), [], 0
    for start, _, end in spans_of(raw)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[redacted]") -> DataFrame:
    """The same rows with every span replaced by a mark; `chars_col`, where present, follows. Null texts stay null."""
    schema, names = docs.schema, docs.columns

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                at = names.index(text_col)
                old = batch.column(at).to_pylist()
                new = [None if t is None else _redacted(t.encode(), mark) for t in old]
                arrays = list(batch.columns)
                arrays[at] = pa.array(new, batch.schema.field(at).type)
                if chars_col in names:
                    k = names.index(chars_col)
                    kept = batch.column(k).to_pylist()
                    arrays[k] = pa.array([c if n == o else len(n) for c, n, o in zip(kept, new, old)], batch.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(frugal(run), schema)
