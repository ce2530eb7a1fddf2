"""Quality rules: counts of a text's words and lines, and the fertility of a public vocabulary on it.

Base rules reject texts of fewer than ten words and texts in which over a fifth of the words stand in repeated
five-word windows. The fertility rules encode every word with a public vocabulary and measure characters per
token, the share of byte-fallback tokens, and the entropy of the tokens relative to the most that many
tokens can have; a text outside the band of its language (or of its script, where the language is unknown) is rejected.

Null texts have no words and are rejected. Rows are handled one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.batches import frugal, over_batches, texts_of
from ledgerweave.llm.synchronise import U, mix
from ledgerweave.llm.tokens import sentence_pieces
from ledgerweave.llm.words import NOT_SPACE, covered, per_text, windows, words_of

VOCABULARY = "piece_bpe_32k.model"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20


@dataclass(frozen=True)
class Band:
    """Accepted range of characters per token, largest share of byte tokens, least relative entropy."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float


#: Bits per token that are enough at any length: the entropy of a language is bounded, the most that n tokens can have is not.
ENOUGH_BITS = 6.0

#: By language, then by script of most letters, then for all others. Scripts that the vocabulary writes in bytes
#: have no byte limit; scripts without spaces or with one token a character have short tokens.
BANDS = {
    "en": Band(1.1, 7.0, 0.05, 0.45),
    "de": Band(1.1, 7.0, 0.05, 0.45),
    "fr": Band(1.1, 7.0, 0.05, 0.45),
    "es": Band(1.1, 7.0, 0.05, 0.45),
    "latin": Band(1.0, 8.0, 0.20, 0.40),
    "cyrillic": Band(1.0, 8.0, 0.30, 0.40),
    "greek": Band(0.6, 8.0, 0.60, 0.35),
    "cjk": Band(0.2, 4.0, 1.00, 0.30),
    "other": Band(0.2, 12.0, 1.00, 0.30),
}
_BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
_MEASURES = "chars_per_token double, byte_share double, token_entropy double"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80
# leading bytes of two-byte characters up to U+024F, of Greek, of Cyrillic, and of three-byte East Asian characters
_SCRIPTS = {"latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)], "greek": [0xCE, 0xCF], "cyrillic": [0xD0, 0xD1, 0xD2, 0xD3], "cjk": [0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xEB, 0xEC, 0xED]}


def script_of(raw: bytes) -> str:
    """The script that most of a text's characters belong to, by their leading bytes."""
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    sums = {name: int(counts[leads].sum()) for name, leads in _SCRIPTS.items()}
    rest = int(counts[0xC0:].sum()) - int(counts[0xC3:0xCA].sum()) - sum(sums[s] for s in ("greek", "cyrillic", "cjk"))
    best = max(sums, key=lambda name: sums[name])
    return best if sums[best] > rest else "other"


def _duplicate_lines(raw: bytes) -> int:
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def measure(texts: list[bytes], languages: list[str | None], vocabulary: str, bands: dict[str, Band]) -> dict[str, np.ndarray]:
    """All measures and verdicts of a list of texts."""
    words = words_of(texts, NOT_SPACE)
    n_words = words.counts()
    sizes = words.ends - words.starts
    buffer = np.frombuffer(words.joined, dtype=np.uint8)
    chars = np.concatenate([[0], np.cumsum(_LEAD[buffer] & NOT_SPACE[buffer])])
    word_chars = per_text(chars[words.ends] - chars[words.starts], words.offsets)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[buffer])])
    n_symbols = per_text(symbols[words.ends] - symbols[words.starts], words.offsets)

    # windows of one text that occur twice: names salted with the text, so one sort serves the whole list
    owner = words.owner()
    repeat = np.zeros(len(sizes), dtype=np.int64)
    names = windows(words.first, WINDOW)
    inside = np.flatnonzero(owner[: len(names)] == owner[WINDOW - 1 : WINDOW - 1 + len(names)])
    if len(inside):
        salted = names[inside] ^ mix(owner[inside].astype(U) + U(1))
        order = np.argsort(salted)
        same = salted[order][1:] == salted[order][:-1]
        twice = np.zeros(len(inside), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        repeat = covered(inside[twice], WINDOW, len(sizes)).astype(np.int64)
    n_repeat = per_text(repeat, words.offsets)

    memory, is_byte = sentence_pieces(vocabulary)
    ids, per_word = memory.flat(words)
    ends = np.concatenate([[0], np.cumsum(per_word)])[words.offsets]
    n_tokens = np.diff(ends)
    byte_share = per_text(is_byte[ids], ends) / np.maximum(n_tokens, 1)
    text_of = np.repeat(np.arange(len(texts)), n_tokens)
    pair, times = np.unique(text_of * (1 << 20) + ids, return_counts=True)
    p = times / np.maximum(n_tokens, 1)[pair >> 20]
    entropy = np.bincount(pair >> 20, weights=-p * np.log2(p), minlength=len(texts))
    most = np.log2(np.maximum(np.minimum(n_tokens, len(is_byte)), 2))
    per_token = word_chars / np.maximum(n_tokens, 1)

    base_failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)
    chosen = [bands.get(lang or "") or bands[script_of(text)] for text, lang in zip(texts, languages)]
    low, high, fallback, least = (np.array([getattr(b, f) for b in chosen]) for f in ("least_chars", "most_chars", "most_bytes", "least_entropy"))
    good = (per_token >= low) & (per_token <= high) & (byte_share <= fallback) & ((entropy / most >= least) | (entropy >= ENOUGH_BITS))
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols,
        "n_dup_lines": np.array([_duplicate_lines(t) for t in texts], dtype=np.int64), "n_repeat_words": n_repeat,
        "base_failed": base_failed, "kept": ~base_failed & good,
        "chars_per_token": per_token, "byte_share": byte_share, "token_entropy": entropy,
    }


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
                  vocabulary: str = VOCABULARY, bands: dict[str, Band] | None = None) -> DataFrame:
    """One row per document: base counts, measures and verdict. Without a language column the script decides."""
    chosen = bands or BANDS
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))

    def work(batch: pa.RecordBatch) -> dict:
        made = measure(texts_of(batch), batch.column("lang").to_pylist(), vocabulary, chosen)
        return {"doc_id": batch.column("doc_id"), **made}

    return over_batches(source, work, f"doc_id long, {_BASE_SCHEMA}, {_MEASURES}")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY,
              bands: dict[str, Band] | None = None) -> DataFrame:
    """The rows that the rules keep, unchanged."""
    chosen, names = bands or BANDS, docs.columns

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 128):
                batch = whole.slice(low, 128)
                texts = [t or b"" for t in batch.column(names.index(text_col)).cast(pa.binary()).to_pylist()]
                languages = batch.column(names.index(lang_col)).to_pylist() if lang_col in names else [None] * len(texts)
                yield batch.filter(pa.array(measure(texts, languages, vocabulary, chosen)["kept"]))

    return docs.mapInArrow(frugal(run), docs.schema)
