"""Plain versions of the contracts, written apart from the operators, and documents that hold every hard case."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import xxhash
from tokenizers import Tokenizer

LAST = 2**63 - 1
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id string, fp string, words int, k int, spans string, content binary"


def documents():
    """(doc_id, text, lang): nulls, empty and long texts, ties, repeated rows, copies, near copies, shared passages."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice(["an", "the", "re", "ón", "is", "st", "ou"]) for _ in range(r.randrange(1, 5))) for _ in range(900)]

    def prose(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))

    passage, long = prose(140), prose(6000)
    rows = [(i, prose(r.randrange(1, 260)), "en") for i in range(40)]
    rows += [(100 + i, prose(20) + " " + passage + "\n" + prose(30), "fr") for i in range(6)]
    rows += [(200 + i, rows[3][1] + " " + rows[5][1], "de") for i in range(4)]
    rows += [(300, long, "en"), (301, long + " end", None), (302, "x" * 3000, "en"), (303, "ab " * 1500, "es"), (304, "ab " * 1400, "es")]
    near = prose(400).split(" ")
    for i in range(6):
        own = list(near)
        own[i * 60] = f"changed{i}"
        rows.append((400 + i, " ".join(own), "en"))
    rows += [(500, None, None), (501, "", "en"), (502, " \n\t ", "en"), (None, prose(80), "en"), (None, prose(80), None), (None, rows[3][1], "en")]
    rows += [(7, rows[7][1], "en"), (7, rows[7][1], "en"), (7, prose(90), "en"), (9, rows[7][1], "en")]
    rows += [(600, 'password = "hunter2secret" token: abcdef AKIA' + "Q" * 16 + " " + "0a" * 20, "en"), (601, "日本語 テスト " * 40, "ja"), (602, "ñ'S 1²3 ×÷ <|endoftext|> İ " * 9, None)]
    rows += [(603, "the same line\nthe same line\n\n the same line\n# $ % & | < >", "en"), (604, "one two three four five " * 4, "en")]
    return rows


def table(spark, rows=None, parts=3):
    """The documents with columns whose names operators use themselves."""
    rows = documents() if rows is None else rows
    full = [(i, t, lang, "s", None if t is None else len(t), "clash", None, 1, 2, "x", b"y") for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def sha(x):
    return hashlib.sha256(x).hexdigest()


def same(df, columns, want):
    got = [tuple(row) for row in df.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def base_secrets(text):
    found = []
    shapes = (
        (re.compile("(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 6),
        (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    for kind, (shape, good) in enumerate(shapes):
        found += [(m.start(), kind, m.end()) for m in shape.finditer(text or "") if good(m)]
    return sorted(found)


def fingerprint(text):
    w = words(fold(text))
    if not w:
        return 0
    n = min(3, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_rows(rows, most=3):
    prints = [fingerprint(t) for _, t, _ in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                group[root(i)] = root(j)
    ids = {}
    for i, (doc, _, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return [(d, f"{p:016x}", least[root(i)]) for i, ((d, _, _), p) in enumerate(zip(rows, prints))], [root(i) for i in range(len(rows))]


def repeated_bytes(rows, length):
    texts = [(t or "").encode() for _, t, _ in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, _, _), t in zip(rows, texts):
        hit, end = [False] * len(t), 0
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[max(i, end) : i + length] = [True] * (i + length - max(i, end))
                end = i + length
        runs = sum(1 for i, h in enumerate(hit) if h and not (i and hit[i - 1]))
        out.append((doc, len(t), sum(hit), runs, sha(bytes(b for b, h in zip(t, hit) if not h))))
    return out


def quality_base(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = [False] * len(w)
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            hit[i : i + 5] = [True] * 5
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), sum(hit), len(w) < 10 or 100 * sum(hit) > 20 * len(w)


def token_ids(rows):
    import public_tokenizers

    model = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    return [model.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows]


def pieces(rows, capacity):
    out = []
    for (doc, _, _), ids in zip(rows, token_ids(rows)):
        ids = [*ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((doc, k, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    return out


def removed_words(rows, length):
    texts = [words(t) for _, t, _ in rows]
    ids = [LAST if d is None else d for d, _, _ in rows]
    low = {}
    for d, w in zip(ids, texts):
        for i in range(len(w) - length + 1):
            p = tuple(w[i : i + length])
            low[p] = min(low.get(p, LAST), d)
    out = []
    for (doc, _, _), d, w in zip(rows, ids, texts):
        hit = [False] * len(w)
        for i in range(len(w) - length + 1):
            if low[tuple(w[i : i + length])] < d:
                hit[i : i + length] = [True] * length
        out.append((doc, len(w), sum(hit), sha(" ".join(x for x, h in zip(w, hit) if not h).encode())))
    return out


def contamination(rows, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    out = []
    for doc, text, _ in rows:
        w, hit, found = split(text), set(), set()
        for item, phrase in items:
            p = split(phrase)
            n = min(window, len(p))
            for i in range(len(p) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == p[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add("" if item is None else str(item))
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return out
