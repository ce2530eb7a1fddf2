"""Text similarity in numpy and plain Python, for use inside Spark tasks.

Jaro-Winkler works on whole arrays of pairs at once. The token and partial ratios
follow their published definitions over the indel ratio (twice the longest common
subsequence over the summed lengths); callers pass distinct values only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerweave.functions.text import as_col

_PREFIX_LIMIT, _PREFIX_WEIGHT, _BOOST_FROM = 4, 0.1, 0.7


def code_points(texts) -> tuple[np.ndarray, np.ndarray]:
    """Code points as a zero-padded matrix, with the lengths."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int32, count=len(texts))
    width = int(lengths.max()) if len(texts) else 0
    flat = np.array(list(texts), dtype=f"<U{max(width, 1)}").view(np.uint32).reshape(len(texts), max(width, 1))
    return flat.astype(np.int32), lengths


def jaro_winkler_codes(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Jaro-Winkler of n pairs given as padded code matrices."""
    n, wa = a.shape
    wb = b.shape[1]
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    used_a = np.zeros((n, wa), dtype=bool)
    used_b = np.zeros((n, wb), dtype=bool)
    columns = np.arange(wb, dtype=np.int32)
    for i in range(int(la.max()) if n else 0):
        free = (b == a[:, i : i + 1]) & ~used_b & (np.abs(columns[None, :] - i) <= reach[:, None])
        free &= (columns[None, :] < lb[:, None]) & (i < la)[:, None]
        hit = free.any(axis=1)
        rows = np.flatnonzero(hit)
        used_b[rows, free[rows].argmax(axis=1)] = True
        used_a[rows, i] = True
    matches = used_a.sum(axis=1)
    width = int(matches.max()) if n else 0
    moved = np.zeros(n, dtype=np.int64)
    if width:
        moved = (_packed(a, used_a, matches, width) != _packed(b, used_b, matches, width)).sum(axis=1)
    m = matches.astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (m / la + m / lb + (m - moved // 2) / m) / 3.0
    jaro = np.where(matches > 0, jaro, 0.0)
    jaro = np.where((la == 0) & (lb == 0), 1.0, jaro)
    k = min(_PREFIX_LIMIT, wa, wb)
    inside = np.arange(k)[None, :] < np.minimum(la, lb)[:, None]
    prefix = np.cumprod((a[:, :k] == b[:, :k]) & inside, axis=1).sum(axis=1)
    return np.where(jaro > _BOOST_FROM, jaro + prefix * _PREFIX_WEIGHT * (1.0 - jaro), jaro)


def _packed(codes: np.ndarray, used: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Matched characters of each row, moved to the front in order."""
    out = np.zeros((codes.shape[0], width), dtype=codes.dtype)
    out[np.arange(width)[None, :] < counts[:, None]] = codes[used]
    return out


def jaro_winkler(left, right) -> np.ndarray:
    """Jaro-Winkler of equally long sequences of texts."""
    if not len(left):
        return np.zeros(0)
    a, la = code_points(left)
    b, lb = code_points(right)
    return jaro_winkler_codes(a, la, b, lb)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, as a bit-parallel count."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & where.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * _common(a, b) / total


def _tokens(text: str) -> tuple[list[str], set[str]]:
    words = text.split()
    return sorted(words), set(words)


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(_tokens(a)[0]), " ".join(_tokens(b)[0]))


def token_set_ratio(a: str, b: str) -> float:
    """Best of: shared words against shared words plus the rest of either side, and the two sums."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = " ".join(sorted(left & right))
    only_a, only_b = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if shared and (not only_a or not only_b):
        return 100.0
    full_a = f"{shared} {only_a}".strip()
    full_b = f"{shared} {only_b}".strip()
    best = ratio(full_a, full_b) if not shared else _shared_prefix_ratio(shared, only_a, only_b)
    if shared:
        best = max(best, ratio(shared, full_a), ratio(shared, full_b))
    return best


def _shared_prefix_ratio(shared: str, only_a: str, only_b: str) -> float:
    """Ratio of 'shared a' and 'shared b' where the shared part is aligned with itself."""
    head = len(shared) + 1
    total = 2 * head + len(only_a) + len(only_b)
    return 200.0 * (head + _common(only_a, only_b)) / total


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against any window of the longer one, cut windows at the ends included."""
    if not a or not b:
        return 100.0 if not a and not b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = _best_window(short, long)
    if len(a) == len(b) and best < 100.0:
        best = max(best, _best_window(long, short))
    return best


def _best_window(short: str, long: str) -> float:
    width = len(short)
    starts = range(-width + 1, len(long))
    return max(ratio(short, long[max(s, 0) : s + width]) for s in starts)


def weighted_ratio(a: str, b: str) -> float:
    """Best of the plain, token and partial ratios, each with its usual weight."""
    if not a or not b:
        return 0.0
    stretch = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if stretch < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if stretch <= 8.0 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * _partial_token_ratio(a, b))


def _partial_token_ratio(a: str, b: str) -> float:
    (sorted_a, set_a), (sorted_b, set_b) = _tokens(a), _tokens(b)
    if set_a & set_b:
        return 100.0
    best = partial_ratio(" ".join(sorted_a), " ".join(sorted_b))
    if len(sorted_a) == len(set_a) and len(sorted_b) == len(set_b):
        return best
    return max(best, partial_ratio(" ".join(sorted(set_a)), " ".join(sorted(set_b))))


# --- metaphone as rewrite rules -----------------------------------------------------------------
# Lower-case letters are still to be coded, upper-case letters are codes. The order matters: rules that
# look at neighbours run before the rules that code those neighbours.
_METAPHONE_RULES = (
    (r"^(?:[kgp](?=n)|w(?=r)|a(?=e))", ""),   # silent first letters
    (r"([^c])\1+", "$1"),                       # doubled letters, except cc
    (r"^x(?=h|i[oa])", "X"), (r"^x", "S"), (r"x", "KS"),
    (r"^wh", "w"),
    (r"(?<!^)(?<=m)b$", ""), (r"b", "B"),
    (r"(?<=c)k", ""),
    (r"(?<=s)ch", "k"), (r"(?<=s)c(?=[iey])", ""),
    (r"ci(?=a)|ch", "X"), (r"c[iey]", "S"), (r"c", "K"),
    (r"dg[iey]", "J"), (r"d", "T"),
    (r"gh(?![aeiou]|$)", "h"), (r"gn$", "n"), (r"g(?=[iey])", "J"), (r"g", "K"),
    (r"ph", "F"), (r"p", "P"), (r"q", "K"), (r"k", "K"),
    (r"sh|si[oa]", "X"), (r"s", "S"),
    (r"th", "0"), (r"t(?=i[oa])", "X"), (r"t(?=ch)", ""), (r"t", "T"),
    (r"v", "F"), (r"z", "S"),
    (r"[wy](?![aeiou])", ""),
    (r"(?<=[aeiou])h(?![aeiou])", ""),
    (r"(?<!^)(?<! )[aeiou]", ""),
    (r" +", " "),
)


def metaphone(c: Column | str) -> Column:
    """Sound code of a name as a chain of rewrites, evaluated by Spark without Python."""
    code = F.lower(as_col(c))
    for pattern, replacement in _METAPHONE_RULES:
        code = F.regexp_replace(code, pattern, replacement)
    return F.upper(code)
