"""Personal data: exact base patterns plus a semi-Markov conditional random field.

The base finds e-mail addresses, IP addresses, payment cards and phone numbers by fixed patterns, in time linear in
the text.  The field reads the places where digits or ``@`` occur, scores whole candidate segments (shape, checksum,
digit counts, words before) and jointly chooses boundaries and types by dynamic programming over segments of at most
``MOST_TOKENS`` tokens.  It adds spans the patterns cannot find; a span that overlaps a base span is dropped.

The field is trained here by conditional likelihood on a bounded sample of windows whose base spans and quoted keys
serve as labels.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .common import map_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
Span = tuple[str, int, int]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All base spans, by kind as listed, then start; positions are code points, ends exclusive."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:  # a match must run from the start of the local characters before its ``@``
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        got = DOMAIN.match(text, at + 1) if start < at else None
        free = got.end() if got else at + 1
        if got:
            out.append(("email", start, free))
        at = text.find("@", free)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


# --- the semi-Markov field -------------------------------------------------------------------------------------

MOST_TOKENS = 16
REACH = 16  # tokens read on each side of a token with a digit or an @
TOKEN = re.compile(r"[^\W_]+|\S")
SEED = re.compile(r"[0-9@]")
N_FEATURES = 64
LABELLED_KEY = re.compile(r"(?:token|secret|api_key|password)\s*=\s*\"([0-9A-Fa-f]{16,})\"", re.I)
SAMPLE_WINDOWS = 400
SAMPLE_CHARS = 4000  # windows above this are not trained on, which bounds what the driver gets
EPOCHS = 6


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Runs of tokens (start, end) within ``REACH`` tokens of a seed; nothing outside can be part of a segment."""
    if not SEED.search(text):
        return []
    tokens = [m.span() for m in TOKEN.finditer(text)]
    out: list[list[tuple[int, int]]] = []
    first, past = 0, -1
    for k, t in enumerate(tokens):
        if SEED.search(text, *t):
            if k - REACH > past:  # does not meet the run before it
                if past > 0:
                    out.append(tokens[first:past])
                first = max(0, k - REACH)
            past = min(len(tokens), k + REACH + 1)
    return [*out, tokens[first:past]]


def _digit_class(n: int) -> int:
    return 0 if n == 0 else 1 if n < 4 else 2 if n < 7 else 3 if n < 9 else 4 if n < 13 else 5 if n <= 16 else \
        6 if n <= 19 else 7


def segment_features(text: str, tokens: Sequence[tuple[int, int]], i: int, j: int) -> list[int] | None:
    """Features of the whole segment of tokens i..j-1, or None where no entity can lie."""
    a, b = tokens[i][0], tokens[j - 1][1]
    s = text[a:b]
    first, final = s[0], s[-1]
    if not (first.isalnum() or first in "+(") or not final.isalnum():
        return None
    ascii_digits = sum("0" <= c <= "9" for c in s)
    if not ascii_digits and "@" not in s:
        return None
    letters = sum(c.isalpha() for c in s)
    f = [0, 1 + _digit_class(ascii_digits)]
    f.append(9 + min(letters, 3) if letters < 3 else 12)
    f.append(13 + min(s.count("@"), 2))
    f.append(16 + min(s.count("."), 4))
    f.append(21 + min(sum(c.isspace() for c in s), 3))
    if first == "+":
        f.append(25)
    if "(" in s and s.count("(") == s.count(")"):
        f.append(26)
    if s.count("(") != s.count(")"):
        f.append(27)
    if ascii_digits and not letters and 13 <= ascii_digits <= 19:
        f.append(28 if luhn("".join(c for c in s if "0" <= c <= "9")) else 29)
    parts = s.split(".")
    if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and p.isascii() for p in parts):
        f.append(30 if all(int(p) <= 255 for p in parts) else 31)
    if "@" in s and DOMAIN.fullmatch(s.partition("@")[2]) and LOCAL_END.match(s.partition("@")[0]):
        f.append(32)
    if len(s) >= 16 and all(c in "0123456789abcdefABCDEF" for c in s):
        f.append(33 if letters else 34)
    f.append(35 + min(j - i, 16) // 2)  # 35..43
    before, after = text[a - 1:a], text[b:b + 1]
    f.append(44 if not before or before.isspace() else 45 if before in "\"'(<[:=" else 46 if before.isalnum() else 47)
    f.append(48 if not after or after.isspace() else 49 if after in "\"'.,;:)>]!?" else 50 if after.isalnum() else 51)
    if i >= 3 and text[tokens[i - 1][0]] in "\"'" and text[tokens[i - 2][0]] in "=:":
        f.append(52)  # a quoted value
    if before and after and (before in "+@.-" and not before.isspace() or after in "@"):
        f.append(53)  # cuts a longer chain
    if j < len(tokens) - 1 and after in ".-@" and text[tokens[j][1]:tokens[j][1] + 1].isalnum():
        f.append(54)
    if any(c in "=;,\"'<>[]{}|/\\!?*#$&" for c in s):
        f.append(55)
    if "%" in s or "_" in s:
        f.append(56)
    if "-" in s:
        f.append(57)
    return f


def segments(text: str, tokens: Sequence[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """(i, j, features) of every segment of at most ``MOST_TOKENS`` tokens that can be an entity, by its start."""
    seeded = bytearray(bool(SEED.search(text, *t)) for t in tokens)
    for i, (start, _) in enumerate(tokens):
        if not (text[start].isalnum() or text[start] in "+("):
            continue
        most = min(i + MOST_TOKENS, len(tokens))
        seed = seeded.find(1, i, most)
        for j in range(seed + 1, most + 1) if seed >= 0 else ():
            if (f := segment_features(text, tokens, i, j)) is not None:
                yield i, j, f


def decode(text: str, tokens: Sequence[tuple[int, int]], weights: np.ndarray) -> list[Span]:
    """The best segmentation: single tokens outside score 0, segments the sum of their type's weights.

    Segments are scored as the walk reaches their start.  Only the scores of the positions a segment can reach are
    held; of every position two bytes stay, the kind and the length of the segment that ends there.
    """
    n = len(tokens)
    kinds, lengths = bytearray(n + 1), bytearray(n + 1)  # length 0: the token before lies outside
    offers: deque[list] = deque([0.0, 0, 0] for _ in range(MOST_TOKENS + 1))  # best segment up to each position ahead
    best, at = 0.0, 0

    def walk(to: int) -> None:
        nonlocal best, at
        while at < to:
            offers.popleft()
            offers.append([0.0, 0, 0])
            at += 1
            score, kind, length = offers[0]
            if length and score > best:
                best, kinds[at], lengths[at] = score, kind, length

    for i, j, f in segments(text, tokens):
        walk(i)
        scores = weights[:, f].sum(axis=1)
        y = int(scores.argmax())
        if scores[y] > 0:
            offer = offers[j - i]
            if not offer[2] or best + float(scores[y]) > offer[0]:
                offer[:] = best + float(scores[y]), y, j - i
    walk(n)
    out, j = [], n
    while j > 0:
        if lengths[j]:
            out.append((KINDS[kinds[j]], tokens[j - lengths[j]][0], tokens[j - 1][1]))
        j -= lengths[j] or 1
    return out[::-1]


def train(texts: Sequence[str], epochs: int = EPOCHS, rate: float = 0.3, penalty: float = 1e-3) -> np.ndarray:
    """Weights (kind, feature) that maximise the conditional likelihood of the labelled windows, by Adagrad."""
    weights = np.zeros((len(KINDS), N_FEATURES))
    weights[:, 0] = -2.0
    squares = np.full_like(weights, 1e-6)
    examples = []
    for text in texts:
        gold = {(s, e): KINDS.index(k) for k, s, e in base_spans(text)}
        gold |= {m.span(1): KINDS.index("secret") for m in LABELLED_KEY.finditer(text)}
        for tokens in windows(text):
            found = list(segments(text, tokens))
            if found:
                labels = [gold.get((tokens[i][0], tokens[j - 1][1]), -1) for i, j, _ in found]
                examples.append((len(tokens), found, labels))
    for _ in range(epochs):
        for n, found, labels in examples:
            scores = np.array([weights[:, f].sum(axis=1) for _, _, f in found])
            sums = np.logaddexp.reduce(scores, axis=1)
            ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
            by_end: dict[int, list[int]] = {}
            by_start: dict[int, list[int]] = {}
            for k, (i, j, _) in enumerate(found):
                by_end.setdefault(j, []).append(k)
                by_start.setdefault(i, []).append(k)
            for j in range(1, n + 1):
                ahead[j] = _logsum([ahead[j - 1], *[ahead[found[k][0]] + sums[k] for k in by_end.get(j, ())]])
            for i in range(n - 1, -1, -1):
                behind[i] = _logsum([behind[i + 1], *[behind[found[k][1]] + sums[k] for k in by_start.get(i, ())]])
            gradient = -penalty * weights
            for k, (i, j, f) in enumerate(found):
                share = np.exp(ahead[i] + behind[j] - ahead[n] + scores[k])
                if labels[k] >= 0:
                    share = -share
                    share[labels[k]] += 1
                else:
                    share = -share
                if np.abs(share).max() > 1e-4:
                    gradient[:, f] += share[:, None]
            squares += gradient ** 2
            weights += rate * gradient / np.sqrt(squares)
    return weights


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top if len(values) == 1 else top + math.log(sum(math.exp(v - top) for v in values))


def find_spans(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """The base spans, and the field's spans that overlap none of them."""
    base = base_spans(text)
    taken = bytearray(len(text) + 1) if base else b""
    for _, s, e in base:
        taken[s:e] = b"\x01" * (e - s)
    added = [(kind, s, e) for tokens in windows(text) for kind, s, e in decode(text, tokens, weights)
             if 1 not in taken[s:e]]
    return base, added


def fit(docs: DataFrame, text_col: str = "text", most: int = SAMPLE_WINDOWS) -> np.ndarray:
    """Train on at most ``most`` different windows of ``docs`` of at most ``SAMPLE_CHARS``, the first by a hash of their text.

    Null texts and those without digits or ``@`` have no windows; equal windows count once; an empty table gives weights
    that find nothing.
    """
    rows = spread(docs.select(F.col(text_col).alias("text")).filter(F.col(text_col).rlike("[0-9@]")))

    def make():
        def step(batch: pa.RecordBatch):
            cut = [t[w[0][0]:w[-1][1]] for t in batch.column("text").to_pylist() for w in windows(t)]
            return {"cut": [c for c in cut if len(c) <= SAMPLE_CHARS]}
        return step

    cuts = map_batches(rows, make, "cut string").distinct()
    sample = cuts.orderBy(F.xxhash64("cut"), "cut").limit(most).collect()
    return train([r.cut for r in sample])


def detect(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row: an array of (kind, start, end, is_base) by kind, then start.

    A null or empty text has no spans; ids may be null or repeated; other columns are ignored and an empty table gives an
    empty result.  Time and memory follow the length of a text, tables of numbers of many megabytes included.
    """
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = rows.schema["id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch):
            found = []
            for text in batch.column("text").to_pylist():
                base, added = find_spans(text, weights) if text else ((), ())
                every = [(KINDS.index(k), s, e, b) for spans, b in ((base, True), (added, False)) for k, s, e in spans]
                found.append([{"kind": KINDS[k], "start": s, "end": e, "is_base": b} for k, s, e, b in sorted(every)])
            return {"id": batch.column("id"), "spans": found}
        return step

    return (map_batches(rows, make, f"id {kind}, "
                        "spans array<struct<kind:string,start:bigint,end:bigint,is_base:boolean>>")
            .withColumnRenamed("id", id_col))


def mask(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``<KIND>``; overlapping spans are replaced as one.

    Columns stay as they are, whatever they are named; null texts stay null, and an empty table stays empty.
    """
    names, kinds = docs.columns, [f.dataType.simpleString() for f in docs.schema]
    at = names.index(text_col)
    ddl = ", ".join(f"c{k} {kind}" for k, kind in enumerate(kinds))

    def make():
        def step(batch: pa.RecordBatch):
            out = {f"c{k}": batch.column(k) for k in range(batch.num_columns)}
            out[f"c{at}"] = [t and replace(t, sum(find_spans(t, weights), [])) for t in batch.column(at).to_pylist()]
            return out
        return step

    return map_batches(spread(docs.toDF(*[f"c{k}" for k in range(len(names))])), make, ddl).toDF(*names)


def replace(text: str, spans: Sequence[Span]) -> str:
    out, done = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= done:
            out += [text[done:s], f"<{kind.upper()}>"]
        done = max(done, e)
    return "".join([*out, text[done:]])
