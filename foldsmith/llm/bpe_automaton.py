"""Byte-pair encoding by a deterministic automaton compiled from the merges, one gadget a merge.

The automaton reads tokens: its arcs carry token labels and its states tell which labels may follow.  Before any merge it
has one state and an arc a byte; afterwards exactly one path spells each word, and its labels are the word's tokens.  The
gadget of a merge ``u v -> w`` changes three things:

* ``v`` may no longer follow ``u``: the arc labelled ``v`` out of the state after ``u`` is cut;
* wherever ``u`` could be read, ``w`` can be read too: a new label;
* after ``w`` whatever could follow ``v`` until now may follow: a new state, a copy of the state after ``v``.

So a state is named by the token that leads to it.  Copies share what they copy: a state keeps the state it was copied
from and the time of the copy, a label the label it went beside, and only the cut arc is stored of each gadget, which
keeps tables of the size of the vocabulary where all arcs written out would be its square.  An arc is found by walking
back through the copies, and remembered.

A word is read from the left: from a state and a position the longest label is taken that continues the text (a trie of
the labels, walked by a table), then the next shorter one, until an arc carries it; a dead end goes back by an arc.  As
each position is reached by one path only, no position is tried twice, and the work follows the length of the word.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .common import map_batches

#: Fixed value: the split pattern of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and arcs a worker remembers at once; longer words are read anew each time.
MOST_WORDS, MOST_ARCS, LONGEST_WORD = 500_000, 500_000, 64
NONE = -1


def bytes_of_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Automaton:
    """``labels`` are the bytes of each token by id, ``merges`` pairs of ids with the id they make, in order."""

    def __init__(self, labels: dict[int, bytes], merges: Sequence[tuple[int, int, int]]):
        self.labels = labels
        most = max(labels, default=0) + 1
        self.born = [0] * most  # the merge that made the label and its state; 0 for a byte
        self.beside, self.copied = [NONE] * most, [NONE] * most
        self.cut: dict[int, int] = {}  # arc (state, label): the merge that cut it
        self.known: dict[int, bool] = {}
        alive = {i for i, label in labels.items() if len(label) == 1}
        for time, merge in enumerate(merges, 1):
            # a merge of labels that no text ever has side by side adds nothing
            if self._gadget(time, *merge) and alive.issuperset(merge[:2]):
                alive.add(merge[2])
        self._number({labels[i]: i for i in alive})

    def _gadget(self, time: int, u: int, v: int, w: int) -> bool:
        if self.born[w] or len(self.labels[w]) == 1:
            raise ValueError(f"two merges make token {w}")
        follows = self._exists(u, v, time - 1)
        self.cut.setdefault(u << 32 | v, time)
        self.born[w], self.beside[w], self.copied[w] = time, u, v
        return follows

    def _exists(self, state: int, label: int, time: int) -> bool:
        """Whether the arc is there after ``time`` merges."""
        while True:
            if self.cut.get(state << 32 | label, time + 1) <= time:
                return False
            if self.born[label] >= self.born[state]:
                if not self.born[label]:
                    return True
                time, label = self.born[label], self.beside[label]  # added next to an arc that its gadget left
            else:
                time, state = self.born[state] - 1, self.copied[state]  # copied before its gadget cut an arc

    def arc(self, state: int, label: int) -> bool:
        """Whether ``label`` may follow the token that leads to ``state``."""
        if len(self.known) >= MOST_ARCS:
            self.known.clear()
        return self.known.setdefault(state << 32 | label, self._exists(state, label, len(self.born)))

    def _number(self, ids: dict[bytes, int]) -> None:
        """The tables: a trie over the labels, and for each label the next shorter one that it begins with."""
        self.goto: dict[int, int] = {}
        self.ends = [NONE]
        self.shorter = [NONE] * len(self.born)
        self.size = [0] * len(self.born)
        for label in sorted(ids):
            node, last = 0, NONE
            for byte in label:
                last = self.ends[node] if self.ends[node] >= 0 else last
                after = self.goto.get(node << 8 | byte)
                if after is None:
                    after = self.goto[node << 8 | byte] = len(self.ends)
                    self.ends.append(NONE)
                node = after
            self.ends[node] = ids[label]
            self.shorter[ids[label]], self.size[ids[label]] = last, len(label)
        self.whole = ids

    def longest(self, word: bytes, start: int) -> int:
        node, found, goto, ends = 0, NONE, self.goto, self.ends
        for k in range(start, len(word)):
            node = goto.get(node << 8 | word[k])
            if node is None:
                break
            if ends[node] >= 0:
                found = ends[node]
        return found

    def read(self, word: bytes) -> list[int]:
        """The labels of the one path that spells ``word``."""
        if word in self.whole:  # its own path is the shortest
            return [self.whole[word]]
        if not word:
            return []
        known, size, shorter, most = self.known, self.size, self.shorter, len(word)
        path, dead, at, state = [], set(), 0, NONE
        label = self.longest(word, 0)
        while True:
            while label >= 0:
                if at + size[label] not in dead:
                    if state < 0:
                        break
                    follows = known.get(state << 32 | label)
                    if self.arc(state, label) if follows is None else follows:
                        break
                label = shorter[label]
            if label >= 0:
                path.append(label)
                at += size[label]
                if at == most:
                    return path
                state, label = label, self.longest(word, at)
            else:
                dead.add(at)
                if not path:
                    raise ValueError(f"no token for byte {word[at]} of {word[:40]!r}")
                label = path.pop()
                at -= size[label]
                state, label = path[-1] if path else NONE, shorter[label]


class _Words(dict):
    """Little-endian ids of words; the common ones are remembered."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.automaton.read(word.encode()), dtype="<u4").tobytes()
        if len(word) <= LONGEST_WORD:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Text to ids and back, equal to the tokenizers library on the same file without special tokens added."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        if (model.get("type", "BPE") != "BPE" or spec.get("normalizer") is not None or split.get("type") != "ByteLevel"
                or split.get("add_prefix_space") or not split.get("use_regex", True) or model.get("dropout")
                or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
                or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip"))):
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        self.path, byte_of = path, bytes_of_characters()
        self.added = {t["content"]: t["id"] for t in added}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.added}
        labels = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.words = _Words(Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]))
        shown = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
                 for t, i in self.added.items()}
        self.shown = labels | shown
        self.split = regex.compile(PATTERN)
        names = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self.cut.split(text) if self.cut and any(a in text for a in self.added) else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.added[part].to_bytes(4, "little"))
            else:
                out.append(b"".join(map(self.words.__getitem__, self.split_words(part))))
        return b"".join(out)

    def split_words(self, text: str) -> list[str]:
        """The library's own split, by the same pattern.

        Character classes of libraries differ for code points that this Unicode version has not assigned: texts that
        hold one are split by the library.
        """
        if not text.isascii() and unassigned()[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
            return [text[a:b] for _, (a, b) in _library(self.path).pre_tokenizer.pre_tokenize_str(text)]
        return self.split.findall(text)

    def decode(self, ids: Sequence[int]) -> str:
        """The labels of the arcs, one after the other; ids without a token give nothing."""
        try:
            data = b"".join(map(self.shown.__getitem__, ids))
        except KeyError:
            data = b"".join(self.shown.get(i, b"") for i in ids)
        return data.decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def unassigned() -> np.ndarray:
    """For every code point, whether it has no category here."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


@functools.lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def load_codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """(id, ids) of every row; a null text is empty and has no ids, null and repeated ids are rows like any other.

    ``ids`` is an array, or with ``packed`` little-endian unsigned 32-bit integers in one binary value.  Other columns
    are ignored, an empty table gives an empty result.  A text of any length is read in time that follows its length;
    the strings of added tokens in a text become those tokens, as in the library.
    """
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = rows.schema["id"].dataType.simpleString()

    def make():
        codec = load_codec(tokenizer)

        def step(batch: pa.RecordBatch):
            found = [codec.encode(text or "") for text in batch.column("text").to_pylist()]
            ids = pa.array(found, pa.binary()) if packed else pa.array(
                [np.frombuffer(f, "<u4").astype(np.int32) for f in found], pa.list_(pa.int32()))
            return {"id": batch.column("id"), "ids": ids}

        return step

    return map_batches(rows, make, f"id {kind}, ids {'binary' if packed else 'array<int>'}").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, tokenizer: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``tokens`` with the text of its ids (array or packed) in ``out``; null ids give a null text."""
    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema}
    if out in kinds:
        raise ValueError(f"column {out} exists")

    def make():
        codec = load_codec(tokenizer)

        def step(batch: pa.RecordBatch):
            cells = batch.column(ids_col).to_pylist()
            texts = [None if c is None else codec.decode(np.frombuffer(c, "<u4").tolist() if isinstance(c, bytes) else c)
                     for c in cells]
            return {n: batch.column(n) for n in kinds} | {out: texts}

        return step

    return map_batches(tokens, make, ", ".join(f"`{n}` {k}" for n, k in kinds.items()) + f", `{out}` string")

