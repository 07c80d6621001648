"""Best-fit packing of token pieces under several capacities at once.

A piece uses tokens, one of the sequence's document places, and attention cost (its length squared).  All three follow
from its length, so pieces fall into as many classes as a sequence has tokens, and vector best-fit can be run over the
histogram of lengths: a class is placed, longest first, into groups of equal bins.  The group is the one whose residual
vector fits best, by weighted dot-product or by weighted norm of what would remain, under every capacity.  A group that
takes only some items is split, so groups and placements stay a few per class however many pieces there are.

The placements (runs of ranks within a class) then go to all executors, and each piece finds its sequence by its rank.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, spread
from .common import map_batches

ROWS_PER_BUCKET = 20_000
#: The backtracking split gives up on white space somewhat longer than this; it is looked for from its start only.
LONG_SPACE = re.compile(r"(?<!\s)\s{100000}")


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence, and the weights of the three residuals when bins are compared."""
    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)


@dataclass(frozen=True)
class Run:
    """``count`` pieces of one length, from rank ``rank`` on, go to sequences ``first``, ``first`` + 1, ..."""
    length: int
    rank: int
    count: int
    first: int
    offset: int


def best_fit(histogram: dict[int, int], limits: Limits = Limits(), rule: str = "norm") -> list[Run]:
    """Vector best-fit, longest class first.  ``rule`` is ``norm`` (least residual) or ``dot`` (best aligned)."""
    full = np.array([limits.tokens, limits.documents, limits.attention], dtype=np.float64)
    weights = np.array(limits.weights)
    runs: list[Run] = []
    left = np.empty((0, 3))  # residual vectors of the open groups
    first, count = np.empty(0, np.int64), np.empty(0, np.int64)
    opened = 0
    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, length * length], dtype=np.float64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens is above a capacity")
        todo, rank = histogram[length], 0
        while todo:
            fits = np.flatnonzero((left >= need).all(axis=1))
            if not len(fits):
                each = int((full // need).min())
                for bins, items in ((todo // each, each), (1, todo % each)):
                    if bins and items:
                        runs += [Run(length, rank + k * bins, bins, opened, k * length) for k in range(items)]
                        left = np.vstack([left, full - items * need])
                        first, count = np.append(first, opened), np.append(count, bins)
                        opened, rank = opened + bins, rank + bins * items
                todo = 0
                break
            after = (left[fits] - need) / full
            if rule == "norm":
                best = fits[np.argmin((weights * after ** 2).sum(axis=1))]
            else:
                best = fits[np.argmin(-((weights * need / full) * (left[fits] / full)).sum(axis=1))]
            take = int(min(todo, count[best]))
            runs.append(Run(length, rank, take, int(first[best]), int(limits.tokens - left[best, 0])))
            if take < count[best]:  # the rest of the group stays as it is
                left = np.vstack([left, left[best]])
                first, count = np.append(first, first[best] + take), np.append(count, count[best] - take)
                count[best] = take
            left[best] -= need
            rank, todo = rank + take, todo - take
        keep = (left[:, 0] >= 1) & (left[:, 1] >= 1) & (left[:, 2] >= 1)
        left, first, count = left[keep], first[keep], count[keep]
    return runs


def fewest(histogram: dict[int, int], limits: Limits) -> list[Run]:
    """The better of both rules; the norm where they open as many sequences."""
    tried = [best_fit(histogram, limits, rule) for rule in ("norm", "dot")]
    return min(tried, key=lambda runs: max((r.first + r.count for r in runs), default=0))


@functools.lru_cache(maxsize=2)
def load_encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids, equal to ``tokenizers`` on the file ``path`` without special tokens.

    A plain byte-level vocabulary whose ids are its merge ranks is run by ``tiktoken``, which gives the same ids at
    three times the speed; a text that holds an added token's string or a very long run of white space, and any other
    file, goes to ``tokenizers``.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    slow = Tokenizer.from_file(path)

    def exact(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    steps, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = (model.get("type", "BPE") == "BPE" and spec.get("normalizer") is None and steps.get("type") == "ByteLevel"
             and not steps.get("add_prefix_space") and steps.get("use_regex", True)
             and not model.get("dropout") and not model.get("ignore_merges"))
    ranks = _byte_ranks(model, {t["content"] for t in spec["added_tokens"]}) if plain else None
    if ranks is None:
        return exact
    # fixed value: the split pattern of byte-level tokenizers
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    added = [t["content"] for t in spec["added_tokens"]]

    def encode(text: str) -> list[int]:
        if any(a in text for a in added) or len(text) >= 100_000 and LONG_SPACE.search(text):
            return exact(text)
        return fast.encode_ordinary(text)

    return encode


def _byte_ranks(model: dict, added: set[str]) -> dict[bytes, int] | None:
    """The vocabulary as bytes by id, or None unless the ids after the single bytes are the merges in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [vocab.get(m) for m in merges] != list(range(256, 256 + len(merges))) or len(vocab) != 256 + len(merges):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}


def cut(ids: Sequence[int], most: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a document: full ones, but for the first of a document that is too long."""
    head = len(ids) % most or min(most, len(ids))
    return [(0, head), *((s, s + most) for s in range(head, len(ids), most))] if len(ids) else []


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, most: int, id_col: str = "doc_id", text_col: str = "text",
             keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every row's pieces; a null text is empty, so one end token."""
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = rows.schema["id"].dataType.simpleString()

    def make():
        encode = load_encoder(tokenizer)

        def step(batch: pa.RecordBatch):
            out = {n: [] for n in ("row", "piece", "start", "length", "ids_crc32", "ids")}
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                for piece, (a, b) in enumerate(cut(ids, most)):
                    out["row"].append(row)
                    out["piece"].append(piece)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(ids[a:b].tobytes()))
                    if keep_ids:
                        out["ids"].append(ids[a:b].astype(np.int32))
            return out | {"id": batch.column("id").take(pa.array(out.pop("row"), pa.int64()))}

        return step

    return map_batches(rows, make, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
                                   + ", ids array<int>" * keep_ids)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, limits: Limits = Limits(), id_col: str = "doc_id",
         text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every piece of every row with its sequence_id and its offset there.

    Repeated rows are packed as often as they occur, null ids like any other; an empty table gives an empty result.
    """
    pieces = materialize(tokenize(docs, tokenizer, end_id, limits.tokens, id_col, text_col, keep_ids), "pack-pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # one row per length
    runs = sorted(fewest(counts, limits), key=lambda r: (r.length, r.rank))
    ranked = rank_in_class(pieces, sum(counts.values()))
    sent = docs.sparkSession.sparkContext.broadcast(
        np.array([[r.length, r.rank, r.first, r.offset] for r in runs], dtype=np.int64).reshape(-1, 4))
    names = [n for n in ranked.columns if n != "rank"]
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}

    def make():
        length, rank, first, offset = sent.value.T
        keys = (length << 44) + rank

        def step(batch: pa.RecordBatch):
            at = batch.column("rank").to_numpy()
            k = np.searchsorted(keys, (batch.column("length").to_numpy() << 44) + at, "right") - 1
            return {n: batch.column(n) for n in names} | {"sequence_id": first[k] + at - rank[k], "offset": offset[k]}

        return step

    ddl = ", ".join(f"{n} {kinds[n]}" for n in names) + ", sequence_id bigint, offset bigint"
    return map_batches(ranked, make, ddl).withColumnRenamed("id", id_col)


def rank_in_class(pieces: DataFrame, rows: int) -> DataFrame:
    """0-based ``rank`` among the pieces of equal length, cut into hash buckets so that no class is sorted whole."""
    buckets = max(64, min(1 << 16, rows // ROWS_PER_BUCKET))
    cut_rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32", "start"), F.lit(buckets)))
    counts = cut_rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"),
                          "pack-offsets")
    inside = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    placed = cut_rows.repartition("length", "bucket").withColumn("rank", F.row_number().over(inside))
    return (placed.join(offsets, ["length", "bucket"])
            .withColumn("rank", (F.col("rank") + F.col("ahead") - 1).cast("long")).drop("bucket", "ahead"))
