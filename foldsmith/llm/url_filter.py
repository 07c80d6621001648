"""URL rules in a sorted digest array.

Each rule ``host/path-prefix`` is one 64-bit xxhash key in a sorted array with its verdict and full string beside it.
The files lie in the shared folder, are fetched once by every executor, and are memory-mapped, so all tasks of an
executor share one copy in the page cache.  A URL probes the array with every (host suffix, path prefix of a length
that occurs in the rules) in one vectorised binary search per batch; a hit counts only if the stored string is equal.

A rule table above ``MAX_INDEX_BYTES`` is not shipped: the same keys are then joined with it by digest and string.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path, spread
from .common import map_batches, write_bytes

MAX_INDEX_BYTES = 256 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host lower-cased over A-Z; both empty for a null URL or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def _suffixes(host: str) -> list[str]:
    """The host and its parent domains, longest first."""
    out = [host]
    while (dot := host.find(".")) >= 0:
        host = host[dot + 1:]
        out.append(host)
    return out


def build_index(rules: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    """Arrays of the index: sorted digests, string offsets, string bytes, block flags and the path lengths that occur.

    A rule given with both verdicts blocks.
    """
    verdicts: dict[str, bool] = {}
    for rule, verdict in rules:
        if rule is not None and verdict in ("allow", "block"):
            verdicts[rule] = verdicts.get(rule, False) or verdict == "block"
    texts = [r.encode() for r in verdicts]
    keys = np.array([xxhash.xxh64_intdigest(t) for t in texts], dtype=np.uint64)
    order = np.argsort(keys, kind="stable")
    texts = [texts[i] for i in order]
    return {"keys": keys[order], "offsets": np.cumsum([0, *map(len, texts)], dtype=np.int64),
            "strings": np.frombuffer(b"".join(texts), dtype=np.uint8),
            "blocks": np.array([verdicts[t.decode()] for t in texts], dtype=bool),
            "lengths": np.array(sorted({len(split_rule(r)[1]) for r in verdicts}), dtype=np.int64)}


def probe(index: dict[str, np.ndarray], hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
    """The longest fitting rule of each URL and its verdict; of equally long ones that with the longer host."""
    lengths = index["lengths"].tolist()
    texts: list[bytes] = []
    rows: list[int] = []
    for row, (host, path) in enumerate(zip(hosts, paths)):
        for suffix in _suffixes(host):
            for n in lengths:
                if n > len(path):
                    break
                texts.append((suffix + path[:n]).encode())
                rows.append(row)
    found: list[str | None] = [None] * len(hosts)
    verdict: list[str | None] = [None] * len(hosts)
    best = [(-1, -1)] * len(hosts)
    keys, offsets, strings = index["keys"], index["offsets"], index["strings"]
    wanted = np.array([xxhash.xxh64_intdigest(t) for t in texts], dtype=np.uint64)
    first = np.searchsorted(keys, wanted, "left")
    past = np.searchsorted(keys, wanted, "right")
    for at in np.flatnonzero(past > first):
        for k in range(first[at], past[at]):  # rules of equal digest
            if bytes(strings[offsets[k]:offsets[k + 1]]) != texts[at]:
                continue
            rule = texts[at].decode()
            rank = (len(rule), len(split_rule(rule)[0]))
            if rank > best[rows[at]]:
                best[rows[at]] = rank
                found[rows[at]], verdict[rows[at]] = rule, "block" if index["blocks"][k] else "allow"
    return found, verdict


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow", max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``urls`` under ``rules`` (rule, verdict).

    A rule ``host/path`` fits its host and all subdomains if the URL's path starts with the rule's; the longest wins.
    Where none fits, rule is null and the verdict is ``default``.  A null URL has an empty host and path.  Repeated
    rows and null ids are judged row by row; an empty table gives an empty result.
    """
    host, path = url_parts(F.col(url_col))
    parts = spread(urls.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")))
    rules = rules.select("rule", "verdict")
    size = rules.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("rule")), F.lit(0)).alias("b")).first()
    if size.b + 24 * size.n > max_index_bytes:
        judged = _by_join(parts, rules, default)
    else:
        judged = _by_array(parts, rules, default)
    return judged.withColumnRenamed("id", id_col)


def _by_array(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    spark = parts.sparkSession
    index = build_index([(r.rule, r.verdict) for r in rules.collect()])  # its size was checked
    tag = uuid.uuid4().hex
    for name, values in index.items():
        buffer = io.BytesIO()
        np.save(buffer, values)
        path = f"{scratch_path(spark, 'url-index')}/{tag}-{name}.npy"
        write_bytes(spark, path, buffer.getvalue())
        spark.sparkContext.addFile(path)
    sizes = {name: len(values) for name, values in index.items()}

    def make():  # an empty array cannot be mapped
        mapped = {name: np.load(SparkFiles.get(f"{tag}-{name}.npy"), mmap_mode="r" if n else None)
                  for name, n in sizes.items()}

        def step(batch: pa.RecordBatch):
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            rule, verdict = probe(mapped, hosts, paths)
            return {"id": batch.column("id"), "host": hosts, "path": paths, "rule": rule,
                    "verdict": [v or default for v in verdict]}

        return step

    kind = parts.schema["id"].dataType.simpleString()
    return map_batches(parts, make, f"id {kind}, host string, path string, rule string, verdict string")


def _by_join(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same search as a join on digest and string, for rule tables too large to ship."""
    table = materialize(rules.filter(F.col("rule").isNotNull() & F.col("verdict").isin("allow", "block"))
                        .groupBy("rule").agg(F.max("verdict").alias("verdict"))  # block is after allow
                        .withColumn("key", F.xxhash64("rule")), "url-rules")
    parts = materialize(parts, "url-parts")
    lengths = table.select(F.array_sort(F.collect_set(
        F.length("rule") - F.length(F.substring_index("rule", "/", 1)))).alias("v")).scalar()  # at most a path's length
    pairs = parts.select("host", "path").distinct().withColumn("lengths", lengths)
    labels = F.split("host", "[.]")
    probes = (pairs.withColumn("s", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(
        F.slice(labels, k, F.size(labels)), "."))))
        .withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))))
        .withColumn("rule", F.concat("s", F.substr("path", F.lit(1), F.col("n")))))
    hits = probes.withColumn("key", F.xxhash64("rule")).join(table, ["key", "rule"])
    best = hits.groupBy("host", "path").agg(F.max(F.struct(
        F.length("rule").alias("a"), F.length("s").alias("b"), "rule", "verdict")).alias("m"))
    best = materialize(best.select("host", "path", "m.rule", "m.verdict"), "url-hits")
    return (parts.join(best, ["host", "path"], "left")
            .select("id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))
