"""URL rules by Bloom filter cascades: exact membership over a complete key universe, without joins.

Level 1 is a Bloom filter of the listed keys. Every key of the corpus that passes it wrongly goes into level 2, every listed
key that passes level 2 wrongly into level 3, and so on until a level has no false positive. A key is listed if it stops at an
even level, or passes all of an odd number. This is exact for every key of the universe, here each (host suffix, path
prefix) of the pages with a prefix length that some rule has; pages are then judged in one pass with the broadcast levels, whose size
follows the list and the logarithm of the universe, not the pages.

Two cascades are kept: which keys are rules, and which rules block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantra.llm.common import stored

SHARD_BYTES = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The production rules: host and path, and what they say.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def positions(keys: list[str], level: int, bits: int, hashes: int) -> np.ndarray:
    """Rows of bit places by double hashing of a 128-bit digest, salted by level."""
    digest = [xxhash.xxh3_128_intdigest(k.encode(), level) for k in keys]
    a = np.array([d & (1 << 64) - 1 for d in digest], np.uint64)
    b = np.array([d >> 64 | 1 for d in digest], np.uint64)
    return (a[:, None] + b[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)


class Filter:
    """One level: its number, bits, hash functions and bit array."""

    def __init__(self, level: int, bits: int, hashes: int, data: np.ndarray) -> None:
        self.level, self.bits, self.hashes, self.data = level, bits, hashes, data

    def has(self, keys: list[str]) -> np.ndarray:
        at = positions(keys, self.level, self.bits, self.hashes)
        return ((self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def listed(levels: list[Filter], keys: list[str]) -> np.ndarray:
    """Exact membership for keys of the universe."""
    out = np.full(len(keys), len(levels) % 2 == 1)
    todo = np.arange(len(keys))
    for depth, level in enumerate(levels, 1):
        if not len(todo):
            break
        ok = level.has([keys[i] for i in todo])
        out[todo[~ok]] = depth % 2 == 0
        todo = todo[ok]
    return out


def _build(keys: DataFrame, level: int, count: int, rate: float) -> Filter:
    """A Bloom filter of keys (column key): partial bit arrays of each partition, merged by shard."""
    bits = max(64, math.ceil(count * math.log2(1 / rate) / math.log(2)))
    hashes = max(1, round(math.log2(1 / rate)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.zeros(bits // 8 + 1, np.uint8)
        for batch in batches:
            at = positions(batch["key"].to_pylist(), level, bits, hashes).ravel()
            np.bitwise_or.at(data, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for lo in range(0, len(data), SHARD_BYTES):
            part = data[lo : lo + SHARD_BYTES]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([lo // SHARD_BYTES], pa.int32()), pa.array([part.tobytes()])], ["shard", "data"])

    def merge(table: pa.Table) -> pa.Table:
        whole = reduce(np.bitwise_or, (np.frombuffer(x.as_py(), np.uint8) for x in table["data"]))
        return pa.table([table["shard"][:1], pa.array([whole.tobytes()])], ["shard", "data"])

    data = np.zeros(bits // 8 + 1, np.uint8)
    for row in keys.mapInArrow(partial, "shard int, data binary").groupBy("shard").applyInArrow(merge, "shard int, data binary").toLocalIterator():
        part = np.frombuffer(row.data, np.uint8)
        data[row.shard * SHARD_BYTES :][: len(part)] = part
    return Filter(level, bits, hashes, data)


def _passing(keys: DataFrame, level: Filter) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(level.has(batch["key"].to_pylist()))) if len(batch) else batch

    return keys.mapInArrow(rows, "key string")


def cascade(keys: DataFrame, strangers: DataFrame, size: int, universe: int) -> list[Filter]:
    """Levels for `size` listed keys (key), exact on them and on the strangers. strangers: other keys of the universe, repeats and listed ones allowed."""
    if not size:
        return []
    rate = min(0.5, math.sqrt(0.5) * size / max(universe, 1))
    levels = [_build(keys, 1, size, rate)]
    wrong = stored(_passing(strangers, levels[0]).distinct().join(keys, "key", "left_anti"), "cascade")
    inside, count = keys, wrong.count()
    while count:
        levels.append(_build(wrong, len(levels) + 1, count, 0.5))
        inside, wrong = wrong, stored(_passing(inside, levels[-1]), "cascade")
        count = wrong.count()
    return levels


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path: empty where the url is null or has no ://."""
    whole = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))


def probes(host: str, path: str, lengths: list[int]) -> list[str]:
    """The keys that a rule for this host and path can have, the longest first (the longer host on ties)."""
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))] if host else []
    keys = {(len(h) + n, len(h), h + path[:n]) for h in hosts for n in lengths if n <= len(path)}
    return [k for _, _, k in sorted(keys, reverse=True)]


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (with url) and, by the longest fitting rule, host, path, rule and verdict; columns of those names are replaced.

    rules: rule (host, then a path that begins with /), verdict (allow or block). Of a rule given twice, block holds. A rule fits
    its host and all subdomains if the url's path starts with the rule's. No fitting rule: rule null, and the cascade's own verdict, allow,
    as the url has no listed key. Null or odd urls have empty host and path and fit none. Repeated rows each give a row.
    """
    spark = pages.sparkSession
    split = rules.where("instr(rule, '/') > 0").select(F.concat(F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER), F.expr("substr(rule, instr(rule, '/'))")).alias("key"), "verdict")
    split = stored(split.groupBy("key").agg(F.max(F.col("verdict") == "block").alias("blocks")), "rules")
    keys, blocked, free = split.select("key"), split.where("blocks").select("key"), split.where("NOT blocks").select("key")
    lengths = sorted(r[0] for r in split.select(F.expr("length(key) - instr(key, '/') + 1").alias("n")).distinct().collect())
    parts = with_parts(pages.drop("host", "path", "rule", "verdict"))

    def all_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            new = {k for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist()) for k in probes(h, p, lengths)} - seen
            if len(seen) < 1_000_000:  # what is not remembered is only sent again
                seen |= new
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.string())], ["key"])

    universe = parts.select("host", "path").mapInArrow(all_keys, "key string")
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    n_blocked, n_free = blocked.count(), free.count()
    shared = spark.sparkContext.broadcast((cascade(keys, universe, n_blocked + n_free, size), cascade(blocked, free, n_blocked, n_blocked + n_free)))
    names = parts.columns

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule_levels, block_levels = shared.value
        for batch in batches:
            each = [probes(h, p, lengths) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist())]
            distinct = list({k for x in each for k in x})
            is_rule = {k for k, ok in zip(distinct, listed(rule_levels, distinct)) if ok} if rule_levels else set()
            blocks = dict(zip(is_rule, listed(block_levels, list(is_rule)))) if block_levels else {}
            found = [next((k for k in x if k in is_rule), None) for x in each]
            said = ["block" if blocks.get(k) else "allow" for k in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(said, pa.string())], [*names, "rule", "verdict"])

    schema = T.StructType([*parts.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return parts.mapInArrow(verdicts, schema)


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, spark.createDataFrame(list(RULES), "rule string, verdict string")).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) ELSE '' END AS raw_host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
h AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r AS (SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
