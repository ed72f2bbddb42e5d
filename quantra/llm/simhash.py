"""SimHash near-duplicates: fingerprints of word shingles, joined with themselves by a binary trie.

`near_duplicates` is the general operator: fingerprint rows, link fingerprints that differ in few bits, and give each document
the least doc_id it reaches. `drop_near_copies` is the filter for corpora: a 512-bit fingerprint of five-word shingles, tries
over its segments for candidates, and the exact Jaccard similarity of the shingle sets for the decision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantra.llm import trie
from quantra.llm.common import chunks, frugal, lists, row_key, small, stored, text_bytes, without
from quantra.llm.components import components
from quantra.llm.texthash import LOWER, SEQUENCE, SPACED, U, mix, word_hashes, words

SEED = 42
#: Leaves of the trie's top hold at least so many fingerprints; the bound grows with the square root of their number.
LEAF = 4096
_BITS = (np.arange(256)[:, None] >> np.arange(7, -1, -1) & 1).astype(np.float32)


def majority(hashes: np.ndarray) -> bytes:
    """hashes: n rows of 64-bit words. Each bit of the result is 1 if it is set in over half of the rows; no rows: zero."""
    n = len(hashes)
    octets = np.ascontiguousarray(hashes.astype(">u8")).view(np.uint8).reshape(n, 8 * hashes.shape[1])
    wide = octets.shape[1]
    seen = np.bincount((octets + np.arange(wide, dtype=np.int64) * 256).ravel(), minlength=256 * wide).reshape(wide, 256)
    return np.packbits((2 * (seen @ _BITS)).ravel() > n).tobytes()


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash by XXH64 (seed 42) of a whole text's word shingles."""
    got = (text or "").encode().lower().split()
    if not got:
        return 0
    if len(got) < shingle:
        parts = [b" ".join(got)]
    else:
        parts = map(b" ".join, zip(*(got[k:] for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, SEED) for x in parts], U)
    return int.from_bytes(majority(hashes.reshape(-1, 1)), "big")


def _fingerprints(shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch["text"]), U, len(batch))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return rows


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id long, text string).

    Fingerprints link at `bits` or fewer differing bits; component_id is the least doc_id among the rows reached through
    links (null if none of them has an id). Null and empty texts have fingerprint zero and link like any other. Repeated rows each
    give a row. Other columns are ignored. Equal fingerprints are joined once, however many documents share them.
    """
    prints = stored(docs.select("doc_id", "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-nodes")
    items = nodes.select(F.lit(0).alias("seg"), F.col("fp").alias("key"), F.col("fp").alias("id"), F.lit(None).cast("binary").alias("payload"))
    leaf = max(LEAF, 8 * math.isqrt(nodes.count()))
    roots = components(trie.links(items, 64, bits, leaf))
    linked = roots.join(nodes, roots.node == nodes.fp)
    least = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    groups = linked.join(least, "root").select("fp", "least_id")
    classes = nodes.join(groups, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    classes = stored(classes, "classes")  # then both sides of the last join are shuffled for it alone, and Spark can split a common fingerprint
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: SEGMENT_LEAF bounds a leaf over all segments together, so each task has a sixteenth of it on either side.
SEGMENTS, SEGMENT_BITS, SEGMENT_BUDGET, SEGMENT_LEAF = 16, 32, 3, 1 << 23
SEEDS = (0x452821E638D01377, 0xBE5466CF34E90C6C, 0xC0AC29B7C97C50DD, 0x3F84D5B5B5470917, 0x9216D5D98979FB1B, 0xD1310BA698DFB5AC, 0x2FFD72DBD01ADFB7, 0xB8E1AFED6A267E96)
#: Words of the fingerprint that go with each segment for the distance of candidates, and the seeds of the keys by which groups are linked first.
COMPARED, STARS = 4, SEEDS[:4]
#: A candidate's shape: its shingles counted by the first bits of their hashes, in half bytes, then how many there are and how many the half bytes leave out.
PARTS, PART_BITS, SHAPE = 128, 7, 10


def most_bits(similarity: float, size: int = 64 * COMPARED) -> int:
    """A distance that hardly any fingerprints (0.1 %) exceed whose shingle sets have just this Jaccard similarity: the mean (arccos of 2s/(1+s), over pi) and three standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(size * p + 3 * math.sqrt(size * p * (1 - p)))


def _shingle_sets_of(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text in order, a shorter text being one shingle."""
    data, offsets = text_bytes(column)
    for _, _, part, off in chunks(data, offsets):
        starts, ends, first = words(part, off, SPACED)
        prefix = SEQUENCE.prefix(word_hashes(LOWER[part], starts, ends))
        for lo, hi in zip(first[:-1], first[1:]):
            at = np.arange(lo, max(lo + 1, hi - shingle + 1)) if hi > lo else np.zeros(0, np.int64)
            yield np.unique(SEQUENCE.spans(prefix, at, np.minimum(at + shingle, hi)))


def _shape(own: np.ndarray) -> bytes:
    counts = np.bincount((own >> U(64 - PART_BITS)).astype(np.int64), minlength=PARTS)
    capped = np.minimum(counts, 15).astype(np.uint8)
    return (capped[::2] | capped[1::2] << 4).tobytes() + np.array([len(own), len(own) - int(capped.sum())], U).tobytes()


def _long_prints(shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, ids, sizes, stars, shapes = [], [], [], [], []
            for own in _shingle_sets_of(batch["text"], shingle):
                mixed = np.stack([mix(own ^ U(s)) for s in SEEDS], axis=1)
                out.append(majority(mixed))
                ids.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                sizes.append(len(own))
                shapes.append(_shape(own))
                stars.append(mixed[:, : len(STARS)].min(axis=0) if len(own) else np.zeros(len(STARS), U))
            stars = lists(np.concatenate(stars).view(np.int64) if stars else np.zeros(0, np.int64), np.full(len(out), len(STARS)), pa.int64())
            made = [pa.array(np.array(ids, U).view(np.int64)), pa.array(out, pa.binary()), pa.array(sizes, pa.int64()), stars, pa.array(shapes, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row_key"], *made], ["doc_id", "row_key", "id", "fp", "size", "stars", "shape"])

    return rows


def _shingle_sets(shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_shingle_sets_of(batch["text"], shingle))
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], lists(flat, np.array([len(x) for x in sets], np.int64), pa.int64())], ["id", "shingles"])

    return rows


def _most_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """No less than the shingles that two texts of these shapes share: of each part at most the smaller count."""
    a, b = (np.ascontiguousarray(z[:, : SHAPE - 2]).view(np.uint8) for z in (x, y))
    shared = np.minimum(a & 15, b & 15).sum(axis=1, dtype=np.int64) + np.minimum(a >> 4, b >> 4).sum(axis=1, dtype=np.int64)
    return shared + np.minimum(x[:, -1], y[:, -1]).astype(np.int64)


def _close(similarity: float):
    """Which pairs of payloads (fingerprint words, shape, group) may reach the similarity and are not of one group yet: by size and distance, then by an exact bound from the shapes."""
    limit = most_bits(similarity)

    def near(x: np.ndarray, y: np.ndarray, seg: int = 0) -> np.ndarray:
        ok = x[:, -1] != y[:, -1]
        m, n = x[ok, -3], y[ok, -3]
        ok[ok] = (np.minimum(m, n) / np.maximum(m, n) >= similarity) & (np.bitwise_count(x[ok, :COMPARED] ^ y[ok, :COMPARED]).sum(axis=1) <= limit)
        a, b = x[ok, COMPARED:-1], y[ok, COMPARED:-1]
        ok[ok] = (1 + similarity) * _most_common(a, b) >= similarity * (a[:, -2] + b[:, -2]) - 1e-6
        apart = np.bitwise_count(np.ascontiguousarray(x[ok, :COMPARED] ^ y[ok, :COMPARED]).view(np.uint32))
        ok[ok] = (apart[:, :seg] > SEGMENT_BUDGET).all(axis=1)  # an earlier segment has the pair already
        return ok

    return near


def _close_rows(similarity: float):
    near = _close(similarity)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[k].to_pylist()), U).reshape(-1, COMPARED + SHAPE + 1) for k in ("x", "y"))
            yield batch.select(["u", "v"]).filter(pa.array(near(x, y)))

    return rows


def _payload(group: str):
    word = lambda k: F.unhex(F.lpad(F.hex(k), 16, "0"))
    return F.concat(F.substring("fp", 1, 8 * COMPARED), "shape", word(group))


def _alike(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) of node ids whose shingle sets have the Jaccard similarity; only their texts are cut into shingles again."""
    pairs = stored(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near-pairs")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    wanted = small(stored(nodes.join(ids, "id").select("id", F.col("doc_id").alias("at_id"), F.col("row_key").alias("at_key")), "near-rows"), 100_000)
    found = texts.join(wanted, texts.doc_id.eqNullSafe(wanted.at_id) & (texts.row_key == wanted.at_key)).select("id", "text")
    sets = stored(found.mapInArrow(frugal(_shingle_sets(shingle)), "id long, shingles array<long>"), "shingle-sets").dropDuplicates(["id"])
    side = lambda k, name: sets.select(F.col("id").alias(k), F.col("shingles").alias(name))
    common = F.size(F.array_intersect("x", "y"))
    both = pairs.join(side("u", "x"), "u").join(side("v", "y"), "v")
    return stored(both.where(common / (F.size("x") + F.size("y") - common) >= similarity).select("u", "v"), "near-links")


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near copies: of each group of documents linked at a Jaccard similarity of `similarity` or more, the row with the least doc_id stays.

    Texts with one set of shingles go first (the least doc_id stays; rows that share id and text are one document and stay or go together). Texts
    without words are no one's copies and all stay. A row without doc_id comes after those with one. Candidates are pairs within most_bits(similarity)
    of whose fingerprints one of 16 segments differs in at most three bits and whose shapes leave the similarity possible; a pair links only if its shingle sets have it. Ties do not
    arise, and very long texts are compared by all their shingles. An empty table stays empty; columns come back as given, whatever their names. To spare large
    groups most of their pairs, each text is first held against the least one with an equal least hash, and what links so is one group.
    """
    texts = docs.select("doc_id", "text", row_key().alias("row_key"))
    prints = stored(texts.mapInArrow(frugal(_long_prints(shingle)), "doc_id long, row_key long, id long, fp binary, size long, stars array<long>, shape binary"), "long-fingerprints")
    empty = F.col("size") == 0
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    nodes = prints.where(~empty).groupBy("id", "size", "stars").agg(F.min(F.struct(order.alias("order"), "fp", "shape")).alias("first"))
    nodes = stored(nodes.select("id", "size", "stars", "first.fp", "first.shape", "first.order.doc_id", "first.order.row_key"), "fingerprint-nodes")
    rays = nodes.select(F.posexplode("stars").alias("star", "low"), "id", _payload("id").alias("payload"))
    hubs = rays.groupBy("star", "low").agg(F.min(F.struct("id", "payload")).alias("hub"))
    starred = rays.join(hubs, ["star", "low"]).where("id <> hub.id").select(F.col("id").alias("u"), F.col("hub.id").alias("v"), F.col("payload").alias("x"), F.col("hub.payload").alias("y"))
    starred = _alike(texts, nodes, starred.mapInArrow(_close_rows(similarity), "u long, v long"), shingle, similarity)
    grouped = nodes.join(components(starred).withColumnRenamed("node", "id"), "id", "left").withColumn("group", F.coalesce("root", "id"))
    segment = lambda k: F.shiftleft(F.conv(F.hex(F.substring("fp", 4 * k + 1, 4)), 16, 10).cast("long"), 32)
    items = stored(grouped.select("fp", "id", _payload("group").alias("payload")), "fingerprint-items")
    items = items.select(F.posexplode(F.array(*(segment(k) for k in range(SEGMENTS)))).alias("seg", "key"), "id", "payload")
    pairs = trie.links(items, SEGMENT_BITS, SEGMENT_BUDGET, SEGMENT_LEAF, _close(similarity), COMPARED + SHAPE + 1, every=True)
    roots = components(starred.unionByName(_alike(texts, nodes, pairs, shingle, similarity)))
    linked = roots.join(nodes, roots.node == nodes.id)
    first = linked.groupBy("root").agg(F.min(order).alias("first")).select("root", F.col("first.doc_id").alias("keep_id"), F.col("first.row_key").alias("keep_key"))
    lost = linked.join(first, "root").where(~(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row_key") == F.col("keep_key")))).select("id")
    kept = nodes.join(lost, "id", "left_anti").select("doc_id", "row_key")
    stay = prints.where(empty).select("doc_id", "row_key").unionByName(kept)
    gone = prints.select("doc_id", "row_key").distinct().join(stay, prints.doc_id.eqNullSafe(stay.doc_id) & (prints.row_key == stay.row_key), "left_anti")
    return without(docs, gone)


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
