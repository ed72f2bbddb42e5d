"""Benchmark decontamination over a distributed positional inverted index.

`build_index` cuts the documents into segments (about SEGMENT_BYTES of text) and stores for each the sorted terms (64-bit word
hashes) and every term's ascending word places, delta coded. A phrase is found in a segment by intersecting its terms' lists, each moved by
the term's offset, from the rarest term on; `proximity` finds places where terms stand within a few words. The segments are independent, so
nothing is shuffled, and a frequent word's list is only probed, not walked, unless all words of a phrase are frequent.

Phrases come in blocks of about BLOCK_BYTES of benchmark text; each is broadcast in turn, so the size of the benchmark only adds passes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantra.llm.common import chunks, frugal, row_key, scratch, stored, text_bytes, without
from quantra.llm.texthash import ALNUM, LOWER, U, word_hashes, words

SEGMENT_BYTES, BLOCK_BYTES = 2 << 20, 16 << 20
INDEX = "segment long, doc_ids array<long>, row_keys array<long>, firsts array<int>, terms binary, starts binary, places binary"


def terms_of(text: str | None) -> np.ndarray:
    """The hashes of a text's words, in order."""
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
    return word_hashes(data, starts, ends)


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, offsets = text_bytes(batch["text"])
        for lo, hi, part, off in chunks(data, offsets, SEGMENT_BYTES):
            part = LOWER[part]
            begins, ends, first = words(part, off, ALNUM)
            hashes = word_hashes(part, begins, ends)
            order = np.argsort(hashes, kind="stable")
            terms, starts = np.unique(hashes[order], return_index=True)
            places = np.diff(order, prepend=0)
            places[starts] = order[starts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), *(pa.array([x], pa.list_(t)) for x, t in ((batch["doc_id"].slice(lo, hi - lo).to_pylist(), pa.int64()), (batch["row_key"].slice(lo, hi - lo).to_pylist(), pa.int64()), (first.tolist(), pa.int32()))), *(pa.array([x.tobytes()]) for x in (terms, starts.astype("<u4"), places.astype("<u4")))],
                ["segment", "doc_ids", "row_keys", "firsts", "terms", "starts", "places"],
            )
            number += 1


def build_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The stored index of docs (doc_id long, text string); null texts are documents without words."""
    rows = docs.select("doc_id", "text", row_key().alias("row_key")).mapInArrow(frugal(_index_rows), INDEX)
    if path is None:
        path = f"{scratch(docs.sparkSession).rstrip('/')}/postings-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


class Segment:
    """One segment's postings."""

    def __init__(self, firsts, terms: bytes, starts: bytes, places: bytes) -> None:
        self.firsts = np.array(firsts, np.int64)
        self.terms, coded = np.frombuffer(terms, U), np.frombuffer(places, "<u4")
        self.cuts = np.append(np.frombuffer(starts, "<u4").astype(np.int64), len(coded))
        sums = np.cumsum(coded.astype(np.int64))
        before = sums[self.cuts[:-1]] - coded[self.cuts[:-1]] if len(coded) else sums
        self.places = sums - np.repeat(before, np.diff(self.cuts))

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The index of each term, -1 where the segment hasn't got it."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def list(self, term: int) -> np.ndarray:
        return self.places[self.cuts[term] : self.cuts[term + 1]]

    def doc(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, places, side="right") - 1

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Where these terms (indices) stand in a row within one document."""
        sizes = self.cuts[terms + 1] - self.cuts[terms]
        order = np.argsort(sizes, kind="stable")
        found = self.list(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                return found
            other = self.list(terms[k])
            at = np.minimum(np.searchsorted(other, found + k), len(other) - 1)
            found = found[other[at] == found + k]
        found = found[(found >= 0)]
        return found[self.doc(found) == self.doc(found + len(terms) - 1)]

    def near(self, terms: np.ndarray, width: int) -> np.ndarray:
        """First words of the spans of at most `width` words of one document that begin with one of the terms and hold them all."""
        lists = [self.list(t) for t in np.unique(terms)]
        rarest = min(lists, key=len)
        starts = np.concatenate(lists)
        at = np.searchsorted(rarest, starts)
        close = (at < len(rarest)) & (rarest[np.minimum(at, len(rarest) - 1)] < starts + width)
        starts = np.unique(starts[close])
        end = np.minimum(starts + width, self.firsts[self.doc(starts) + 1])
        for other in lists:
            at = np.searchsorted(other, starts)
            ok = (at < len(other)) & (other[np.minimum(at, len(other) - 1)] < end)
            starts, end = starts[ok], end[ok]
        return starts


def windows_of(items: Iterator[tuple[str, np.ndarray]], width: int) -> tuple[dict[int, np.ndarray], list[set[str]]]:
    """Distinct windows by length (terms, one row each; the last column is the window's number) and the items of each number."""
    numbers: dict[bytes, int] = {}
    owners: list[set[str]] = []
    by_length: dict[int, list[np.ndarray]] = {}
    for item, terms in items:
        n = min(width, len(terms))
        for lo in range(len(terms) - n + 1) if n else ():
            window = terms[lo : lo + n]
            key = window.tobytes()
            if key not in numbers:
                numbers[key] = len(owners)
                owners.append(set())
                by_length.setdefault(n, []).append(np.append(window, U(numbers[key])))
            owners[numbers[key]].add(item)
    return {n: np.stack(x) for n, x in by_length.items()}, owners


HITS = "segment long, row int, places array<int>, items array<string>"


def _search(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length, owners = shared.value
        for batch in batches:
            for number, firsts, *blobs in zip(*(batch[k] for k in ("segment", "firsts", "terms", "starts", "places"))):
                segment = Segment(firsts.as_py(), *(x.as_py() for x in blobs))
                cover = np.zeros(len(segment.places) + 1, np.int32)
                of_row: dict[int, set[str]] = {}
                for n, table in by_length.items():
                    found = segment.find(table[:, :-1])
                    for k in np.flatnonzero((found >= 0).all(axis=1)):
                        starts = segment.phrase(found[k])
                        np.add.at(cover, starts, 1)
                        np.add.at(cover, starts + n, -1)
                        for row in np.unique(segment.doc(starts)).tolist():
                            of_row.setdefault(row, set()).update(owners[int(table[k, -1])])
                if of_row:
                    hit = np.flatnonzero(np.cumsum(cover) > 0)
                    row = segment.doc(hit)
                    rows = sorted(of_row)
                    places = [(hit[np.searchsorted(row, r) : np.searchsorted(row, r, side="right")] - segment.firsts[r]).astype(np.int32) for r in rows]
                    yield pa.RecordBatch.from_arrays([pa.array([number.as_py()] * len(rows), pa.int64()), pa.array(rows, pa.int32()), pa.array(places, pa.list_(pa.int32())), pa.array([sorted(of_row[r]) for r in rows], pa.list_(pa.string()))], ["segment", "row", "places", "items"])

    return rows


def phrase_hits(index: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """(segment, row, places, items): for each document with a match, the words inside matches and the items matched.

    benchmark: item_id, text. A window is `width` consecutive words of an item, or all words of a shorter one. Items with a null id or
    text, or without words, match nothing.
    """
    spark = index.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    found = []
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(windows_of(((r.item_id, terms_of(r.text)) for r in part.toLocalIterator()), width))
        rows = index.select("segment", "firsts", "terms", "starts", "places").mapInArrow(frugal(_search(shared)), HITS)
        found.append(stored(rows, "hits") if blocks > 1 else rows)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("segment", "row").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def _near(shared, width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for firsts, doc_ids, *blobs in zip(*(batch[k] for k in ("firsts", "doc_ids", "terms", "starts", "places"))):
                segment, ids = Segment(firsts.as_py(), *(x.as_py() for x in blobs)), doc_ids.as_py()
                for item, terms in shared.value:
                    found = segment.find(terms)
                    if len(found) and (found >= 0).all():
                        starts = segment.near(found, width)
                        row = segment.doc(starts)
                        yield pa.RecordBatch.from_arrays([pa.array([item] * len(row), pa.string()), pa.array([ids[r] for r in row], pa.int64()), pa.array(starts - segment.firsts[row])], ["item_id", "doc_id", "place"])

    return rows


def proximity(index: DataFrame, queries: list[tuple[str, str]], width: int) -> DataFrame:
    """(item_id, doc_id, place): where all words of a query (item_id, text) stand within `width` words, for each span that begins with one of them."""
    shared = index.sparkSession.sparkContext.broadcast([(item, terms_of(text)) for item, text in queries])
    return index.select("firsts", "doc_ids", "terms", "starts", "places").mapInArrow(_near(shared, width), "item_id string, doc_id long, place long")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """One row for each of docs: doc_id, row_key, n_words, n_hit, items (matched item ids as sorted strings), contaminated.

    A word is hit inside any occurrence of a benchmark window; a document is contaminated with n_hit > 0 and share * n_hit >= n_words. Null
    and empty texts have no words. Repeated rows and rows without doc_id each give a row. An empty benchmark hits nothing. Other columns are ignored.
    """
    index = build_index(docs)
    each = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "row_keys", F.slice("firsts", 1, F.size("doc_ids")).alias("a"), F.slice("firsts", 2, F.size("doc_ids")).alias("b"))).alias("row", "doc"))
    each = each.select("segment", "row", F.col("doc.doc_ids").alias("doc_id"), F.col("doc.row_keys").alias("row_key"), (F.col("doc.b") - F.col("doc.a")).cast("long").alias("n_words"))
    joined = each.join(phrase_hits(index, benchmark, width), ["segment", "row"], "left")
    n_hit = F.coalesce(F.size("places"), F.lit(0)).cast("long")
    n_hit = F.when(F.col("places").isNull(), F.lit(0).cast("long")).otherwise(n_hit)
    out = joined.select("doc_id", "row_key", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """docs without the contaminated rows; columns as given, whatever their names.

    Null and empty texts stay; a very long text is judged by all its words; repeated rows stay or go together; rows without doc_id are judged like any other. An empty table or
    benchmark changes nothing.
    """
    return without(docs, contamination(docs, benchmark, width, share).where("contaminated"))


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    got = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256).alias("items_sha256"), "contaminated")
