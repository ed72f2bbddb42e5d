"""Substring deduplication over word windows with a count-min prefilter.

First pass: every window of `width` consecutive words is represented by its least `width // 2`-word gram, so that equal
windows have equal grams and neighbouring windows mostly share theirs. Partition sketches of the grams (one count for
each document that has it) are merged; the merged count of a window's gram is never under the number of documents
with the window. Second pass: only windows whose gram is estimated in two documents or more are grouped, by a
128-bit digest of their words, and those that a document with a smaller id also has are removed. Nothing repeated is
lost: a window in two documents makes its gram's count two in every row of the sketch.

Hot windows: in each block of text only the smallest document's copy of a window is sent on; later copies there are
resolved on the spot. A window thus gives at most a row a block, however many documents share it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantra.llm import sketch
from quantra.llm.common import chunks, lists, row_key, text_bytes
from quantra.llm.texthash import SEQUENCE, SEQUENCE2, SPACED, WORD2, U, fitting, least, mix, word_hashes, words

#: Candidate windows that are resolved together before rows are sent on.
BLOCK_WINDOWS = 1 << 19


def _windows(data: np.ndarray, offsets: np.ndarray, width: int):
    """Word places, word hashes, the starts of whole windows, each one's gram place, and the grams' hashes."""
    starts, ends, first = words(data, offsets, SPACED)
    hashes = word_hashes(data, starts, ends)
    gram = max(1, width // 2)
    grams = SEQUENCE.windows(hashes, gram)
    whole = np.flatnonzero(fitting(first, width, len(hashes)))
    place = least(grams, width - gram + 1)[whole] if len(whole) else whole
    return starts, ends, first, hashes, whole, place, grams


def _gram_counts(width: int):
    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        data, offsets = text_bytes(batch["text"])
        for _, _, part, off in chunks(data, offsets):
            _, _, first, _, _, place, grams = _windows(part, off, width)
            at = np.unique(place)
            doc = np.searchsorted(first, at, side="right")
            key = grams[at]
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            keep = np.ones(len(key), bool)
            keep[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            yield key[keep]

    return keys_of


def _resolved(h1, h2, doc, row, place) -> tuple[tuple, tuple]:
    """Of one block's candidate windows: those that a smaller document of the block also has, and the rest as one entry for each digest and row."""
    order = np.lexsort((place, row, doc, h2, h1))
    h1, h2, doc, row, place = (x[order] for x in (h1, h2, doc, row, place))
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    later = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    keep = ~later
    h1, h2, doc, krow, kplace, knew = h1[keep], h2[keep], doc[keep], row[keep], place[keep], new[keep]
    knew[1:] |= krow[1:] != krow[:-1]
    head = np.flatnonzero(knew)
    return (row[later], place[later]), (h1[head], h2[head], krow[head], kplace, np.diff(np.append(head, len(h1))))


SENT = "h1 long, h2 long, doc_id long, row_key long, settled boolean, places array<int>"


def _candidates(width: int, bitmap, bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, held, size, ids, keys = bitmap.value, [], 0, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, ids, keys
            if held:
                row_doc, row_keys = np.concatenate(ids), np.concatenate(keys)
                h1, h2, row, place = (np.concatenate(x) for x in zip(*held))
                (lrow, lplace), (a, b, krow, kplace, counts) = _resolved(h1, h2, row_doc[row], row, place)
                lorder = np.lexsort((lplace, lrow))
                lrow, lplace = lrow[lorder], lplace[lorder]
                lheads = np.flatnonzero(np.diff(lrow, prepend=-1))
                lrows = lrow[lheads]
                lcounts = np.diff(np.append(lheads, len(lrow)))
                who = np.concatenate([krow, lrows])
                spread = mix(row_keys[lrows].view(U))  # settled rows are no one's copies
                for lo in range(0, len(who), 1 << 16):
                    part = slice(lo, lo + (1 << 16))
                    count = np.concatenate([counts, lcounts])
                    at = np.concatenate([[0], np.cumsum(count)])
                    values = np.concatenate([kplace, lplace])[at[lo] : at[min(lo + (1 << 16), len(who))]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([a, spread]).view(np.int64)[part]), pa.array(np.concatenate([b, spread]).view(np.int64)[part]), pa.array(row_doc[who][part]), pa.array(row_keys[who][part]), pa.array((np.arange(len(who)) >= len(krow))[part]), lists(values, count[part], pa.int32())],
                        ["h1", "h2", "doc_id", "row_key", "settled", "places"],
                    )
            held, size, ids, keys = [], 0, [], []

        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            doc_ids, row_keys = (batch[k].to_numpy(zero_copy_only=False) for k in ("doc_id", "row_key"))
            for lo, hi, part, off in chunks(data, offsets):
                starts, ends, first, hashes, whole, place, grams = _windows(part, off, width)
                repeated = np.zeros(len(grams) + 1, bool)
                at = np.unique(place)
                repeated[at] = sketch.at_least(grams[at], packed, bits)
                whole = whole[repeated[place]]
                base = sum(map(len, ids))
                ids.append(doc_ids[lo:hi])
                keys.append(row_keys[lo:hi])
                if len(whole):
                    p1, p2 = SEQUENCE.prefix(hashes), SEQUENCE2.prefix(word_hashes(part, starts, ends, WORD2))
                    row = np.searchsorted(first, whole, side="right") - 1
                    held.append((SEQUENCE.spans(p1, whole, whole + width), SEQUENCE2.spans(p2, whole, whole + width), row + base, (whole - first[row]).astype(np.int32)))
                    size += len(whole)
                if size > BLOCK_WINDOWS:
                    yield from flush()
        yield from flush()

    return rows


def removed_windows(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, row_key, places): where windows start that a document with a smaller doc_id also has.

    docs: doc_id long, text string. Rows without a doc_id take no part. Rows that share a doc_id are the same document.
    """
    texts = docs.select("doc_id", "text", row_key().alias("row_key")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch.width_bits(total / 6 * 2 / (width // 2 + 2))
    (bitmap,) = sketch.merged(texts, _gram_counts(width), bits, (2,))
    sent = texts.mapInArrow(_candidates(width, docs.sparkSession.sparkContext.broadcast(bitmap), bits), SENT)
    least_doc = F.min("doc_id").over(Window.partitionBy("h1", "h2"))
    found = sent.withColumn("least", least_doc).where("settled OR least < doc_id")
    return found.groupBy("doc_id", "row_key").agg(F.flatten(F.collect_list("places")).alias("places"))


def _kept_words(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, places in zip(batch["text"], batch["places"]):
                got = (text.as_py() or "").encode().split()
                n = len(got)
                if places.is_valid:
                    cover = np.zeros(n + 1, np.int64)
                    at = np.unique(places.values.to_numpy(zero_copy_only=False))
                    cover[at] += 1
                    cover[at + width] -= 1
                    keep = np.cumsum(cover[:n]) == 0
                    got = [w for w, k in zip(got, keep) if k]
                out.append((n, n - len(got), b" ".join(got)))
            n, gone, kept = zip(*out) if out else ((), (), ())
            left = [batch[k] for k in batch.schema.names if k not in ("text", "places")]
            yield pa.RecordBatch.from_arrays([*left, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([x.decode() for x in kept], pa.string())], [*(k for k in batch.schema.names if k not in ("text", "places")), "n_words", "n_removed", "kept"])

    return rows


def dedup_substrings(docs: DataFrame, width: int = 50) -> DataFrame:
    """One row for each of docs: doc_id, n_words, n_removed, kept (what is left, words joined by a space).

    A word goes if it lies in a window of `width` words that also starts in a document with a smaller doc_id. A null
    or empty text gives zeros and an empty `kept`; texts of fewer than `width` words stay; rows without a doc_id stay as they
    are; repeated rows each give a row. Other columns are ignored.
    """
    key = row_key()
    texts = docs.select("doc_id", "text", key.alias("row_key"))
    found = removed_windows(docs, width)
    return texts.join(found, ["doc_id", "row_key"], "left").select("doc_id", "text", "places").mapInArrow(_kept_words(width), "doc_id long, n_words long, n_removed long, kept string")



def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
