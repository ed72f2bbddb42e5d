"""Suffix-array deduplication of long byte strings with a logarithmic family of indexes.

Every window of `width` bytes is stood for by its least 64-byte gram (an anchor), so equal windows have equal anchors at equal
offsets. A count-min sketch of the anchors drops those that occur once. Around each repeated anchor a piece of text, all bytes of the
windows it stands for, goes to the task of its gram. There, batches of pieces arrive. Each batch gets a sparse suffix array (its anchors in
the order of gram and text from the anchor on), is merge-scanned against the levels held so far, and enters as a level of its own;
levels of equal size merge into one of twice the size.

A scan compares neighbours only. It merges two runs in suffix order, takes the common prefix of each two neighbours, and does the same for the
texts before the anchors, read backwards. A window with o bytes before its anchor repeats exactly if another piece shares o bytes
backwards and width - o forwards: pieces between which no neighbours share less lie in one interval of either array, so for each o the
pieces of one pair of intervals repeat each other. The work is that of the windows, however many pieces share a gram.

Hot groups: pieces that are equal within a block of input are settled there and one of them is sent. Anchors that the sketch counts HOT
times or more are not sent as text; their windows are compared by a 128-bit digest, one row for each digest and block, so no task holds an
unbounded group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantra.llm import sketch
from quantra.llm.common import chunks, lists, row_key, stored, text_bytes
from quantra.llm.texthash import WORD, WORD2, U, fitting, least

GRAM, HOT = 64, 4096
PIECE, WINDOW, SETTLED = 0, 1, 2
SENT = "kind int, h1 long, h2 long, doc_id long, row_key long, at int, n int, off int, settled boolean, body binary, spans array<int>"
SPANS = "doc_id long, row_key long, spans array<int>"


def _anchors(data: np.ndarray, offsets: np.ndarray, width: int):
    """Prefix hashes, gram hashes, anchors, and each one's first window and number of windows."""
    prefix = WORD.prefix(data.astype(U) + U(1))
    gram = min(GRAM, width)
    n = len(data) - gram + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return prefix, np.zeros(0, U), none, none, none
    grams = WORD.spans(prefix, np.arange(n), np.arange(gram, n + gram))
    whole = np.flatnonzero(fitting(offsets, width, len(data)))
    if not len(whole):
        return prefix, grams, whole, whole, whole
    place = least(grams, width - gram + 1)[whole]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (whole[1:] != whole[:-1] + 1)])
    return prefix, grams, place[first], whole[first], np.diff(np.append(first, len(whole)))


def _gram_keys(width: int):
    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        data, offsets = text_bytes(batch["text"])
        for _, _, part, off in chunks(data, offsets):
            _, grams, at, _, _ = _anchors(part, off, width)
            yield grams[np.unique(at)]

    return keys_of


def _batch(kind: int, count: int, **columns) -> pa.RecordBatch:
    kinds = {"h1": pa.int64(), "h2": pa.int64(), "doc_id": pa.int64(), "row_key": pa.int64(), "at": pa.int32(), "n": pa.int32(), "off": pa.int32(), "settled": pa.bool_(), "body": pa.binary(), "spans": pa.list_(pa.int32())}
    made = {k: v if isinstance(v, pa.Array) else pa.array(v, kinds[k]) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays([pa.array(np.full(count, kind), pa.int32()), *(made.get(k, pa.nulls(count, t)) for k, t in kinds.items())], ["kind", *kinds])


def _pieces(width: int, bitmaps, bits: int):
    """Pieces, digests of hot windows, and the spans that a block settles by itself."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, hot_map = bitmaps.value
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            doc_ids, keys = batch["doc_id"], batch["row_key"].to_numpy(zero_copy_only=False)
            key_of: list[bytes] = []
            piece: list[tuple[int, int, int, int, int, bytes]] = []
            hot: list[tuple[np.ndarray, ...]] = []
            for lo, _, part, off in chunks(data, offsets):
                prefix, grams, at, first, count = _anchors(part, off, width)
                more = sketch.at_least(grams[at], twice, bits)
                at, first, count = at[more], first[more], count[more]
                if not len(at):
                    continue
                very = sketch.at_least(grams[at], hot_map, bits)
                row = np.searchsorted(off, first, side="right") - 1
                raw = part.tobytes()
                for g, p, a, c, r in zip(grams[at[~very]].view(np.int64).tolist(), at[~very].tolist(), first[~very].tolist(), count[~very].tolist(), row[~very].tolist()):
                    body = raw[a : a + c - 1 + width]
                    piece.append((g, lo + r, a - int(off[r]), c, p - a, body))
                    key_of.append(xxhash.xxh3_128_digest(body) + (p - a).to_bytes(4))
                if very.any():
                    c = count[very]
                    starts = np.repeat(first[very], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                    second = WORD2.prefix(part.astype(U) + U(1))
                    r = np.repeat(row[very], c)
                    hot.append((WORD.spans(prefix, starts, starts + width), WORD2.spans(second, starts, starts + width), lo + r, starts - off[r]))
            spans: dict[int, list[int]] = {}
            seen, sent = Counter(key_of), set()
            keep = []
            for key, x in zip(key_of, piece):
                if seen[key] > 1:
                    spans.setdefault(x[1], []).extend((x[2], x[2] + x[3] - 1 + width))
                if key not in sent:
                    sent.add(key)
                    keep.append((*x, seen[key] > 1))
            for lo in range(0, len(keep), 1 << 13):
                g, r, a, c, o, body, settled = zip(*keep[lo : lo + (1 << 13)])
                yield _batch(PIECE, len(g), h1=list(g), doc_id=doc_ids.take(pa.array(r)), row_key=keys[list(r)], at=list(a), n=list(c), off=list(o), settled=list(settled), body=list(body))
            if hot:
                h1, h2, r, at = (np.concatenate(x) for x in zip(*hot))
                order = np.lexsort((h2, h1))
                h1, h2, r, at = h1[order], h2[order], r[order], at[order]
                head = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
                size = np.diff(np.append(head, len(h1)))
                many = np.repeat(size > 1, size)
                back = np.lexsort((at[many], r[many]))
                rr, aa = r[many][back], at[many][back]
                cut = np.flatnonzero(np.r_[True, (rr[1:] != rr[:-1]) | (aa[1:] > aa[:-1] + width)]) if len(rr) else []
                for x, y in zip(cut, [*cut[1:], len(rr)]):
                    spans.setdefault(int(rr[x]), []).extend((int(aa[x]), int(aa[y - 1]) + width))
                for lo in range(0, len(head), 1 << 16):
                    h = head[lo : lo + (1 << 16)]
                    yield _batch(WINDOW, len(h), h1=h1[h].view(np.int64), h2=h2[h].view(np.int64), doc_id=doc_ids.take(pa.array(r[h])), row_key=keys[r[h]], at=at[h], settled=size[lo : lo + (1 << 16)] > 1)
            if spans:
                r = sorted(spans)
                values = np.concatenate([np.array(spans[x], np.int64) for x in r])
                yield _batch(SETTLED, len(r), doc_id=doc_ids.take(pa.array(r)), row_key=keys[r], spans=lists(values, np.array([len(spans[x]) for x in r]), pa.int32()))

    return rows


class Piece:
    """A piece of text around an anchor at `off`; its first n bytes begin windows, whose marks stand from `place` on in the family's marks."""

    __slots__ = ("body", "gram", "n", "off", "place", "row")

    def __init__(self, gram: int, body: bytes, off: int, n: int, row) -> None:
        self.gram, self.body, self.off, self.n, self.row, self.place = gram, body, off, n, row, 0

    def suffix(self) -> tuple[int, bytes]:
        return self.gram, self.body[self.off :]

    def before(self) -> tuple[int, bytes]:
        return self.gram, self.body[: self.off][::-1]


def _common(a: bytes, b: bytes) -> int:
    """Bytes that a and b share from their beginning."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


def _shared(keys: list[tuple[int, bytes]]) -> np.ndarray:
    """Of each key and the one before it, the bytes shared, -1 for another gram."""
    return np.array([-1, *(_common(x[1], y[1]) if x[0] == y[0] else -1 for x, y in zip(keys, keys[1:]))][: len(keys)], np.int64)


class Family:
    """Levels of suffix arrays: level k is empty or holds what 2**k batches brought. `compared` counts comparisons of texts."""

    def __init__(self, width: int) -> None:
        self.width, self.levels, self.marks, self.compared = width, [], np.zeros(0, bool), 0

    def insert(self, batch: list[Piece]) -> None:
        place = len(self.marks)
        for p in batch:
            p.place, place = place, place + p.n
        self.marks = np.append(self.marks, np.zeros(place - len(self.marks), bool))
        new = sorted(batch, key=Piece.suffix)
        self._scan(new)
        grams = {p.gram for p in new}
        for level in self.levels:
            known = [p for p in level if p.gram in grams]
            if known:
                both = {p.gram for p in known}
                self._scan(sorted(known + [p for p in new if p.gram in both], key=Piece.suffix))  # two sorted runs: one merging pass
        k = 0
        while k < len(self.levels) and self.levels[k]:
            new = sorted(self.levels[k] + new, key=Piece.suffix)
            self.levels[k] = []
            k += 1
        if k == len(self.levels):
            self.levels.append([])
        self.levels[k] = new

    def _scan(self, run: list[Piece]) -> None:
        """Mark the windows that repeat within a run in suffix order."""
        gram = np.array([p.gram for p in run], np.int64)
        alone = np.ones(len(run), bool)
        alone[1:] &= gram[1:] != gram[:-1]
        alone[:-1] &= gram[1:] != gram[:-1]
        run = [p for p, x in zip(run, alone.tolist()) if not x]
        if not run:
            return
        count, back = len(run), sorted(range(len(run)), key=lambda i: run[i].before())
        fwd_shared, back_shared = _shared([p.suffix() for p in run]), _shared([run[i].before() for i in back])
        self.compared += 2 * (count - 1)
        rank = np.empty(count, np.int64)
        rank[back] = np.arange(count)
        off, n, place = (np.array([getattr(p, k) for p in run], np.int64) for k in ("off", "n", "place"))
        for o in range(int((off - n).min()) + 1, int(off.max()) + 1):
            at = np.flatnonzero((off - n < o) & (o <= off))
            key = np.cumsum(fwd_shared < self.width - o)[at] * (count + 1) + np.cumsum(back_shared < o)[rank[at]]
            order = np.argsort(key)
            same = np.flatnonzero(np.diff(key[order]) == 0)
            hit = at[order[np.concatenate([same, same + 1])]]
            self.marks[place[hit] + off[hit] - o] = True

    def pieces(self) -> Iterator[Piece]:
        for level in self.levels:
            yield from level

    def spans(self) -> Iterator[tuple[Piece, list[int]]]:
        """Pieces with windows that repeat, and from, to, ... of the bytes these cover in the piece."""
        for p in self.pieces():
            found = np.flatnonzero(np.diff(np.concatenate([[0], self.marks[p.place : p.place + p.n].view(np.int8), [0]])))
            if p.row and len(found):
                yield p, (found + np.tile([0, self.width - 1], len(found) // 2)).tolist()


def _repeats(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family(width)
        for batch in batches:
            columns = [batch[k].to_pylist() for k in ("h1", "body", "off", "n", "doc_id", "row_key", "at", "settled")]
            family.insert([Piece(g, body, off, n, None if settled else (doc, key, at)) for g, body, off, n, doc, key, at, settled in zip(*columns)])
        out = [(*p.row[:2], [p.row[2] + x for x in spans]) for p, spans in family.spans()]
        for lo in range(0, len(out), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[lo : lo + (1 << 14)]), (pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["doc_id", "row_key", "spans"])

    return rows


def repeated_spans(docs: DataFrame, width: int = 400) -> DataFrame:
    """(doc_id, row_key, spans): from, to, from, to, ... of bytes in windows of `width` that also start elsewhere."""
    texts = docs.select("doc_id", "text", row_key().alias("row_key")).where(F.octet_length("text") >= width)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch.width_bits(total * 2 / (width - min(GRAM, width) + 2))
    bitmaps = docs.sparkSession.sparkContext.broadcast(sketch.merged(texts, _gram_keys(width), bits, (2, HOT)))
    sent = stored(texts.mapInArrow(_pieces(width, bitmaps, bits), SENT), "pieces")
    settled = sent.where(F.col("kind") == SETTLED).select("doc_id", "row_key", "spans")
    copies = F.count("*").over(Window.partitionBy("h1", "h2"))
    windows = sent.where(F.col("kind") == WINDOW).withColumn("copies", copies).where("copies > 1 AND NOT settled")
    windows = windows.select("doc_id", "row_key", F.array(F.col("at"), F.col("at") + width).alias("spans"))
    pieces = sent.where(F.col("kind") == PIECE).select("h1", "body", "off", "n", "doc_id", "row_key", "at", "settled").repartition("h1")
    found = settled.unionByName(windows).unionByName(pieces.mapInArrow(_repeats(width), SPANS))
    return found.groupBy("doc_id", "row_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _kept_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch["text"], batch["spans"]):
            raw = (text.as_py() or "").encode()
            if not spans.is_valid:
                out.append((len(raw), 0, 0, raw))
                continue
            edges = spans.values.to_numpy(zero_copy_only=False)
            cover = np.zeros(len(raw) + 1, np.int64)
            np.add.at(cover, edges[::2], 1)
            np.add.at(cover, edges[1::2], -1)
            gone = np.cumsum(cover[:-1]) > 0
            runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
            out.append((len(raw), int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup_bytes(docs: DataFrame, width: int = 400) -> DataFrame:
    """One row for each of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes left).

    docs: doc_id long, text string. Every copy of a repeated string of `width` bytes goes, the first too; strings in one document
    repeat as well, overlapping ones included. Null and empty texts give zeros and no bytes; shorter texts stay. Repeated rows are
    copies of each other; rows without a doc_id take part. Other columns are ignored.
    """
    texts = docs.select("doc_id", "text", row_key().alias("row_key"))
    spans = repeated_spans(docs, width).select(F.col("doc_id").alias("id"), F.col("row_key").alias("key"), "spans")
    joined = texts.join(spans, texts.doc_id.eqNullSafe(spans.id) & (texts.row_key == spans.key), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_kept_bytes, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
