"""Token files with directly addressable codes.

A token id is cut into 8-bit chunks, least first. Level 0 holds the first chunk of every id, level k the k-th chunk of
those that have one; a bit map beside each level marks the ids that go on, and a rank directory (the number of marks before each
512 bits) takes a place in one level to its place in the next. Any token is read from as many bytes as it has chunks, without
decoding what is around it.

The files are tables of segments of whole documents (SEGMENT_TOKENS tokens and a chunk's at most, unless one document has more) in ascending doc_id order: `part` and
`seq` give the order, `first` the tokens of the part before the segment, `doc_ids` and `doc_tokens` its documents, `payload` its codes.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantra.llm.common import chunks, frugal, ranges, row_key, scratch, small, text_bytes

SEGMENT_TOKENS = 1 << 20
END_ID = 2
RANK_BITS = 512
MAGIC = b"DAC1"


def pack(ids: np.ndarray) -> bytes:
    """The codes of one segment: magic, tokens, levels; then of each level its size, chunks, bit map and rank directory."""
    ids, levels = ids.astype(np.uint32), []
    while True:
        more = ids > 0xFF
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(more) // RANK_BITS) * RANK_BITS, bool)
        padded[: len(more)] = more
        ranks = np.concatenate([[0], np.cumsum(padded.reshape(-1, RANK_BITS).sum(axis=1))]).astype("<u4")
        levels.append((ids.astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        if not more.any():
            break
        ids = ids[more] >> np.uint32(8)
    head = MAGIC + struct.pack("<QB", len(levels[0][0]), len(levels))
    return head + b"".join(struct.pack("<QQQ", *map(len, x)) + b"".join(x) for x in levels)


class Codes:
    """One segment's codes: a token by its place, or all of them."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.size, count = struct.unpack_from("<QB", payload, 4)
        self.levels, at = [], 13
        for _ in range(count):
            sizes = struct.unpack_from("<QQQ", payload, at)
            at += 24
            level = []
            for n, kind in zip(sizes, (np.uint8, np.uint8, "<u4")):
                level.append(np.frombuffer(payload, kind, n // np.dtype(kind).itemsize, at))
                at += n
            self.levels.append(level)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, place: int) -> int:
        if not 0 <= place < self.size:
            raise IndexError(place)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[place]) << shift
            if not bits[place >> 3] >> (place & 7) & 1:
                break
            block = place // RANK_BITS
            lo, hi = block * RANK_BITS >> 3, place >> 3
            before = int(np.bitwise_count(bits[lo:hi]).sum()) + (int(bits[hi]) & (1 << (place & 7)) - 1).bit_count()
            place, shift = int(ranks[block]) + before, shift + 8
        return value

    def all(self) -> np.ndarray:
        ids = self.levels[0][0].astype(np.uint32)
        at = np.arange(self.size)
        for k, (_, bits, _) in enumerate(self.levels[:-1]):
            at = at[np.unpackbits(bits, count=len(at), bitorder="little").astype(bool)]
            ids[at] |= self.levels[k + 1][0].astype(np.uint32) << np.uint32(8 * (k + 1))
        return ids


def _classes() -> np.ndarray:
    """Bytes by what the byte-level splitter never joins: 1 ASCII letters, 2 digits, 3 other printable ASCII, 4 white space; 0 for the rest and the apostrophe."""
    out = np.zeros(256, np.uint8)
    for b in range(33, 127):
        out[b] = 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 * (chr(b) != "'")
    out[[9, 10, 11, 12, 13, 32]] = 4
    return out


CLASSES, WHITE = _classes(), 4
#: White space outside ASCII and separators, which the splitter may read as white space.
ODD = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: The splitter that `unit_starts` knows.
BYTE_LEVEL = {"normalizer": None, "post_processor": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}}


def unit_starts(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where the units of every row start; a row marked in `whole` is one unit.

    A unit is a run of one class (or of unclassed bytes and what they touch) with one space before it, or a run of white space; before a word, the
    last byte of a run of white space is a unit of its own, or the word's space.
    """
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    kind = CLASSES[data]
    start = np.zeros(n + 1, bool)
    white = kind == WHITE
    before, now = kind[:-1], kind[1:]
    start[1:n] = (before != now) & (now > 0) & (before > 0) & ~white[:-1]
    start[1:n] |= white[1:] & ~white[:-1]
    word = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    word = word[~first[word]]
    start[word - 1] = True
    start[word[data[word - 1] != 0x20]] = True
    if whole.any():
        inside = np.repeat(whole, np.diff(offsets))
        start[:n][inside] = False
    start[offsets] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Token ids by the tokenizers library, each distinct unit of text once.

    For a byte-level vocabulary whose splitter never joins text across units, texts are cut into units, a chunk's distinct units are looked up
    in a store, and the library encodes those that are new. At KEPT units the store keeps only those met again since the last time. Texts with
    a special token's string or with odd white space, and all texts of any other kind of vocabulary, are units as a whole.
    """

    KEPT, CHUNK, CALL = 300_000, 2 << 20, 256

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        made = json.loads(self.tokenizer.to_str())
        splitter = made["pre_tokenizer"] or {}
        self.by_unit = all(made[k] is None for k in ("normalizer", "post_processor")) and all(splitter.get(k) == v for k, v in BYTE_LEVEL["pre_tokenizer"].items())
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.place: dict[bytes, int] = {}
        self.ids, self.counts, self.again = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)

    @classmethod
    def of(cls, vocabulary: str) -> Encoder:
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = cls(vocabulary)
        return _ENCODERS[vocabulary]

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[bytes], whole: list[bool]) -> None:
        """Encode new units; those that are neither white space nor whole texts in lines, as a line end between them is always a token of its own."""
        lined, rest = [], []
        for x, apart in zip(units, whole):
            (rest if apart or x.isspace() else lined).append(x)
        ids, counts = [self.ids], [self.counts]
        for lo in range(0, len(lined), self.CALL * 64):
            part = lined[lo : lo + self.CALL * 64]
            got = np.concatenate([np.append(x, self.line) for x in self._encoded([b"\n".join(part[k : k + self.CALL]).decode() for k in range(0, len(part), self.CALL)])])
            ends = np.flatnonzero(got == self.line[0])
            if len(ends) != len(part):
                raise ValueError("the vocabulary joins text across line ends")
            ids.append(got[got != self.line[0]])
            counts.append(np.diff(ends, prepend=-1) - 1)
        for x in self._encoded([x.decode() for x in rest]):
            ids.append(x)
            counts.append(np.array([len(x)]))
        self.place.update(zip(lined + rest, range(len(self.place), len(self.place) + len(units))))
        self.ids, self.counts = np.concatenate(ids), np.concatenate(counts)
        self.again = np.append(self.again, np.zeros(len(units), bool))

    def _forget(self) -> None:
        keep = self.again if 2 * self.again.sum() <= self.KEPT else np.zeros(len(self.again), bool)
        self.ids, self.counts = self.ids[np.repeat(keep, self.counts)], self.counts[keep]
        self.place = {x: i for i, x in enumerate(x for x, k in zip(self.place, keep.tolist()) if k)}
        self.again = np.zeros(len(self.counts), bool)

    def _chunk(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and each row's count."""
        starts = unit_starts(data, offsets, whole)
        edges = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, edges, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = units.dictionary.to_pylist()
        if len(self.place) > self.KEPT:
            self._forget()
        place = np.fromiter(map(self.place.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(place < 0)
        self.again[place[place >= 0]] = True
        if len(new):
            apart = np.zeros(len(distinct), bool)
            apart[units.indices.to_numpy()[np.searchsorted(starts, offsets[:-1])[whole & (np.diff(offsets) > 0)]]] = True
            self._learn([distinct[i] for i in new], apart[new].tolist())
            place[new] = np.fromiter((self.place[distinct[i]] for i in new), np.int64, len(new))
        which = place[units.indices.to_numpy()]
        counts = self.counts[which]
        ids = self.ids[ranges((np.cumsum(self.counts) - self.counts)[which], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(ends[np.searchsorted(starts, offsets)])

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First row, end row, ids of all rows between, and each row's count; a null text has no ids."""
        text = pc.fill_null(column, "")
        whole = np.full(len(text), not self.by_unit)
        for odd in (pc.match_substring_regex(text, ODD), *(pc.match_substring(text, x) for x in self.special)):
            whole |= odd.to_numpy(zero_copy_only=False)
        for lo, hi, part, offsets in chunks(*text_bytes(text), self.CHUNK):
            yield lo, hi, *self._chunk(part, offsets, whole[lo:hi])


_ENCODERS: dict[str, Encoder] = {}

SEGMENTS = "part int, seq int, first long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, payload binary"


def _segments(vocabulary: str, end_id: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(vocabulary), TaskContext.get().partitionId()
        seq = first = 0
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, first, held
            ids, counts = (np.concatenate(x) for x in zip(*(x[:2] for x in held)))
            out = [[part], [seq], [first], [len(ids)], [[x for y in held for x in y[2].to_pylist()]], [counts], [pack(ids)]]
            seq, first, held = seq + 1, first + len(ids), []
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], ["part", "seq", "first", "n_tokens", "doc_ids", "doc_tokens", "payload"])

        for batch in batches:
            for lo, hi, ids, counts in encoder(batch["text"]):
                held.append((np.insert(ids, np.cumsum(counts), end_id), counts + 1, batch["doc_id"][lo:hi]))
                if sum(len(x[0]) for x in held) >= SEGMENT_TOKENS:
                    yield flush()
        if held:
            yield flush()

    return rows


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode every text of docs (doc_id long, text string) and write the token files.

    A null or empty text has the end id alone; rows without doc_id come first; rows that share a doc_id follow in the
    order of their texts' hashes. Other columns are ignored.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    key = row_key().alias("row_key")
    ordered = docs.select("doc_id", "text", key).repartitionByRange("doc_id", "row_key").sortWithinPartitions("doc_id", "row_key")
    ordered.select("doc_id", "text").mapInArrow(frugal(_segments(vocabulary, end_id)), SEGMENTS).write.option("compression", "zstd").parquet(path)


def _part_starts(segments: DataFrame) -> DataFrame:
    """The tokens before each part: one row for each task that wrote."""
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, first, doc_ids, counts, payload in zip(*(batch[k] for k in ("part", "first", "doc_ids", "doc_tokens", "payload"))):
            n = np.array(counts.as_py(), np.int64)
            ends = np.cumsum(n)
            raw = memoryview(Codes(payload.as_py()).all().astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * (b - a) : 4 * b]) for a, b in zip(n.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(n), pa.int32()), doc_ids.values, pa.array(first.as_py() + ends - n), pa.array(n), pa.array(crc, pa.int64())], ["part", "doc_id", "in_part", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files: rows as they were written, repeated ones and those without doc_id too; files without documents give none."""
    segments = spark.read.parquet(path)
    docs = segments.mapInArrow(frugal(_documents), "part int, doc_id long, in_part long, n_tokens long, ids_crc32 long")
    starts = small(_part_starts(segments), 100_000)
    return docs.join(starts, "part").select("doc_id", (F.col("part_start") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_ids, counts, payload in zip(*(batch[k] for k in ("doc_ids", "doc_tokens", "payload"))):
            offsets = np.concatenate([[0], np.cumsum(counts.as_py())]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(Codes(payload.as_py()).all().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([doc_ids.values, ids], ["doc_id", "ids"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (with the end id) of every document."""
    return spark.read.parquet(path).mapInArrow(_ids, "doc_id long, ids array<long>")


def _lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_ids, tokens, places, payload in zip(*(batch[k] for k in ("of", "token", "places", "payload"))):
            codes = Codes(payload.as_py())
            yield pa.RecordBatch.from_arrays([doc_ids.values, tokens.values, pa.array([codes[int(p)] for p in places.values.to_numpy()], pa.int64())], ["doc_id", "token", "id"])


def tokens_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """wanted: (doc_id long, token long, from 0) -> doc_id, token, id by random access; places outside a document give no row."""
    segments = spark.read.parquet(path)
    each = segments.select("part", "seq", F.posexplode(F.arrays_zip("doc_ids", "doc_tokens")).alias("at", "doc"), "doc_tokens")
    where = each.select("part", "seq", F.col("doc.doc_ids").alias("doc_id"), F.col("doc.doc_tokens").alias("n"), F.aggregate(F.slice("doc_tokens", 1, F.col("at")), F.lit(0).cast("long"), lambda a, x: a + x).alias("before"))
    hits = wanted.join(where, "doc_id").where("token >= 0 AND token < n").select("part", "seq", F.struct("doc_id", "token", (F.col("before") + F.col("token")).alias("place")).alias("hit"))
    sets = hits.groupBy("part", "seq").agg(F.collect_list("hit").alias("hits"))
    found = segments.select("part", "seq", "payload").join(sets, ["part", "seq"])
    return found.select(F.col("hits.doc_id").alias("of"), F.col("hits.token").alias("token"), F.col("hits.place").alias("places"), "payload").mapInArrow(_lookup, "doc_id long, token long, id long")


def token_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the token files of docs (in the shared folder unless a path is given) and read their documents back.

    A null or empty text is its end id; a very long one is a segment of its own; repeated rows each have their place, ties of doc_id in the order of the texts' hashes, rows without
    doc_id first. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    path = path or f"{scratch(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path)
    return read_documents(spark, path)


def op5_token_output(spark, sf_dir: str) -> DataFrame:
    return token_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
