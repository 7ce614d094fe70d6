"""Token ids in files of fixed-width bit packing, with block offsets for random access.

A file: the blocks, then a footer, then the footer's length. Every id takes the fewest bits that the vocabulary needs,
every block holds BLOCK ids and begins on a byte. The footer has the width, the counts, each block's offset, and each
document's id, first position and whether it has no id. unpack() turns any range of ids into a numpy array without touching other blocks.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafquery.llm.common import file_bytes, fresh_dir, short_batches, texts_of
from leafquery.llm.splitters import exact_splitters, with_part

MAGIC = b"LQPACK01"
BLOCK = 1 << 14
#: Text bytes meant for one file, and the most files; beyond that, files grow (they are written as a stream).
FILE_BYTES, MOST_FILES = 24 << 20, 65_536
MOST_WORDS = 400_000
#: A word on its line: lower-case letters (those whose case is plain) and the marks after them, or anything else.
_STEM = re.compile(r"""^(?:([a-z\u00df-\u00f6\u00f8-\u012f]+)([.,;:!?"#$%&*|()]*)|.*)$""", re.M)


#: Widths that are numbers of whole bytes: the same bits as any other width would give.
WHOLE = {8: "u1", 16: "<u2", 32: "<u4"}


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids in width bits each, lowest bit first, padded to whole bytes."""
    if width in WHOLE:
        return ids.astype(WHOLE[width]).tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, width: int, first: int, count: int) -> np.ndarray:
    """count ids from position first, as 32-bit integers: each is cut from the eight bytes in which it begins."""
    if count <= 0:
        return np.empty(0, np.uint32)
    if width in WHOLE:
        return np.frombuffer(data, WHOLE[width], count, first * width // 8).astype(np.uint32)
    at = (np.arange(first, first + count, dtype=np.int64)) * width
    low, high = int(at[0] >> 3), int((at[-1] + width + 7) >> 3)
    raw = np.zeros(high - low + 8, np.uint8)
    raw[: high - low] = np.frombuffer(data, np.uint8, high - low, low)
    byte = (at >> 3) - low
    word = np.zeros(count, np.uint64)
    for k in range((width + 7 + 7) // 8):
        word |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


class Writer:
    """Takes documents in order and writes one file; nothing of it can be seen before close()."""

    def __init__(self, uri: str, width: int):
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.width, self.rest, self.held, self.at, self.n = width, [], 0, 0, 0
        self.offsets: list[int] = []
        self.doc_ids: list[int | None] = []
        self.starts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.n)
        self.n += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 16 * BLOCK:
            self._blocks(self.held // BLOCK * BLOCK)

    def _blocks(self, upto: int) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.empty(0, np.uint32)
        for k in range(0, upto, BLOCK):
            data = pack(ids[k : min(k + BLOCK, upto)], self.width)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.rest, self.held = [ids[upto:]], len(ids) - upto

    def close(self) -> int:
        self._blocks(self.held)
        index = [self.offsets, [x or 0 for x in self.doc_ids], self.starts]
        docs = b"".join(np.array(x, "<i8").tobytes() for x in index) + bytes(x is None for x in self.doc_ids)
        footer = struct.pack("<IIQQQ", self.width, BLOCK, self.n, len(self.offsets), len(self.doc_ids)) + docs
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.out.close()
        self.fs.move(self.temp, self.path)
        return self.n


class Reader:
    """ids(first, count) reads only the blocks in question."""

    def __init__(self, uri: str):
        self.fs, path = fs.FileSystem.from_uri(uri)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 16)
        (length,) = struct.unpack("<Q", self.file.read(8))
        if self.file.read(8) != MAGIC:
            raise ValueError(f"{uri} is not a file of packed ids")
        self.file.seek(size - 16 - length)
        footer = self.file.read(length)
        self.end = size - 16 - length
        self.width, self.block, self.n, blocks, docs = struct.unpack_from("<IIQQQ", footer)
        x = np.frombuffer(footer, "<i8", blocks + 2 * docs, struct.calcsize("<IIQQQ"))
        self.offsets, self.starts = x[:blocks], x[blocks + docs :]
        self.doc_ids = [None if none else i for i, none in zip(x[blocks : blocks + docs].tolist(), footer[-docs:] if docs else b"", strict=True)]

    def ids(self, first: int, count: int) -> np.ndarray:
        out = []
        while count > 0:
            k, inside = divmod(first, self.block)
            take = min(count, self.block - inside)
            stop = int(self.offsets[k + 1]) if k + 1 < len(self.offsets) else self.end
            self.file.seek(int(self.offsets[k]))
            out.append(unpack(self.file.read(stop - int(self.offsets[k])), self.width, inside, take))
            first, count = first + take, count - take
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def documents(self, run: int = 64) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Each document's id, first position and ids, reading some blocks at a time."""
        stops = np.append(self.starts[1:], self.n)
        held, low = np.empty(0, np.uint32), 0
        for doc_id, start, stop in zip(self.doc_ids, self.starts.tolist(), stops.tolist(), strict=True):
            if stop > low + len(held):
                held, low = np.concatenate([held[start - low :], self.ids(low + len(held), min(self.n, max(stop, low + len(held) + run * self.block)) - low - len(held))]), start
            yield doc_id, start, held[start - low : stop - low]


class WordEncoder:
    """Ids by the tokenizers library. The tokenizer drops white space and joins nothing across it, so the words
    between spaces and line ends are encoded once and remembered, as little-endian integers of `kind`."""

    def __init__(self, data: bytes, kind: str = "<u4"):
        from tokenizers import Tokenizer

        self.lib, self.kind = Tokenizer.from_str(data.decode()), kind
        ends = [i for word, i in self.lib.get_vocab().items() if word.endswith("</w>")]
        self.ends = np.zeros(max(self.lib.get_vocab().values()) + 1, bool)
        self.ends[ends] = True
        self.batch = getattr(self.lib, "encode_batch_fast", self.lib.encode_batch)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Encode words that are not known. Plain letters are one unit to the tokenizer, whatever their case, and marks
        after them another, so only stems and marks are encoded, many stems in one call and told apart by the ends of
        units."""
        known, words = self.words, list(words)
        if not words:
            return
        parts = _STEM.findall("\n".join(words).lower())
        stems, tails = [p[0] for p in parts], [p[1] for p in parts]
        if len(parts) != len(words):  # lower case that adds lines does not exist; then nothing is taken apart
            stems = tails = [""] * len(words)
        alone = [word for word, stem in zip(words, stems) if not stem]  # noqa: B905
        new = list(set(stems).difference(known, ("",)))
        alone += set(tails).difference(known, alone)
        for k in range(0, len(new), 512):
            part = new[k : k + 512]
            ids = np.array(self.batch([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                stops = (ends * np.dtype(self.kind).itemsize).tolist()
                raw = ids.astype(self.kind).tobytes()
                known.update(zip(part, [raw[a:b] for a, b in zip([0, *stops], stops)]))  # noqa: B905
            else:  # a vocabulary whose units do not end visibly
                alone += part
        for k in range(0, len(alone), 4096):
            part = alone[k : k + 4096]
            for word, e in zip(part, self.batch(part, add_special_tokens=False), strict=True):
                known[word] = np.array(e.ids, self.kind).tobytes()
        known.update([(word, known[stem] + known[tail] if tail else known[stem]) for word, stem, tail in zip(words, stems, tails) if stem])  # noqa: B905

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split).difference(self.words)
        if self.older:
            again = {w: x for w in new if (x := self.older.get(w)) is not None}
            self.words.update(again)
            new.difference_update(again)
        self.learn(new)
        known = self.words.__getitem__
        out = [b"".join(map(known, words)) for words in split]
        if len(self.words) >= MOST_WORDS:
            self.older, self.words = self.words, {}
        return out


_encoders: dict[str, WordEncoder] = {}


def word_encoder(data: bytes, kind: str = "<u4") -> WordEncoder:
    key = hashlib.sha256(data).hexdigest() + kind
    if key not in _encoders:
        _encoders[key] = WordEncoder(data, kind)
    return _encoders[key]


def vocabulary_of(data: bytes) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(data.decode()).get_vocab_size(with_added_tokens=True)


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, to: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, append end_id to each, and write files in ascending order of the id column below `to`.

    Returns one row per file: part, uri, n_docs, n_tokens, in the order of the ids. Null texts count as empty and get
    the end id alone; rows with a null id come first and keep it; repeated
    ids stay next to each other. Further columns are ignored. An empty table writes nothing.
    """
    spark = docs.sparkSession
    short_batches(spark)
    to = to or fresh_dir(spark, "ids")
    data = file_bytes(tokenizer_path)
    vocab = spark.sparkContext.broadcast(data)
    width = width_of(max(vocabulary_of(data), end_id + 1))
    kind = "<u2" if width <= 16 else "<u4"
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long") + 16
    total = slim.agg(F.sum(size)).first()[0] or 0
    parts = max(1, min(MOST_FILES, round(total / FILE_BYTES)))
    cuts = exact_splitters(slim.where("doc_id is not null"), F.col("doc_id"), size, [k / parts for k in range(1, parts)], [0.1 * total / parts] * (parts - 1), bins=max(4096, 4 * parts))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = word_encoder(vocab.value, kind)
        tail = np.array([end_id], kind).tobytes()
        for batch in batches:
            ids = [x + tail for x in use.encode(texts_of(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, done = None, None, []

        def end():
            if out:
                done.append((now, uri, len(out.doc_ids), out.close()))

        uri = ""
        for batch in batches:
            for part, doc_id, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    end()
                    now, uri = part, f"{to}/ids-{part:05d}.lqp"
                    out = Writer(uri, width)
                out.add(doc_id, np.frombuffer(ids, kind))
        end()
        cols = list(zip(*done, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "uri", "n_docs", "n_tokens"])

    coded = slim.mapInArrow(encode, "doc_id long, ids binary")
    dealt = with_part(coded, F.col("doc_id"), cuts, "part").select(F.coalesce("part", F.lit(0)).cast("int").alias("part"), "doc_id", "ids")
    files = dealt.repartitionById(parts, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "ids").mapInArrow(write, "part int, uri string, n_docs long, n_tokens long")
    rows = sorted(tuple(r) for r in files.collect())  # one short row for each file
    return spark.createDataFrame(rows, "part int, uri string, n_docs long, n_tokens long")


def read_ids(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids in all documents before it), n_tokens, ids_crc32 of the ids as
    little-endian unsigned 32-bit integers."""
    spark = files.sparkSession
    base, rows = 0, []
    for r in sorted(files.collect(), key=lambda r: r.part):
        rows.append((r.uri, base))
        base += r.n_tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "start", "n_tokens", "ids_crc32"], [pa.int64()] * 4
        for batch in batches:
            for uri, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = []
                for doc_id, start, ids in Reader(uri).documents():
                    held.append((doc_id, before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    listed = spark.createDataFrame(rows, "uri string, base long").repartition(max(1, len(rows)))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
