"""Token ids of texts, and their files: ids one after another with Elias-Fano encoded document boundaries.

A file holds a run of documents in ascending doc_id order: a header, the ids as 16- or 32-bit integers, the doc_ids, and
the documents' ends as an Elias-Fano sequence. With n documents over u ids each end costs log2(u/n) + 2 bits, plus a
sample for each 64th; ``EliasFano.select`` gives a document's end from those without a table of offsets.

Defined results: a null text is empty (its document has only the end id); documents with equal doc_ids stand in the order
of their texts' checksums, then of their texts; a null doc_id comes first; no rows give no rows; other columns of the input are not carried.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparkgrove.llm.common import id_text, keeps, planned_bytes, shared_dir, stored, texts_of, tidy, to_arrow

#: Words whose ids a worker keeps; with more of them it takes over only those that come again.
WORDS_KEPT = 250_000
#: In bytes.
LONGEST_WORD_KEPT = 48
#: Signs that are split off the word before them.
TAIL = b".,;:!?"
#: Bytes of UTF-8 with A-Z in lower case and line feeds as spaces.
LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 10 else c for c in range(256))
#: Bytes of UTF-8 by kind: a letter or digit, a space, a sign of TAIL, another sign, part of a character beyond ASCII.
KINDS = bytes(ord("a") if chr(c).isalnum() and c < 128 else ord(" ") if c in b" \n" else ord(".") if c in TAIL else ord("#") if c < 128 else ord("?") for c in range(256))


def _byte_level() -> dict[int, str]:
    """For each letter of Latin-1 beyond ASCII its UTF-8 bytes as byte-level vocabularies write them.

    Printable bytes stand for themselves, the others for the code points from 256 on, in their order.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in printable)}
    return {c: "".join(chr(b if b in printable else others[b]) for b in chr(c).encode()) for c in range(128, 256)}


BYTE_LEVEL = _byte_level()
#: No run of these alone is split, nor are they letters.
SIGNS = string.punctuation
SAMPLE = 64
MAGIC = b"SGEF0001"
SHARD_IDS = 1 << 20
PART_BYTES = 256 << 20


class Words(dict):
    """The ids of words, as bytes, by the words' UTF-8; those not at hand are worked out when they are asked for."""

    def __init__(self, tokenizer, typecode: str):
        self.tokenizer, self.model, self.typecode = tokenizer, tokenizer.model, typecode
        self.old: dict[bytes, bytes] = {}
        self[b""] = b""

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.ids_of(word.decode())
        if len(word) <= LONGEST_WORD_KEPT:
            self[word] = ids
        return ids

    def ids_of(self, word: str) -> bytes:
        """Letters and a run of signs after them are kept apart by the vocabulary's splitting.

        Its normalizer takes lower case, which is plain for Latin-1, whose words need no normalizing or splitting then.
        """
        core = word if word.isalpha() else word.rstrip(SIGNS)
        if core.isalpha() and len(core) <= LONGEST_WORD_KEPT and (core.isascii() or max(core) < "\u0100"):
            if core is not word:
                return self[core.lower().encode()] + self[word[len(core) :].encode()]
            plain = word.lower() if word.isascii() else word.lower().translate(BYTE_LEVEL)
            return array(self.typecode, [t.id for t in self.model.tokenize(plain)]).tobytes()
        return array(self.typecode, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def renew(self) -> None:
        """Keep only those of the words at hand that are asked for again."""
        self.old = dict(self)
        self.clear()
        self[b""] = b""

    def forget(self) -> None:
        self.renew()
        self.old = {}


def split_words(text: str) -> list[bytes]:
    """The text at spaces and line feeds as UTF-8, in ASCII lower case where that can't change its ids.

    It can where a special token is written in capitals, or where a mark joins a small letter but not the capital. Signs of
    TAIL are words of their own if each before a space stands after a letter or a digit, for then no run of signs is cut.
    """
    data = text.encode()
    if b"<|" in data or b"\xcc" in data or b"\xcd" in data:
        return data.replace(b"\n", b" ").split(b" ")
    kinds = data.translate(KINDS)
    data = data.translate(LOWER)
    if b".. " not in kinds and b"#. " not in kinds and (b"?. " not in kinds or _all_letters(text)):
        for sign in TAIL:
            data = data.replace(b"%c " % sign, b" %c " % sign)
    return data.split(b" ")


def _all_letters(text: str) -> bool:
    """Whether the characters beyond ASCII are Latin letters that stay such in lower case (a capital I with a dot doesn't)."""
    return all(x.isascii() or x < "\u0250" and x != "\u0130" and x.isalpha() for x in set(text))


class TextEncoder:
    """Encodes with the tokenizers library and keeps the ids of words.

    The vocabulary's splitting never crosses a space or line feed and drops them, so a text's ids are those of its words
    between them, one after another.
    """

    _open: dict[str, TextEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.words = Words(self.tokenizer, "HI"[self.dtype.itemsize == 4])

    @classmethod
    def get(cls, path: str) -> TextEncoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    @classmethod
    def forget(cls) -> None:
        """Let go of the words kept."""
        for x in cls._open.values():
            x.words.forget()

    def encode(self, texts: list[str], end: int, kept: int | None = None) -> Iterator[bytes]:
        """The ids of each text and the end id, as bytes of self.dtype. kept: words whose ids stay at hand."""
        kept = WORDS_KEPT if kept is None else kept
        tail = np.array([end], self.dtype).tobytes()
        get = self.words.__getitem__
        for text in texts:
            if len(self.words) > kept:
                self.words.renew()
            yield b"".join(map(get, split_words(text))) + tail


keeps("words", TextEncoder.forget)


# ---- Elias-Fano ---------------------------------------------------------------------------------------------------


class EliasFano:
    """A rising sequence of integers up to ``universe``, in about log2(universe / n) + 2 bits each."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) if n else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.reshape(-1), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, universe, low_bits, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """Value i: from the sample before it, over the bytes of the high bits up to its one."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE  # ones to pass after the one at ``at``
        byte, bits = at >> 3, int(self.high[at >> 3]) >> (at & 7) << (at & 7)
        while (count := bits.bit_count()) <= left:
            left -= count
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        one = byte * 8 + (bits & -bits).bit_length() - 1
        first = i * self.low_bits
        window = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3].tobytes(), "little") >> (first & 7)
        return one - i << self.low_bits | window & (1 << self.low_bits) - 1

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return (ones - np.arange(self.n) << self.low_bits) + low

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQIIII", self.n, self.universe, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, universe, low_bits, low, high, samples = struct.unpack_from("<QQIIII", data)
        at = struct.calcsize("<QQIIII")
        return cls(
            n, universe, low_bits, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low),
            np.frombuffer(data, "<u4", samples, at + low + high),
        )


# ---- files --------------------------------------------------------------------------------------------------------


def file_bytes(ids: list[bytes], width: int, doc_ids: list[int | None]) -> bytes:
    """One file of documents. A null doc_id is written as a flag beside a zero."""
    ends = np.cumsum([len(x) // width for x in ids])
    keys = np.array([x or 0 for x in doc_ids], "<i8").tobytes()
    nulls = np.packbits([x is None for x in doc_ids], bitorder="little").tobytes()
    body = b"".join(ids)
    return MAGIC + struct.pack("<IQQ", width, len(ids), len(body)) + body + keys + nulls + EliasFano.of(ends).to_bytes()


class TokenFile:
    """Reads one file: the ids and the bounds of each of its documents."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        width, n, size = struct.unpack_from("<IQQ", data, 8)
        at = 8 + struct.calcsize("<IQQ")
        self.ids = np.frombuffer(data, f"<u{width}", size // width, at)
        keys = np.frombuffer(data, "<i8", n, at + size)
        nulls = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at + size + 8 * n), count=n, bitorder="little")
        self.doc_ids = [None if x else int(k) for k, x in zip(keys, nulls, strict=True)]
        self.ends = EliasFano.from_bytes(data[at + size + 8 * n + -(-n // 8) :])

    def __len__(self) -> int:
        return self.ends.n

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


FILES = "part int, shard int, first_id long, n_docs long, n_ids long, start_in_part long, file binary"


def write_token_files(docs: DataFrame, tokenizer: str, end: int, path: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode docs and write their files below path (a folder that all executors share), in ascending doc_id order.

    The rows are dealt out by ranges of doc_id (of equal ones, of the texts' checksums), so a part's documents follow those
    of the part before it. There are as many parts as a shuffle has, or more: one for each PART_BYTES of input. A part has
    files of shard_ids ids or one document more. The files are the binary column of a Parquet table, which any store that
    Spark can write can hold. Returns that table, read back.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), planned_bytes(docs) // PART_BYTES)
    arrow = to_arrow(spark, FILES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = TextEncoder.get(tokenizer), TaskContext.get().partitionId()
        width = encoder.dtype.itemsize
        keys, ids, size, start, shard = [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            n = size // width
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "first_id": keys[0], "n_docs": len(ids), "n_ids": n, "start_in_part": start, "file": file_bytes(ids, width, keys)}], schema=arrow)

        for batch in batches:
            for key, coded in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts_of(batch), end), strict=True):
                keys.append(key)
                ids.append(coded)
                size += len(coded)
                if size >= shard_ids * width:
                    yield row()
                    start, shard = start + size // width, shard + 1
                    keys, ids, size = [], [], 0
        if ids:
            yield row()

    summed = id_text(docs).withColumn("crc", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    dealt = summed.repartitionByRange(parts, "doc_id", "crc").sortWithinPartitions("doc_id", "crc", "text").select("doc_id", "text")
    return stored(dealt.mapInArrow(tidy(run, "words"), FILES), path or shared_dir(spark))


def with_starts(files: DataFrame) -> DataFrame:
    """Adds start: the ids of all files before. Only a row for each part is summed up in one place.

    These rows go to all executors: they are as many as the parts that files were dealt out to, so no file is shuffled.
    """
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return files.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("start_in_part")).drop("base")


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document from the files: its place among all ids, its length and the crc of its ids."""
    arrow = to_arrow(files.sparkSession, DIGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("file"), strict=True):
                file = TokenFile(data.as_buffer().to_pybytes())
                ends = file.ends.values()
                starts = np.concatenate([[0], ends[:-1]])
                crcs = [zlib.crc32(file.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, pa.int64()), pa.array(starts + start, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())], schema=arrow)

    return with_starts(files).select("start", "file").mapInArrow(tidy(run), DIGEST)
