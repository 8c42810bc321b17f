"""Token ids in binary files: patched frame-of-reference blocks with an index.

Documents are ordered by id over range partitions; each partition becomes a shard of segments, and
a segment holds whole documents, about ``SEGMENT`` ids. The files are Parquet, one row per segment:

* ``shard``, ``segment``, ``before`` (ids of the shard before the segment), ``n_ids``
* ``doc_ids`` and ``lengths``: the documents of the segment, in order
* ``payload``: the ids. After a header of magic, block size, ids, blocks and exceptions come the
  byte starts of the blocks (one more than blocks), block minima, widths, starts of each block's
  exceptions, exception positions and values, and the packed blocks. A block holds the differences
  of its ids to its minimum, packed at the width that ``PERCENTILE`` of them fit in; the others are
  exceptions, stored whole. Block starts allow reading any range of ids alone.

A second table has the ids before each shard, so that a document's place among all ids is known.

Defined results: a null or empty text is only the end id. Rows with a null doc_id come first. Rows
that repeat a doc_id are documents of their own, in order of text. An empty table gives empty
files. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import table, write_small_batches
from gridloom.session import scratch_folder

BLOCK, SEGMENT, PERCENTILE = 128, 65_536, 0.95
MAGIC, HEADER = b"PFR1", struct.Struct("<4sHQII")
END_ID = 0
#: Pieces whose ids a worker remembers (both halves of the memory hold at most so many), pieces
#: encoded together, and characters cut together.
REMEMBERED, TOGETHER, CHARACTERS = 300_000, 50_000, 1 << 24
#: Signs that are a piece of their own after a word.
END_SIGNS = ".,;:"
#: A sign that no text is cut at holds the pieces of a text apart; texts that have it are not cut.
CUT = "\x01"
#: White space at which a text can't be cut: the tokenizer may join it to its neighbours.
UNEVEN = re.compile(r"[^\S \n]|[ \n]{2}")
UNEVEN_PAIRS = ("  ", " \n", "\n ", "\n\n")


def byte_letters() -> str:
    """The letters that byte-level vocabularies write bytes with, by byte: printable bytes as they
    are, the others in order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return "".join(chr(b if b in plain else 256 + others.index(b)) for b in range(256))


def _is_uneven(text: str) -> bool:
    """Whether a text can't be cut. White space other than a space is never printable, so plain searches
    settle most texts."""
    if CUT in text or "<|" in text or any(pair in text for pair in UNEVEN_PAIRS):
        return True
    return not text.replace("\n", "").isprintable() and UNEVEN.search(text) is not None


class Encoder:
    """Ids of texts by a tokenizer file.

    A byte-level tokenizer cuts a text before each space and around line ends, so texts are cut
    there, the pieces of a batch are told apart by Arrow's dictionary, and each different piece is
    encoded once and remembered. Letters alone are one word to the tokenizer, so they go to its model
    directly; other pieces are encoded many in one text, with line ends between them. Texts with
    other or repeated white space are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 2**16 else "<u4")
        # Pieces are remembered here; the model's own memory would only cost time.
        model = self._tokenizer.model
        model._resize_cache(0)
        self._word = model.tokenize
        self._code = "H" if self.kind.itemsize == 2 else "I"
        self._letters = byte_letters()
        self._line = self.whole("\n")
        self._signs = {sign: self.whole(sign).tobytes() for sign in END_SIGNS}
        # A space alone is the end of a text.
        self._base = {"": b"", "\n": self._line.tobytes(), " ": self.whole(" ").tobytes()}
        self._known: dict[str, bytes] = dict(self._base)
        self._older: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def forget(self) -> None:
        """Give up what is remembered: a worker lives on after its task, beside other work."""
        self._known, self._older = dict(self._base), {}
        pa.default_memory_pool().release_unused()

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, which are not empty and hold no white space but a first space."""
        out: list[bytes] = []
        for at in range(0, len(pieces), TOGETHER):
            part = pieces[at : at + TOGETHER]
            ids = self.whole("\n".join(part))
            ends = np.flatnonzero(ids == self._line[0])
            if len(self._line) != 1 or len(ends) != len(part) - 1:
                out += [self.whole(piece).tobytes() for piece in part]
                continue
            raw, size = ids.tobytes(), self.kind.itemsize
            starts, stops = np.r_[0, ends + 1] * size, np.r_[ends, len(ids)] * size
            out += [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        return out

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces.

        A sign after a letter is a word of its own to the tokenizer, and so are letters with a space
        before them or none.
        """
        known, older, signs, word, code = self._known, self._older, self._signs, self._word, self._code
        letters_of, space = self._letters, self._letters[32]
        found, others = list(map(known.get, pieces)), []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            piece = pieces[i]
            ids = older.get(piece)
            if ids is None:
                sign = signs.get(piece[-1]) if piece[-2:-1].isalpha() else None
                stem = piece if sign is None else piece[:-1]
                ids = None if sign is None else known.get(stem)
                if ids is None:
                    spaced = stem[:1] == " "
                    letters = stem[1:] if spaced else stem
                    if not letters.isalpha():
                        others.append(i)
                        continue
                    if not letters.isascii():
                        letters = charmap_decode(letters.encode(), "strict", letters_of)[0]
                    tokens = word(space + letters if spaced else letters)
                    ids = array(code, [token.id for token in tokens]).tobytes()
                    if sign is not None:
                        known[stem] = ids
                if sign is not None:
                    ids += sign
            found[i] = known[piece] = ids
        for i, ids in zip(others, self._encoded([pieces[i] for i in others]), strict=True):
            found[i] = known[pieces[i]] = ids
        if len(known) > REMEMBERED:
            # What is met again from the older half moves to the newer one.
            self._older, self._known = known, dict(self._base)
        return found

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that can be cut, and how many each has."""
        marked = [text.replace(" ", CUT + " ").replace("\n", f"{CUT}\n{CUT}") for text in texts]
        lists = pc.split_pattern(pa.array(marked, pa.large_string()), CUT)
        numbered = lists.flatten().dictionary_encode()
        index = numbered.indices.to_numpy()
        pieces = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        made = self._ids_of(pieces)
        sizes = np.fromiter(map(len, made), np.int32, len(made)) // self.kind.itemsize
        store = np.frombuffer(b"".join(made), self.kind)
        kind = np.int32 if len(index) and int(sizes.max()) * len(index) < 2**31 else np.int64
        lengths, starts = sizes[index], (np.cumsum(sizes, dtype=kind) - sizes)[index]
        ends = np.cumsum(lengths, dtype=kind)
        places = np.repeat(starts - (ends - lengths), lengths)
        places += np.arange(len(places), dtype=kind)
        ids = store[places]
        # Pieces of a text follow each other; every text has one at least.
        bounds = np.r_[0, ends][lists.offsets.to_numpy()]
        return ids, np.diff(bounds)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray | None] = [self.whole(t) if _is_uneven(t) else None for t in texts]
        even = [i for i, ids in enumerate(out) if ids is None]
        while even:
            held, count = 0, 0
            while count < len(even) and (not count or held + len(texts[even[count]]) <= CHARACTERS):
                held += len(texts[even[count]])
                count += 1
            part, even = even[:count], even[count:]
            ids, lengths = self._cut([texts[i] for i in part])
            for i, piece in zip(part, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
                out[i] = piece
        return out

    def ids(self, text: str) -> np.ndarray:
        return self.batch([text])[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)


def packed(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    n = len(ids)
    blocks = -(-n // block)
    filled = np.empty(blocks * block, np.uint32)
    filled[:n] = ids
    filled[n:] = ids[-1] if n else 0
    rows = filled.reshape(blocks, block)
    low = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = rows - low[:, None]
    at = max(0, int(np.ceil(percentile * block)) - 1)
    fits = np.partition(rest, at, axis=1)[:, at] if blocks else np.zeros(0, np.uint32)
    widths = np.ceil(np.log2(fits.astype(np.float64) + 1)).astype(np.uint8)
    outlier = rest >= (np.uint64(1) << widths.astype(np.uint64))[:, None]
    places = np.nonzero(outlier)
    exceptions = np.zeros(blocks + 1, np.uint32)
    np.cumsum(outlier.sum(axis=1), out=exceptions[1:])
    sizes = widths.astype(np.int64) * block // 8
    starts = np.zeros(blocks + 1, np.uint32)
    np.cumsum(sizes, out=starts[1:])
    body = np.zeros(int(starts[-1]), np.uint8)
    for width in np.unique(widths):
        if width == 0:
            continue
        chosen = np.flatnonzero(widths == width)
        size = 2 if width <= 16 else 4
        bits = np.unpackbits(
            rest[chosen].astype(f"<u{size}").view(np.uint8).reshape(len(chosen), block, size),
            axis=2, bitorder="little",
        )[:, :, :width]
        bytes_ = np.packbits(bits.reshape(len(chosen), -1), axis=1, bitorder="little")
        body[starts[chosen].astype(np.int64)[:, None] + np.arange(bytes_.shape[1])] = bytes_
    head = HEADER.pack(MAGIC, block, n, blocks, len(places[0]))
    return b"".join(
        (head, starts.astype("<u4").tobytes(), low.astype("<u4").tobytes(), widths.tobytes(),
         exceptions.astype("<u4").tobytes(), places[1].astype("<u2").tobytes(),
         rest[places].astype("<u4").tobytes(), body.tobytes())
    )


def unpacked(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a payload; only the blocks that hold them are decoded."""
    magic, block, n, blocks, patches = HEADER.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a payload of token ids")
    at = HEADER.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(payload, kind, count, at)
        at += part.nbytes
        return part

    starts, low = take("<u4", blocks + 1).astype(np.int64), take("<u4", blocks)
    widths, exceptions = take("u1", blocks), take("<u4", blocks + 1)
    places, values = take("<u2", patches), take("<u4", patches)
    # The last values may look a few bytes beyond the end.
    body = np.frombuffer(payload + b"\0" * 8, np.uint8, offset=at)
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    first, last = start // block, -(-stop // block)
    out = np.zeros((last - first, block), np.uint32)
    for width in np.unique(widths[first:last]):
        if width == 0:
            continue
        chosen = np.flatnonzero(widths[first:last] == width)
        # Each value lies in the five bytes from the one that holds its first bit.
        bit = np.arange(block) * int(width)
        at_byte = starts[chosen + first][:, None] + (bit >> 3)
        value = np.zeros((len(chosen), block), np.uint64 if width > 17 else np.uint32)
        for i in range((int(width) + 14) // 8):
            value |= body[at_byte + i].astype(value.dtype) << value.dtype.type(8 * i)
        value >>= (bit & 7).astype(value.dtype)
        out[chosen] = value & value.dtype.type((1 << int(width)) - 1)
    a, b = exceptions[first], exceptions[last]
    rows = np.repeat(np.arange(first, last), np.diff(exceptions[first : last + 1].astype(np.int64))) - first
    out[rows, places[a:b]] = values[a:b]
    out += low[first:last, None]
    return out.reshape(-1)[start - first * block : stop - first * block]


SEGMENT_SCHEMA = (
    "shard int, segment long, before long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, keep: bool = True) -> None:
    """Segments to ``path``/segments and the ids before each shard to ``path``/shards.

    Workers ``keep`` the pieces that they met for their next task, unless other work follows that needs the memory.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    schema = to_arrow_schema(StructType.fromDDL(SEGMENT_SCHEMA))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tool = TaskContext.get().partitionId(), encoder(tokenizer)
        end = np.array([end_id], tool.kind)
        ids, doc_ids, held, segment, before = [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            row = {
                "shard": shard, "segment": segment, "before": before, "n_ids": held, "doc_ids": doc_ids,
                "lengths": [len(x) for x in ids], "payload": packed(np.concatenate(ids)),
            }
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for doc_id, made in zip(batch.column(0).to_pylist(), tool.batch(texts), strict=True):
                ids.append(np.concatenate((made, end)))
                doc_ids.append(doc_id)
                held += len(ids[-1])
                if held >= SEGMENT:
                    yield closed()
                    segment, before = segment + 1, before + held
                    ids, doc_ids, held = [], [], 0
        if doc_ids:
            yield closed()
        if not keep:
            tool.forget()

    # The last key spreads equal rows; their order among themselves makes no difference.
    keys = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", "text").repartitionByRange(parts, *keys)
    ordered = dealt.sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    write_small_batches(ordered.select("doc_id", "text").mapInArrow(encode, SEGMENT_SCHEMA), f"{path}/segments")
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    (
        spark.read.parquet(f"{path}/segments").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
        # One row per shard.
        .select("shard", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)).alias("ahead"))
        .write.parquet(f"{path}/shards")
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) from the files."""
    return _documents(spark, path, "ids binary", lambda raw: raw)


def _documents(spark: SparkSession, path: str, last: str, derive) -> DataFrame:
    schema = f"doc_id long, start long, n_tokens long, {last}"
    name = last.split()[0]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = unpacked(row["payload"]).astype("<u4")
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                starts = ends - row["lengths"]
                derived = [derive(raw[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "start": pa.array(starts + (row["ahead"] + row["before"])),
                        "n_tokens": pa.array(row["lengths"], pa.int64()),
                        name: pa.array(derived, pa.binary() if name == "ids" else pa.int64()),
                    }
                )

    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(f"{path}/segments")
    shards = spark.read.schema("shard int, ahead long").parquet(f"{path}/shards")
    return segments.join(shards, "shard").select(
        "doc_ids", "lengths", "before", "ahead", "payload"
    ).mapInArrow(decode, schema)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files."""
    return _documents(spark, path, "ids_crc32 long", zlib.crc32)


def op8_token_ids(spark, folder: str) -> DataFrame:
    import public_tokenizers

    path = scratch_folder(spark, "tokens")
    write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digests(spark, path)
