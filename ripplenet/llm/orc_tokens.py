"""Token ids in ORC files: integer run lengths, stripes, row indexes and Bloom filters on document ids.

Texts are dealt into ranges of ids, each range is tokenised in order by one task and written as one file.
A row holds a document: its id, the number of its file, the tokens before it in that file, and its ids, which ORC
stores as run-length encoded integers.  Files are read stripe by stripe, each stripe by any task.  A filter on ``doc_id`` first
passes over files and stripes by their statistics, then over groups of rows by row index and Bloom filter.

A document's place in the corpus is its place in its file plus the tokens of all files before it: a sum per
file, so no pass over the corpus in one task and no rewriting.

The byte-level pattern always parts a text before a space that a visible character of Latin-1 follows, around a line feed between
two visible ones, and between a letter and a mark of punctuation.  So the bytes of many texts are cut there at once, the pieces are numbered
by their distinct values, and each of these is encoded by the tokenizer's model once per worker and then looked up.  Whatever lies between two cuts and isn't
plain is encoded by the whole tokenizer, and any text that holds the string of an added token in one call.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from . import common as c

SCHEMA = "doc_id long, part int, at long, n_tokens long, ids array<int>"
#: Bytes of a stripe; rows of a group in the row index; share of absent ids that a Bloom filter lets pass.
STRIPE_BYTES, GROUP_ROWS, BLOOM_FPP = 16 << 20, 1000, 0.01
#: After so many rows a writer looks whether its stripe is full: long texts fill one soon.
CHECKED_ROWS = 250
#: Pieces a Python worker remembers before the older half goes, and the longest of them.
WORDS, WORD_CHARS = 1 << 19, 64
#: Bytes of texts that are cut and numbered together.
CHUNK_BYTES = 4 << 20
#: Pieces that the byte-level pattern leaves whole: their ids are those of the model alone.
PLAIN = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@]+|[0-9]+)|\n")
LETTER, MARK, VISIBLE = 1, 2, 4
#: First byte of the letters from À to ÿ, and the second bytes of the two signs among them.
LATIN, TIMES, DIVIDE = 0xC3, 0x97, 0xB7


def _kinds() -> np.ndarray:
    """LETTER, MARK and VISIBLE of each ASCII byte."""
    kinds = np.zeros(256, np.uint8)
    kinds[33:127] = VISIBLE
    for b in range(33, 127):
        kinds[b] |= LETTER * chr(b).isalpha() | MARK * bool(re.match(r"[!-&(-/:-@]", chr(b)))
    return kinds


_KINDS = _kinds()


@functools.cache
def _tokenizer(name: str):
    import public_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))


def _byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: itself where visible, else the next one from 256 on."""
    seen, spare = {*range(33, 127), *range(161, 173), *range(174, 256)}, itertools.count(256)
    return [chr(b if b in seen else next(spare)) for b in range(256)]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each byte of the texts between ``offsets``, which are valid UTF-8."""
    n = len(data)
    kinds = _KINDS[data]
    lead = data == LATIN
    latin = np.zeros(n, bool)  # the second byte of a letter from À to ÿ, or of a sign among them
    latin[1:] = lead[:-1]
    letter = (latin & (data != TIMES) & (data != DIVIDE)) | (kinds & LETTER).astype(bool)
    begins = (kinds & LETTER).astype(bool)
    begins[:-1] |= lead[:-1] & letter[1:]
    mark, visible = (kinds & MARK).astype(bool), (kinds & VISIBLE).astype(bool)
    after = np.zeros(n, bool)  # a visible character follows in the same text
    after[:-1] = (visible | lead)[1:]
    before = np.zeros(n, bool)
    before[1:] = (visible | latin)[:-1]
    full = offsets[:-1] < offsets[1:]
    after[offsets[1:][full] - 1] = False
    before[offsets[:-1][full]] = False
    cut = (data == 32) & after
    lines = (data == 10) & before & after
    cut |= lines
    cut[1:] |= lines[:-1] | (mark[1:] & letter[:-1]) | (begins[1:] & mark[:-1])
    cut[offsets[:-1][full]] = True
    return cut


class Pieces:
    """Ids of the pieces of texts, remembered as bytes."""

    def __init__(self, tokenizer):
        self.tokenizer, self.new, self.old = tokenizer, {}, {}
        self.letters = dict(enumerate(_byte_letters()))
        self.model = Tokenizer(tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.whole = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()).encode() or rb"(?!)")

    def encode(self, text: str) -> bytes:
        return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def plain(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of plain form, which the model encodes in one call."""
        spelt = [p.decode("latin-1").translate(self.letters) for p in pieces]
        return [array("i", x.ids).tobytes() for x in self.model.encode_batch_fast(spelt, add_special_tokens=False)]

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces."""
        found = list(map(self.new.get, pieces))
        missing = [i for i, x in enumerate(found) if x is None]
        plain = []
        for i in missing:
            piece = pieces[i]
            found[i] = self.old.get(piece)
            if found[i] is None:
                text = piece.decode()
                if PLAIN.fullmatch(text):
                    plain.append(i)
                else:
                    found[i] = self.encode(text)
        if plain:
            for i, x in zip(plain, self.plain([pieces[i] for i in plain]), strict=True):
                found[i] = x
        for i in missing:
            if len(pieces[i]) <= WORD_CHARS:
                if len(self.new) >= WORDS:
                    self.old, self.new = self.new, {}
                self.new[pieces[i]] = found[i]
        return found

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (binary, none null), and the place of each text's first one, with the end."""
        try:
            texts.cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([x.as_py().decode("utf-8", "replace").encode() for x in texts], pa.binary())
        data, offsets = c.binary_parts(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cut = piece_starts(data, offsets)
        if self.whole.search(data):
            for a, b in itertools.pairwise(offsets.tolist()):
                if self.whole.search(data[a:b]):
                    cut[a + 1 : b] = False
        starts = np.flatnonzero(cut).astype(np.int32)
        edges = np.append(starts, np.int32(len(data)))
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        number, ids = pieces.indices.to_numpy(), self.ids(pieces.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        place, sizes = np.cumsum(size) - size, size[number]
        ends = np.cumsum(sizes)
        at = np.repeat(place[number] - ends + sizes, sizes)
        at += np.arange(len(at))
        flat = np.frombuffer(b"".join(ids), np.int32)[at]
        return flat, np.append(0, ends)[np.searchsorted(starts, offsets)]

    def of(self, text: str) -> bytes:
        return self.of_texts(pa.array([text.encode()], pa.binary()))[0].tobytes()


@functools.cache
def _pieces(name: str) -> Pieces:
    return Pieces(_tokenizer(name))


def _encode(name: str, end_id: int):
    def run(batches):
        pieces, part, before = _pieces(name), TaskContext.get().partitionId(), 0
        for batch in batches:
            for docs, texts in c.chunks(batch, CHUNK_BYTES):
                flat, places = pieces.of_texts(texts)
                flat, sizes = np.insert(flat, places[1:], np.int32(end_id)), np.diff(places) + 1
                at = before + np.cumsum(sizes) - sizes
                before += len(flat)
                columns = [docs, pa.array(np.full(len(sizes), part, np.int32)), pa.array(at), pa.array(sizes), c.lists(flat, sizes)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "at", "n_tokens", "ids"])

    return run


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes each document's ids, ``end_id`` last, in ascending id order.

    A null or empty text is ``end_id`` alone.  Rows of one id follow each other in the order of a hash of their texts;
    null ids come first.  A repeated row is a document of its own.  Texts are encoded whole; other columns are ignored.
    An empty table gives a folder without rows.
    """
    rows = c.text_bytes(docs, id_col, text_col)
    keyed = rows.withColumn("tie", F.xxhash64("raw")).withColumn("row", F.monotonically_increasing_id())  # one id with many rows is cut, too
    ranges = keyed.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "raw")
    writer = ranges.mapInArrow(_encode(tokenizer, end_id), SCHEMA).write.mode("overwrite")
    options = {
        "compression": "zstd",
        "orc.stripe.size": STRIPE_BYTES,
        "orc.rows.between.memory.checks": CHECKED_ROWS,
        "orc.create.index": "true",
        "orc.row.index.stride": GROUP_ROWS,
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": BLOOM_FPP,
    }
    writer.options(**options).orc(path)


def read_token_files(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """(doc_id, part, at, n_tokens, ids); with ``ids`` only those documents, the rest passed over by the files' metadata."""
    files = spark.read.schema(SCHEMA).orc(path)
    return files if ids is None else files.where(F.col("doc_id").isin(list(ids)))


def starts(files: DataFrame) -> DataFrame:
    """(part, base): tokens of all files before each.  One row per file, whatever the corpus holds."""
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.expr("sum(n) over (order by part rows between unbounded preceding and 1 preceding)")
    return sums.select("part", F.coalesce(before, F.lit(0)).alias("base"))


def _crc(batches):
    for batch in batches:
        lists = batch.column(3)
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        ends = lists.offsets.to_numpy()
        crcs = [zlib.crc32(flat[a:b]) for a, b in itertools.pairwise(ends)]
        columns = [*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "at", "n_tokens", "ids_crc32"])


def token_digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the ids as the files hold them.

    ``start`` counts the ids of all documents before it; the checksum is over little-endian unsigned 32-bit ids, end id included.
    """
    read = files.select("doc_id", "part", "at", "ids").mapInArrow(_crc, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(starts(files)), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
