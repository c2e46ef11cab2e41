"""Helpers shared by the operators: scratch tables, words, hashes."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents handled together inside a task; bounds the working memory of the kernels.
SLICE_BYTES = 1 << 20
#: Bytes of rows that a Python worker is handed at once, for operators whose rows are large; Spark's own bound is 64 MB, of which the
#: executor holds several copies (vectors that double as they grow, the message, the worker's batch and the one before) for each of its tasks.
BATCH_BYTES = 1 << 22
#: Distinct words whose hash a Python worker remembers before it starts afresh.
WORD_CACHE = 1 << 18
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


#: Paths of results that operators left for their callers to read.
KEPT: list[str] = []


def free(spark: SparkSession, since: int) -> None:
    """Deletes the results kept after the first ``since`` ones: for callers that have written what they read from them."""
    while len(KEPT) > since:
        _delete(spark, KEPT.pop())


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@functools.cache
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"ripplenet-{application}-")


class Scratch:
    """Tables that cut lineage, in the folder all executors share.

    ``spark.checkpoint.dir`` names that folder; a temporary folder stands in only where
    it is unset and the master is local, as in tests.  Tables written with ``keep=False``
    disappear at :meth:`drop` or :meth:`clear`; the operator's result is kept until :func:`free`.  A table once
    written needs no shuffle files any more, so these go at the end of each write.  ``batch_bytes`` bounds the batches
    that Python workers get while its tables are written, to one row at least.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

    def __init__(self, spark: SparkSession, label: str, batch_bytes: int | None = None):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = root or _local_root(spark.sparkContext.applicationId)
        self.spark, self.root, self.paths, self.written = spark, f"{root}/{label}-{uuid.uuid4().hex}", [], 0
        self.settings = {self.CLEANUP: "true"} | ({self.BATCH: str(batch_bytes)} if batch_bytes else {})

    def table(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        self.written += 1
        path = f"{self.root}/{name}-{self.written}"
        before = {key: self.spark.conf.get(key, None) for key in self.settings}
        for key, value in self.settings.items():
            self.spark.conf.set(key, value)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            for key, value in before.items():
                self.spark.conf.unset(key) if value is None else self.spark.conf.set(key, value)
        if keep:
            KEPT.append(path)
        else:
            self.paths.append((name, path))
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        """A path for files of another format; kept like a result."""
        KEPT.append(f"{self.root}/{name}")
        return KEPT[-1]

    def drop(self, *names: str) -> None:
        """Deletes the tables written under these names so far."""
        for name, path in self.paths:
            if name in names:
                _delete(self.spark, path)
        self.paths = [x for x in self.paths if x[0] not in names]

    def clear(self) -> None:
        self.drop(*[name for name, _ in self.paths])


#: A key that holds more than this part of all rows is hot; there are fewer such keys than its inverse.
HOT_PART, SALTS = 1 / 4096, 64


def dealt(rows: DataFrame, keyed: DataFrame, on: list[str], by: Column, scratch: Scratch, name: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row per key and the number ``n`` of rows that hold it.

    Rows of a hot key are dealt over SALTS tasks by a hash of ``by``, and the key is repeated for each of them.
    The hot keys that are broadcast to tell them apart are fewer than 1 / HOT_PART, whatever the input.
    """
    keyed = scratch.table(keyed, name)
    total = keyed.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > HOT_PART * total
    marks = F.broadcast(keyed.where(hot).select(*on, F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)
    salted = rows.join(marks, on, "left").withColumn("salt", salt).drop("hot")
    copies = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(hot, SALTS - 1).otherwise(0)))).drop("n")
    return salted.join(copies, [*on, "salt"], how).drop("salt")


#: Keys are told apart roughly by so many buckets of their hash.
BUCKETS = 1 << 20


def bucket_of(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def buckets_of(rows: DataFrame, *keys: str) -> DataFrame:
    """The buckets that the keys fall into: at most BUCKETS rows, so they are broadcast at every size.

    A first sieve before a join by the keys themselves.  With few keys it leaves little to shuffle; with
    very many it leaves all rows, and the join by shuffle behind it is the same.
    """
    return F.broadcast(rows.select(bucket_of(*map(F.col, keys)).alias("bucket")).distinct())


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``ids``; only rows in a bucket of some id are shuffled."""
    ids = ids.select(key).where(F.col(key).isNotNull())
    marks = buckets_of(ids, key)
    tagged = rows.withColumn("bucket", bucket_of(F.col(key)))
    far = tagged.join(marks, "bucket", "left_anti")
    near = tagged.join(marks, "bucket", "left_semi").join(ids.distinct().hint("merge"), key, "left_anti")
    return far.select(rows.columns).union(near.select(rows.columns))


def one_row_an_id(rows: DataFrame, key: str) -> DataFrame:
    """Of the rows that share a key the least by its other columns; only rows in a bucket of a repeated key are shuffled."""
    twice = rows.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1").select(key)
    marks = buckets_of(twice, key)
    tagged = rows.withColumn("bucket", bucket_of(F.col(key)))
    others = [x for x in rows.columns if x != key]
    least = tagged.join(marks, "bucket", "left_semi").groupBy(key).agg(F.min(F.struct(*others)).alias("row"))
    return tagged.join(marks, "bucket", "left_anti").select(rows.columns).union(least.select(key, "row.*").select(rows.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id and UTF-8 bytes only, so that scans prune all other columns."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and raw texts in slices of about SLICE_BYTES; a longer text is a slice of its own."""
    for batch in batches:
        ids, raws, size = [], [], 0
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = raw.as_py() or b""
            if ids and size + len(raw) > SLICE_BYTES:
                yield ids, raws
                ids, raws, size = [], [], 0
            ids.append(i)
            raws.append(raw)
            size += len(raw)
        if ids:
            yield ids, raws


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls in one array, and where each value begins, with the end."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    held = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, most: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts (null: empty) of a batch in chunks of about ``most`` bytes, without copies; a longer text is a chunk of its own."""
    ids, texts = batch.column(0), batch.column(1).fill_null(b"")
    if not len(ids):
        return
    _, offsets = binary_parts(texts)
    a = 0
    while a < len(ids):
        b = max(a + 1, int(np.searchsorted(offsets, int(offsets[a]) + most, "right")) - 1)
        yield ids.slice(a, b - a), texts.slice(a, b - a)
        a = b


class WordHashes(dict):
    """64-bit hash of a word's bytes, remembered for frequent words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def salted(i: int) -> np.uint64:
    return np.uint64(int(GOLDEN) * i & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd bases of the two polynomial window hashes.
BASES = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64; kept while short."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 15)
        inverse = pow(base, -1, 1 << 64)
        have = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            have.append(np.multiply.accumulate(p))
        have = tuple(have)
        if size <= 1 << 20:
            _POWERS[base] = have
    return have


class Windows:
    """Hashes of any window of a sequence of 64-bit values in constant time."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        self.up, self.down = _powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def every(self, n: int, width: int) -> np.ndarray:
        """Hashes of the first ``n`` windows of ``width`` values."""
        return mix((self.sums[width : width + n] - self.sums[:n]) * self.down[:n])


def byte_values(raw: bytes | np.ndarray) -> np.ndarray:
    """Bytes as well spread 64-bit values."""
    return _BYTES[np.frombuffer(raw, np.uint8)]


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals, sorted by start, as maximal disjoint runs."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]
    return starts[new], ends[last]
