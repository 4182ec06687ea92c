"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.session import checkpoint_dir

# A table is broadcast only when its counted rows stay within this many.
BROADCAST_ROWS = 1_000_000
# Bytes of a batch that goes to a worker.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
# Distinct terms a counting task holds before it hands on what it has.
COUNTER_TERMS = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *extra) -> DataFrame:
    """``(doc_id, text)`` and named extras only, so that other columns cannot clash; null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *extra)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Later steps then start from files that outlive any executor.  All tables of one
    application lie in one folder named after it, which may go when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/ticketlake-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint when ``df`` has at most ``bound`` (narrow) rows; else a shuffled hash hint,
    so that the large side is not sorted.  ``df`` should be a staged table: it is counted."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= bound else df.hint("shuffle_hash")


def shared_path(spark: SparkSession) -> str:
    """A new folder name beside the tables of ``stage``, for outputs of several tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/ticketlake-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def join_copies(rows: DataFrame, side: DataFrame, key: str, how: str, total: int,
                bound: int = BROADCAST_ROWS, hot: int = 1000) -> DataFrame:
    """``rows`` joined with the staged ``side (key, copies, ...)``, one row a key, on a key that may be hot.

    A side of at most ``bound`` narrow rows is broadcast.  Of a larger one, keys that hold at
    least 1/``hot`` of the ``total`` rows, at most ``hot`` of them, are broadcast, and only the
    rows of other keys are shuffled.  ``how``: left, left_semi or left_anti.
    """
    if how != "left":
        side = side.select(key, "copies")
    if side.count() <= bound:
        return rows.join(F.broadcast(side), key, how)
    often = F.col("copies") * F.lit(hot) >= F.lit(total)
    many, few = side.where(often), side.where(~often)
    rest = (rows.join(F.broadcast(many.select(key)), key, "left_anti")
            .join(few.hint("shuffle_hash"), key, how))
    if how == "left_anti":
        return rest
    return rows.join(F.broadcast(many), key, "inner" if how == "left" else how).unionByName(rest)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the batches that go to workers, where the session does not: by rows alone a
    batch of long texts can be larger than a worker."""
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def map_texts(df: DataFrame, make: Callable[[], Callable[[list, list], dict]], schema: str) -> DataFrame:
    """Run a batch function over ``(doc_id, text)`` rows.

    ``make`` runs once a task and returns ``f(ids, texts) -> {column: list or array}``.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string  # noqa: F401
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for b in batches:
            for part in slices(b):
                f = f or make()
                cols = f(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(cols[x.name], type=x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


_STATE: list[tuple] = []


def worker_state(key: tuple, make: Callable):
    """What ``make`` builds, kept by this worker process for its next tasks with the same ``key``.

    A process keeps one at a time: the one before is given up first, cycles included.
    """
    if not _STATE or _STATE[0][0] != key:
        if _STATE:
            _STATE.clear()
            gc.collect()
            give_back()
        _STATE.append((key, make()))
    return _STATE[0][1]


def give_back() -> None:
    """Returns freed memory to the system where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def digest_of(blob: bytes) -> bytes:
    return hashlib.blake2b(blob, digest_size=16).digest()


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterable[pa.RecordBatch]:
    """Parts of a batch, so that decoded Python objects stay few."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def term_counts(texts: DataFrame, make: Callable[[], tuple], kind: str = "string") -> DataFrame:
    """``(term, n)`` over all texts.

    ``make`` gives ``(split, parts)``: chunks of a text, and the terms of a chunk (``None``:
    the chunk itself).  Tasks count their own share first, so a very frequent term reaches
    the shuffle once a task and not once an occurrence.
    """
    def run(batches):
        split, parts = make()
        seen: Counter = Counter()

        def rows():
            terms = seen
            if parts is not None:
                terms = Counter()
                for chunk, n in seen.items():
                    for t in parts(chunk):
                        terms[t] += n
            return pa.RecordBatch.from_pydict({
                "term": pa.array(list(terms), type=pa.binary() if kind == "binary" else pa.string()),
                "n": pa.array(list(terms.values()), type=pa.int64())})
        for b in batches:
            for part in slices(b):
                for t in part.column(0).to_pylist():
                    seen.update(split(t))
                if len(seen) >= COUNTER_TERMS:
                    yield rows()
                    seen = Counter()
        if seen:
            yield rows()

    return (texts.select("text").mapInArrow(run, f"term {kind}, n long")
            .groupBy("term").agg(F.sum("n").alias("n")))


def frequent_terms(counts: DataFrame, bound: int) -> list[tuple]:
    """Terms holding at least 1/``bound`` of all occurrences, most frequent first.

    At most ``bound`` terms can hold that share each, so the list has a proven size however
    large the corpus; no sort and no limit is needed.  ``counts`` should be staged.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    if not total:
        return []
    rows = counts.where(F.col("n") * F.lit(bound) >= F.lit(total)).collect()
    return sorted(((r["term"], r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


class Memo(dict):
    """key -> ``make(key)``, remembered in two generations of ``size``: when the newer is full the
    older goes, so keys in use stay.  Long keys are not kept."""

    def __init__(self, make: Callable, size: int, longest: int = 64):
        self.make, self.size, self.longest, self.older = make, size, longest, {}

    def __missing__(self, key):
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
            if len(key) > self.longest:
                return got
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = got
        return got


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in -> byte, as public byte-level vocabularies write their pieces:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file's bytes as a broadcast (a few MB), so executors need no copy of their own."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def special_splitter(contents: list[str]):
    """Splits a text into (section, special or None) pairs; specials match in the raw text, longest first."""
    if not contents:
        return lambda t: [(t, None)]
    pat = re.compile("|".join(re.escape(c) for c in sorted(contents, key=len, reverse=True)))

    def split(t: str):
        out, at = [], 0
        for m in pat.finditer(t):
            out.append((t[at:m.start()], m.group()))
            at = m.end()
        out.append((t[at:], None))
        return out
    return split
