"""What the operators share: chunks of text, words, hashes and the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK_BYTES = 6 << 20  # text that a Python worker holds as words at one time
BATCH_BYTES = 6 << 20  # of an Arrow batch of texts, a chunk or so: the JVM and the worker each hold one whole
_NOT_ALNUM = re.compile(r"[\W_]+")
_NOT_LETTER = r"[^\p{L}\p{N}]+"
_scratch: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, seen by all executors, under ``spark.checkpoint.dir``.

    Only where the session names no such folder (tests on one machine) is a
    temporary one made. Folders on a mounted file system go when Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", base)
        _scratch.append(base)
    path = f"{base.rstrip('/')}/marlstone/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def local_path(path: str) -> str:
    """The path by which Python opens a folder of a mounted shared file system."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {path}")
    return path


@atexit.register
def _clean() -> None:
    for path in _scratch:
        if path.startswith(("file:", "/")):
            shutil.rmtree(local_path(path), ignore_errors=True)


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """mapInArrow over batches of bounded bytes, however long the texts are, unless the session sets its own bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives the memory that Arrow and the C library keep for later back to the machine: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_key(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """Adds two columns that are never null and together name a document.

    They come from doc_id and text, so that rows with a null or repeated doc_id
    but different texts stay apart, and repeated rows are one document.
    """
    did, uid = fresh(docs, "mls_did", "mls_uid")
    return docs.withColumns({did: F.coalesce("doc_id", F.lit(-(2**63))), uid: F.xxhash64("doc_id", "text")}), did, uid


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``size`` bytes of text, or one longer text; those of a batch are about equal."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        each = 1.1 * total / max(1, round(total / size))  # some room, so that no small slice is left over
        low = 0
        while low < len(ends):
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + each, "right")))
            yield batch.slice(low, high - low)
            low = high
    release()


def split_words(col: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of the white-space separated words, the distinct words, each text's first word."""
    lists = pc.utf8_split_whitespace(pc.fill_null(col, ""))
    coded = lists.flatten().dictionary_encode()
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, offsets


def normal(word: str) -> str:
    """The word in lower case without what is neither letter nor digit."""
    word = word.lower()
    return word if word.isalnum() else _NOT_ALNUM.sub("", word)


def normal_array(words: pa.Array) -> pa.Array:
    """normal() of each word of an array."""
    low = pc.utf8_lower(words)
    plain = pc.utf8_is_alnum(low)
    if pc.all(plain, min_count=0).as_py():
        return low
    return pc.replace_with_mask(low, pc.invert(plain), pc.replace_substring_regex(low.filter(pc.invert(plain)), _NOT_LETTER, ""))


def normal_words(col: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """As split_words, over normal forms; words of which nothing is left are dropped."""
    index, raw, offsets = split_words(col)
    coded = normal_array(raw).dictionary_encode()
    names = coded.dictionary.to_pylist()
    index = coded.indices.to_numpy(zero_copy_only=False)[index] if len(index) else index
    if "" in names:
        keep = index != names.index("")
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        index = index[keep]
    return index, names, offsets


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values: a sort, which for numbers is faster than a table of hashes."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def hashes(strings: list[str]) -> np.ndarray:
    """64-bit hashes."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, strings), np.uint64, len(strings))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values between the offsets."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]
