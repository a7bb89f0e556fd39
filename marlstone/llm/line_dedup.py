"""Line dedup that can take documents back.

A store is a folder that all executors see. Batches come one after another: documents are
inserted or deleted. Of each batch the store keeps its documents' lines, its documents,
and by how much it changed the exact reference count of each line that it touched: the
count of a line is the sum of its changes, merged into one table now and then. In front
of the counts stands one cuckoo filter for each shard of the lines' hashes: what the
filters don't know has never been seen, so only lines that they may know are looked up.
Cuckoo filters can delete, so a line whose count falls to 0 leaves them again, and
after a deletion the store is as if the document had never come. A batch counts once
its record is written, which is the last thing; a store can be opened again from its folder.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import fresh, mix, shared_folder, with_key

SLOTS = 4
SHARD_LINES = 1 << 18  # distinct lines of a shard at most: its filter, up to 1 MB, is one cell, and one task holds its new lines
MERGE = 8  # tables of changes that are merged into one
_LINES = "h1 bigint, h2 bigint, did bigint, uid bigint, pos int"
_DOCS = "did bigint, uid bigint, sign int"
_CHANGES = "h1 bigint, h2 bigint, change bigint, before bigint"
_FILTERS = "shard int, data binary"
_RECORD = "batch int, inserted boolean, shards int, filters string, counts_from int, n_lines bigint"


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each key in one of two buckets."""

    def __init__(self, keys: int) -> None:
        buckets = 1 << max(3, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.84)))))
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def of(cls, data: bytes) -> CuckooFilter:
        made = cls(0)
        made.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return made

    def data(self) -> bytes:
        return self.table.tobytes()

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = mix(h1.astype(np.int64).view(np.uint64) ^ mix(h2.astype(np.int64).view(np.uint64)))
        mark = np.maximum(x & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
        return mark, ((x >> np.uint64(16)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        mark, bucket = self._places(h1, h2)
        return ((self.table[bucket] == mark[:, None]) | (self.table[self._other(bucket, mark)] == mark[:, None])).any(axis=1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """Adds keys that are not there; False if the table is too full, and then it is unusable."""
        mark, bucket = self._places(h1, h2)
        moved = np.zeros(len(mark), np.int64)
        random = np.random.default_rng(len(mark))
        for _ in range(600):
            if not len(mark):
                return True
            order = np.argsort(bucket, kind="stable")
            mark, bucket, moved = mark[order], bucket[order], moved[order]
            rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
            free = self.table[bucket] == 0
            fits = rank < free.sum(axis=1)
            slot = (np.cumsum(free, axis=1) == rank[:, None] + 1).argmax(axis=1)
            self.table[bucket[fits], slot[fits]] = mark[fits]
            mark, bucket, moved = mark[~fits], bucket[~fits], moved[~fits]
            first = np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)] & (moved > 0)
            at, slot = bucket[first], random.integers(0, SLOTS, int(first.sum()))
            out = self.table[at, slot]  # a key that has tried both buckets takes another's slot
            self.table[at, slot] = mark[first]
            mark[first] = out
            go = first | (moved == 0)
            bucket[go] = self._other(bucket[go], mark[go])
            moved[go] += 1
        return False

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Removes keys that are there."""
        mark, bucket = self._places(h1, h2)
        pending = np.arange(len(mark))
        for where in (bucket, self._other(bucket, mark)):
            while len(pending):
                hit = self.table[where[pending]] == mark[pending][:, None]
                found = hit.any(axis=1)
                if not found.any():
                    break
                which = pending[found]
                slot = hit[found].argmax(axis=1)
                _, one = np.unique(where[which] * SLOTS + slot, return_index=True)  # a slot can go once
                self.table[where[which[one]], slot[one]] = 0
                pending = np.setdiff1d(pending, which[one], assume_unique=True)


def _line_rows(docs: DataFrame, did: str, uid: str) -> DataFrame:
    """h1, h2, did, uid, pos of each line that isn't blank."""
    lines = docs.select(F.col(did).alias("did"), F.col(uid).alias("uid"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.where("line rlike '\\\\S'")
    return lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "did", "uid", "pos")


def _cut(docs: DataFrame, drops: DataFrame, did: str, uid: str) -> tuple[DataFrame, str, str]:
    """The documents without the lines in drops (did, uid, pos), and two columns: lines dropped, and whether one is left."""
    dropped, left = fresh(docs, "n_dropped", "mls_left")
    [gone] = fresh(docs, "mls_gone")
    by_doc = drops.groupBy(F.col("did").alias(did), F.col("uid").alias(uid)).agg(F.collect_set("pos").alias(gone))
    joined = docs.join(by_doc, [did, uid], "left")
    parts = F.split("text", "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone)), lambda i: F.element_at(parts, i + 1))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    joined = joined.withColumns({dropped: F.coalesce(F.size(gone), F.lit(0)), "text": text})
    return joined.withColumn(left, (F.col(dropped) == 0) | F.col("text").rlike("\\S")).drop(gone), dropped, left


class LineStore:
    """Lines, documents, reference counts and filters, in a folder that all executors see.

    With the path of a store that is there, that store is opened; what a batch left
    behind that ended before its record was written is overwritten.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, shard_lines: int = SHARD_LINES) -> None:
        self.spark = spark
        self.path = path or shared_folder(spark, "lines")
        self.shard_lines = shard_lines
        self.batch = 0
        self.inserts: list[int] = []
        self.shards = self.counts_from = self.n_lines = 0
        self.filters_at = ""
        records = spark.read.schema(_RECORD).json(f"{self.path}/record-*").orderBy("batch").collect() if path and self._has_records() else []
        for r in records:  # a row for each batch
            self.batch, self.shards, self.filters_at, self.counts_from, self.n_lines = r.batch, r.shards, r.filters, r.counts_from, r.n_lines
            self.inserts += [r.batch] * r.inserted

    def _files(self, name: str) -> tuple[JavaObject, JavaObject]:
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return pattern, pattern.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _has_records(self) -> bool:
        pattern, files = self._files("record-*")
        found = files.globStatus(pattern)
        return found is not None and len(found) > 0

    def _remove(self, name: str) -> None:
        path, files = self._files(name)
        files.delete(path, True)

    def _put(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def _read(self, schema: str, *names: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def _commit(self, batch: int, inserted: bool, filters: str, n_lines: int) -> None:
        counts_from = self.counts_from
        if batch - counts_from >= MERGE:
            merged = self._changes(batch).groupBy("h1", "h2").agg(F.sum("change").alias("change")).where("change > 0")
            self._put(merged.withColumn("before", F.lit(0).cast("bigint")), f"merged-{batch}")
            counts_from = batch
        row = [(batch, inserted, self.shards, filters, counts_from, n_lines)]
        self.spark.createDataFrame(row, _RECORD).coalesce(1).write.mode("overwrite").json(f"{self.path}/record-{batch}")
        self.batch, self.filters_at, self.counts_from, self.n_lines = batch, filters, counts_from, n_lines
        self.inserts += [batch] * inserted

    def _changes(self, to: int) -> DataFrame:
        first = [f"merged-{self.counts_from}"] if self.counts_from else []
        return self._read(_CHANGES, *first, *(f"changes-{k}" for k in range(self.counts_from + 1, to + 1)))

    def counts(self) -> DataFrame:
        """The exact reference counts: h1, h2, n."""
        return self._changes(self.batch).groupBy("h1", "h2").agg(F.sum("change").alias("n")).where("n > 0")

    def filters(self) -> DataFrame:
        return self._read(_FILTERS, *([self.filters_at] if self.filters_at else []))

    def lines(self) -> DataFrame:
        """All lines that ever came, with the batch in which they did."""
        parts = [self._read(_LINES, f"lines-{k}").withColumn("batch", F.lit(k)) for k in self.inserts]
        return reduce(DataFrame.unionByName, parts) if parts else self._read(_LINES + ", batch int")

    def _events(self) -> DataFrame:
        parts = [self._read(_DOCS, f"docs-{k}").withColumn("batch", F.lit(k)) for k in range(1, self.batch + 1)]
        return reduce(DataFrame.unionByName, parts) if parts else self._read(_DOCS + ", batch int")

    def documents(self) -> DataFrame:
        """did, uid and batch of the documents that are there, with the batch in which they came."""
        last = self._events().groupBy("did", "uid").agg(F.max(F.struct("batch", "sign")).alias("e"))
        return last.where("e.sign > 0").select("did", "uid", "e.batch")

    def live(self) -> DataFrame:
        """Lines of the documents that are there, with the batch in which they came."""
        if len(self.inserts) == self.batch:  # nothing was deleted
            return self.lines()
        # a document's lines went with it: those of its insertions before it was last deleted
        gone = self._events().where("sign < 0").groupBy("did", "uid").agg(F.max("batch").alias("gone"))
        return self.lines().join(gone, ["did", "uid"], "left").where("gone is null or batch > gone").drop("gone")

    def _shard(self, shards: int) -> Column:
        return F.pmod(F.xxhash64("h1", "h2"), F.lit(shards)).cast("int")

    def _known(self, lines: DataFrame) -> DataFrame:
        """Of distinct lines (h1, h2), those that the filters may have."""
        if not self.filters_at:
            return lines.select("h1", "h2").limit(0)

        def probe(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(filters):
                return rows.iloc[:0][["h1", "h2"]]
            return rows[CuckooFilter.of(filters.data.iloc[0]).contains(rows.h1.to_numpy(), rows.h2.to_numpy())][["h1", "h2"]]

        left = lines.select("h1", "h2", self._shard(self.shards).alias("shard")).groupBy("shard")
        return left.cogroup(self.filters().groupBy("shard")).applyInPandas(probe, "h1 bigint, h2 bigint")

    def _update(self, lines: DataFrame, batch: int, add: bool) -> str:
        """Where new filters are, with the distinct lines in or out. A shard that grows too full is built anew from the counts."""

        def change(key: tuple, rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            h1, h2 = rows.h1.to_numpy(), rows.h2.to_numpy()
            if not len(filters):
                kept = _filled(h1, h2, len(rows))
            else:
                kept = CuckooFilter.of(filters.data.iloc[0])
                if not add:
                    kept.delete(h1, h2)
                elif (np.count_nonzero(kept.table) + len(rows)) > 0.9 * kept.table.size or not kept.insert(h1, h2):
                    return pd.DataFrame({"shard": [key[0]], "data": [b""]})
            return pd.DataFrame({"shard": [key[0]], "data": [kept.data()]})

        left = lines.withColumn("shard", self._shard(self.shards)).groupBy("shard")
        name = f"filters-{batch}"
        self._put(left.cogroup(self.filters().groupBy("shard")).applyInPandas(change, _FILTERS), name)
        made = self._read(_FILTERS, name)
        full = made.where("length(data) = 0").select("shard")
        if add and self.filters_at and not full.isEmpty():
            again = self._sharded(batch).join(full, "shard", "left_semi").groupBy("shard").applyInPandas(_build, _FILTERS)
            self._put(again.unionByName(made.where("length(data) > 0")), f"grown-{batch}")
            self._remove(name)
            name = f"grown-{batch}"
        return name

    def _sharded(self, batch: int) -> DataFrame:
        """shard, h1 and h2 of all lines that are there after the batch."""
        there = self._changes(batch).groupBy("h1", "h2").agg(F.sum("change").alias("n")).where("n > 0")
        return there.select(self._shard(self.shards).alias("shard"), "h1", "h2")

    def insert(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Takes in documents: those given, keyed (see with_key), and the lines of theirs to drop.

        A line is dropped if a document that came before has it, or if it comes again
        in this batch: the occurrence with the least (doc_id, hash of the text,
        position) stays, null ids first. A document that is there already changes nothing.
        """
        keyed, did, uid = with_key(docs)
        batch = self.batch + 1
        given = keyed.groupBy(F.col(did).alias("did"), F.col(uid).alias("uid")).agg(F.count("*").alias("n"))
        if self.batch:
            given = given.join(self.documents().select("did", "uid", F.lit(1).alias("there")), ["did", "uid"], "left")
        else:
            given = given.withColumn("there", F.lit(None).cast("int"))
        self._put(given.withColumn("sign", F.lit(1)), f"given-{batch}")
        given = self.spark.read.parquet(f"{self.path}/given-{batch}")
        self._put(given.where("there is null").select("did", "uid", "sign"), f"docs-{batch}")
        twice, there = given.agg(F.coalesce(F.max("n"), F.lit(1)) > 1, F.count("there") > 0).first()
        rows = _line_rows(keyed, did, uid)
        if there:
            rows = rows.join(given.where("there is not null").select("did", "uid"), ["did", "uid"], "left_anti")
        # of a document that is given twice, the lines come once
        self._put(rows.distinct() if twice else rows, f"lines-{batch}")
        self._remove(f"given-{batch}")
        rows = self._read(_LINES, f"lines-{batch}")
        counted = rows.groupBy("h1", "h2").agg(F.count("*").alias("change"), F.min(F.struct("did", "uid", "pos")).alias("owner"))
        if self.filters_at:
            self._put(counted, f"own-{batch}")
            counted = self.spark.read.parquet(f"{self.path}/own-{batch}")
            before = self._changes(self.batch).join(self._known(counted), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.sum("change").alias("before"))
            counted = counted.join(before.where("before > 0"), ["h1", "h2"], "left")
        else:
            counted = counted.withColumn("before", F.lit(None).cast("bigint"))
        self._put(counted.withColumn("before", F.coalesce("before", F.lit(0))), f"changes-{batch}")
        self._remove(f"own-{batch}")
        found = self.spark.read.parquet(f"{self.path}/changes-{batch}")
        n_lines = self.n_lines + found.where("before = 0").count()
        shards = max(self.shards, 1 << max(0, int(np.ceil(np.log2(max(1, n_lines) / self.shard_lines)))))
        if self.filters_at and shards > self.shards:  # all filters anew, in more shards
            self.shards, filters = shards, f"filters-{batch}"
            self._put(self._sharded(batch).groupBy("shard").applyInPandas(_build, _FILTERS), filters)
        else:
            self.shards = shards
            filters = self._update(found.where("before = 0").select("h1", "h2"), batch, add=True)
        self._commit(batch, True, filters, n_lines)
        again = found.where("change > 1 or before > 0").select("h1", "h2", F.when(F.col("before") == 0, F.col("owner")).alias("owner"))
        here = F.struct("did", "uid", "pos")
        drops = rows.join(again, ["h1", "h2"]).where(~here.eqNullSafe(F.col("owner"))).select("did", "uid", "pos")
        return keyed, drops

    def delete(self, docs: DataFrame) -> None:
        """Takes out documents, given as they were inserted (doc_id and text); others are passed over."""
        keyed, did, uid = with_key(docs)
        batch = self.batch + 1
        gone = keyed.select(F.col(did).alias("did"), F.col(uid).alias("uid")).distinct()
        gone = self.documents().join(gone, ["did", "uid"], "left_semi")
        self._put(gone.select("did", "uid", F.lit(-1).alias("sign"), "batch"), f"docs-{batch}")
        gone = self.spark.read.parquet(f"{self.path}/docs-{batch}").select("did", "uid", "batch")
        rows = self.lines().join(gone, ["did", "uid", "batch"], "left_semi")
        less = rows.groupBy("h1", "h2").agg((-F.count("*")).alias("change"))
        before = self._changes(self.batch).withColumn("less", F.lit(0).cast("bigint"))
        both = before.select("h1", "h2", F.col("change").alias("before"), "less").unionByName(less.select("h1", "h2", F.lit(0).cast("bigint").alias("before"), F.col("change").alias("less")))
        both = both.groupBy("h1", "h2").agg(F.sum("before").alias("before"), F.sum("less").alias("change")).where("change < 0")
        self._put(both.select("h1", "h2", "change", "before"), f"changes-{batch}")
        none_left = self._read(_CHANGES, f"changes-{batch}").where("before + change = 0").select("h1", "h2")
        filters = self._update(none_left, batch, add=False) if self.filters_at else ""
        self._commit(batch, False, filters, self.n_lines - none_left.count())

    def drops(self) -> DataFrame:
        """The lines to drop of the documents that are there now: of each line's occurrences the earliest stays."""
        rows = self.live()
        here = F.struct("batch", "did", "uid", "pos")
        own = rows.groupBy("h1", "h2").agg(F.min(here).alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
        return rows.join(own, ["h1", "h2"]).where(here != F.col("owner")).select("did", "uid", "pos")


def _filled(h1: np.ndarray, h2: np.ndarray, room: int) -> CuckooFilter:
    kept = CuckooFilter(room)
    while not kept.insert(h1, h2):
        kept = CuckooFilter(4 * len(kept.table))
    return kept


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter of all its lines, with room to grow."""
    return pd.DataFrame({"shard": [key[0]], "data": [_filled(rows.h1.to_numpy(), rows.h2.to_numpy(), 2 * len(rows)).data()]})


def maintained(docs: DataFrame, second: str, again: str, store: LineStore | None = None) -> DataFrame:
    """What dedup_lines gives, of a store that documents came to, left, and came to again.

    second and again are SQL conditions on docs. Documents for which second isn't true come
    first, the others after them; those for which again is true are then deleted, and at
    last inserted again. All of docs are there in the end, and lines stay where they came first of what is there.
    """
    store = store or LineStore(docs.sparkSession)
    later, back = (F.coalesce(F.expr(c), F.lit(False)) for c in (second, again))
    docs = docs.select("doc_id", "text")
    store.insert(docs.where(~later))
    store.insert(docs.where(later))
    store.delete(docs.where(back))
    store.insert(docs.where(back))
    keyed, did, uid = with_key(docs)
    cut, dropped, _ = _cut(keyed, store.drops(), did, uid)
    return cut.select("doc_id", "text", F.col(dropped).alias("n_dropped"))


def dedup_lines(docs: DataFrame, store: LineStore | None = None) -> DataFrame:
    """doc_id, text without lines that came before, and n_dropped, a row for each row of docs.

    Lines are what line feeds separate and are compared as they are. Blank lines are
    never dropped, nor is anything of a null or empty text; a text that loses all its
    lines is empty. Repeated rows are one document, so each keeps its lines; with the
    same doc_id but other texts they are different documents. Other columns are not read.
    """
    store = store or LineStore(docs.sparkSession)
    keyed, drops = store.insert(docs.select("doc_id", "text"))
    did, uid = keyed.columns[-2:]
    cut, dropped, _ = _cut(keyed, drops, did, uid)
    return cut.select("doc_id", "text", F.col(dropped).alias("n_dropped"))


def without_repeated_lines(docs: DataFrame, store: LineStore | None = None) -> DataFrame:
    """docs, with all columns, without repeated lines; n_chars follows the text.

    A document of which nothing but blank lines is left goes; one that had nothing to
    begin with stays.
    """
    store = store or LineStore(docs.sparkSession)
    keyed, drops = store.insert(docs)
    did, uid = keyed.columns[-2:]
    cut, dropped, left = _cut(keyed, drops, did, uid)
    cut = cut.where(left)
    if "n_chars" in docs.columns:
        changed = F.when(F.col(dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", changed)
    return cut.select([F.col(f"`{c}`") for c in docs.columns])
