"""Line dedup with sharded cuckoo filters over exact reference-count tables.

A line's key is the line stripped of ASCII white space at both ends, with A-Z lower-cased; only keys of LEAST_CHARS code
points or more count. Every shard (a range of key digests) has an exact table - digest, how many documents hold it,
the largest such document - and cuckoo filters of its digests: one of all, one of the repeated ones. A filter answers
"certainly not here" without the table; "maybe" is settled by the table, so false positives never change a result. Filters
take deletions, and the table counts back down, so documents can be inserted and deleted again without rebuilding. Whatever
is deduplicated goes through such an index: its documents are inserted, and what they lose is read from filters and table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifdrift.llm.shared import new_path, thrifty, written
from motifdrift.llm.words import slices
from motifdrift.sources.snapshots import Manifests

LEAST_CHARS, LEAST_DOCS = 20, 3
STRIPPED = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}
#: Digests that a shard should hold at most; with 16-bit fingerprints its filter then has about 4 MB.
SHARD_KEYS = 1_500_000
#: Digests that are put into a filter at once.
SLICE_KEYS = 1 << 17
#: Texts are split into lines in slices of about so many bytes.
SPLIT_BYTES = 2 << 20
#: Filters of repeated lines go to every task up to this size in all; beyond it, lines are dealt to the filters, about so many to a task.
PREFILTER_BYTES, GROUP_LINES = 48 << 20, 1_000_000


def line_key(line: str) -> bytes | None:
    """The digest of a line's key, or None if the key is too short to count."""
    key = line.strip(STRIPPED).translate(LOWER)
    return hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest() if len(key) >= LEAST_CHARS else None


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; 0 is an empty place. Keys are 16-byte digests, in arrays of two unsigned 64-bit halves."""

    SLOTS = 4

    def __init__(self, n_buckets: int, table: np.ndarray | None = None):
        self.n = n_buckets
        self.table = np.zeros((n_buckets, self.SLOTS), np.uint16) if table is None else table

    @classmethod
    def of(cls, digests: np.ndarray) -> CuckooFilter:
        """A filter of these distinct digests; the table doubles until all fit."""
        n = 1 << max(2, int(np.ceil(np.log2(max(1, len(digests)) / (cls.SLOTS * 0.85)))))
        while True:
            made = cls(n)
            if made.insert(digests):
                return made
            n *= 2

    def places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and first bucket of each digest."""
        mark = (digests[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, (digests[:, 0] & np.uint64(self.n - 1)).astype(np.int64)

    def other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        step = (mark.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(self.n - 1)
        return (bucket.astype(np.uint64) ^ step).astype(np.int64)

    def insert(self, digests: np.ndarray, rounds: int = 400) -> bool:
        """Adds all, a slice at a time so that memory stays small; False if some found no place."""
        return all(self._insert(digests[i : i + SLICE_KEYS], rounds) for i in range(0, len(digests), SLICE_KEYS))

    def _insert(self, digests: np.ndarray, rounds: int) -> bool:
        """In a round each waiting mark goes to its bucket, or evicts a mark there that then waits."""
        mark, at = self.places(digests)
        rng = np.random.default_rng(1)
        for turn in range(rounds):
            if not len(mark):
                return True
            order = np.argsort(at, kind="stable")
            mark, at = mark[order], at[order]
            first = np.searchsorted(at, at)
            nth = np.arange(len(at)) - first
            rows = self.table[at]
            free = rows == 0
            fits = nth < free.sum(1)
            # The nth waiting mark of a bucket takes its nth free place.
            slot = np.argmax(free & (free.cumsum(1) == (nth + 1)[:, None]), axis=1)
            self.table[at[fits], slot[fits]] = mark[fits]
            mark, at = mark[~fits], at[~fits]
            lead = np.ones(len(at), bool)
            lead[1:] = at[1:] != at[:-1]
            if turn % 2 == 0:
                at = self.other(at, mark)
            else:
                slot = rng.integers(0, self.SLOTS, len(at))
                out = self.table[at[lead], slot[lead]]
                self.table[at[lead], slot[lead]] = mark[lead]
                mark = np.concatenate([out, mark[~lead]])
                at = np.concatenate([at[lead], at[~lead]])
                at = self.other(at, mark)
        return not len(mark)

    def maybe(self, digests: np.ndarray) -> np.ndarray:
        """False: certainly not inserted."""
        mark, at = self.places(digests)
        return (self.table[at] == mark[:, None]).any(1) | (self.table[self.other(at, mark)] == mark[:, None]).any(1)

    def delete(self, digests: np.ndarray) -> None:
        """Takes out one mark for each digest; the digests must have been inserted."""
        mark, at = self.places(digests)
        for _ in range(2):  # in the first bucket, then in the other one
            order = np.lexsort((mark, at))
            mark, at = mark[order], at[order]
            both = (at << 16) | mark
            nth = np.arange(len(at)) - np.searchsorted(both, both)
            hits = self.table[at] == mark[:, None]
            there = nth < hits.sum(1)
            slot = np.argmax(hits & (hits.cumsum(1) == (nth + 1)[:, None]), axis=1)
            self.table[at[there], slot[there]] = 0
            mark, at = mark[~there], at[~there]
            at = self.other(at, mark)

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, "<u2").reshape(-1, cls.SLOTS).copy()
        return cls(len(table), table)


def halves(digests: pa.Array | pa.ChunkedArray | list[bytes]) -> np.ndarray:
    """The digests as rows of two numbers; a column's are not copied value by value."""
    if isinstance(digests, list):
        return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    chunks = [c.cast(pa.binary(16)) for c in (digests.chunks if isinstance(digests, pa.ChunkedArray) else [digests]) if len(c)]
    parts = [np.frombuffer(c.buffers()[1], "<u8", 2 * len(c), 16 * c.offset).reshape(-1, 2) for c in chunks]
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64)


def shard_of(key: str, n_shards: int):
    return F.pmod(F.xxhash64(key), F.lit(n_shards)).cast("int")


def keyed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (a hash of the text), key: a row for each document and counted key in it, however often the document repeats it.

    The hash tells rows of one id apart, so that each meets its own keys alone. Whether a line goes depends on id and key, so rows whose hashes are equal do no harm.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, most=SPLIT_BYTES):
            counts, out = [], []
            for text in texts.to_pylist():
                own = {line_key(x) for x in text.split("\n")} - {None}
                counts.append(len(own))
                out += sorted(own)
            take = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.record_batch({"doc_id": batch.column(0).take(take), "row": batch.column(2).take(take), "key": pa.array(out, pa.binary())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col)).mapInArrow(thrifty(keys), "doc_id long, row long, key binary")


def counted(lines: DataFrame) -> DataFrame:
    """key, refs, last: counts come from partial sums, so a line in a third of all documents is one small row for each task."""
    return lines.groupBy("key").agg(F.count("*").alias("refs"), F.max("doc_id").alias("last"))


def filters_of(table: DataFrame) -> DataFrame:
    """shard, n_keys, filter for each shard of a table with distinct keys."""

    def build(part: pa.Table) -> pa.Table:
        made = CuckooFilter.of(halves(part.column("key")))
        return pa.table({"shard": part.column("shard").slice(0, 1), "n_keys": pa.array([part.num_rows], pa.int64()), "filter": pa.array([made.to_bytes()], pa.binary())})

    return table.select("shard", "key").groupBy("shard").applyInArrow(build, "shard int, n_keys long, filter binary")


def prefiltered(lines: DataFrame, repeated: DataFrame, n_shards: int, most_bytes: int = PREFILTER_BYTES) -> DataFrame:
    """lines without those that filters of the repeated keys rule out."""
    return not_ruled_out(lines, written(filters_of(repeated), "line-filters"), n_shards, most_bytes)


def not_ruled_out(lines: DataFrame, filters: DataFrame, n_shards: int, most_bytes: int | None = None) -> DataFrame:
    """lines (doc_id, row, key) that their shard's filter (shard, filter) may hold. Filters larger than most_bytes (PREFILTER_BYTES) in all meet the lines by shard."""
    most_bytes = PREFILTER_BYTES if most_bytes is None else most_bytes
    size = filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    if size > most_bytes:
        return probed_by_shard(lines.withColumn("shard", shard_of("key", n_shards)), filters)
    sent = lines.sparkSession.sparkContext.broadcast({r.shard: bytes(r.filter) for r in filters.collect()})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {s: CuckooFilter.from_bytes(b) for s, b in sent.value.items()}
        for batch in batches:
            shard, digests = batch.column("shard").to_numpy(), halves(batch.column("key"))
            hit = np.zeros(len(shard), bool)
            for s in np.unique(shard):
                if s in opened:
                    mine = np.flatnonzero(shard == s)
                    hit[mine] = opened[s].maybe(digests[mine])
            yield batch.filter(pa.array(hit))

    return lines.withColumn("shard", shard_of("key", n_shards)).mapInArrow(thrifty(probe), "doc_id long, row long, key binary, shard int").drop("shard")


def probed_by_shard(lines: DataFrame, filters: DataFrame) -> DataFrame:
    """Lines (doc_id, row, key, shard) that their shard's filter doesn't rule out. A shard of many lines is dealt over salts, each of which gets its filter."""
    counts = lines.groupBy("shard").agg(F.count("*").alias("lines"))
    salts = written(filters.join(counts, "shard").select("shard", "filter", F.ceil(F.col("lines") / GROUP_LINES).cast("int").alias("salts")), "line-salts")
    dealt = lines.join(F.broadcast(salts.select("shard", "salts")), "shard")  # a row for each SHARD_KEYS repeated keys
    dealt = dealt.select("doc_id", "row", "key", "shard", F.pmod(F.xxhash64("doc_id", "row", "key"), F.col("salts")).cast("int").alias("salt"))
    sent = salts.select("shard", "filter", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def probe(part: pa.Table, own: pa.Table) -> pa.Table:
        found = np.zeros(part.num_rows, bool)
        if part.num_rows and own.num_rows:
            found = CuckooFilter.from_bytes(own.column("filter")[0].as_py()).maybe(halves(part.column("key")))
        return part.select(["doc_id", "row", "key"]).filter(pa.array(found))

    return dealt.groupBy("shard", "salt").cogroup(sent.groupBy("shard", "salt")).applyInArrow(probe, "doc_id long, row long, key binary")


def dropped_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, row, keys: the keys whose lines the rows of that id and text lose, as an index of all of docs tells."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return LineIndex(docs.sparkSession, least_docs=least_docs).insert(named).dropped()


def kept_lines(text: str | None, keys: list[bytes] | None) -> tuple[int, int, str]:
    """Lines before dropping, lines dropped, the remaining text."""
    text = text or ""
    n_lines = text.count("\n") + 1
    if not keys:
        return n_lines, 0, text
    gone = set(keys)
    left = [x for x in text.split("\n") if line_key(x) not in gone]
    return n_lines, n_lines - len(left), "\n".join(left)


KEPT = "doc_id long, n_lines long, n_dropped long, kept string, kept_sha256 string"


def deduplicated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the remaining text), kept_sha256 for every row.

    Null and empty texts are one empty line. Each row counts as a document, rows that repeat an id too; all rows with
    the largest id keep their lines. A null id is never the largest unless every holder's is null. An empty table gives no
    rows. Only the two columns are read. A row has at most its own lines in the group of its dropped keys, however many rows share its id.
    """
    lost = dropped_keys(docs, id_col, text_col, least_docs).withColumnsRenamed({"doc_id": "_lost_id", "row": "_lost_row"})
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch, _ in slices(batches, most=SPLIT_BYTES):
            rows = []
            for doc_id, text, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n_lines, n_dropped, kept = kept_lines(text, keys)
                rows.append((doc_id, n_lines, n_dropped, kept, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in KEPT.split(", ")])

    both = whole.join(lost, F.col("doc_id").eqNullSafe(F.col("_lost_id")) & (F.xxhash64("text") == F.col("_lost_row")), "left").select("doc_id", "text", "keys")
    return both.mapInArrow(thrifty(apply), KEPT)


def with_kept_lines(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs (doc_id, text, any others) with the remaining texts, and n_chars, if there, counted again. Rows and columns stay; null texts stay null."""
    lost = dropped_keys(docs, least_docs=least_docs).select(F.col("doc_id").alias("_lost_id"), F.col("row").alias("_lost_row"), F.col("keys").alias("_lost_keys"))
    names = docs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in slices(batches, most=SPLIT_BYTES):
            text = [t if not k else kept_lines(t, k)[2] for t, k in zip(batch.column("text").to_pylist(), batch.column("_lost_keys").to_pylist(), strict=True)]
            columns = {n: batch.column(n) for n in names} | {"text": pa.array(text, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    met = docs["doc_id"].eqNullSafe(lost["_lost_id"]) & (F.xxhash64(docs["text"]) == lost["_lost_row"])
    joined = docs.join(lost, met, "left").drop("_lost_id", "_lost_row").mapInArrow(thrifty(apply), docs.schema)
    return joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else joined


class LineIndex:
    """Line dedup of documents that come and go, stored under a path. By shard of keys: exact counts (table), filters of all live keys (filters)
    and of the keys that least_docs documents hold (repeats). By change: which rows an insertion brought (held), which ids a deletion took out (gone).

    insert() and delete() write new folders of the shards that they change and leave all others as they are; then they commit a manifest of what
    counts now. Opening a path reads the newest manifest, so an index outlives its driver, and a change that was killed never happened. Of two
    writers at once, the later one fails (Conflict) and can open the index again. clean() deletes what no manifest names any more. The
    number of shards follows the number of keys: before more are inserted than shard_keys a shard, all are dealt anew over more shards.

    Rows that repeat an id each count, and a null id is no largest id unless every holder's is null; deleting an id takes out all its rows (null ids can't be named, and stay).
    """

    SCHEMAS = {
        "held": "doc_id long, row long, key binary, change int",
        "gone": "doc_id long, change int",
        "table": "key binary, refs long, last long, shard int",
        "filters": "n_keys long, filter binary, shard int",
        "repeats": "n_keys long, filter binary, shard int",
    }
    BY_SHARD = ("table", "filters", "repeats")

    def __init__(self, spark: SparkSession, path: str | None = None, n_shards: int = 1, shard_keys: int = SHARD_KEYS, least_docs: int = LEAST_DOCS):
        """n_shards, shard_keys and least_docs are of a new index; one that is there keeps its own."""
        self.spark, self.path = spark, path or new_path(spark, "line-index")
        self.manifests, self.version = Manifests(spark, self.path), ""
        self.n_shards, self.shard_keys, self.least_docs = n_shards, shard_keys, least_docs
        self._open()

    def _open(self) -> None:
        self.number, state = self.manifests.latest()
        self.n_shards, self.shard_keys, self.least_docs = (state.get(x, getattr(self, x)) for x in ("n_shards", "shard_keys", "least_docs"))
        #: For each shard (of held and gone: change) the one folder that counts.
        self.live: dict[str, dict[int, list[str]]] = {name: {int(s): v for s, v in state.get("live", {}).get(name, {}).items()} for name in self.SCHEMAS}

    def _changed(self, step: Callable[[DataFrame], None], rows: DataFrame) -> LineIndex:
        """One change as a whole: it is committed, or the index is as the manifest says."""
        try:
            step(rows)
            return self._commit()
        except BaseException:
            self._open()
            raise

    def _begin(self) -> None:
        """New folders have a name that nothing has used, whatever was killed before."""
        self.version = uuid.uuid4().hex

    def _commit(self) -> LineIndex:
        live = {name: {str(s): v for s, v in shards.items() if v} for name, shards in self.live.items()}
        own = {"n_shards": self.n_shards, "shard_keys": self.shard_keys, "least_docs": self.least_docs}
        self.number = self.manifests.commit(own | {"live": live}, self.number)
        return self

    def clean(self, kept: int = 2, age_s: float = 24 * 3600) -> int:
        """Deletes folders that none of the newest manifests names; how many."""
        folders = lambda state: {f"{self._part(name, s)}/version={v}" for name, shards in state.get("live", {}).items() for s, versions in shards.items() for v in versions}
        return self.manifests.clean(folders, 3, kept, age_s)

    def _part(self, name: str, s: int | str) -> str:
        return f"{name}/{'shard' if name in self.BY_SHARD else 'change'}={s}"

    def _read(self, name: str, parts: list[int] | None = None) -> DataFrame:
        """The rows of the shards or changes (None: all), with its number."""
        paths = [f"{self.path}/{self._part(name, s)}/version={v}" for s, versions in self.live[name].items() if parts is None or s in parts for v in versions]
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        return self.spark.read.schema(f"{self.SCHEMAS[name]}, version string").option("basePath", f"{self.path}/{name}").parquet(*paths).drop("version")

    def _write(self, name: str, rows: DataFrame, shards: list[int]) -> None:
        """rows (with shard) as new folders of the shards, each from one task; a shard without rows has none."""
        if shards:
            rows = rows.repartition(len(shards), "shard")
            rows.withColumn("version", F.lit(self.version)).write.partitionBy("shard", "version").mode("append").parquet(f"{self.path}/{name}")
        for s in shards:
            there = f"version={self.version}" in {x for x, _ in self.manifests.children(self._part(name, s))}
            self.live[name][s] = [self.version] if there else []

    def _write_change(self, name: str, rows: DataFrame) -> DataFrame:
        """rows as what this change brings; read again, without its number."""
        change = self.number + 1
        rows.write.parquet(f"{self.path}/{self._part(name, change)}/version={self.version}")
        self.live[name][change] = [self.version]
        return self._read(name, [change]).drop("change")

    def _write_repeats(self, shards: list[int]) -> None:
        """Filters of the repeated keys of shards whose table has been written."""
        self._write("repeats", filters_of(self._read("table", shards).filter(F.col("refs") >= self.least_docs)), shards)

    def _with_filters(self, keys: DataFrame, shards: list[int], change: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """change(keys of a shard, its filter's row or none) for each of the shards."""
        return keys.groupBy("shard").cogroup(self._read("filters", shards).groupBy("shard")).applyInArrow(change, schema)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds documents. Keys that the filters don't know are new and skip the exact table; the others are added to its counts."""
        return self._changed(self._insert, docs)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Takes documents out (doc_ids: column doc_id). Only the exact rows of their keys are counted again; keys that nobody holds leave the filters."""
        return self._changed(self._delete, doc_ids)

    def _make_room(self, lines: DataFrame) -> None:
        """Enough shards for the keys that are there and those of lines, which are estimated: only the layout depends on them."""
        keys = lines.agg(F.approx_count_distinct("key")).first()[0] + (self._read("filters").agg(F.sum("n_keys")).first()[0] or 0)
        if keys > self.n_shards * self.shard_keys:
            self._deal_anew(self.n_shards << (-(-keys // (self.n_shards * self.shard_keys)) - 1).bit_length())

    def _insert(self, docs: DataFrame) -> None:
        self._begin()
        lines = self._write_change("held", keyed_lines(docs))
        self._make_room(lines)
        counts = counted(lines).withColumn("shard", shard_of("key", self.n_shards))
        if any(self.live["table"].values()):
            return self._add(written(counts, "line-counts"))
        # Nothing is there that a filter could know.
        shards = list(range(self.n_shards))
        self._write("table", counts, shards)
        self._write("filters", filters_of(self._read("table", shards)), shards)
        self._write_repeats(shards)

    def _add(self, counts: DataFrame) -> None:
        """Adds counts (key, refs, last, shard) to those that are there."""
        shards = [r.shard for r in counts.select("shard").distinct().collect()]

        def probe(part: pa.Table, own: pa.Table) -> pa.Table:
            found = np.zeros(part.num_rows, bool)
            if own.num_rows and part.num_rows:
                found = CuckooFilter.from_bytes(own.column("filter")[0].as_py()).maybe(halves(part.column("key")))
            return part.select(["key", "refs", "last", "shard"]).append_column("maybe", pa.array(found))

        fresh = written(self._with_filters(counts, shards, probe, "key binary, refs long, last long, shard int, maybe boolean"), "line-split")
        table, maybe, new = self._read("table", shards), fresh.filter("maybe").drop("maybe"), fresh.filter("not maybe").drop("maybe")
        known = table.join(maybe.select("key"), "key", "left_semi")
        summed = known.unionByName(maybe).groupBy("key", "shard").agg(F.sum("refs").alias("refs"), F.max("last").alias("last"))
        merged = table.join(maybe.select("key"), "key", "left_anti").unionByName(summed).unionByName(new)
        added = written(new.select("shard", "key").unionByName(maybe.join(known.select("key"), "key", "left_anti").select("shard", "key")), "line-new")

        def add(part: pa.Table, own: pa.Table) -> pa.Table:
            """A filter that has no room left is null, and made anew."""
            digests = halves(part.column("key")) if part.num_rows else np.zeros((0, 2), np.uint64)
            made = CuckooFilter.from_bytes(own.column("filter")[0].as_py()) if own.num_rows else CuckooFilter.of(digests)
            full = own.num_rows and not made.insert(digests)
            n = part.num_rows + (own.column("n_keys")[0].as_py() if own.num_rows else 0)
            shard = (part if part.num_rows else own).column("shard").slice(0, 1)
            return pa.table({"shard": shard, "n_keys": pa.array([n], pa.int64()), "filter": pa.array([None if full else made.to_bytes()], pa.binary())})

        changed = [r.shard for r in added.select("shard").distinct().collect()]
        filters = written(self._with_filters(added, changed, add, "shard int, n_keys long, filter binary"), "line-filters")
        full = [r.shard for r in filters.filter("filter is null").select("shard").collect()]
        self._write("table", merged, shards)
        again = filters_of(self._read("table", full)) if full else None
        kept = filters.filter("filter is not null")
        self._write("filters", kept if again is None else kept.unionByName(again), changed)
        self._write_repeats(shards)

    def _deal_anew(self, n_shards: int) -> None:
        table = self._read("table").withColumn("shard", shard_of("key", n_shards))
        self.n_shards, shards, there = n_shards, list(range(n_shards)), any(self.live["table"].values())
        self.live |= {name: {} for name in self.BY_SHARD}
        if there:
            self._write("table", table, shards)
            self._write("filters", filters_of(self._read("table")), shards)
            self._begin()  # the change itself may write the same shards again

    def _delete(self, doc_ids: DataFrame) -> None:
        self._begin()
        out = written(doc_ids.select("doc_id").filter("doc_id is not null").distinct(), "line-out")
        held = self.held().withColumn("shard", shard_of("key", self.n_shards))
        gone = written(held.join(out, "doc_id", "left_semi").select("shard", "key").distinct(), "line-gone")
        self._write_change("gone", out)
        shards = [r.shard for r in gone.select("shard").distinct().collect()]
        left = held.join(out, "doc_id", "left_anti").join(gone.select("key"), "key", "left_semi")
        again = written(left.groupBy("shard", "key").agg(F.count("*").alias("refs"), F.max("doc_id").alias("last")), "line-again")
        table = self._read("table", shards).join(gone.select("key"), "key", "left_anti").unionByName(again)
        dead = written(gone.join(again.select("key"), "key", "left_anti").select("shard", "key"), "line-dead")
        changed = [r.shard for r in dead.select("shard").distinct().collect()]

        def take(part: pa.Table, own: pa.Table) -> pa.Table:
            made = CuckooFilter.from_bytes(own.column("filter")[0].as_py())
            made.delete(halves(part.column("key")))
            n = own.column("n_keys")[0].as_py() - part.num_rows
            return pa.table({"shard": own.column("shard"), "n_keys": pa.array([n], pa.int64()), "filter": pa.array([made.to_bytes()], pa.binary())})

        filters = self._with_filters(dead, changed, take, "shard int, n_keys long, filter binary")
        self._write("filters", filters, changed)
        self._write("table", table, shards)
        self._write_repeats(shards)

    def compact(self) -> LineIndex:
        """Writes the rows that are held as one change, so that ids that deletions took out need no longer be looked up."""

        def step(rows: DataFrame) -> None:
            self._begin()
            change = self.number + 1
            self._write_change("held", rows)
            self.live |= {"held": {change: [self.version]}, "gone": {}}

        return self._changed(step, self.held())

    def held(self) -> DataFrame:
        """doc_id, row, key of all documents that are in: what an insertion brought and no later deletion took out."""
        rows = self._read("held")
        if not self.live["gone"]:
            return rows.drop("change")
        gone = self._read("gone").groupBy(F.col("doc_id").alias("_gone")).agg(F.max("change").alias("_until"))
        return rows.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.col("change") < F.col("_until")), "left_anti").drop("change")

    def counts(self) -> DataFrame:
        return self._read("table")

    def repeated(self) -> DataFrame:
        return self.counts().filter(F.col("refs") >= self.least_docs)

    def dropped(self) -> DataFrame:
        """doc_id, row, keys: the keys whose lines the rows of that id and text lose now. Filters of repeated keys keep most lines out of the join with the exact counts."""
        some = not_ruled_out(self.held(), self._read("repeats"), self.n_shards)
        # A hot key has many rows on the left only, which Spark splits; the exact table has one row for each key.
        lost = some.join(self.repeated().select("key", "last").hint("merge"), "key").filter(~F.col("doc_id").eqNullSafe(F.col("last")))
        return lost.groupBy("doc_id", "row").agg(F.collect_set("key").alias("keys"))


def line_report(docs: DataFrame) -> DataFrame:
    return deduplicated_lines(docs).drop("kept")
