"""At-least-once deliveries collapsed to one row per message.

:class:`MessageStore` keeps messages in hash-bucketed, key-sorted runs below one
folder, with a manifest beside them that names the runs there are and the upload
each came from.  ``upsert`` turns a batch into one sorted run without repeated
keys; uploading the same run again changes nothing, also from another process
or after a restart.  ``compact`` merges runs two by two, bucket by bucket, so
that equal identifiers collapse, and ``read`` gives the same merged view without
writing.

Scale: a run is collapsed by a sort-based aggregation whose partial step works
before the shuffle, so a message delivered billions of times leaves each map
task once.  Merging is a full outer sort-merge join of equally bucketed, sorted
files: no exchange and no sort, and a run holds one row a key.  (Reading more
than two runs uncompacted brings merged rows together anew.)  Buckets let
lookups by identifier read one file a run.
"""

from __future__ import annotations

import json
import uuid
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import scratch


def message_key(col: str | Column) -> Column:
    """An identifier without surrounding white space and letter case; null where nothing is left."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))
    return F.when(c != "", c)


class MessageStore:
    """Hash-bucketed sorted storage of messages.

    keys: identifier columns; of the rows given at least one is not null.
    order: columns that decide which copy stays (the smallest; ties are decided
    by the later columns, so the last one should be unique).

    path: the folder; one with a manifest is opened as it is.  Writers that
    change a store at the same time don't overwrite each other: the later one
    fails and may open the store anew.
    """

    def __init__(self, spark: SparkSession, keys: list[str], order: list[str], payload: list[str], path: str | None = None, buckets: int | None = None):
        self.spark, self.keys, self.order, self.payload = spark, keys, order, payload
        self.path = path or scratch.new_dir(spark, "messages")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.runs, self.schema = 0, {}, None
        self._tables: dict[str, str] = {}
        self._load()

    # --- manifest ---

    def _load(self) -> None:
        versions = [int(n.removeprefix("manifest-")) for n in scratch.names(self.spark, self.path) if n.startswith("manifest-")]
        if versions:
            self.version = max(versions)
            found = json.loads(scratch.read_text(self.spark, f"{self.path}/manifest-{self.version}"))
            if found["keys"] != self.keys or found["order"] != self.order or found["payload"] != self.payload:
                raise ValueError("the store holds other columns")
            self.runs, self.buckets, self.schema = found["runs"], found["buckets"], found["schema"]

    def _commit(self, runs: dict[str, str]) -> None:
        """A new version of the manifest; fails if another writer made it first."""
        text = json.dumps({"keys": self.keys, "order": self.order, "payload": self.payload, "buckets": self.buckets, "schema": self.schema, "runs": runs})
        scratch.write_new_text(self.spark, f"{self.path}/manifest-{self.version + 1}", text)
        self.version, self.runs = self.version + 1, runs

    # --- runs ---

    def _keys(self) -> list[str]:
        return [f"_k{i}" for i in range(len(self.keys))]

    def _table(self, directory: str) -> str:
        """The catalogue's name of a run: bucketed tables are known by name only."""
        if directory not in self._tables:
            name = "messages_" + uuid.uuid4().hex
            cols = ", ".join(self._keys())
            self.spark.sql(f"create table {name} ({self.schema}) using parquet options (path '{self.path}/{directory}') clustered by ({cols}) sorted by ({cols}) into {self.buckets} buckets")
            self._tables[directory] = name
        return self._tables[directory]

    def _write(self, df: DataFrame, label: str) -> str:
        """A bucketed, sorted run; ``df`` has its rows in the buckets' partitions already."""
        directory, name = f"{label}-{uuid.uuid4().hex[:12]}", "messages_" + uuid.uuid4().hex
        df.write.bucketBy(self.buckets, *self._keys()).sortBy(*self._keys()).option("path", f"{self.path}/{directory}").format("parquet").saveAsTable(name)
        self.schema = self.schema or self.spark.table(name)._jdf.schema().toDDL()
        self._tables[directory] = name
        return directory

    def upsert(self, batch: DataFrame, run: str) -> None:
        """Add a batch as one sorted run; a run id that is known already is left alone."""
        if run in self.runs:
            return
        # null is a value of a key here, and joins of buckets need plain equality
        keyed = batch.select(
            *(F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")).alias(n) for k, n in zip(self.keys, self._keys())),
            F.struct(*self.order).alias("_order"),
            F.struct(*(self.payload or self.order)).alias("_row"),
        )
        once = keyed.groupBy(*self._keys()).agg(F.min_by(F.struct("_order", "_row"), "_order").alias("_first"), F.count(F.lit(1)).alias("_copies"))
        rows = once.select(*self._keys(), "_first._order", "_first._row", "_copies").repartition(self.buckets, *self._keys())
        self._commit({**self.runs, run: self._write(rows, "run")})

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two views of runs as one, the first row of each key and all its copies: a merge of sorted buckets."""
        a, b = a.alias("a"), b.alias("b")
        both = a.join(b.hint("merge"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in self._keys()], "full_outer")
        first = F.col("b._copies").isNull() | (F.col("a._order") <= F.col("b._order"))
        pick = lambda c: F.when(first, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
        copies = F.coalesce("a._copies", F.lit(0)) + F.coalesce("b._copies", F.lit(0))
        return both.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in self._keys()), pick("_order"), pick("_row"), copies.cast("bigint").alias("_copies"))

    def _view(self, directories: list[str]) -> DataFrame:
        # files of a bucket are read in their order, one a run, so that nothing is sorted again
        self.spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        views = [self.spark.table(self._table(d)) for d in directories]
        while len(views) > 1:
            views = [self._merged(*pair) if len(pair) > 1 else pair[0] for pair in (views[i : i + 2] for i in range(0, len(views), 2))]
        return views[0]

    def compact(self) -> None:
        """Merge all runs into one, two by two; old runs go once the manifest names the new one.

        Run ids stay known, so a late repeat of an old upload still has no effect.
        """
        while len(old := list(dict.fromkeys(self.runs.values()))) > 1:
            became = {}
            for pair in (old[i : i + 2] for i in range(0, len(old) - 1, 2)):
                became.update(dict.fromkeys(pair, self._write(self._view(pair), "merged")))
            self._commit({run: became.get(d, d) for run, d in self.runs.items()})
            for directory in became:
                self.spark.sql(f"drop table {self._tables.pop(directory)}")
                scratch.remove(self.spark, f"{self.path}/{directory}")

    def read(self, count: str = "copies") -> DataFrame:
        """One row per message: keys, payload and ``count``, the number of rows it came in."""
        if not self.runs:
            raise ValueError("the store is empty")
        merged = self._view(list(dict.fromkeys(self.runs.values())))
        keys = (F.when(F.col(n) != "", F.substring(n, 2, 1 << 30)).alias(k) for k, n in zip(self.keys, self._keys()))
        return merged.select(*keys, *(F.col("_row")[c].alias(c) for c in self.payload), F.col("_copies").alias(count))

    def close(self) -> None:
        """Take the runs out of the catalogue; their files and the manifest stay, and frames read before still work."""
        for name in self._tables.values():
            self.spark.sql(f"drop table {name}")
        self._tables.clear()


def collapse_deliveries(
    df: DataFrame, keys: list[str], order: list[str], payload: list[str] | None = None, required: str | None = None, batch: str | None = None, batch_runs: int = 2, keep_unkeyed: bool = True
) -> DataFrame:
    """One row per message, with ``copies``.

    keys are compared without letter case and surrounding white space and come
    out in that form.  Rows whose ``required`` key (default: the last key) is
    null or blank have no identity: each is kept with copies = 1, or left out if
    ``keep_unkeyed`` is false.  Of equal rows and of ties in ``order`` one is
    kept.  An empty table gives an empty result.  Columns of the input that are
    called like the helper columns are only read if they are in ``payload``
    (default: all but the keys); if one of those is called ``copies``, the count
    is called ``copies_``.

    The rows go into a store in ``batch_runs`` uploads, by a hash of ``batch``
    (default: of the order columns), and come out of its compacted buckets.
    """
    required = required or keys[-1]
    payload = payload if payload is not None else [c for c in df.columns if c not in keys]
    by = [batch] if batch else order
    needed = list(dict.fromkeys([*keys, *order, *payload, *by]))
    rows = df.select(*needed).withColumns({k: message_key(k) for k in keys})
    has = F.col(required).isNotNull()
    store = MessageStore(df.sparkSession, keys, order, payload)
    keyed = rows.filter(has)
    for run in range(batch_runs):
        store.upsert(keyed.filter(F.pmod(F.xxhash64(*by), F.lit(batch_runs)) == run), f"run-{run}")
    store.compact()
    count = "copies_" if "copies" in payload else "copies"
    out = store.read(count)
    store.close()
    if keep_unkeyed:
        out = out.unionByName(rows.filter(~has).select(*keys, *payload, F.lit(1).cast("bigint").alias(count)))
    return out


def repeated_messages(df: DataFrame, keys: list[str], order: list[str], required: str | None = None, batch: str | None = None) -> DataFrame:
    """The identifiers that came in more than one row, with ``copies``.

    Only identifiers, order and batch columns are read; batches aren't stored.
    """
    return collapse_deliveries(df, keys, order, [], required, batch, keep_unkeyed=False).filter("copies > 1")
