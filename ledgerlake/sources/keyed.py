"""A table of one row a key, changed by merges: copy-on-write buckets, event-time versions, tombstones (rows S13, T08).

Layout under its path: data/v=N/bucket=K (Parquet), and manifests/N, a small table of (bucket, v) that says which files make version N. A merge reads the
buckets that its changes touch, writes them anew, and then its manifest; what has no finished manifest does not count, so a lost driver leaves the
former version. Versions that no kept manifest names are deleted.

Of a key's rows the newest by event time counts, a deletion before others of its time, then the greatest row. The order is total, so the
table after any merges is a function of the changes alone: neither their batching nor the order in which they arrive matters, and a merge that
is done again changes nothing. A deletion is a row too (a tombstone), so that rows older than it which come late stay deleted.

Defined results: changes with a null key or time are left out; repeated changes count once; an empty batch makes no version; reading a table
that has never been merged into is an error. Columns may be added by later changes; older rows have null there. One merge runs at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Manifests that are kept, for readers that have begun: the newest and those before it.
KEPT = 2


def shared_folder(spark: SparkSession) -> str:
    """Where driver and executors share files: spark.checkpoint.dir; only a session of one machine may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or "file:///tmp/checkpoints/ledgerlake").rstrip("/")


class KeyedTable:
    """key: its column; time: the column of event times; deleted: a boolean column of changes, added as false where they have none."""

    def __init__(self, spark: SparkSession, path: str, key: str, time: str, deleted: str = "deleted", buckets: int = 64):
        self.spark, self.path, self.key, self.time, self.deleted, self.buckets = spark, path.rstrip("/"), key, time, deleted, buckets

    def _at(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions with a finished manifest, oldest first."""
        path, fs = self._at("manifests")
        found = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        done = [int(n) for n in found if n.isdigit() and fs.exists(self._at("manifests", n, "_SUCCESS")[0])]
        return sorted(done)

    def _manifest(self, version: int) -> dict[int, int]:
        """bucket -> version of its files; at most `buckets` rows."""
        return {r.bucket: r.v for r in self.spark.read.parquet(f"{self.path}/manifests/{version}").collect()}

    def _files(self, manifest: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(manifest.items())]
        return self.spark.read.option("mergeSchema", True).parquet(*paths)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _newest(self, rows: DataFrame) -> DataFrame:
        values = F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)])
        order = F.struct(F.col(self.time), F.col(self.deleted), F.to_json(values))
        return rows.groupBy(self.key).agg(F.max_by(F.struct("*"), order).alias("_row")).select("_row.*")

    def merge(self, changes: DataFrame, forget_before=None) -> int:
        """Merge changes and return the table's version. Tombstones older than forget_before go from the buckets that are written."""
        if self.deleted not in changes.columns:
            changes = changes.withColumn(self.deleted, F.lit(False))
        changes = changes.withColumn(self.deleted, F.coalesce(self.deleted, F.lit(False))).where(F.col(self.key).isNotNull() & F.col(self.time).isNotNull())
        done = self.versions()
        before = self._manifest(done[-1]) if done else {}
        touched = {r.bucket for r in changes.select(self._bucket().alias("bucket")).distinct().collect()}
        if not touched:
            return done[-1] if done else 0
        old = {b: v for b, v in before.items() if b in touched}
        rows = self._files(old).unionByName(changes, allowMissingColumns=True) if old else changes
        newest = self._newest(rows)
        if forget_before is not None:
            newest = newest.where(~(F.col(self.deleted) & (F.col(self.time) < F.lit(forget_before))))
        version = max(self._numbers(), default=0) + 1
        newest.withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(f"{self.path}/data/v={version}")
        path, fs = self._at("data", f"v={version}")
        written = {int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path) if f.getPath().getName().startswith("bucket=")}
        now = [(b, v) for b, v in before.items() if b not in touched] + [(b, version) for b in sorted(written)]
        self.spark.createDataFrame(now, "bucket int, v long").coalesce(1).write.parquet(f"{self.path}/manifests/{version}")
        self._clean()
        return version

    def delete(self, keys: DataFrame) -> int:
        """Merge deletions of keys (key, time)."""
        return self.merge(keys.select(self.key, self.time).withColumn(self.deleted, F.lit(True)))

    def _numbers(self) -> list[int]:
        """Numbers of all versions begun, finished or not."""
        path, fs = self._at("data")
        return [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path)] if fs.exists(path) else []

    def _clean(self) -> None:
        done = self.versions()
        kept = done[-KEPT:]
        named = {(b, v) for n in kept for b, v in self._manifest(n).items()}
        for v in self._numbers():
            path, fs = self._at("data", f"v={v}")
            for f in fs.listStatus(path):
                name = f.getPath().getName()
                if name.startswith("bucket=") and (int(name.split("=")[1]), v) not in named:
                    fs.delete(f.getPath(), True)
            if not any(w == v for _, w in named) and v not in kept:
                fs.delete(path, True)
        for n in done[:-KEPT]:
            path, fs = self._at("manifests", str(n))
            fs.delete(path, True)

    def read(self, with_deleted: bool = False) -> DataFrame:
        """The live rows of the newest version."""
        done = self.versions()
        if not done:
            raise ValueError(f"no version of a table in {self.path}")
        manifest = self._manifest(done[-1])
        if not manifest:
            raise ValueError(f"no rows in {self.path}")
        rows = self._files(manifest)
        return rows if with_deleted else rows.where(~F.col(self.deleted)).drop(self.deleted)


def settled(rows: DataFrame, link: str = "pending_transaction_id", own: tuple[str, ...] = ()) -> DataFrame:
    """rows(transaction_id, pending, `link`, ...) without pending rows that a posted row names; of several that name one, each takes its place.

    A posted row takes the columns `own` (a user's changes) from its pending row where it has none. Since it is a function of the table's rows, it does not
    matter whether the pending or the posted row came first.
    """
    posted = F.coalesce(~F.col("pending"), F.lit(True)) & F.col(link).isNotNull()
    named = rows.where(posted).select(F.col(link).alias("transaction_id")).distinct()
    pending = rows.where(F.coalesce("pending", F.lit(False)))
    stay = rows.join(named.join(pending.select("transaction_id"), "transaction_id", "left_semi"), "transaction_id", "left_anti").select(rows.columns)
    if not own:
        return stay
    # Most rows have no link: under a null key they would all meet in one task, so each has a key of its own that no pending row has.
    key = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    before = pending.select(key("l", "transaction_id").alias("_pending"), *[F.col(c).alias(f"_{c}") for c in own])
    joined = stay.withColumn("_link", F.when(posted, key("l", link)).otherwise(key("n", "transaction_id"))).join(before, F.col("_link") == F.col("_pending"), "left")
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) if c in own else F.col(c) for c in rows.columns])


def adopted(rows: DataFrame, feed: str = "plaid_transaction_id") -> DataFrame:
    """rows with each row of a feed taken for a row without a feed id of the same user, account, amount, day and description: that one gets
    the feed id and the feed row goes. The k-th of one side by transaction_id takes the k-th of the other; rows of null keys stay."""
    from pyspark.sql import Window

    key = ["user_id", "account_id", "amount", "transaction_date", "description"]
    fed = F.coalesce(F.col(feed) != "", F.lit(False))
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    # Copies of one kind are few beside the rows of a user; their places are taken by the key and the kind.
    place = F.row_number().over(Window.partitionBy(*key, fed).orderBy("transaction_id"))
    numbered = rows.where(whole).withColumn("_fed", fed).withColumn("_place", place)
    theirs = numbered.where("_fed").select(*key, "_place", F.col(feed).alias("_feed"), F.col("transaction_id").alias("_taken"))
    mine = numbered.where("NOT _fed").join(theirs, [*key, "_place"], "left")
    ours = mine.select(*[F.coalesce("_feed", feed).alias(c) if c == feed else F.col(c) for c in rows.columns])
    taken = mine.where("_taken IS NOT NULL").select(F.col("_taken").alias("transaction_id"))
    return ours.unionByName(numbered.where("_fed").join(taken, "transaction_id", "left_anti").select(rows.columns)).unionByName(rows.where(~whole))
