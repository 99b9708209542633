"""Frequency of every distinct term, kept up to date by signed deltas.

A store holds per-term occurrence and record counts in a folder partitioned by term bucket.
A batch of added, changed or deleted records becomes signed rows (+1 for each new image, -1
for each old image) and is aggregated to one change per term (partial aggregation before the
shuffle, so a hot term costs one row per task). The changes are written as a new layer of the
buckets they touch; a bucket is merged into one layer when it has more than ``MOST_LAYERS``, so a
batch costs what it holds and not what the store holds. Readers add the layers up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS = "term string, occurrences long, records long"


def signed_deltas(added: DataFrame | None, removed: DataFrame | None = None) -> DataFrame:
    """Per-term changes from ``record_terms`` rows of new and of old record images.

    A changed record is in both. Rows are (id, term, n); the result is (term, d_occ, d_rec),
    without terms whose changes cancel. Null terms are left out.
    """
    parts = [d.select("term", (F.col("n") * s).alias("o"), F.lit(s).cast("long").alias("r")) for d, s in ((added, 1), (removed, -1)) if d is not None]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return (
        both.filter("term is not null").groupBy("term")
        .agg(F.sum("o").alias("d_occ"), F.sum("r").alias("d_rec")).filter("d_occ <> 0 or d_rec <> 0")
    )


def changed_records(before: DataFrame, after: DataFrame, id_col: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new images, old images) of the rows that differ between two snapshots keyed by ``id_col``.

    Rows are compared by a digest of ``fields``; null differs from every value. An unchanged
    row is in neither result.
    """
    digest = F.xxhash64(*[F.coalesce(F.col(f), F.lit("\u0000")) for f in fields])
    old = before.select(id_col, digest.alias("_old"))
    new = after.select(id_col, digest.alias("_new"))
    same = old.join(new, id_col).filter("_old = _new").select(id_col)
    return after.join(same, id_col, "left_anti"), before.join(same, id_col, "left_anti")


#: Layers of a bucket from which on it is merged.
MOST_LAYERS = 4
#: Terms of the first batch for each bucket of a new store.
BUCKET_TERMS = 1_000_000


class TermStore:
    """Persistent partitioned counts: ``path/v<N>/bucket=<b>`` and a manifest of live layers.

    ``path`` must lie in a folder that all executors share. A new store takes its number of
    buckets from the first batch, an existing one keeps it. A version counts once its manifest
    has been renamed into place; a writer that dies before leaves the former version. Layers and
    manifests that are no longer used are removed after that.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.version = 0
        self.live: dict[int, list[int]] = {}
        self.total_records = 0
        self._load()

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _manifests(self) -> list[int]:
        fs, at = self._fs()
        top = at(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def _load(self) -> None:
        known = self._manifests()
        if not known:
            return
        rows = self.spark.read.schema("bucket int, version int, total long").json(f"{self.path}/manifest/v{known[-1]}").collect()  # a few rows per bucket
        self.version = known[-1]
        for r in rows:
            if r.bucket >= 0:
                self.live.setdefault(r.bucket, []).append(r.version)
            else:
                self.buckets, self.total_records = r.version, r.total

    def _bucket(self):
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def _read(self, buckets: set[int] | None = None) -> DataFrame:
        """Summed layers; buckets of one layer are read as they are."""
        chosen = {b: vs for b, vs in sorted(self.live.items()) if buckets is None or b in buckets}
        single = [f"{self.path}/v{vs[0]}/bucket={b}" for b, vs in chosen.items() if len(vs) == 1]
        many = [f"{self.path}/v{v}/bucket={b}" for b, vs in chosen.items() if len(vs) > 1 for v in vs]
        out = self.spark.read.schema(COUNTS).parquet(*single) if single else self.spark.createDataFrame([], COUNTS)
        if many:
            summed = self.spark.read.schema(COUNTS).parquet(*many).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).filter("records > 0")
            out = out.unionByName(summed) if single else summed
        return out

    def _write(self, rows: DataFrame) -> set[int]:
        """Write rows as a new version; returns the buckets that have any."""
        self.version += 1
        out = f"{self.path}/v{self.version}"
        rows.withColumn("bucket", self._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(out)
        fs, at = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(at(out))]
        return {int(n.split("=")[1]) for n in names if n.startswith("bucket=")}

    def apply(self, deltas: DataFrame, record_change: int) -> None:
        """Merge (term, d_occ, d_rec); ``record_change`` is added to the number of records."""
        changes = deltas.select("term", F.col("d_occ").alias("occurrences"), F.col("d_rec").alias("records"))
        if self.buckets is None:
            from citeloom.session import materialize

            changes = materialize(changes, "deltas")
            self.buckets = max(16, -(-changes.count() // BUCKET_TERMS))
        for b in self._write(changes):
            self.live.setdefault(b, []).append(self.version)
        self.total_records += record_change
        full = {b for b, vs in self.live.items() if len(vs) > MOST_LAYERS}
        if full:
            left = self._write(self._read(full))
            for b in full:
                self.live[b] = [self.version] if b in left else []
            self.live = {b: vs for b, vs in self.live.items() if vs}
        self._commit()

    def _commit(self) -> None:
        rows = [(b, v, self.total_records) for b, vs in self.live.items() for v in vs] + [(-1, self.buckets, self.total_records)]
        draft = f"{self.path}/manifest/_draft-{self.version}"
        self.spark.createDataFrame(rows, "bucket int, version int, total long").coalesce(1).write.mode("overwrite").json(draft)  # a few rows per bucket
        fs, at = self._fs()
        if not fs.rename(at(draft), at(f"{self.path}/manifest/v{self.version}")):
            raise OSError(f"another writer has written version {self.version} of {self.path}")
        used = {v for vs in self.live.values() for v in vs}
        for v in self._manifests()[:-1]:
            fs.delete(at(f"{self.path}/manifest/v{v}"), True)
        for s in fs.listStatus(at(self.path)):
            name = s.getPath().getName()
            if name[0] == "v" and name[1:].isdigit() and int(name[1:]) not in used:
                fs.delete(s.getPath(), True)

    def counts(self) -> DataFrame:
        return self._read().filter("records > 0")

    def marked(self, rare_max: int = 2, common_share: float = 0.08) -> DataFrame:
        """(term, occurrences, records, mark): ``rare`` up to ``rare_max`` records, ``common``
        above ``common_share`` of all records, else null. A term that is both counts as rare."""
        mark = F.when(F.col("records") <= rare_max, "rare").when(F.col("records") > common_share * self.total_records, "common")
        return self.counts().withColumn("mark", mark)
