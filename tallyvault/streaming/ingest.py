"""Digests that arrive over time, taken into a store once each.

An extension beyond batch saving; each batch follows the rules of `candidates.absent`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyvault.inventory import Store
from tallyvault.operators import contents
from tallyvault.operators.candidates import absent
from tallyvault.schemas import SCHEMAS


def hashes(spark: SparkSession, folder: str, store_folder: str, checkpoint: str) -> StreamingQuery:
    """Read Parquet files of hashes that appear in `folder` and publish those that are new.

    A batch that is run again after a failure finds its digests stored and adds nothing.  A
    batch writes its own digests alone and looks only at the scans that it names.  With them
    it adds its own counts of contents, in one commit, for scans whose counts are kept or
    that had no digests.
    """

    def take(batch: DataFrame, _: int) -> None:
        store = Store(spark, store_folder)
        found = store.load()
        named = [r[0] for r in batch.select("scan_id").distinct().collect()]  # scans, not files
        mine = F.col("scan_id").isin(named)
        files = found.entries.filter(mine & (F.col("kind") == "FILE")).select("scan_id", "entry_id", "kind", "size")
        new = absent(batch.select("scan_id", "entry_id", "sha256"), found.hashes.filter(mine), files).persist()
        if not new.isEmpty():
            kept = F.col("scan_id").isin([s for s in named if s not in contents.missing(store, found.revision)])
            counts = contents.counted(files.join(new.filter(kept), ["scan_id", "entry_id"]))
            store.save(append=True, base=found.revision, hashes=new.select("scan_id", "entry_id", "sha256"), contents=counts)
        new.unpersist()

    stream = spark.readStream.schema(SCHEMAS["hashes"]).parquet(folder)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
