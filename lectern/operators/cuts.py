"""Cut lineage: rows written to the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """The rows, written once: what reads them later does not run their work again. Only a local session may lack spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lectern-"))
    return df.checkpoint(eager=True)
