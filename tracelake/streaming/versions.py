"""An extension of ours: file versions as a stream, passed on only when their content changed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "path string, seq long, sha string, before string"


def changes(versions: DataFrame) -> DataFrame:
    """``path, seq, sha, before`` for each version of ``path, seq, text`` that differs from the one before.

    The state of a path is its last digest and sequence number; older versions
    that come late are dropped.
    """

    def step(key, frames: Iterator[pd.DataFrame], state):
        seq, sha = state.get if state.exists else (-1, None)
        out = []
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            if row.seq > seq:
                if row.sha != sha:
                    out.append((key[0], row.seq, row.sha, sha))
                seq, sha = row.seq, row.sha
        state.update((int(seq), sha))
        yield pd.DataFrame(out, columns=["path", "seq", "sha", "before"])

    slim = versions.select("path", F.col("seq").cast("long").alias("seq"), F.sha2("text", 256).alias("sha"))
    return slim.groupBy("path").applyInPandasWithState(step, OUT, "seq long, sha string", "append", "NoTimeout")
