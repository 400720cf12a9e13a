"""Files of a table written as a file tree, by the executors."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _writer(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One at a time and without a copy: the contents of a batch are as large as its files.
            for path, content in zip(batch.column("path"), batch.column("content")):
                path = path.as_py()
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"{path}: not a path below the root")
                target = os.path.join(root, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                # A repeated task attempt replaces the file by the same content.
                partial = f"{target}.{uuid.uuid4().hex}.part"
                with open(partial, "wb") as file:
                    file.write(content.as_buffer())
                os.replace(partial, target)
            yield pa.RecordBatch.from_pydict({"written": pa.array([batch.num_rows], pa.int64())})

    return write


def write_tree(files: DataFrame, root: str) -> int:
    """Write rows (path, content) as files below `root`, a folder all executors see; their number."""
    rows = files.select("path", F.col("content").cast("binary").alias("content"))
    written = rows.mapInArrow(_writer(root), "written bigint")
    return written.agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0]
