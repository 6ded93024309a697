"""Lines written back as log files."""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WRITTEN = "source string, path string, lines bigint"
_WRITTEN_ARROW = pa.schema([("source", pa.string()), ("path", pa.string()), ("lines", pa.int64())])


def write_logs(lines: DataFrame, folder: str, last_newline: bool = True, gzip: bool = False) -> DataFrame:
    """Files ``folder/source`` with the lines of each source in order, written by the tasks that read ``source, path, lines``.

    A file appears whole, in place of one that was there.  Every source is written by one task, which streams over its
    lines.  ``last_newline=False`` leaves the last line unfinished; null texts are empty lines.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder.removeprefix("file:"))
        fs.create_dir(root, recursive=True)
        source, out, n = None, None, 0

        def finish() -> pa.RecordBatch:
            if last_newline:
                out.write(b"\n")
            out.close()
            fs.move(f"{root}/.{source}.part", f"{root}/{source}")
            return pa.RecordBatch.from_pylist([{"source": source, "path": f"{root}/{source}", "lines": n}], schema=_WRITTEN_ARROW)

        for batch in batches:
            for name, text in zip(batch.column("source").to_pylist(), batch.column("text").to_pylist()):
                if name != source:
                    if out:
                        yield finish()
                    source, n = name, 0
                    out = fs.open_output_stream(f"{root}/.{source}.part", compression="gzip" if gzip else None)
                out.write((b"\n" if n else b"") + (text or "").encode())
                n += 1
        if out:
            yield finish()

    lines = lines.select(F.col("source").cast("string").alias("source"), "line", "text")
    # Dealt by a hash of the source: where lines come from a join by source, repartition("source") is left out of the plan
    # as done already, and the adaptive execution may then read that join's shuffle by writer, a source in many tasks.
    ordered = lines.repartition(F.xxhash64("source"))
    return ordered.sortWithinPartitions("source", "line").select("source", "text").mapInArrow(write, _WRITTEN)
