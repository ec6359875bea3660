"""A stream of tokens from array files that keep coming, and an idempotent sink."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from weftline.sources.arrays import PART, _opened, _stream, array_files, read_head


@dataclass
class Tokens(InputPartition):
    path: str
    first: int  # the number in the stream of the file's first token
    start: int
    stop: int


class TokenReader(DataSourceStreamReader):
    """The offset is the number of tokens so far, in the order of the files' names.

    Files are only ever added behind the last one, and whole (written under another name
    first), so an offset means the same tokens in every run.
    """

    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rows", PART))
        self.known: dict[str, int] = {}

    def _sizes(self) -> list[tuple[str, int]]:
        fs, _ = _opened(self.path)
        for path in array_files(self.path):
            if path not in self.known:
                with _stream(fs, path, None) as s:
                    self.known[path] = read_head(s, path).rows
        return sorted(self.known.items())

    def initialOffset(self) -> dict:  # noqa: N802
        return {"tokens": 0}

    def latestOffset(self, *_: object) -> dict:  # noqa: N802
        return {"tokens": sum(n for _, n in self._sizes())}

    def partitions(self, start: dict, end: dict) -> list[Tokens]:
        out, first = [], 0
        for path, n in self._sizes():
            low, high = max(start["tokens"], first), min(end["tokens"], first + n)
            out += [Tokens(path, first, a, min(a + self.rows, high)) for a in range(low, high, self.rows)]
            first += n
        return out

    def read(self, part: Tokens) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.path)
        with _stream(fs, part.path, None) as s:
            head = read_head(s, part.path)
            width = int(np.prod(head.row_shape, dtype=np.int64))
            if width != 1:
                raise ValueError(f"{part.path} holds rows of {width} numbers, not tokens")
            s.seek(head.offset + (part.start - part.first) * head.kind.itemsize)
            x = np.frombuffer(s.read((part.stop - part.start) * head.kind.itemsize), head.kind)
        yield pa.record_batch({"at": np.arange(part.start, part.stop), "token": x.astype(np.int64)})

    def commit(self, end: dict) -> None:
        pass


class TokenStream(DataSource):
    """`path`: a folder of .npy files of tokens; `rows`: tokens of a task."""

    @classmethod
    def name(cls) -> str:
        return "token_stream"

    def schema(self) -> str:
        return "at long, token long"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return TokenReader(dict(self.options))


def token_stream(spark: SparkSession, path: str, rows: int = PART) -> DataFrame:
    """(at, token): a stream of the tokens in a folder's files, numbered through all of them."""
    spark.dataSource.register(TokenStream)
    return spark.readStream.format("token_stream").option("path", path).option("rows", rows).load()


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """A foreachBatch step that writes a batch as a whole, so that one that is tried again leaves it once."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def run_to_end(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Processes what is there since the last run with this checkpoint, and stops."""
    query = rows.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
