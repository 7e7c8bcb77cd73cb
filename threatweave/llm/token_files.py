"""Operator 3: token-id output as flat unsigned integer files with 64-bit document offsets.

A data set is a folder of ``ids-*.bin`` files (little-endian unsigned integers, as narrow as the vocabulary allows) and,
beside each, an ``idx-*.bin`` file of 64-bit integers: for n documents n ids of documents, n validity flags of those and
n + 1 offsets into the flat file. Files hold documents in ascending order of their ids. ``manifest`` (Parquet) has one row
a file with ``base``, the tokens in all files before it, from a prefix sum over the files.

A file is named after its task's attempt, and the manifest only lists files of attempts that ended well, so a lost
executor or a repeated task leaves no trace in the data set.

Defined results: a null text is an empty one; a document always has its end id; rows with equal document ids follow each
other, ordered by a hash of their text; a null document id comes first and is read back as null; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import freeing, new_path, table

READ_DOCS = 4096


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") is False else f"file://{uri}")


def _open(uri: str, name: str, dtype: str) -> np.ndarray:
    """The file's integers: memory-mapped where the folder is mounted, else read from its store."""
    from pyarrow import fs

    system, path = _filesystem(uri)
    where = f"{path}/{name}"
    if system.get_file_info(where).size == 0:
        return np.zeros(0, dtype=dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(where, dtype=dtype, mode="r")
    with system.open_input_file(where) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def write_token_files(docs: DataFrame, uri: str, *, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, write the files below ``uri`` and return the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        enc = tokens.encoder(tokenizer_path)
        end = np.array([end_id], dtype=enc.dtype)
        system, path = _filesystem(uri)
        names = [f"{kind}-{part:06d}-{attempt}.bin" for kind in ("ids", "idx")]
        keys, valid, sizes = [], [], []
        out = None
        for chunk in tokens.chunks(batches, "text"):
            if out is None:
                out = system.open_output_stream(f"{path}/{names[0]}")
            texts = chunk["text"].combine_chunks()
            ids, bounds = enc.encode(texts)
            out.write(np.insert(ids, bounds[1:], end[0]).tobytes())
            ok = chunk["doc_id"].is_valid().to_numpy()
            valid.append(ok.astype(np.int64))
            keys.append(chunk["doc_id"].fill_null(0).to_numpy().astype(np.int64))
            sizes.append(np.diff(bounds) + 1)
        tokens.forget(tokenizer_path)
        if out is None:
            return
        out.close()
        n = np.concatenate(sizes)
        with system.open_output_stream(f"{path}/{names[1]}") as f:
            for x in (np.concatenate(keys), np.concatenate(valid), np.concatenate([[0], np.cumsum(n)])):
                f.write(x.astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": [part], "ids_file": [names[0]], "idx_file": [names[1]], "dtype": [enc.dtype.str], "n_docs": [len(n)], "n_tokens": [int(n.sum())]}, schema=schema)

    schema = pa.schema([("part", pa.int64()), ("ids_file", pa.string()), ("idx_file", pa.string()), ("dtype", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    spark = docs.sparkSession
    system, path = _filesystem(uri)
    system.create_dir(path, recursive=True)
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"))
    ordered.mapInArrow(freeing(write), "part long, ids_file string, idx_file string, dtype string, n_docs long, n_tokens long").write.parquet(f"{uri}/written")
    # One row a file: the prefix sum over them is small however large the corpus.
    files = spark.read.parquet(f"{uri}/written")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{uri}/manifest")
    return spark.read.parquet(f"{uri}/manifest")


def read_token_files(spark: SparkSession, uri: str) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_docs"]
                index = _open(uri, row["idx_file"], "<i8")
                ids = _open(uri, row["ids_file"], row["dtype"])
                keys, valid, offsets = index[:n], index[n : 2 * n], index[2 * n :]
                for a in range(0, n, READ_DOCS):
                    b = min(n, a + READ_DOCS)
                    at = offsets[a : b + 1]
                    crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys[a:b], mask=valid[a:b] == 0), "start": at[:-1] + row["base"], "n_tokens": np.diff(at), "ids_crc32": np.array(crc, dtype=np.int64)})

    files = spark.read.parquet(f"{uri}/manifest")
    return files.repartition(max(1, files.count()), "part").mapInArrow(freeing(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), uri, tokenizer_path=tokens.default_path(), end_id=1)
    return read_token_files(spark, uri)
