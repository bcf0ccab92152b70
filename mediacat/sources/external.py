"""External media programs, run on executors: one row of paths in, one row of output or error out.

Failures are data: a program that is missing, fails or times out gives its error text, so
one bad file does not fail the job, and the error feeds the tombstones.
"""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.functions import keys
from mediacat.sources import listing

TAIL = 2000
FRAME_SECONDS, FRAME_WIDTH, FRAME_HEIGHT = 2, 9, 8


@lru_cache(maxsize=16)
def resolve(name: str, variable: str, places: tuple[str, ...] = ()) -> str:
    """Path of a program: the variable (which must exist), known places, PATH, or the bare name."""
    if own := os.environ.get(variable):
        if not os.path.exists(own):
            raise FileNotFoundError(f"{variable} names {own}, which does not exist")
        return own
    return next((p for p in places if os.path.exists(p)), None) or shutil.which(name) or name


def run_program(args: list[str], timeout: float | None = None) -> tuple[bytes | None, str | None]:
    """(stdout, None), or (None, the last part of what the program says about its failure)."""
    try:
        done = subprocess.run(args, capture_output=True, timeout=timeout, check=False)
    except (OSError, subprocess.TimeoutExpired) as e:
        return None, str(e)[-TAIL:]
    if done.returncode:
        return None, f"exit {done.returncode}: {done.stderr.decode('utf-8', 'replace')[-TAIL:]}"
    return done.stdout, None


def probe_args(path: str) -> list[str]:
    return [resolve("ffprobe", "FFPROBE_PATH"), "-v", "error", "-print_format", "json", "-show_format", "-show_streams", path]


def frame_args(path: str, seconds: float = FRAME_SECONDS) -> list[str]:
    return [resolve("ffmpeg", "FFMPEG_PATH"), "-v", "error", "-i", path, "-vf", f"fps=1/{seconds:g},scale={FRAME_WIDTH}:{FRAME_HEIGHT},format=gray", "-f", "rawvideo", "-"]


def hasher_args(path: str) -> list[str]:
    return [resolve("pdq-photo-hasher", "PDQ_HASHER_PATH"), path]


def signature_args(path: str, out: str) -> list[str]:
    """Arguments that write a video's MPEG-7 signature to a file."""
    return [resolve("ffmpeg", "FFMPEG_PATH"), "-y", "-i", path, "-vf", f"signature=format=binary:filename={out}", "-f", "null", "-"]


def outputs(paths: DataFrame, args: Callable[[str], list[str]], timeout: float | None = None) -> DataFrame:
    """source_key, output (binary), error of a program over `path` of each row; paths: source_key, path."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, path in zip(pdf["source_key"], pdf["path"], strict=True):
                try:
                    found = run_program(args(path), timeout)
                except OSError as e:
                    found = (None, str(e)[-TAIL:])
                yield pd.DataFrame([(key, *found)], columns=["source_key", "output", "error"])

    return paths.select("source_key", "path").mapInPandas(each, "source_key string, output binary, error string")


def uploaded(files: DataFrame, put: Callable[[str, str, str], None], tasks: int = 8) -> DataFrame:
    """source path, key and error of files sent by `put(path, key, content_type)`, at most `tasks` at a time; files: path, key, content_type."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors = []
            for row in pdf.itertuples(index=False):
                try:
                    put(row.path, row.key, row.content_type)
                    errors.append(None)
                except Exception as e:  # a failed upload is a row of the result
                    errors.append(str(e)[-TAIL:])
            yield pdf.assign(error=errors)

    return files.select("path", "key", "content_type").repartition(tasks).mapInPandas(each, "path string, key string, content_type string, error string")


def uploaded_tree(spark: SparkSession, root: str, prefix: str, put: Callable[[str, str, str], None], tasks: int = 8) -> DataFrame:
    """`uploaded` over all files under a root, under their relative paths behind a prefix, with content types by suffix."""
    files = listing.tree(spark, root).select(F.concat(F.lit(root.rstrip("/") + "/"), "source_key").alias("path"), F.concat(F.lit(prefix), "source_key").alias("key"), keys.content_type(F.col("source_key")).alias("content_type"))
    return uploaded(files, put, tasks)


def hashed(paths: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """source_key, sha256, n_bytes, error of files read in chunks, for objects too large for a binary column."""
    import hashlib

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, path in zip(pdf["source_key"], pdf["path"], strict=True):
                digest, n = hashlib.sha256(), 0
                try:
                    with open(path, "rb") as f:
                        while part := f.read(chunk):
                            digest.update(part)
                            n += len(part)
                    rows.append((key, digest.hexdigest(), n, None))
                except OSError as e:
                    rows.append((key, None, n, str(e)))
            yield pd.DataFrame(rows, columns=["source_key", "sha256", "n_bytes", "error"])

    return paths.select("source_key", "path").mapInPandas(each, "source_key string, sha256 string, n_bytes long, error string")
