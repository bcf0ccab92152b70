"""Output trees that are put in two phases: all files side by side, the playlist last.

A master playlist says that a tree is whole, so it is put only after everything else is there;
the first error of a tree cancels what is left of it, and what had been put of it is removed
again. The program that makes a tree and the uploads are one step of one task, as its files lie
on that task's machine; nothing else reads them. Putting is repeatable: keys follow from the
content, so a task that is run again puts the same objects once more.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed

import pandas as pd
from pyspark.sql import DataFrame

#: Uploads of a tree at a time; characters of an error that are kept; the file that ends a tree.
CONCURRENCY, TAIL, LAST = 8, 2000, "master.m3u8"

Put = Callable[[str, str, str], None]


def kind_of(name: str) -> str:
    """`keys.content_type` of one name."""
    from mediacat.functions import keys

    return next((kind for suffix, kind in keys.CONTENT_TYPES if name.endswith(suffix)), keys.OTHER_CONTENT)


def _files(folder: str) -> list[str]:
    found = [os.path.relpath(os.path.join(at, f), folder) for at, _, names in os.walk(folder) for f in names]
    return sorted(f.replace(os.sep, "/") for f in found)


def put_tree(folder: str, prefix: str, put: Put, remove: Callable[[str], None] | None = None, concurrency: int = CONCURRENCY) -> list[str]:
    """Paths of a tree's files, in order, once all are put; raises the first error of a file.

    put(path, key, content type) is called from threads, `remove(key)` for what had been put before the error.
    A tree without its last file is an error, and nothing of it is put.
    """
    names = _files(folder)
    if LAST not in names:
        raise FileNotFoundError(f"{LAST} is not there")
    done: list[str] = []
    send = lambda name: put(os.path.join(folder, name), prefix + name, kind_of(name))
    try:
        with ThreadPoolExecutor(max(1, concurrency)) as pool:
            asked = {pool.submit(send, n): n for n in names if n != LAST}
            try:
                for one in as_completed(asked):
                    one.result()
                    done.append(asked[one])
            except BaseException:
                for one in asked:  # those under way end by themselves
                    one.cancel()
                pool.shutdown(wait=True)
                done = [n for one, n in asked.items() if one.done() and not one.cancelled() and one.exception() is None]
                raise
        send(LAST)
    except BaseException:
        for name in done if remove else ():
            try:
                remove(prefix + name)
            except Exception:  # noqa: BLE001, S112 - the error that led here is the one to tell
                continue
        raise
    return names


def encoded(contents: DataFrame, make: Callable[[str, str, str], None], put: Put, work: str, remove: Callable[[str], None] | None = None, concurrency: int = CONCURRENCY, tasks: int = 200) -> DataFrame:
    """content_id, rel_path, error: new outputs of contents, as `Pass.videos` asks for.

    make(source_key, content_id, folder) writes a tree into an empty folder, which is made under
    `work` and removed afterwards; `work` is a disk of the machine that runs the task, or shared. A tree
    that is made and put whole gives a row for each file, another one a row with its error.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, cid in zip(pdf["source_key"], pdf["content_id"], strict=True):
                folder = os.path.join(work, f"tree-{uuid.uuid4().hex}")
                try:
                    os.makedirs(folder)
                    make(key, cid, folder)
                    rows = [(cid, name, None) for name in put_tree(folder, f"by-id/{cid}/", put, remove, concurrency)]
                except Exception as e:  # noqa: BLE001 - a tree that fails is a row
                    rows = [(cid, None, str(e)[-TAIL:] or type(e).__name__)]
                finally:
                    shutil.rmtree(folder, ignore_errors=True)
                yield pd.DataFrame(rows, columns=["content_id", "rel_path", "error"])

    return contents.select("source_key", "content_id").repartition(tasks, "content_id").mapInPandas(each, "content_id string, rel_path string, error string")
