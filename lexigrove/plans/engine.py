"""A whole build, and builds as jobs."""

from __future__ import annotations

import json
import logging
import re
import threading
import time
import traceback
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import IndexConfig
from ..functions.symbols import TERMINATOR
from ..operators import allocate as groups_of
from ..operators import prefixes as prefixes_of
from ..operators import suffixes as suffixes_of
from ..operators import tree
from ..sources.corpus import boundaries, superstring, write_index
from ..storage import cut_path, drop, new_folder, prepare

log = logging.getLogger("lexigrove")


@dataclass
class SuffixIndex:
    """The tables of one build; all but config lazy or written."""

    config: IndexConfig
    corpus: DataFrame
    prefixes: DataFrame
    groups: DataFrame
    group_count: int
    suffixes: DataFrame
    elements: DataFrame
    nodes: DataFrame
    edges: DataFrame
    boundaries: DataFrame
    stats: DataFrame
    uncovered: DataFrame
    #: Folders of the tables that the others are read from.
    written: list[str] = field(default_factory=list)

    @classmethod
    def build(cls, corpus: DataFrame, config: IndexConfig | None = None) -> SuffixIndex:
        config = config or IndexConfig()
        prepare(corpus.sparkSession)
        written: list[str] = []

        def cut(df: DataFrame) -> DataFrame:
            df, path = cut_path(df)
            written.append(path)
            return df

        corpus = cut(corpus)
        size = corpus.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
        limit = config.resolved_limit(size)
        joined = config.boundary == "superstring"
        if config.complete and not joined and not corpus.where(F.contains("text", F.lit(TERMINATOR))).isEmpty():
            raise ValueError("a text has the terminator in it, which complete needs for texts' ends")
        found, width = prefixes_of.discover(corpus, limit, config.max_window, config.window, config.step, config.exclude_newlines, superstring=joined, complete=config.complete and not joined)
        found = cut(found)
        text = superstring(corpus) if joined else corpus
        grouped, group_count = groups_of.allocated(found, limit, config.num_workers)
        written.append(new_folder(corpus.sparkSession))
        pieces = suffixes_of.index_elements(text, found, config.boundary, config.complete, config.max_positions, folder=written[-1])
        return cls(
            config, corpus, found, grouped, group_count, tree.suffixes(pieces), pieces, tree.nodes(pieces, text), tree.edges(pieces, text),
            boundaries(corpus), tree.index_stats(pieces, found, limit, width), prefixes_of.uncovered(corpus, found), written,
        )

    @staticmethod
    def trees(corpus: DataFrame) -> DataFrame:
        """(prefix, leaves, max_depth) of the sub-trees that build() makes of a corpus without options. Beyond a block they are made and measured in the tasks, not written."""
        prepare(corpus.sparkSession)
        config = IndexConfig()
        limit = config.resolved_limit(corpus.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0])
        found = cut_path(prefixes_of.discover(corpus, limit, config.max_window, config.window, config.step, config.exclude_newlines)[0])[0]
        return suffixes_of.tree_stats(corpus, found)

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in ("prefixes", "groups", "suffixes", "nodes", "edges", "boundaries", "stats")}

    def write(self, path: str, kind: str = "parquet") -> None:
        write_index(self.tables(), path, kind)


def _json(value: dict) -> str:
    def camel(x: object) -> object:
        if isinstance(x, dict):
            return {re.sub("_(.)", lambda m: m.group(1).upper(), k): camel(v) for k, v in x.items()}
        return [camel(v) for v in x] if isinstance(x, list) else x

    return json.dumps(camel(value), ensure_ascii=False)


class NotFound(KeyError):
    """No such job, or no such group."""


class NotReady(RuntimeError):
    """The job still runs, or has failed."""


class Jobs:
    """Builds by job id, in threads of the driver."""

    def __init__(self) -> None:
        self._jobs: dict[str, dict] = {}
        self._lock = threading.Lock()

    def submit(self, corpus: DataFrame, num_workers: int = 4, memory_limit: int | None = None, tail_length: int | None = None, **options) -> str:
        config = IndexConfig(num_workers=num_workers, memory_limit=memory_limit or None, tail_length=tail_length or None, **options)
        key = str(uuid.uuid4())
        job = {"status": "running", "progress": 0, "start": time.time()}
        with self._lock:
            self._jobs[key] = job

        def run() -> None:
            try:
                result = SuffixIndex.build(corpus, config)
                end = time.time()
                done = {"status": "completed", "result": result, "stats": result.stats.first().asDict(), "group_count": result.group_count}
            except Exception as e:  # a job's failure is its result
                end, done = time.time(), {"status": "failed", "error": str(e), "stack": traceback.format_exc()}
            job.update(done | {"end": end, "duration": end - job["start"]})
            log.info("job %s %s after %.1f s", key, done["status"], job["duration"])
            job.pop("progress", None)

        job["thread"] = threading.Thread(target=run, daemon=True)
        job["thread"].start()
        log.info("job %s started", key)
        return key

    def _job(self, key: str) -> dict:
        with self._lock:
            if key not in self._jobs:
                raise NotFound(key)
            return self._jobs[key]

    def _result(self, key: str) -> SuffixIndex:
        job = self._job(key)
        if job["status"] != "completed":
            raise NotReady(job["status"])
        return job["result"]

    def status(self, key: str) -> dict:
        job = self._job(key)
        return {k: job[k] for k in ("status", "progress", "stats", "group_count", "duration", "error") if k in job}

    def wait(self, key: str, timeout: float | None = None) -> dict:
        self._job(key)["thread"].join(timeout)
        return self.status(key)

    def groups(self, key: str) -> DataFrame:
        """All groups in order, those without a prefix too."""
        result = self._result(key)
        return groups_of.group_totals(result.groups, result.group_count, result.config.num_workers).orderBy("group_id")

    def group(self, key: str, group_id: int) -> dict[str, DataFrame]:
        """The prefixes of a group and their sub-trees; none for a group without prefixes."""
        result = self._result(key)
        if not 0 <= group_id < result.group_count:
            raise NotFound(group_id)
        mine = result.groups.where(F.col("group_id") == group_id)
        wanted = mine.select("prefix")
        return {"prefixes": mine} | {n: getattr(result, n).join(wanted, "prefix", "left_semi") for n in ("suffixes", "nodes", "edges")}

    def summary(self, key: str) -> dict:
        job, result = self._job(key), self._result(key)
        return {"stats": job["stats"], "group_count": job["group_count"], "duration": job["duration"], "boundaries": result.boundaries}

    def page(self, key: str, index: int, size: int = 1) -> DataFrame:
        """size groups from the one with this display index on; an index out of range is taken for the nearest there is."""
        first = min(max(1, index), max(1, self._result(key).group_count))
        return self.groups(key).where(F.col("display_index").between(first, first + size - 1))

    def json(self, key: str, what: str = "summary", group_id: int | None = None) -> str:
        """status, summary, groups or group as JSON, in camel case; a group with its sub-trees, which come to the driver."""
        if what == "status":
            return _json(self.status(key))
        if what == "groups":
            rows = [r.asDict() for r in self.groups(key).drop("round_id").collect()]
            return _json({"group_count": len(rows), "groups": rows})
        if what == "summary":
            found = self.summary(key)
            return _json(found | {"boundaries": [r.asDict() for r in found["boundaries"].orderBy("index").collect()]})
        if what != "group" or group_id is None:
            raise ValueError(f"no such answer: {what}")
        return _json({"group_id": group_id} | {n: [r.asDict() for r in df.collect()] for n, df in self.group(key, group_id).items()})

    def delete(self, key: str) -> None:
        """Forgets the job and deletes its tables; a build that runs isn't stopped."""
        with self._lock:
            job = self._jobs.pop(key, None)
        if job is None:
            raise NotFound(key)
        log.info("job %s deleted", key)
        if "result" in job:
            for path in job["result"].written:
                drop(job["result"].corpus.sparkSession, path)
