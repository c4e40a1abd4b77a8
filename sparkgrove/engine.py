"""The search engine: search, streaming search, repos, status, health and refreshing."""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from threading import Event

from pyspark.sql import DataFrame, SparkSession

from sparkgrove.functions.globs import GlobError, glob_to_regex
from sparkgrove.operators import index, matching, shaping
from sparkgrove.operators.incremental import drop_orphans, prepare_repo
from sparkgrove.plans.planner import SearchPlan, effective_limit, plan
from sparkgrove.sources.corpora import with_text
from sparkgrove.sources.store import Store
from sparkgrove.streaming.refresh import Heartbeat


class ResultCache:
    """Keeps the results used last, for some time."""

    def __init__(self, entries: int = 1000, seconds: float = 300, clock: Callable[[], float] = time.monotonic):
        self.entries, self.seconds, self.clock = entries, seconds, clock
        self.kept: OrderedDict[tuple, tuple[float, str]] = OrderedDict()

    def get(self, key: tuple) -> str | None:
        if key not in self.kept:
            return None
        made, value = self.kept[key]
        if self.clock() - made >= self.seconds:
            del self.kept[key]
            return None
        self.kept.move_to_end(key)
        return value

    def put(self, key: tuple, value: str) -> None:
        self.kept[key] = (self.clock(), value)
        self.kept.move_to_end(key)
        while len(self.kept) > self.entries:
            self.kept.popitem(last=False)

    def clear(self) -> None:
        self.kept.clear()


def checked_glob(glob: str | None, lenient: bool = False) -> str | None:
    """The glob if it can be used. A bad one, or one with "..", is an error, or (lenient) no filter at all."""
    if not glob:
        return None
    try:
        if ".." in glob:
            raise GlobError('".." in a path pattern')
        glob_to_regex(glob)
        return glob
    except GlobError:
        if lenient:
            return None
        raise


def search_frames(files: DataFrame, postings: DataFrame | None, found: SearchPlan, limit: int, glob: str | None = None, repos: str | list[str] | None = None, cap: int = matching.LINE_CAP, context: int = shaping.CONTEXT, details: DataFrame | None = None) -> DataFrame:
    """One row per repo with matches: shaping.nested of all of them. With postings the candidates come from these."""
    files = matching.by_path(matching.by_repo(files, repos), glob)
    if postings is not None:
        files = index.candidate_files(files, matching.by_path(matching.by_repo(postings, repos), glob), found)
    texts = with_text(files)
    matched = matching.matching_lines(texts, found, cap)
    counted = shaping.file_matches(matched)
    shown = shaping.first_files(counted, limit)
    lines = shaping.context_lines(texts, matched.join(shown.select("repo", "path"), ["repo", "path"], "left_semi"), context)
    return shaping.nested(lines, shown, shaping.repo_totals(counted), details)


def as_json(row) -> dict:
    """A row of search_frames as the API gives it: ranges as pairs, absent address and ref left out."""
    files = [{"path": f.path, "match_count": f.match_count, "blocks": [{"lines": [{"line_number": x.line_number, "line": x.line, "match_ranges": [[r.start, r.end] for r in x.match_ranges]} for x in b.lines]} for b in f.blocks]} for f in row.files]
    own = {k: v for k, v in (("url", row.url), ("git_ref", row.git_ref)) if v is not None}
    return {"repo": row.repo, **own, "files": files, "total_file_count": row.total_file_count, "total_match_count": row.total_match_count}


class SearchEngine:
    """Answers searches over a store and keeps it up to date.

    sources gives the files (repo, path, content) of a repo; details has url, ref and resolved_ref of repos.
    """

    def __init__(self, spark: SparkSession, store: Store, details: DataFrame | None = None, server_limit: int = 10_000, cache: ResultCache | None = None, poll_seconds: float = 60, mode: str = "exact", lenient_globs: bool = False):
        self.spark, self.store, self.details, self.server_limit, self.mode, self.lenient = spark, store, details, server_limit, mode, lenient_globs
        self.cache = cache or ResultCache()
        self.heartbeat = Heartbeat(poll_seconds)
        self.states: dict[str, tuple[str, str | None]] = {}
        if store.current():
            store.validate()
            self.states = {r.repo: ("ready", None) for r in store.table("files").select("repo").distinct().collect()}

    # ---- searching

    def _frames(self, query: str, is_regex: bool, ignore_case: bool, repos, glob: str | None, limit: int, use_index: bool, version: str | None) -> DataFrame:
        found = plan(query, is_regex, ignore_case, self.mode)
        postings = self.store.table("postings", version) if use_index or self.mode == "strict" else None
        return search_frames(self.store.table("files", version), postings, found, limit, checked_glob(glob, self.lenient), repos, details=self.details)

    def search(self, query: str, is_regex: bool = False, ignore_case: bool = False, repos: str | None = None, files: str | None = None, max_results: int = 0, use_index: bool = True) -> dict:
        """All repos' results with totals. What has results is kept in the cache."""
        version = self.store.current()
        key = (version, query, is_regex, ignore_case, repos, files, max_results)
        if (kept := self.cache.get(key)) is not None:
            return json.loads(kept)
        began = time.perf_counter()
        limit = effective_limit(max_results, self.server_limit)
        rows = self._frames(query, is_regex, ignore_case, repos, files, limit, use_index, version).orderBy("repo").collect()
        results = [as_json(r) for r in rows if r.files]
        out = {
            "results": results, "duration_ms": (time.perf_counter() - began) * 1000, "total_files": sum(r["total_file_count"] for r in results),
            "total_matches": sum(r["total_match_count"] for r in results), "truncated": any(r["total_file_count"] > len(r["files"]) for r in results),
        }
        if results:
            self.cache.put(key, json.dumps(out))
        return out

    def search_stream(self, query: str, is_regex: bool = False, ignore_case: bool = False, repos: str | None = None, files: str | None = None, max_results: int = 0) -> Iterator[tuple[str, dict]]:
        """("result", a repo's results) one by one, then ("done", totals). Nothing is cached."""
        began = time.perf_counter()
        frames = self._frames(query, is_regex, ignore_case, repos, files, effective_limit(max_results, self.server_limit), True, self.store.current())
        total = 0
        for row in frames.where("total_file_count > 0").orderBy("repo").toLocalIterator():
            total += row.total_file_count
            yield "result", as_json(row)
        yield "done", {"duration_ms": (time.perf_counter() - began) * 1000, "total_files": total}

    # ---- about the index

    def repos(self) -> DataFrame:
        return index.repo_info(self.store.table("files"), self.store.table("postings"))

    def status(self) -> DataFrame:
        rows = [(r, s, e) for r, (s, e) in sorted(self.states.items())]
        return shaping.sanitized(self.spark.createDataFrame(rows, "repo string, status string, error string"))

    def health(self) -> dict:
        if not self.store.current():
            return {"status": "no_repos", "repos_indexed": 0, "total_docs": 0, "watcher_status": self.heartbeat.status()}
        return shaping.health(self.repos()).first().asDict() | {"watcher_status": self.heartbeat.status()}

    # ---- keeping up to date

    def cycle(self, sources: dict[str, Callable[[], DataFrame] | object], workers: int = 4, seconds: float = 300, max_file_size: int = 1 << 20, excludes: list[str] | None = None) -> bool:
        """Write a layer for each repo that changed, some at a time, and put those that were written whole in force together.

        sources: see incremental.prepare_repo. A repo that fails or takes longer than ``seconds`` keeps what it had and
        doesn't hold up the others. Repos that aren't among the sources go. Returns whether a new version is in force.
        """
        started: dict[str, float] = {}

        def prepare(repo: str):
            started[repo] = time.monotonic()
            self.spark.addTag(f"load-{repo}")
            try:
                return prepare_repo(self.store, repo, sources[repo], max_file_size, excludes)
            finally:
                self.spark.removeTag(f"load-{repo}")

        pool = ThreadPoolExecutor(workers)
        waiting = {pool.submit(prepare, repo): repo for repo in sources}
        self.states |= {repo: ("indexing", None) for repo in sources}
        written, tokens = [], {}
        while waiting:
            done, _ = wait(waiting, timeout=0.1, return_when=FIRST_COMPLETED)
            for job in done:
                repo = waiting.pop(job)
                try:
                    layer, token = job.result()
                except Exception as e:
                    self.states[repo] = ("failed", str(e))
                    continue
                self.states[repo] = ("ready", None)
                written += [layer] if layer else []
                tokens |= {repo: token} if token else {}
            for job, repo in list(waiting.items()):
                if repo in started and time.monotonic() - started[repo] > seconds:
                    self.spark.interruptTag(f"load-{repo}")
                    del waiting[job]
                    self.states[repo] = ("failed", "timed out")
        pool.shutdown(wait=False, cancel_futures=True)
        for repo in set(self.states) - set(sources):
            del self.states[repo]
        changed = bool(written)
        if written or self.store.current() and any(self.store.tokens().get(k) != v for k, v in tokens.items()):
            self.store.append(written, tokens)
        changed |= drop_orphans(self.store, list(sources))
        self.cache.clear()
        self.heartbeat.beat()
        return changed

    def watch(self, sources: dict, interval: float, cycles: int | None = None, stop: Event | None = None, **how) -> int:
        """Run cycles with ``interval`` seconds between, until stop is set or there have been so many; how many changed something."""
        stop, changes, k = stop or Event(), 0, 0
        while cycles is None or k < cycles:
            changes, k = changes + self.cycle(sources, **how), k + 1
            if k == cycles or stop.wait(interval):
                break
        return changes
