"""Git repositories as sources, through the git command.

A repository is cloned bare and with one branch only; its tree is listed without reading contents. Contents are read by
their object ids in tasks, from a folder of clones that all executors reach; only ids, paths and sizes go through the driver.
"""

from __future__ import annotations

import base64
import os
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparkgrove.config import Repo, is_scp_address
from sparkgrove.sources.corpora import SYMLINK

CHUNK_BYTES = 32 << 20


class GitError(RuntimeError):
    """The git command failed."""


@dataclass(frozen=True)
class Entry:
    mode: int
    oid: str
    size: int
    path: str


class GitSource:
    """A bare clone of a repository below a folder of clones."""

    def __init__(self, repo: Repo, folder: str, timeout: float = 300):
        self.repo, self.path, self.timeout = repo, Path(folder) / repo.name, timeout

    def _key_file(self, files: str) -> str | None:
        """The configured key's path; a key given as text is put into the folder ``files``, for one command."""
        if self.repo.ssh_key_path or not self.repo.ssh_key:
            return self.repo.ssh_key_path
        path = Path(files) / "key"
        path.touch(0o600)
        path.write_text(self.repo.ssh_key.strip() + "\n")
        return str(path)

    def _environment(self, files: str) -> dict[str, str]:
        """files: a private folder that goes after the command. Credentials go through the environment, never through arguments or the clone's configuration."""
        env = os.environ | {"GIT_TERMINAL_PROMPT": "0"}
        if key := self._key_file(files):
            env["GIT_SSH_COMMAND"] = f"ssh -i '{key}' -o IdentitiesOnly=yes" + ("" if self.repo.ssh_key_passphrase else " -o BatchMode=yes")
        if key and self.repo.ssh_key_passphrase:
            ask = Path(files) / "ask"
            ask.write_text("#!/bin/sh\nprintf '%s\\n' \"$SPARKGROVE_PASSPHRASE\"\n")
            ask.chmod(0o700)
            env |= {"SPARKGROVE_PASSPHRASE": self.repo.ssh_key_passphrase, "SSH_ASKPASS": str(ask), "SSH_ASKPASS_REQUIRE": "force", "DISPLAY": ":0"}
        if self.repo.auth_token and not is_scp_address(self.repo.url):
            basic = base64.b64encode(f"x-access-token:{self.repo.auth_token}".encode()).decode()
            env |= {"GIT_CONFIG_COUNT": "1", "GIT_CONFIG_KEY_0": "http.extraHeader", "GIT_CONFIG_VALUE_0": f"Authorization: Basic {basic}"}
        return env

    def _git(self, *args: str, given: bytes | None = None) -> bytes:
        with tempfile.TemporaryDirectory(prefix="sparkgrove-") as files:
            try:
                run = subprocess.run(["git", *args], input=given, capture_output=True, timeout=self.timeout, env=self._environment(files))
            except subprocess.TimeoutExpired as e:
                raise GitError("timed out") from e
        if run.returncode:
            raise GitError(run.stderr.decode("utf-8", "replace")[-500:])
        return run.stdout

    def clone_or_open(self) -> bool:
        """Whether the clone is new."""
        if (self.path / "HEAD").exists():
            return False
        self.path.parent.mkdir(parents=True, exist_ok=True)
        branch = ["--branch", self.repo.ref] if self.repo.ref else []
        self._git("clone", "--quiet", "--bare", "--single-branch", *branch, "--", self.repo.url, str(self.path))
        return True

    def ref(self) -> str:
        """The branch or tag that is indexed: the configured one, else the remote's default."""
        if self.repo.ref:
            return self.repo.ref
        head = (self.path / "HEAD").read_text().strip()
        return head.removeprefix("ref: refs/heads/") if head.startswith("ref: ") else "main"

    def commit(self) -> str:
        return self._git("-C", str(self.path), "rev-parse", f"{self.ref()}^{{commit}}").decode().strip()

    def fetch(self) -> str | None:
        """The new commit; None if there is none."""
        old = self.commit()
        self._git("-C", str(self.path), "fetch", "--quiet", "--force", "origin", f"{self.ref()}:{self.ref()}")
        return new if (new := self.commit()) != old else None

    def tree(self) -> list[Entry]:
        """Files of the tree, symlinks included, without their contents."""
        out = []
        for line in self._git("-C", str(self.path), "ls-tree", "-r", "-l", "-z", self.commit()).split(b"\0"):
            if line:
                about, path = line.split(b"\t", 1)
                mode, kind, oid, size = about.split()
                if kind == b"blob":
                    out.append(Entry(int(mode, 8), oid.decode(), int(size), path.decode("utf-8", "surrogateescape")))
        return out

    def token(self) -> str:
        """Fetches; the commit that is there then. While it stays nothing has changed."""
        if not self.clone_or_open():
            self.fetch()
        return self.commit()

    def manifest(self, spark: SparkSession, max_file_size: int = 1 << 20) -> DataFrame:
        """repo, path, oid of files up to the size; symlinks are left out."""
        rows = [(self.repo.name, e.path, e.oid) for e in self.tree() if e.size <= max_file_size and e.mode != SYMLINK]
        return spark.createDataFrame(rows, "repo string, path string, oid string")

    def files(self, spark: SparkSession, max_file_size: int = 1 << 20, keys: DataFrame | None = None) -> DataFrame:
        """repo, path, content, mode of files up to the size, of these keys (repo, path) only if given. Larger ones aren't read."""
        wanted, chunk, size = [], 0, 0
        for e in self.tree():
            if e.size <= max_file_size:
                wanted.append((self.repo.name, e.path, e.mode, e.oid, chunk))
                size += e.size
                if size > CHUNK_BYTES:
                    chunk, size = chunk + 1, 0
        entries = spark.createDataFrame(wanted, "repo string, path string, mode int, oid string, chunk int")
        if keys is not None:
            entries = entries.join(keys.select("repo", "path"), ["repo", "path"], "left_semi")
        return entries.repartition(chunk + 1, "chunk").mapInArrow(_contents(str(self.path)), "repo string, path string, content binary, mode int")


def _contents(clone: str):
    """Reads the objects named in each batch with one git command."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import subprocess

        import pyarrow as pa

        for batch in batches:
            oids = batch.column("oid").to_pylist()
            got = subprocess.run(["git", "-C", clone, "cat-file", "--batch"], input="".join(f"{x}\n" for x in oids).encode(), capture_output=True, check=True).stdout
            at, contents = 0, []
            for _ in oids:
                begin = got.index(b"\n", at) + 1
                end = begin + int(got[at : begin - 1].rsplit(b" ", 1)[1])
                contents.append(got[begin:end])
                at = end + 1
            yield pa.RecordBatch.from_arrays([batch.column("repo"), batch.column("path"), pa.array(contents, pa.binary()), batch.column("mode")], names=["repo", "path", "content", "mode"])

    return run
