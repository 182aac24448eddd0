"""Local git repositories as sources: clones, commit logs, scans of one or all repositories, single files.

Cloning and reading logs happen on the driver, a repository at a time; the files they yield are read by Spark.
"""

from __future__ import annotations

import os
import shutil
import subprocess
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.operators import tables as tb
from codelode.parse import registry as rg

from . import files as sf

COMMIT = "sha string, author string, author_email string, timestamp timestamp, message string, files_changed array<string>, additions int, deletions int"


class RepositoryError(RuntimeError):
    """A repository that can't be cloned, updated or read."""


def git(folder: str | None, *args: str) -> str:
    got = subprocess.run(["git", *(["-C", folder] if folder else []), *args], capture_output=True, text=True, errors="replace", env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})
    if got.returncode:
        raise RepositoryError(got.stderr.strip().splitlines()[-1] if got.stderr.strip() else f"git {args[0]} failed")
    return got.stdout


def is_repository(folder: str) -> bool:
    try:
        return os.path.isdir(folder) and os.path.realpath(git(folder, "rev-parse", "--show-toplevel").strip()) == os.path.realpath(folder)
    except RepositoryError:
        return False


def with_token(url: str, token: str | None) -> str:
    """The URL to fetch from; a token goes into https ones only."""
    return url.replace("https://", f"https://{token}@", 1) if token and url.startswith("https://") else url


def checkout(url: str, folder: str, branch: str | None = None, token: str | None = None, depth: int = 1) -> str:
    """The working tree of the repository: of a ``file://`` URL its own folder, else ``folder``, cloned or brought up to date.

    A folder that is no repository is cloned anew; a branch the clone lacks is fetched.
    """
    if url.startswith("file://") and not url.endswith(".git"):
        own = url.removeprefix("file://")
        if not is_repository(own):
            raise RepositoryError(f"{own} is no repository")
        return own
    source = with_token(url, token)
    if is_repository(folder):
        git(folder, "remote", "set-url", "origin", source)
        name = branch or git(folder, "rev-parse", "--abbrev-ref", "HEAD").strip()
        git(folder, "fetch", "-q", "--depth", str(depth), "origin", f"+refs/heads/{name}:refs/remotes/origin/{name}")
        git(folder, "checkout", "-q", "-B", name, f"refs/remotes/origin/{name}")
        return folder
    if os.path.exists(folder):
        shutil.rmtree(folder)
    os.makedirs(os.path.dirname(os.path.abspath(folder)), exist_ok=True)
    git(None, "clone", "-q", "--depth", str(depth), *(["--branch", branch] if branch else []), source, folder)
    return folder


def commits(spark: SparkSession, folder: str, branch: str | None = None, limit: int = 100, since: datetime | None = None) -> DataFrame:
    """Commits newest first, at most ``limit``, none older than ``since`` (naive times are UTC); an unknown branch reads HEAD."""
    name = branch or "HEAD"
    try:
        git(folder, "rev-parse", "-q", "--verify", f"{name}^{{commit}}")
    except RepositoryError:
        name = "HEAD"
    sep, end = "\x1f", "\x1e"
    when = [] if since is None else [f"--since={int((since if since.tzinfo else since.replace(tzinfo=timezone.utc)).timestamp())}"]
    out = git(folder, "log", name, f"-{limit}", *when, f"--pretty=format:{end}%H{sep}%an{sep}%ae{sep}%ct{sep}%B{sep}", "--numstat")
    rows = []
    for block in filter(None, out.split(end)):
        sha, author, email, ts, message, stats = block.split(sep)
        lines = [x.split("\t") for x in stats.strip().split("\n") if x.count("\t") == 2]
        added, gone = (sum(int(x[i]) for x in lines if x[i].isdigit()) for i in (0, 1))
        rows.append((sha, author, email, datetime.fromtimestamp(int(ts), timezone.utc), message.strip(), [x[2] for x in lines], added, gone))
    return spark.createDataFrame(rows, COMMIT)


def scan(spark: SparkSession, folder: str, repository_id: int, branch: str = "HEAD", suffixes: tuple[str, ...] = (".py",)) -> DataFrame:
    """The files of a working tree with the repository's id, the branch and the last commit that touched each."""
    last = sf.last_commit_per_path(commits(spark, folder, branch, 2**31 - 1))
    f = sf.walk(spark, folder, suffixes).withColumns({"repository_id": F.lit(repository_id).cast("long"), "branch": F.lit(branch)})
    return f.join(last.withColumnsRenamed({"sha": "last_commit", "timestamp": "last_commit_at"}), "path", "left")


def scan_all(spark: SparkSession, repositories: list[tuple[int, str]], root: str, suffixes: tuple[str, ...] = (".py",)) -> tuple[DataFrame | None, DataFrame]:
    """(files of all repositories that could be read, report): one that fails is a row with its error, the others go on.

    report: (repository_id, url, status, error).
    """
    frames, report = [], []
    for number, url in repositories:
        try:
            frames.append(scan(spark, checkout(url, os.path.join(root, str(number))), number, suffixes=suffixes))
            report.append((number, url, "success", None))
        except (RepositoryError, OSError) as e:
            report.append((number, url, "failed", str(e)))
    files = None
    for f in frames:
        files = f if files is None else files.unionByName(f)
    return files, spark.createDataFrame(report, "repository_id long, url string, status string, error string")


def sync_file(stored: DataFrame, folder: str, repository_id: int, path: str, branch: str = "HEAD") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files afterwards, entities, errors) after one file was read again: the row of (repository, path, branch) is put in
    place of the old one, and the file parsed."""
    spark = stored.sparkSession
    one = scan(spark, folder, repository_id, branch, (os.path.splitext(path)[1],)).filter(F.col("path") == path)
    row = one.select("repository_id", "path", "branch", "content_hash", "git_hash", F.col("size").cast("int").alias("size"), "language")
    after = tb.upsert(stored.select("repository_id", "path", "branch", "content_hash", "git_hash", "size", "language"), row, ["repository_id", "path", "branch"])
    key = F.xxhash64("repository_id", "path", "branch")
    file, content = one.select(key.alias("id"), "path"), one.select(key.alias("file_id"), "content")
    return after, rg.entities(file, content), rg.report(file, content)


def changed_since(commits_: DataFrame, since: datetime | None) -> DataFrame:
    """(changed_files): how many files the commits since the last sync touched; all of them if it never was synced."""
    c = commits_ if since is None else commits_.filter(F.col("timestamp") >= F.lit(since))
    return c.select(F.explode("files_changed").alias("path")).agg(F.count_distinct("path").alias("changed_files"))
