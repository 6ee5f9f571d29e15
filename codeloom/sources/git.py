"""Checkouts and change feeds from git (S1, S2, S5, S6), by the git program on the driver. Optional:
the engine itself starts from a checkout's path."""

from __future__ import annotations

import os
import shutil
import stat
import subprocess

from pyspark.sql import DataFrame, SparkSession

from codeloom.operators.changes import parse_status_lines


def _git(*args: str, cwd: str | None = None) -> str:
    return subprocess.run(["git", *args], cwd=cwd, check=True, capture_output=True, text=True).stdout


def clone(url: str, branch: str, folder: str) -> str:
    """Full single-branch clone into ``folder``; what is there is deleted first."""
    if os.path.exists(folder):
        shutil.rmtree(folder)
    os.makedirs(os.path.dirname(os.path.abspath(folder)), exist_ok=True)
    _git("clone", "--single-branch", "--branch", branch, "--", url, folder)
    return folder


def pull(folder: str) -> None:
    _git("pull", cwd=folder)


def head(folder: str) -> str:
    return _git("rev-parse", "HEAD", cwd=folder).strip()


def changed_since(spark: SparkSession, folder: str, commit: str) -> DataFrame:
    """Changes from ``commit`` to the head: status, path, old_path."""
    lines = [(x,) for x in _git("-c", "core.quotePath=false", "diff", "--name-status", commit, "HEAD", cwd=folder).splitlines()]
    return parse_status_lines(spark.createDataFrame(lines, "line string")).select("status", "path", "old_path")


def install_hook(folder: str, url: str) -> str:
    """A post-commit hook that asks the server at ``url`` for an incremental run in the background."""
    hooks = os.path.join(folder, ".git", "hooks")
    os.makedirs(hooks, exist_ok=True)
    path = os.path.join(hooks, "post-commit")
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'#!/bin/sh\ncurl -s -X POST "{url}" >/dev/null 2>&1 &\n')
    os.chmod(path, os.stat(path).st_mode | stat.S_IXUSR | stat.S_IXGRP | stat.S_IXOTH)
    return path
