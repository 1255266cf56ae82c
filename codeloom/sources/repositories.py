"""Git repositories: mirrors, references, checkouts of one commit, changes and metadata."""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import os
import re
import shutil
import subprocess
import tempfile
import time
from collections.abc import Iterator


def _git(*args: str, cwd: str | None = None) -> str:
    done = subprocess.run(["git", *args], cwd=cwd, capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed: {done.stderr.strip()[-500:]}")
    return done.stdout.strip()


def strip_credentials(url: str) -> str:
    return re.sub(r"^(https?://|git@|ssh://)[^@]+@(.+)", r"\1\2", url)


class Volume:
    """Mirrors below ``root``, one for each url, updated under a lock that processes share."""

    def __init__(self, root: str):
        self.root = root
        os.makedirs(os.path.join(root, "workspaces"), exist_ok=True)

    def mirror_path(self, url: str) -> str:
        return os.path.join(self.root, hashlib.sha256(url.encode()).hexdigest() + ".git")

    def update(self, url: str) -> str:
        """Clone the repository's mirror, or fetch into it; its path."""
        path = self.mirror_path(url)
        with open(path + ".lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            if os.path.isdir(path):
                _git("fetch", "--all", "--prune", "--quiet", cwd=path)
            else:
                fresh = f"{path}.{os.getpid()}.tmp"
                shutil.rmtree(fresh, ignore_errors=True)
                _git("clone", "--mirror", "--quiet", url, fresh)
                os.rename(fresh, path)
        return path

    def head(self, url: str, branch: str = "main") -> str:
        """The commit of a branch or tag; ``ValueError`` if there is neither."""
        path = self.mirror_path(url)
        for ref in (branch, f"refs/heads/{branch}", f"refs/tags/{branch}"):
            with contextlib.suppress(RuntimeError):
                return _git("rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}", cwd=path)
        raise ValueError(f"no branch or tag {branch!r}")

    @contextlib.contextmanager
    def checkout(self, url: str, commit: str) -> Iterator[str]:
        """A folder with the files of one commit, removed afterwards in any case."""
        folder = tempfile.mkdtemp(dir=os.path.join(self.root, "workspaces"))
        path = self.mirror_path(url)
        try:
            _git("worktree", "add", "--detach", "--force", "--quiet", folder, commit, cwd=path)
            yield folder
        finally:
            shutil.rmtree(folder, ignore_errors=True)
            with contextlib.suppress(RuntimeError):
                _git("worktree", "prune", cwd=path)

    def remove_orphans(self, max_age: float = 3600) -> list[str]:
        """Remove workspaces older than ``max_age`` seconds, which a killed process left."""
        gone = []
        base = os.path.join(self.root, "workspaces")
        for name in sorted(os.listdir(base)):
            path = os.path.join(base, name)
            if time.time() - os.path.getmtime(path) > max_age:
                shutil.rmtree(path, ignore_errors=True)
                gone.append(path)
        return gone

    def changed_files(self, url: str, since: str | None, until: str = "HEAD") -> list[str]:
        """Paths that differ between two commits; none if ``since`` is empty or unknown."""
        if not since:
            return []
        try:
            return _git("diff", "--name-only", since, until, cwd=self.mirror_path(url)).splitlines()
        except RuntimeError:
            return []


def repository_info(path: str) -> dict[str, str]:
    """``id, url, name, commit, branch`` of a local folder; a folder without Git has its path for a url, the MD5 of it for an id, and ``unknown`` for the rest."""
    info = {"url": os.path.abspath(path), "commit": "unknown", "branch": "unknown"}
    for key, args in (("url", ("config", "--get", "remote.origin.url")), ("commit", ("rev-parse", "HEAD")), ("branch", ("rev-parse", "--abbrev-ref", "HEAD"))):
        with contextlib.suppress(RuntimeError):
            info[key] = strip_credentials(_git(*args, cwd=path)) or info[key]
    return info | {"id": hashlib.md5(info["url"].encode()).hexdigest(), "name": re.sub(r"\.git$", "", info["url"].rstrip("/").rpartition("/")[2])}
