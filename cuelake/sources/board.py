"""A folder through which a driver and the tasks of a running job talk: a mark to stop, and counts while tasks run."""

from __future__ import annotations

import json
import time
from collections import Counter

from pyspark import TaskContext


def open_folder(uri: str):
    """(file system, path) of a shared folder: local or mounted paths, and the schemes that Arrow knows (``s3a`` is its ``s3``)."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    if uri.startswith("/"):
        return LocalFileSystem(), uri
    return FileSystem.from_uri("s3:" + uri.removeprefix("s3a:") if uri.startswith("s3a:") else uri)


class RunBoard:
    """Stop and progress of one run, in a ``folder`` of its own that driver and executors share.

    The driver (any of its threads, or another process) calls ``stop`` and ``counts``; tasks ask ``stopped`` before each call and ``tell`` what
    they did. Both touch the folder at most every ``every_sec``. A task that runs again overwrites its own counts. It is pickled with the functions that use it.
    """

    def __init__(self, folder: str, every_sec: float = 0.5):
        self.folder, self.every_sec = folder.rstrip("/"), every_sec
        self._opened, self._looked, self._stopped, self._told, self._counts, self._task = None, 0.0, False, 0.0, Counter(), None

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "every_sec": self.every_sec}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _fs(self):
        if self._opened is None:
            self._opened = open_folder(self.folder)
        return self._opened

    def _write(self, name: str, data: bytes) -> None:
        fs, base = self._fs()
        folder, _, _ = f"{base}/{name}".rpartition("/")
        fs.create_dir(folder, recursive=True)
        fresh = f"{folder}/.{name.replace('/', '-')}-{time.time_ns()}"
        with fs.open_output_stream(fresh) as f:
            f.write(data)
        fs.move(fresh, f"{base}/{name}")  # a reader sees the old file or the new one

    def stop(self) -> None:
        """Ask all tasks to call no model any more."""
        self._write("stop", b"")

    def stopped(self) -> bool:
        now = time.monotonic()
        if not self._stopped and (not self._looked or now - self._looked >= self.every_sec):
            from pyarrow.fs import FileType

            fs, base = self._fs()
            self._looked, self._stopped = now, fs.get_file_info(f"{base}/stop").type != FileType.NotFound
        return self._stopped

    def tell(self, last: bool = False, **counts: int) -> None:
        """Add to this task's counts; ``last`` writes them at once."""
        task = TaskContext.get()
        key = (task.stageId(), task.partitionId(), task.taskAttemptId()) if task else (0, 0, 0)
        if key != self._task:  # Python workers are used again by other tasks
            self._task, self._counts, self._told = key, Counter(), 0.0
        self._counts.update(counts)
        now = time.monotonic()
        if last or now - self._told >= self.every_sec:
            self._write(f"progress/{key[0]}-{key[1]}.json", json.dumps(self._counts).encode())
            self._told = now

    def counts(self) -> dict[str, int]:
        """What all tasks told so far."""
        from pyarrow.fs import FileSelector

        fs, base = self._fs()
        total: Counter = Counter()
        for info in fs.get_file_info(FileSelector(f"{base}/progress", allow_not_found=True)):
            if info.base_name.endswith(".json") and not info.base_name.startswith("."):
                with fs.open_input_stream(info.path) as f:
                    total.update(json.loads(f.read() or b"{}"))
        return dict(total)


def eta_sec(counts: dict[str, int], total: int) -> float | None:
    """Seconds of work left by the mean of the answered ones, as if one after another; None before the first."""
    if not counts.get("ok"):
        return None
    return counts["elapsed_ms"] / counts["ok"] * (total - counts["ok"] - counts.get("failed", 0)) / 1000
