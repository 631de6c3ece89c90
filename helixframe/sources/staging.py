"""How the sinks publish files: tasks write under ``_temporary``, and only what the job commits is moved into place.

A failed or speculative attempt leaves its file under ``_temporary/<job>``, which readers don't
list and which goes when the job ends, whether it is committed or aborted.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql.datasource import WriterCommitMessage

from helixframe.sources import files


@dataclass
class Part(WriterCommitMessage):
    """Names of the files of one task's successful attempt."""

    names: list[str]
    rows: int


class Staging:
    def __init__(self, path: str, overwrite: bool, suffixes: tuple[str, ...]):
        """suffixes: of the files that an overwrite replaces."""
        self.path, self.overwrite, self.suffixes, self.job = path.rstrip("/"), overwrite, suffixes, uuid.uuid4().hex[:12]
        self.folder = f"{self.path}/_temporary/{self.job}"

    def name(self, suffix: str) -> str:
        """A new name for this attempt."""
        task = TaskContext.get()
        return f"part-{task.partitionId() if task else 0:06d}-{self.job}-{uuid.uuid4().hex[:8]}{suffix}"

    def commit(self, messages: list[Part | None]) -> None:
        """Moves what was committed into place. An overwrite first moves the old files aside, and
        back if the new ones can't all be moved."""
        old = [n for n in files.names(self.path) if n.endswith(self.suffixes)] if self.overwrite else []
        new = [n for m in messages if m for n in m.names]
        moved: list[tuple[str, str]] = []
        try:
            for n in old:
                files.move(f"{self.path}/{n}", f"{self.folder}/old/{n}")
                moved.append((f"{self.path}/{n}", f"{self.folder}/old/{n}"))
            for n in new:
                files.move(f"{self.folder}/{n}", f"{self.path}/{n}")
                moved.append((f"{self.folder}/{n}", f"{self.path}/{n}"))
        except BaseException:
            for was, now in reversed(moved):
                files.move(now, was)
            raise
        self.abort()

    def abort(self, messages: list[Part | None] | None = None) -> None:
        """Removes all that attempts of this job have left, whether they told of it or not."""
        files.remove_folder(self.folder)
        if not files.names(f"{self.path}/_temporary", True):
            files.remove_folder(f"{self.path}/_temporary")
