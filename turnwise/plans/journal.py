"""One durable record per paid call, so that neither a retried task nor a later run pays for it again."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

Ask = Callable[[str, str], dict]


class Journal:
    """Records by key below ``folder``: a path or URI of a file system that all executors share.

    A record is written under a name of its own and then moved to the key's place, so it is there whole or not at all.
    """

    def __init__(self, folder: str):
        self.folder = folder
        self._files = None

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "_files": None}

    def _at(self, key: str):
        from pyarrow import fs

        if self._files is None:
            self._files = fs.FileSystem.from_uri(self.folder)
        files, root = self._files
        name = hashlib.sha256(key.encode()).hexdigest()
        return files, f"{root.rstrip('/')}/{name[:2]}", name

    def get(self, key: str) -> dict | None:
        files, folder, name = self._at(key)
        try:
            with files.open_input_stream(f"{folder}/{name}.json") as file:
                got = json.loads(file.read())
        except FileNotFoundError:
            return None
        return got["record"] if got["key"] == key else None

    def put(self, key: str, record: dict) -> None:
        files, folder, name = self._at(key)
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(own := f"{folder}/.{uuid.uuid4().hex}") as file:
            file.write(json.dumps({"key": key, "record": record}).encode())
        files.move(own, f"{folder}/{name}.json")


def recorded(ask: Ask, journal: Journal) -> Ask:
    """``ask``, but for successes that are in the journal already; new ones go there before they are handed on."""

    def call(path: str, category: str) -> dict:
        got = journal.get(path)
        if got is None:
            got = ask(path, category)
            if got.get("success"):
                journal.put(path, got)
        return got

    return call
