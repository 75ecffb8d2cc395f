"""A tracker that serves the ``conversations`` table: an issue a conversation, its first turn the summary, the others comments.

It stands in for a remote service in tests and queries. Options: ``table``, a folder or file of Parquet that every machine reaches, and ``upto``, how
many conversations have been opened so far.
"""

from __future__ import annotations

from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs

#: Bytes of decoded row groups that a process keeps; it holds one at least.
KEPT = 256 << 20


class _Table:
    """Turns by conversation. In memory are the keys with the row groups that hold their turns, and the row groups read last."""

    def __init__(self, path: str):
        files, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        data = ds.dataset(inner, filesystem=files, format="parquet")
        self._parts = [part for file in data.get_fragments() for part in file.split_by_row_group()]
        held = [np.unique(self._keys_of(part.to_table(columns=["conv_id"], use_threads=False))) for part in self._parts]
        self._at = np.concatenate([*held, np.zeros(0, np.int64)])
        self._of = np.repeat(np.arange(len(held)), [len(x) for x in held])
        order = np.argsort(self._at, kind="stable")
        self._at, self._of = self._at[order], self._of[order]
        self.keys = np.unique(self._at).tolist()
        self._read: OrderedDict[int, tuple[np.ndarray, pa.Table]] = OrderedDict()

    @staticmethod
    def _keys_of(table: pa.Table) -> np.ndarray:
        if table["conv_id"].null_count:
            raise ValueError("a turn without conversation")
        return table["conv_id"].to_numpy().astype(np.int64)

    def _load(self, i: int) -> tuple[np.ndarray, pa.Table]:
        """A row group in order of its keys."""
        table = self._parts[i].to_table(use_threads=False)
        keys = self._keys_of(table)
        order = np.lexsort((table["turn"].to_numpy(), keys))
        return keys[order], table.take(pa.array(order))

    def _part(self, i: int) -> tuple[np.ndarray, pa.Table]:
        if i in self._read:
            self._read.move_to_end(i)
        else:
            self._read[i] = self._load(i)
            while len(self._read) > 1 and sum(t.nbytes for _, t in self._read.values()) > KEPT:
                self._read.popitem(last=False)
        return self._read[i]

    def turns(self, keys: list[int]) -> dict[int, list[dict]]:
        wanted = np.array(keys, np.int64)
        begin, end = np.searchsorted(self._at, wanted, "left"), np.searchsorted(self._at, wanted, "right")
        asked: dict[int, list[int]] = {}
        for key, a, z in zip(keys, begin.tolist(), end.tolist()):
            for i in self._of[a:z].tolist():
                asked.setdefault(i, []).append(key)
        out: dict[int, list[dict]] = {k: [] for k in keys}
        for i in sorted(asked):
            at, table = self._part(i)
            for key in asked[i]:
                a = int(np.searchsorted(at, key, "left"))
                out[key] += table.slice(a, int(np.searchsorted(at, key, "right")) - a).to_pylist()
        return {k: sorted(v, key=lambda r: r["turn"]) for k, v in out.items()}


@lru_cache(4)
def _table(path: str) -> _Table:
    return _Table(path)


class Tracker:
    def __init__(self, options: dict[str, str]):
        self._data = _table(options["table"])
        self._keys = self._data.keys[: int(options["upto"])] if "upto" in options else self._data.keys

    def _turns(self, keys: list[int]) -> dict[int, list[dict]]:
        return self._data.turns(keys)

    @staticmethod
    def _issue(key: int, turns: list[dict]) -> dict:
        return {"key": f"CNV-{key}", "fields": {"summary": turns[0]["text"] if turns else "", "status": {"name": "Open"}, "reporter": {"displayName": turns[0]["role"] if turns else ""}}}

    def search(self, query: str, token: str | None, size: int) -> dict:
        at = int(token or 0)
        keys = self._keys[at : at + size]
        found = self._turns(keys)
        more = at + size < len(self._keys)
        return {"issues": [self._issue(k, found[k]) for k in keys], "isLast": not more} | ({"nextPageToken": str(at + size)} if more else {})

    def issue(self, key: str) -> dict | None:
        number = int(key.removeprefix("CNV-")) if key.removeprefix("CNV-").isdigit() else None
        return self._issue(number, self._turns([number])[number]) if number in self._keys else None

    def comments(self, key: str) -> list[dict]:
        number = int(key.removeprefix("CNV-"))
        return [{"author": {"displayName": r["role"]}, "created": "2024-01-01T00:00:00", "body": r["text"]} for r in self._turns([number])[number][1:]]
