"""Databases that can hold a catalog: SQLite, and DuckDB files in one process. Each gives connections that take SQLite's SQL."""

from __future__ import annotations

import importlib.util
import os
import re
import sqlite3
import threading

#: Locks of DuckDB files by path: there, a transaction that began later could fail at its commit.
_LOCKS: dict[str, threading.RLock] = {}


class Sqlite:
    name = "sqlite"
    untyped = ""

    def __init__(self, path: str):
        self.path = path

    def connect(self) -> sqlite3.Connection:
        con = sqlite3.connect(self.path, timeout=30, isolation_level=None)
        con.row_factory = sqlite3.Row
        return con

    def prepare(self, con) -> None:
        con.execute("PRAGMA journal_mode = WAL")


class Row(tuple):
    """A row by position or by name, as SQLite's."""

    def __new__(cls, values, names: list[str]):
        row = super().__new__(cls, values)
        row.names = names
        return row

    def keys(self) -> list[str]:
        return self.names

    def __getitem__(self, key):
        return super().__getitem__(self.names.index(key) if isinstance(key, str) else key)


class _Result:
    def __init__(self, rows: list[tuple], names: list[str], count: int):
        self.rowcount = count
        self._rows = iter([Row(r, names) for r in rows])

    def fetchone(self) -> Row | None:
        return next(self._rows, None)

    def fetchall(self) -> list[Row]:
        return list(self._rows)

    def __iter__(self):
        return self._rows


class DuckdbConnection:
    def __init__(self, con, lock: threading.RLock):
        self.con, self.lock, self.held = con, lock, False

    def execute(self, sql: str, args=()) -> _Result:
        text = sql.strip()
        if text == "BEGIN IMMEDIATE":
            self.lock.acquire()
            self.held = True
            text = "BEGIN TRANSACTION"
        try:
            done = self.con.execute(self._translated(text), list(args))
        finally:
            if text in ("COMMIT", "ROLLBACK") and self.held:
                self.held = False
                self.lock.release()
        names = [c[0] for c in done.description or []]
        rows = done.fetchall() if names else []
        changes = re.match(r"(INSERT|UPDATE|DELETE)\b", text) and len(names) == 1 and rows
        return _Result([] if changes else rows, names, rows[0][0] if changes else -1)

    def executemany(self, sql: str, rows: list[tuple]) -> None:
        self.con.executemany(self._translated(sql), [list(r) for r in rows])

    def _translated(self, sql: str) -> str:
        if sql.startswith(("CREATE TABLE", "ALTER TABLE")):
            return re.sub(r"\bINTEGER\b", "BIGINT", sql)
        return re.sub(r"\bIS \?", "IS NOT DISTINCT FROM ?", sql)


class Duckdb:
    name = "duckdb"
    untyped = " VARCHAR"

    def __init__(self, path: str):
        import duckdb

        self.path = path
        self.root = duckdb.connect(path)

    def connect(self) -> DuckdbConnection:
        return DuckdbConnection(self.root.cursor(), _LOCKS.setdefault(os.path.abspath(self.path), threading.RLock()))

    def prepare(self, con) -> None:
        pass


def backend_of(path: str):
    """The database by a prefix (``sqlite:``, ``duckdb:``), the file's first bytes, or its ending; SQLite where nothing tells."""
    if re.match(r"postgres(ql)?:|.*\b(host|dbname)=", path):
        raise NotImplementedError("catalogs in PostgreSQL are not supported" + ("" if importlib.util.find_spec("psycopg2") else ", and its driver is not installed"))
    kind, _, rest = path.partition(":")
    if kind in ("sqlite", "duckdb") and rest:
        return Duckdb(rest) if kind == "duckdb" else Sqlite(rest)
    head = b""
    if os.path.isfile(path):
        with open(path, "rb") as f:
            head = f.read(16)
    if head[8:12] == b"DUCK" or not head and path.lower().endswith((".duckdb", ".ddb")):
        return Duckdb(path)
    return Sqlite(path)
