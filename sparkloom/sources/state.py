"""Durable state of connectors: fetch buffer, push queue, claims and job references (SQLite on the driver)."""

from __future__ import annotations

import json
import sqlite3
import time
from collections.abc import Iterable

# How long events and claims live, in seconds.
EVENT_TTL = 7 * 24 * 3600
CLAIM_TTL = 10 * 60

_TABLES = """
CREATE TABLE IF NOT EXISTS buffer (target TEXT, row TEXT);
CREATE TABLE IF NOT EXISTS queue (target TEXT, rowid INTEGER, change TEXT, snapshot INTEGER, at REAL, claim TEXT, claimed REAL, tries INTEGER DEFAULT 0,
    PRIMARY KEY (target, rowid, change));
CREATE TABLE IF NOT EXISTS dead (target TEXT, rowid INTEGER, change TEXT, snapshot INTEGER, reason TEXT);
CREATE TABLE IF NOT EXISTS jobs (target TEXT, batch TEXT, ref TEXT, PRIMARY KEY (target, batch));
CREATE TABLE IF NOT EXISTS fetches (target TEXT PRIMARY KEY, claim TEXT, page TEXT, done INTEGER);
CREATE TABLE IF NOT EXISTS tokens (name TEXT PRIMARY KEY, value TEXT, until REAL);
"""


class State:
    def __init__(self, path: str = ":memory:"):
        self.db = sqlite3.connect(path, check_same_thread=False)
        self.db.executescript(_TABLES)

    # -- fetch buffer

    def buffer(self, target: str, rows: Iterable[dict]) -> None:
        with self.db:
            self.db.executemany("INSERT INTO buffer VALUES (?, ?)", [(target, json.dumps(r, default=str)) for r in rows])

    def buffered(self, target: str) -> list[dict]:
        return [json.loads(r) for (r,) in self.db.execute("SELECT row FROM buffer WHERE target = ? ORDER BY rowid", (target,))]

    def clear_buffer(self, target: str) -> None:
        with self.db:
            self.db.execute("DELETE FROM buffer WHERE target = ?", (target,))
            self.db.execute("DELETE FROM fetches WHERE target = ?", (target,))

    def fetch_of(self, target: str) -> tuple[str, str | None, bool] | None:
        """(claim, next page as JSON, finished) of a fetch whose rows no commit has taken yet."""
        found = self.db.execute("SELECT claim, page, done FROM fetches WHERE target = ?", (target,)).fetchone()
        return (found[0], found[1], bool(found[2])) if found else None

    def keep_page(self, target: str, claim: str, rows: Iterable[dict], page: str | None, done: bool) -> None:
        """A page's rows and where to go on, in one transaction: a crash comes before both or after both."""
        with self.db:
            self.db.executemany("INSERT INTO buffer VALUES (?, ?)", [(target, json.dumps(r, default=str)) for r in rows])
            self.db.execute("INSERT OR REPLACE INTO fetches VALUES (?, ?, ?, ?)", (target, claim, page, done))

    # -- push queue

    def enqueue(self, target: str, events: Iterable[tuple[int, str, int]], replace: bool = False) -> None:
        """(rowid, change, snapshot); a newer event of the same row and change takes the older one's place."""
        with self.db:
            if replace:
                self.db.execute("DELETE FROM queue WHERE target = ?", (target,))
            self.db.executemany("INSERT OR REPLACE INTO queue (target, rowid, change, snapshot, at) VALUES (?, ?, ?, ?, ?)", [(target, r, c, s, time.time()) for r, c, s in events])

    def claim(self, target: str, n: int, claim: str, now: float | None = None) -> list[tuple[int, str, int]]:
        """Up to n events that nobody holds, in order of snapshot and row."""
        now = time.time() if now is None else now
        with self.db:
            self.db.execute("DELETE FROM queue WHERE target = ? AND at < ?", (target, now - EVENT_TTL))
            found = self.db.execute(
                "SELECT rowid, change, snapshot FROM queue WHERE target = ? AND (claim IS NULL OR claimed < ?) ORDER BY snapshot, rowid, change LIMIT ?", (target, now - CLAIM_TTL, n)
            ).fetchall()
            self.db.executemany("UPDATE queue SET claim = ?, claimed = ? WHERE target = ? AND rowid = ? AND change = ?", [(claim, now, target, r, c) for r, c, _ in found])
        return found

    def heartbeat(self, claim: str) -> None:
        with self.db:
            self.db.execute("UPDATE queue SET claimed = ? WHERE claim = ?", (time.time(), claim))

    def ack(self, target: str, events: Iterable[tuple[int, str]]) -> None:
        with self.db:
            self.db.executemany("DELETE FROM queue WHERE target = ? AND rowid = ? AND change = ?", [(target, r, c) for r, c in events])

    def nack(self, target: str, events: Iterable[tuple[int, str]]) -> None:
        with self.db:
            self.db.executemany("UPDATE queue SET claim = NULL, claimed = NULL, tries = tries + 1 WHERE target = ? AND rowid = ? AND change = ?", [(target, r, c) for r, c in events])

    def release(self, claim: str) -> None:
        """Give back what a claim still holds; it counts as a try."""
        with self.db:
            self.db.execute("UPDATE queue SET claim = NULL, claimed = NULL, tries = tries + 1 WHERE claim = ?", (claim,))

    def reject(self, target: str, events: Iterable[tuple[int, str, int, str]]) -> None:
        events = list(events)
        with self.db:
            self.db.executemany("INSERT INTO dead VALUES (?, ?, ?, ?, ?)", [(target, *e) for e in events])
        self.ack(target, [(r, c) for r, c, *_ in events])

    def backlog(self, target: str) -> int:
        return self.db.execute("SELECT count(*) FROM queue WHERE target = ?", (target,)).fetchone()[0]

    def dead(self, target: str) -> list[tuple]:
        return self.db.execute("SELECT rowid, change, snapshot, reason FROM dead WHERE target = ?", (target,)).fetchall()

    # -- asynchronous jobs and tokens

    def job(self, target: str, batch: str) -> str | None:
        found = self.db.execute("SELECT ref FROM jobs WHERE target = ? AND batch = ?", (target, batch)).fetchone()
        return found[0] if found else None

    def keep_job(self, target: str, batch: str, ref: str | None) -> None:
        with self.db:
            self.db.execute("DELETE FROM jobs WHERE target = ?", (target,))
            if ref is not None:
                self.db.execute("INSERT INTO jobs VALUES (?, ?, ?)", (target, batch, ref))

    def token(self, name: str) -> str | None:
        found = self.db.execute("SELECT value FROM tokens WHERE name = ? AND until > ?", (name, time.time())).fetchone()
        return found[0] if found else None

    def keep_token(self, name: str, value: str, seconds: float) -> None:
        with self.db:
            self.db.execute("INSERT OR REPLACE INTO tokens VALUES (?, ?, ?)", (name, value, time.time() + seconds))
