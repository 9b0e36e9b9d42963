"""File operations with trash, history, undo and batches; and the same checks as set operations on tables."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- one at a time, on the driver


class OperationError(Exception):
    """An operation whose preconditions do not hold; nothing has been done."""


@dataclass(frozen=True)
class Operation:
    """``op``: create, delete, move, copy, write, mkdir or symlink."""

    op: str
    path: str
    to: str | None = None
    content: str | None = None
    append: bool = False


def parse_operations(text: str) -> list[Operation]:
    """A JSON list of operations, or of an object's ``operations``; ``src``/``dst``/``target``/``link`` are understood."""
    data = json.loads(text)
    out = []
    for o in data["operations"] if isinstance(data, dict) else data:
        path, to = o.get("path") or o.get("src") or o.get("link"), o.get("to") or o.get("dst") or o.get("target")
        if not o.get("op") or not path:
            raise ValueError(f"not an operation: {o}")
        out.append(Operation(o["op"], path, to, o.get("content"), bool(o.get("append"))))
    return out


def parse_lines(op: str, text: str) -> Operation:
    """``path``, ``path\\ncontent`` or ``source\\ntarget`` as an operation."""
    first, _, rest = text.partition("\n")
    if op in ("move", "copy", "symlink"):
        return Operation(op, first.strip(), rest.strip())
    return Operation(op, first.strip(), None, rest if op in ("create", "write") else None)


@dataclass
class Workspace:
    """A folder in which operations are done, recorded, and can be undone.

    ``on_change(kind, path, to_path)`` is told of every change so that tables can follow.
    """

    root: str
    state: str
    retention: timedelta = timedelta(days=7)
    on_change: Callable[[str, str, str | None], None] | None = None
    history: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        os.makedirs(f"{self.state}/trash", exist_ok=True)

    def _at(self, path: str) -> str:
        full = os.path.normpath(os.path.join(self.root, path.lstrip("/")))
        if full != os.path.normpath(self.root) and not full.startswith(os.path.normpath(self.root) + os.sep):
            raise OperationError(f"{path} lies outside")
        return full

    def check(self, o: Operation) -> str | None:
        """Why an operation cannot be done now, or null."""
        try:
            here, there = self._at(o.path), self._at(o.to) if o.to else None
        except OperationError as e:
            return str(e)
        if o.op in ("create", "mkdir") and os.path.lexists(here):
            return "exists already"
        if o.op == "symlink":
            return "exists already" if os.path.lexists(here) else None if o.to else "no target"
        if o.op in ("delete", "move", "copy"):
            if not os.path.lexists(here):
                return "does not exist"
            if o.op == "delete" and os.path.isdir(here):
                return "is a folder"
            if o.op != "delete" and not there:
                return "no target"
            if o.op != "delete" and os.path.lexists(there):
                return "target exists already"
        elif o.op not in ("create", "write", "mkdir"):
            return f"unknown operation {o.op}"
        return None

    def run(self, o: Operation, record: bool = True) -> dict:
        """Do one operation; returns its history entry. A failed check is recorded and raised."""
        why = self.check(o)
        undo = None
        if why is None:
            here, there = self._at(o.path), self._at(o.to) if o.to and o.op != "symlink" else o.to
            os.makedirs(os.path.dirname(there if o.op in ("move", "copy") else here), exist_ok=True)
            if o.op in ("create", "write"):
                with open(here, "a" if o.append else "w") as f:
                    f.write(o.content or "")
                undo = {"op": "delete", "path": o.path} if o.op == "create" else None
            elif o.op == "delete":
                undo = {"op": "restore", "trash_id": self._trash(o.path, here)["trash_id"], "path": o.path}
            elif o.op == "move":
                os.rename(here, there)
                undo = {"op": "move", "path": o.to, "to": o.path}
            elif o.op == "copy":
                (shutil.copytree if os.path.isdir(here) else shutil.copy2)(here, there)
                undo = {"op": "delete", "path": o.to}
            elif o.op == "mkdir":
                os.mkdir(here)
                undo = {"op": "rmdir", "path": o.path}
            elif o.op == "symlink":
                os.symlink(o.to, here)
                undo = {"op": "unlink", "path": o.path}
            self._tell(o.op, o.path, o.to)
        entry = dict(entry_id=uuid.uuid4().hex, operation=o.op, path=o.path, logged_at=datetime.now(UTC).isoformat(), success=why is None, reversible=undo is not None, undo_data=None if undo is None else json.dumps(undo), error_message=why)
        if record:
            self._log(entry)
        if why is not None:
            raise OperationError(f"{o.op} {o.path}: {why}")
        return entry

    def _tell(self, op: str, path: str, to: str | None) -> None:
        if self.on_change:
            kind = {"create": "created", "write": "modified", "delete": "deleted", "move": "renamed", "copy": "created", "restore": "created"}.get(op)
            if kind:
                self.on_change(kind, to if op == "copy" else path, to if op == "move" else None)

    def _log(self, entry: dict) -> None:
        self.history.append(entry)
        with open(f"{self.state}/history.jsonl", "a") as f:
            f.write(json.dumps(entry) + "\n")

    def _trash(self, path: str, here: str) -> dict:
        ident, now = uuid.uuid4().hex, datetime.now(UTC)
        at = f"{self.state}/trash/{ident}"
        os.makedirs(at)
        shutil.move(here, f"{at}/content")
        entry = dict(trash_id=ident, original_path=path, trash_path=f"{at}/content", deleted_at=now.isoformat(), expires_at=(now + self.retention).isoformat(), size_bytes=os.path.getsize(f"{at}/content"))
        with open(f"{at}/meta.json", "w") as f:
            json.dump(entry, f)
        return entry

    def trash(self) -> list[dict]:
        out = []
        for ident in sorted(os.listdir(f"{self.state}/trash")):
            try:
                with open(f"{self.state}/trash/{ident}/meta.json") as f:
                    out.append(json.load(f))
            except (OSError, ValueError):
                continue
        return out

    def restore(self, trash_id: str) -> str:
        """Put a deleted file back; fails if its place is taken."""
        entry = next((e for e in self.trash() if e["trash_id"] == trash_id), None)
        if entry is None:
            raise OperationError(f"nothing in the trash under {trash_id}")
        here = self._at(entry["original_path"])
        if os.path.lexists(here):
            raise OperationError(f"{entry['original_path']} exists already")
        os.makedirs(os.path.dirname(here), exist_ok=True)
        shutil.move(entry["trash_path"], here)
        shutil.rmtree(f"{self.state}/trash/{trash_id}", ignore_errors=True)
        self._tell("restore", entry["original_path"], None)
        return entry["original_path"]

    def purge(self, now: datetime | None = None) -> int:
        """Remove what has expired from the trash; returns how many files."""
        old = [e for e in self.trash() if e["expires_at"] and datetime.fromisoformat(e["expires_at"]) < (now or datetime.now(UTC))]
        for e in old:
            shutil.rmtree(f"{self.state}/trash/{e['trash_id']}", ignore_errors=True)
        return len(old)

    def undo(self, entry_id: str) -> None:
        """Reverse a recorded operation."""
        entry = next((e for e in self.history if e["entry_id"] == entry_id), None)
        if entry is None or not entry["success"] or not entry["undo_data"]:
            raise OperationError("this cannot be undone")
        self._reverse(json.loads(entry["undo_data"]))

    def _reverse(self, undo: dict) -> None:
        if undo["op"] == "restore":
            self.restore(undo["trash_id"])
        elif undo["op"] == "move":
            self.run(Operation("move", undo["path"], undo["to"]), record=False)
        elif undo["op"] == "rmdir":
            os.rmdir(self._at(undo["path"]))
        else:
            here = self._at(undo["path"])
            if not os.path.lexists(here):
                raise OperationError(f"{undo['path']} does not exist")
            shutil.rmtree(here) if os.path.isdir(here) and not os.path.islink(here) else os.remove(here)
            self._tell("delete", undo["path"], None)

    def batch(self, operations: list[Operation], atomic: bool = True, dry_run: bool = False) -> list[dict]:
        """Do several operations; returns an entry for each that was tried.

        ``dry_run`` only checks each against the present state. ``atomic`` stops at the first
        failure and takes back, last first, what was done; otherwise the rest goes on. An
        overwritten file is put back from a copy.
        """
        if dry_run:
            return [dict(operation=o.op, path=o.path, success=(why := self.check(o)) is None, error_message=why) for o in operations]
        out, done = [], []
        for o in operations:
            saved = None
            if atomic and o.op == "write" and os.path.isfile(self._at(o.path)):
                saved = f"{self.state}/saved-{uuid.uuid4().hex}"
                shutil.copy2(self._at(o.path), saved)
            try:
                entry = self.run(o)
                out.append(entry)
                done.append((o, entry, saved))
            except OperationError as e:
                out.append(dict(operation=o.op, path=o.path, success=False, error_message=str(e)))
                if atomic:
                    for past, entry, copy in reversed(done):
                        if copy:
                            shutil.move(copy, self._at(past.path))
                            self._tell("write", past.path, None)
                        elif past.op == "write":
                            os.remove(self._at(past.path))
                            self._tell("delete", past.path, None)
                        elif entry["undo_data"]:
                            self._reverse(json.loads(entry["undo_data"]))
                        entry["rolled_back"] = True
                    done = []
                    break
        for _, _, copy in done:
            if copy:
                os.remove(copy)
        return out


# ---------------------------------------------------------------- many at a time, on tables


def validate(operations: DataFrame, files: DataFrame) -> DataFrame:
    """``operations (seq, op, path, to_path)`` with ``problem``, each against the files as they are.

    A null operation, an unknown one or one without a path is a problem too; so is a target
    that the move or copy lacks or that exists.
    """
    have = files.where(F.coalesce(F.col("status"), F.lit("pending")) != "deleted").select("path").where("path is not null").distinct()
    here = have.select("path", F.lit(True).alias("_here"))
    there = have.select(F.col("path").alias("to_path"), F.lit(True).alias("_there"))
    both = operations.join(here, "path", "left").join(there, "to_path", "left")
    two = F.col("op").isin("move", "copy")
    problem = (
        F.when(F.col("path").isNull() | F.col("op").isNull(), "not an operation")
        .when(~F.col("op").isin("create", "delete", "move", "copy", "write", "mkdir", "symlink"), "unknown operation")
        .when(F.col("op").isin("create", "mkdir", "symlink") & F.col("_here").isNotNull(), "exists already")
        .when((two | (F.col("op") == "delete")) & F.col("_here").isNull(), "does not exist")
        .when(two & F.col("to_path").isNull(), "no target")
        .when(two & F.col("_there").isNotNull(), "target exists already")
    )
    return both.select(*operations.columns, problem.alias("problem"))


def history(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct history entries, newest first."""
    df = entries.where(F.col("entry_id").isNotNull()).dropDuplicates(["entry_id"]).orderBy(F.desc("logged_at"), "entry_id")
    return df if limit is None else df.limit(limit)


def undoable(entries: DataFrame) -> DataFrame:
    """``(entry_id, operation, path, undo)`` of successful, reversible entries whose undo data is JSON, as a map of strings."""
    rows = entries.where(F.col("entry_id").isNotNull() & F.col("success") & F.col("reversible") & F.col("undo_data").isNotNull()).dropDuplicates(["entry_id"])
    rows = rows.withColumn("undo", F.from_json("undo_data", "map<string,string>"))
    return rows.where(F.col("undo").isNotNull()).select("entry_id", "operation", "path", "undo")


def history_summary(entries: DataFrame) -> DataFrame:
    """Per operation: how often, how often it failed, and how many entries can be undone."""
    rows = entries.where(F.col("entry_id").isNotNull()).dropDuplicates(["entry_id"])
    can = F.col("success") & F.col("reversible") & F.col("undo_data").isNotNull()
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return rows.groupBy("operation").agg(F.count("*").alias("entries"), n(~F.col("success")).alias("failed"), n(can).alias("undoable"))


def trash_state(trash: DataFrame, now: str) -> DataFrame:
    """``(trash_id, original_path, size_bytes, expired)``: an entry without an expiry never expires."""
    rows = trash.where(F.col("trash_id").isNotNull()).dropDuplicates(["trash_id"])
    expired = F.coalesce(F.col("expires_at") < F.lit(now).cast("timestamp"), F.lit(False))
    return rows.select("trash_id", "original_path", "size_bytes", expired.alias("expired"))


def restorable(trash: DataFrame, files: DataFrame, now: str) -> DataFrame:
    """Per path the latest entry that has not expired, and whether its place is free."""
    rows = trash.where(F.col("trash_id").isNotNull() & (F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now).cast("timestamp"))))
    last = rows.groupBy("original_path").agg(F.max(F.struct("deleted_at", "trash_id", "size_bytes")).alias("t"))
    taken = files.where(F.col("status") != "deleted").select(F.col("path").alias("original_path"), F.lit(True).alias("_taken")).distinct()
    joined = last.join(taken, "original_path", "left")
    return joined.select("original_path", F.col("t.trash_id").alias("trash_id"), F.col("t.size_bytes").alias("size_bytes"), F.col("_taken").isNull().alias("free"))
