import json
import os
from datetime import UTC, datetime, timedelta

import pytest

from gleaner.operators import fileops as O
from gleaner.plans import organize
from gleaner.sources import files, logs


@pytest.fixture
def ws(tmp_path):
    os.makedirs(f"{tmp_path}/r")
    events = []
    w = O.Workspace(f"{tmp_path}/r", f"{tmp_path}/s", on_change=lambda *e: events.append(e))
    w.events = events
    return w


def read(ws, p):
    with open(f"{ws.root}/{p}") as f:
        return f.read()


def test_single_operations_and_undo(ws):
    a = ws.run(O.Operation("create", "d/a.txt", content="one"))
    assert read(ws, "d/a.txt") == "one"
    with pytest.raises(O.OperationError, match="exists already"):
        ws.run(O.Operation("create", "d/a.txt"))
    m = ws.run(O.Operation("move", "d/a.txt", "e/b.txt"))
    ws.undo(m["entry_id"])
    assert read(ws, "d/a.txt") == "one"
    c = ws.run(O.Operation("copy", "d/a.txt", "c.txt"))
    ws.undo(c["entry_id"])
    assert not os.path.exists(f"{ws.root}/c.txt")
    d = ws.run(O.Operation("delete", "d/a.txt"))
    assert len(ws.trash()) == 1 and not os.path.exists(f"{ws.root}/d/a.txt")
    ws.undo(d["entry_id"])
    assert read(ws, "d/a.txt") == "one" and ws.trash() == []
    ws.run(O.Operation("write", "d/a.txt", content="+", append=True))
    assert read(ws, "d/a.txt") == "one+"
    ws.undo(a["entry_id"])
    assert not os.path.exists(f"{ws.root}/d/a.txt")
    ws.run(O.Operation("mkdir", "m"))
    ws.run(O.Operation("symlink", "l", "m"))
    for bad in (O.Operation("delete", "m"), O.Operation("delete", "none"), O.Operation("move", "none", "x"), O.Operation("copy", "l", "m"), O.Operation("odd", "x"), O.Operation("create", "../x")):
        with pytest.raises(O.OperationError):
            ws.run(bad)
    assert ("renamed", "d/a.txt", "e/b.txt") in ws.events
    with pytest.raises(O.OperationError):
        ws.undo("none")


def test_batches(ws):
    ops = [O.Operation("create", "a", content="1"), O.Operation("write", "b", content="2"), O.Operation("move", "a", "c")]
    assert all(r["success"] for r in ws.batch(ops[:2]))
    bad = [O.Operation("write", "b", content="changed"), O.Operation("delete", "a"), O.Operation("mkdir", "n"), O.Operation("delete", "none"), O.Operation("create", "never")]
    out = ws.batch(bad)
    assert [r["success"] for r in out] == [True, True, True, False]
    assert read(ws, "b") == "2" and read(ws, "a") == "1" and not os.path.exists(f"{ws.root}/n") and not os.path.exists(f"{ws.root}/never")
    assert [r["success"] for r in ws.batch(bad[3:], atomic=False)] == [False, True]
    assert [r["success"] for r in ws.batch([O.Operation("create", "a"), O.Operation("delete", "b")], dry_run=True)] == [False, True] and read(ws, "b") == "2"


def test_trash_expires(ws):
    ws.run(O.Operation("create", "a"))
    ws.run(O.Operation("delete", "a"))
    assert ws.purge() == 0 and ws.purge(datetime.now(UTC) + timedelta(days=8)) == 1 and ws.trash() == []
    with pytest.raises(O.OperationError):
        ws.restore("none")


def test_front_ends():
    text = json.dumps({"operations": [{"op": "move", "src": "a", "dst": "b"}, {"op": "write", "path": "c", "content": "x", "append": True}]})
    assert O.parse_operations(text) == [O.Operation("move", "a", "b"), O.Operation("write", "c", None, "x", True)]
    assert O.parse_lines("create", "p\nl1\nl2") == O.Operation("create", "p", None, "l1\nl2") and O.parse_lines("copy", "a\nb") == O.Operation("copy", "a", "b")
    with pytest.raises(ValueError):
        O.parse_operations('[{"op": "move"}]')


def test_validate_table(spark):
    have = spark.createDataFrame([("/a", "indexed"), ("/gone", "deleted"), (None, None)], "path string, status string")
    ops = spark.createDataFrame([(1, "create", "/a", None), (2, "create", "/gone", None), (3, "move", "/a", "/b"), (4, "copy", "/a", "/a"), (5, "delete", "/x", None), (6, "odd", "/a", None), (7, None, "/a", None), (8, "move", "/a", None)], "seq int, op string, path string, to_path string")
    got = {r.seq: r.problem for r in O.validate(ops, have).collect()}
    assert got == {1: "exists already", 2: None, 3: None, 4: "target exists already", 5: "does not exist", 6: "unknown operation", 7: "not an operation", 8: "no target"}


def test_history_files(spark, ws, tmp_path):
    ws.run(O.Operation("create", "a"))
    ws.run(O.Operation("delete", "a"))
    with open(f"{ws.state}/history.jsonl", "a") as f:
        f.write("not json\n")
    h = logs.read_history(spark, f"{ws.state}/history.jsonl")
    assert [r.operation for r in h.collect()] == ["delete", "create"] and logs.read_history(spark, f"{ws.state}/history.jsonl", 1).count() == 1
    s = {r.operation: (r.entries, r.undoable) for r in O.history_summary(h).collect()}
    assert s == {"create": (1, 1), "delete": (1, 1)} and O.undoable(h).count() == 2
    logs.append_history(h, f"{tmp_path}/more")
    assert logs.read_history(spark, f"{tmp_path}/more").count() == 2


def test_plan_documents(spark, tmp_path):
    files_df = spark.createDataFrame([("/p/a.txt", "text/plain"), ("/p/b.md", "text/plain")], "path string, mime_type string")
    logs.write_plan(organize.by_type(files_df, "/p"), f"{tmp_path}/plans", "plan1", "by type")
    logs.write_plan(organize.by_project(files_df, "/p"), f"{tmp_path}/plans", "plan2", "by project")
    with open(f"{tmp_path}/plans/plan1/odd.json", "w") as f:
        f.write("no json\n")
    plans = logs.read_plans(spark, f"{tmp_path}/plans")
    assert plans.count() == 4 and plans.where("action = 'move'").count() == 2
    assert [(r.plan_id, r.mkdir, r.move) for r in logs.summarize_plans(plans).collect()] == [("plan1", 2, 2)]


def test_trash_tables(spark):
    t = spark.createDataFrame([("1", "/a", "2026-01-01", "2026-01-08", 3), ("1", "/a", "2026-01-01", "2026-01-08", 3), ("2", "/a", "2026-01-05", None, 4), ("3", "/b", "2026-01-01", "2026-03-01", 5), (None, "/c", None, None, 1)], "trash_id string, original_path string, d string, e string, size_bytes long")
    t = t.selectExpr("trash_id", "original_path", "to_timestamp(d) deleted_at", "to_timestamp(e) expires_at", "size_bytes")
    have = spark.createDataFrame([("/b", "indexed")], "path string, status string")
    assert {(r.trash_id, r.expired) for r in O.trash_state(t, "2026-02-01").collect()} == {("1", True), ("2", False), ("3", False)}
    assert {(r.original_path, r.trash_id, r.free) for r in O.restorable(t, have, "2026-02-01").collect()} == {("/a", "2", True), ("/b", "3", False)}


def test_scan_and_extract(spark, tmp_path):
    for n, data in {"a.txt": b"one\n\ntwo", "b/c.lock": b"", "b/.hid": b"x", "b/d.md": b"# T\n\nbody", "e.bin": b"\x00", "f.gif": b"GIF89a\x05\x00\x04\x00"}.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/{n}"), exist_ok=True)
        with open(f"{tmp_path}/{n}", "wb") as f:
            f.write(data)
    df = files.scan(spark, str(tmp_path), content=True)
    assert {r.name for r in df.collect()} == {"a.txt", "d.md", "e.bin", "f.gif"}
    assert {r.name for r in files.scan(spark, str(tmp_path), includes=["*.md"]).collect()} == {"d.md"} and files.scan(spark, str(tmp_path), max_size=4).where("name = 'a.txt'").count() == 0
    got = {r.path.rsplit("/", 1)[1]: r for r in files.extract(df).collect()}
    assert [e.text for e in got["a.txt"].elements] == ["one", "two"] and got["f.gif"].text == "Image: f.gif (5x4, gif)"
    docs = files.load_documents(files.extract(df)).collect()
    assert {d.metadata.get("element_type") for d in docs} == {None, "paragraph"}
    pdf = spark.createDataFrame([("/x.pdf", bytearray(b"1")), ("/y.pdf", bytearray(b""))], "path string, content binary")

    def reader(data):
        if not data:
            raise ValueError("empty")
        return ["Great Title Here\n\nsome plain text goes on.", "second page"]

    got = {r.path: r for r in files.extract_pdf(pdf, reader).collect()}
    assert got["/x.pdf"].page_count == 2 and [e.kind for e in got["/x.pdf"].elements] == ["heading", "paragraph", "paragraph"] and "ValueError" in got["/y.pdf"].error_message
