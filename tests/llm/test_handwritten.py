import random

from gleaner.llm import handwritten as hw


def test_notices():
    yes = {
        "// Code generated by foo-gen v1.2. DO NOT EDIT.": "generated", "# @generated SignedSource<<ab>>": "generated", "/* Autogenerated from x.idl - edit the definition instead */": "generated",
        "# This file was automatically produced by x; manual changes will be lost.": "generated", "// Automatisch erzeugt aus x.xsd, bitte nicht von Hand ändern": "generated",
        "/* Imported unchanged from project Abc, tag v1; send fixes upstream */": "vendored", "// x.h - single-header library, public domain": "vendored",
        "# Copied from https://x.example.invalid/releases/1 (bundled so that the build works offline)": "vendored",
        "// Some lib 3.18.6 - upstream copy, see https://x.example.invalid/ for the source": "vendored", "/*! lib v6.3 | (c) The Lib Authors | released under the permissive licence */": "vendored",
    }
    no = [
        '// HEADER = "Code generated by x. DO NOT EDIT."', "// do not edit the generated config, change this template instead", "# the output below is generated by x at run time and never stored",
        "// hand-tuned; an earlier version was generated and has been rewritten", "# auto-generated files are ignored by x, see docs", 'x = "Code generated by y"', "", "//", "# imported from the list below",
        "// Copyright the maintainers. Licensed under the project licence.", "# the copy goes to the upstream copy of the list",
    ]
    assert {k: hw.notice_of(k) for k in yes} == yes
    assert [k for k in no if hw.notice_of(k)] == []


def test_notice_lines_do_not_reach_the_features():
    a, _, found = hw.chunk_features("# Code generated by x. DO NOT EDIT.\nvalue = 1\n")
    b, _, none = hw.chunk_features("value = 1\n")
    assert a == b and found == "generated" and none is None


def hand(rng):
    names = [f"{rng.choice(['load', 'item', 'queue', 'result', 'name'])}_{rng.choice(['path', 'list', 'value', 'node'])}" for _ in range(20)]
    return "".join(f"def {rng.choice(names)}({rng.choice(names)}):\n    # {rng.choice(['reads', 'keeps', 'finds'])} the {rng.choice(names)}\n    return {rng.choice(names)}.{rng.choice(names)}({rng.randint(1, 99)})\n\n" for _ in range(rng.randint(4, 12)))


def mini(rng):
    return "".join(f"function {rng.choice('abcdef')}({rng.choice('xyz')}){{return {rng.choice('xyz')}.{rng.choice('klm')}+{rng.randint(1, 999)}}}" for _ in range(rng.randint(20, 60)))


def test_find(spark):
    rng = random.Random(1)
    rows, files = [], []
    for i in range(160):
        rows.append((f"h{i}", f"/p/src/hand{i}.py", "code:py", hand(rng)))
    for i in range(24):
        rows.append((f"m{i}", f"/p/src/lib{i}.min.js", "code:js", mini(rng)))
    for i in range(12):
        rows.append((f"u{i}", f"/p/src/plain{i}.js", "code:js", mini(rng)))
    for i in range(15):
        rows.append((f"v{i}", f"/p/vendor/zlorp/a{i}.py", "code:py", hand(rng)))
        rows.append((f"o{i}", f"/p/vendors/src/hand_too{i}.py", "code:py", hand(rng)))  # a module of one's own
        rows.append((f"d{i}", f"/p/src/table{i}.py", "code:py", "rows = [\n" + "".join(f"[{rng.randint(1, 9999)}, {rng.random():.4f}, {i}],\n" for i in range(80)) + "]"))
    rows += [("g", "/p/src/gen1.py", "code:py", "# @generated\n" + hand(rng))]
    rows += [("by", "/p/generated_by_hand/builders/a.py", "code:py", hand(rng)), ("t", "/p/readme.md", "markdown", "# Code generated by x"), ("n1", "/p/src/none.py", "code:py", None), ("n2", None, "code:py", "x"), ("e", "/p/src/empty.py", "code:py", ""), (None, "/p/src/hand0.py", "code:py", "x = 1"), rows[0]]
    files = [(p, "text/x-python", None, None) for p in {r[1] for r in rows}] + [(None, "text/plain", None, None)]
    chunks = spark.createDataFrame([(*r, "q") for r in rows], "chunk_id string, file_path string, content_type string, content string, path string")
    table = spark.createDataFrame(files, "path string, mime_type string, indexed_at timestamp, modified_at timestamp")
    got = {r.path: r for r in hw.find_foreign_files(chunks, table).collect()}
    assert len(got) == len({r[1] for r in rows if r[1] and r[2].startswith("code:") and r[3] is not None})
    found = {p for p, r in got.items() if r.found}
    assert {f"/p/src/plain{i}.js" for i in range(12)} <= found  # only the forest can know
    assert {"/p/src/gen1.py", *(f"/p/vendor/zlorp/a{i}.py" for i in range(15)), *(f"/p/src/table{i}.py" for i in range(15))} <= found
    assert all(r.notice or r.probability >= 0.5 for r in got.values() if r.found)
    assert not any("hand" in p for p in found)


def test_few_files_and_none(spark):
    schema, fschema = "chunk_id string, file_path string, content_type string, content string", "path string, mime_type string, indexed_at timestamp, modified_at timestamp"
    none = spark.createDataFrame([], fschema)
    assert hw.find_foreign_files(spark.createDataFrame([], schema), none).count() == 0
    two = spark.createDataFrame([("a", "/x/vendor/pkg/a.py", "code:py", "x = 1"), ("b", "/x/b.py", "code:py", "y = 2")], schema)
    assert {r.path: r.found for r in hw.find_foreign_files(two, none).collect()} == {"/x/vendor/pkg/a.py": True, "/x/b.py": False}


def test_held_out(spark):
    rng = random.Random(2)
    rows = [(f"h{i}", f"/p/src/hand{i}.py", "code:py", hand(rng)) for i in range(120)] + [(f"m{i}", f"/p/src/lib{i}.min.js", "code:js", mini(rng)) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id string, file_path string, content_type string, content string")
    none = spark.createDataFrame([], "path string, mime_type string, indexed_at timestamp, modified_at timestamp")
    r = hw.held_out_accuracy(chunks, none, 3).first()
    assert r.marked > 5 and r.unmarked > 10 and r.marked_found == 1 and r.unmarked_found == 0 and r.with_notice == 0
