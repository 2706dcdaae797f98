"""Readers, parsers and live operators on files written by the tests."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import extraction as X
from sparkloom.operators.parsers import parse
from sparkloom.sources import session_log, source_tree, vcs
from sparkloom.streaming import live


def test_commit_log(spark, tmp_path):
    s = vcs.SEPARATOR
    (tmp_path / "log").write_text(f"{s}h1\x1f2024-01-02T03:04:05+00:00\x1f2 days ago\x1ffeat: a\x1fb\n\na.ts\nb.ts\na.ts\n{s}h2\x1fbad\n{s}h3\x1f2024-01-01T00:00:00+02:00\x1f3 days ago\x1fx\n\n")
    r = vcs.commits(spark, str(tmp_path / "log")).collect()
    assert [(x.hash, x.message, x.files) for x in r] == [("h1", "feat: a\x1fb", ["a.ts", "b.ts"])]


def test_counts_renames_blame(spark, tmp_path):
    (tmp_path / "num").write_text("1\t2\ta.ts\n-\t-\tlogo.png\n")
    assert [(r.file, r.added) for r in vcs.line_counts(spark, str(tmp_path / "num")).orderBy("file").collect()] == [("a.ts", 1), ("logo.png", None)]
    (tmp_path / "names").write_text("R097\told.ts\tnew.ts\nM\tx.ts\n")
    assert vcs.renames(spark, str(tmp_path / "names")).collect() == [("old.ts", "new.ts", 97)]
    h = "a" * 40
    (tmp_path / "blame").write_text(f"{h} 1 1 2\nauthor-time 86400\n\tx\n{h} 2 2\n\ty\n{'0' * 40} 3 3 1\nauthor-time 0\n\tz\n")
    assert [(r.line, r.days) for r in vcs.blame(spark, str(tmp_path / "blame"), 3 * 86400).orderBy("line").collect()] == [(1, 2.0), (2, 2.0), (3, 0.0)]


def test_session_log(spark, tmp_path):
    said = lambda i, content, out=10, **k: json.dumps({"type": "assistant", "timestamp": f"2024-01-01T00:00:{i:02}Z", "sessionId": "s", "message": {"role": "assistant", "content": content, "usage": {"input_tokens": 5, "output_tokens": out}}, **k})
    tool = lambda name, **i: [{"type": "tool_use", "name": name, "input": i}]
    lines = [said(1, [{"type": "text", "text": "hi"}]), "{broken", said(2, tool("Read", file_path="a.ts")), said(3, tool("Bash", command="ls")), said(4, "end", 60), said(5, tool("Edit"), isSidechain=True)]
    (tmp_path / "s.jsonl").write_text("\n".join(lines))
    t = session_log.turns(session_log.entries(spark, str(tmp_path / "s.jsonl"))).orderBy("turn_index").collect()
    assert [([x.name for x in r.tools], r.output_tokens, r.file_paths) for r in t] == [(["Read"], 20, ["a.ts"]), (["Bash"], 10, []), ([], 60, [])]
    assert session_log.discover(spark, str(tmp_path)).count() == 1
    assert session_log.duration("2w").days == 14
    with pytest.raises(ValueError, match="duration"):
        session_log.duration("soon")


def test_source_tree_and_extraction(spark, tmp_path):
    root = tmp_path / "proj"
    for name, text in {
        "src/a.ts": 'import { helper } from "./b";\nimport React from "react";\nexport function run() { helper(); local(); }\nfunction local() { return 1; }\n',
        "src/b.ts": "export function helper() { return 2; }\n", "node_modules/x.ts": "x", "tool/main.py": "from tool.util import go\ndef start():\n    go()\n",
        "tool/util.py": "def go():\n    pass\n", "tsconfig.json": '{ // c\n "compilerOptions": { "strict": true, } }', "package.json": '{"name": "p", "main": "./src/a.ts"}', "README.md": "x",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    files = source_tree.files(spark, str(root))
    assert {r.path for r in files.collect()} == {"src/a.ts", "src/b.ts", "tool/main.py", "tool/util.py"}
    x = X.extract(files).cache()
    imports = X.resolve_imports(X.facts(x, "imports"), files)
    assert {(r.path, r.specifier): r.target for r in imports.collect()} == {("src/a.ts", "./b"): "src/b.ts", ("src/a.ts", "react"): None, ("tool/main.py", "tool.util"): "tool/util.py"}
    calls = X.resolve_calls(X.facts(x, "calls"), X.facts(x, "symbols"), imports)
    assert {(r.caller, r.callee, r.target, r.tier) for r in calls.collect()} == {("run", "helper", "src/b.ts", 2), ("run", "local", "src/a.ts", 1), ("start", "go", "tool/util.py", 2)}
    assert X.call_graph(calls).count() == 3
    facts = {(r.tool, r.key): r.value for r in source_tree.constraints(source_tree.config_texts(spark, str(root))).collect()}
    assert facts["tsconfig", "strict"] == "true" and facts["manifest", "main"] == "./src/a.ts"
    assert [r.file for r in source_tree.entry_files(source_tree.config_texts(spark, str(root))).collect()] == ["src/a.ts"]
    names = spark.createDataFrame([("tsconfig.json",), ("x/go.mod",), ("turbo.json",)], "path string")
    assert {r.name for r in source_tree.stacks(names).collect()} == {"typescript", "go", "turborepo"}


def test_parsers_of_all_languages():
    ts = parse("typescript", 'export class Foo extends Bar implements Baz {\n  run() { this.go(); new Thing(); }\n}\nimport("lazy");')
    assert ("Foo", "Bar", "extends") in ts["heritage"] and ("lazy", [], False, True) in ts["imports"] and ("run", None, "Thing", 2, True) in ts["calls"]
    py = parse("python", "if TYPE_CHECKING:\n    import a\nclass Ab(B, metaclass=M):\n    @dec\n    def run(self): return go()\n")
    assert py["imports"] == [("a", [], True, False)] and ("Ab", "M", "metaclass") in py["heritage"] and ("run", "dec") in py["decorators"]
    assert parse("python", "def (") == parse("cobol", "x") == parse("go", None)
    go = parse("go", 'import "fmt"\ntype Srv struct {\n\tBase\n}\nfunc (s *Srv) Run() { fmt.Println(1) }\n')
    assert [s[:2] for s in go["symbols"]] == [("Run", "method"), ("Srv", "struct")] and go["heritage"] == [("Srv", "Base", "embeds")]
    rs = parse("rust", "use a::{b, c::*};\nmod inner;\nimpl Show for Pt { fn show(&self) { Pt::make() } }\n")
    assert [i[0] for i in rs["imports"]] == ["a::b", "a::c", "mod::inner"] or ("mod::inner", [], False, False) in rs["imports"]
    assert ("show", "Pt", "make", 3, False) in rs["calls"]
    java = parse("java", "import a.b.C;\n@Service\npublic class Kit extends L implements N {\n  public void go() { run(); }\n}\n")
    assert ("a.b.C", ["C"], False, False) in java["imports"] and ("Kit", "N", "implements") in java["heritage"] and ("Kit", "Service") in java["decorators"]


def test_resolution_order_and_interfaces(spark):
    bases = spark.createDataFrame([("g", "D", "B", 0), ("g", "D", "C", 1), ("g", "B", "A", 0), ("g", "C", "A", 0), ("g", "X", "X", 0)], "graph_id string, class string, base string, position int")
    got = [r.ancestor for r in X.linearise(bases).where(F.col("class") == "D").orderBy("place").collect()]
    assert got == ["D", "B", "C", "A"]
    m = spark.createDataFrame([("T", "a"), ("T", "b"), ("U", "a")], "type string, method string")
    i = spark.createDataFrame([("I", "a"), ("I", "b"), ("J", "a")], "interface string, method string")
    assert {(r.type, r.interface) for r in X.satisfied_interfaces(m, i).collect()} == {("T", "I"), ("T", "J"), ("U", "J")}


def test_live_limits_sessions_and_refresh(spark, tmp_path):
    calls = spark.createDataFrame([("s", i, datetime(2024, 1, 1, 0, i), c, e) for i, (c, e) in enumerate([("ls", False)] * 3 + [("x", True)] + [("ls", False)] * 2)], "session_id string, call_id bigint, at timestamp, command string, is_edit boolean")
    calls.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    q = live.limit_calls(stream(), budget=5).writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {r.call_id: r.blocked for r in spark.table("limits").collect()} == {0: None, 1: None, 2: "streak", 3: None, 4: None, 5: "budget"}
    q = live.session_spans(stream(), "session_id", "at", "2 minutes").writeStream.format("memory").queryName("spans").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert spark.table("spans").columns == ["session_id", "started_at", "ended_at", "events"]
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    files.write.parquet(str(tmp_path / "files"))
    seen = []
    q = live.refresh(spark.readStream.schema(files.schema).parquet(str(tmp_path / "files")), lambda: files.where("path = 'a'"), lambda df, n: seen.extend(r.path for r in df.collect()), str(tmp_path / "c3")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert seen == ["b"]


def test_entry_imports_without_the_training_subpackage():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "hits_trade" in e.queries()
