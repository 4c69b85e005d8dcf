import json
import random

from pyspark.sql import functions as F

from difflens.functions import richtext
from difflens.functions import values as V
from difflens.operators import findings
from difflens.plans import presets
from difflens.sources import landed, tree


def test_read_diffs_replaces_bad_bytes_and_unifies_line_ends(spark, tmp_path):
    (tmp_path / "a.patch").write_bytes(b"diff --git a/a.cs b/a.cs\r\n+++ b/a.cs\r\n@@ -1 +1 @@\r\n+x \xff\r\n")
    row = landed.read_diffs(spark, str(tmp_path)).first()
    assert row.diff_text.endswith("+x �\n") and "\r" not in row.diff_text


def test_scan(spark, tmp_path):
    good = {"r1/src/a.cs": "x\r\ny z\n", "r1/b.SQL": "\n\nA", "r2/c.ts": "console.log(1)"}
    bad = ["r1/bin/x.cs", "r1/a.min.js", "r2/node_modules/x.js", "r2/x.txt", "r2/.cs", "r1/obj/y.sql"]
    for name, text in {**good, **{b: "x" for b in bad}}.items():
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    sources = landed.read_tree(spark, str(tmp_path / "root"))
    lines = landed.scan_lines(sources)
    repos = {r.pr_id: r.repo for r in sources.select("pr_id", "repo").distinct().collect()}
    got = {}
    for r in lines.orderBy("line_no").collect():
        got.setdefault(f"{repos[r.pr_id]}/{r.path}", []).append(r.content)
    assert got == {"r1/src/a.cs": ["x", "y", "z"], "r1/b.SQL": ["", "", "A"], "r2/c.ts": ["console.log(1)"]}
    assert {r.rule_id for r in findings.find(lines).collect()} >= {"SQL-FMT-002", "TS-001"}


def test_excluded_folders_are_not_entered(spark, tmp_path, monkeypatch):
    for repo in ("one", "two"):
        for folder in ("src/deep", "node_modules/x/y", "src/bin"):
            (tmp_path / repo / folder).mkdir(parents=True)
            for i in range(20):
                (tmp_path / repo / folder / f"f{i}.cs").write_text("x")
        (tmp_path / repo / ".cs").write_text("a name, not a suffix")
    (tmp_path / "loose.cs").write_text("not in a repository")
    reader = tree.TreeReader(f"file://{tmp_path}", tuple(V.SCAN_EXCLUDED_FOLDERS))
    seen = []
    listed = tree.TreeReader._children
    monkeypatch.setattr(tree.TreeReader, "_children", lambda self, system, folder: seen.append(folder) or listed(self, system, folder))
    assert sorted(p.value for p in reader.partitions()) == ["one", "two"]
    assert sorted(path for _, path, _ in reader.read(tree.Repository("one"))) == sorted(f"src/deep/f{i}.cs" for i in range(20))
    assert not any("node_modules" in s or s.endswith("bin") for s in seen) and len(seen) == 4
    df = landed.read_tree(spark, str(tmp_path))
    assert df.count() == 40 and df.rdd.getNumPartitions() == 2
    assert df.filter(~landed.scanned_file(F.col("path"))).count() == 0


def test_bin_in_a_file_name_is_not_a_folder(spark):
    df = spark.createDataFrame([("cabin/x.cs",), ("Bin/x.cs",), ("a/bin/x.cs",)], "path string")
    assert [r.path for r in df.filter(landed.scanned_file(F.col("path"))).collect()] == ["cabin/x.cs", "Bin/x.cs"]


def test_local_review_prefers_the_diff(spark):
    text = "diff --git a/a.ts b/a.ts\n+++ b/a.ts\n@@ -1 +1 @@\n+console.log(1)\n"
    diffs = spark.createDataFrame([(1, text), (2, " \n")], "pr_id long, diff_text string")
    sources = spark.createDataFrame([(n, "b.ts", "const x: any = 1") for n in (1, 2)], "pr_id long, path string, text string")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "pr_id long, folder_name string").withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    got = presets.local_review(diffs, sources, asked)
    assert sorted((r.pr_id, r.rule_id) for r in got["findings"].collect()) == [(1, "TS-001"), (2, "TS-003")]
    assert [r.pr_id for r in got["nothing"].collect()] == [3]
    assert [r.pr_id for r in landed.without_files(asked, got["lines"]).collect()] == [3]


def nest(depth):
    node = {"type": "text", "text": "deep"}
    for i in range(depth):
        node = {"type": "listItem" if i % 2 else "bulletList", "content": [node, {"type": "text", "text": str(i)}]}
    return {"type": "doc", "content": [node]}


def plain(node):
    if not isinstance(node, dict):
        return ""
    if node.get("type") == "text":
        value = node.get("text")
        return json.dumps(value) if isinstance(value, (int, float)) else value if isinstance(value, str) else ""
    sep = "\n" if node.get("type") in ("paragraph", "heading", "bulletList", "listItem") else " "
    children = node.get("content")
    return sep.join(plain(c) for c in children) if isinstance(children, list) else ""


def test_rich_text_is_read_alike_at_every_depth(spark):
    rng = random.Random(6)

    def tree(depth):
        loose = rng.choice(["hi", None, 7, [], {}, {"type": None}, {"text": "no type"}, {"type": "text"}, {"type": "text", "text": None}, {"type": "text", "text": 12},
                            {"type": "text", "text": True}, {"type": "text", "text": ["x"]}, {"type": 3, "content": [{"type": "text", "text": "odd"}]}, {"type": "paragraph", "content": "no list"}])
        if depth == 0:
            return loose
        kids = [tree(depth - 1), loose, {"type": "text", "text": f"t{depth}"}]
        rng.shuffle(kids)
        return {"type": rng.choice(["doc", "paragraph", "heading", "listItem", "x", None]), "content": kids}

    trees = [tree(d) for d in range(1, 41) for _ in range(3)] + [nest(d) for d in (200, 300)]
    rows = [(i, json.dumps(t)) for i, t in enumerate(trees)]
    df = spark.createDataFrame(rows, "i int, doc string").select("i", richtext.rich_text(F.col("doc")).alias("t"))
    assert {r.i: r.t for r in df.collect()} == {i: plain(t).strip() for i, t in enumerate(trees)}
    deep = '{"type":"x","content":[' * 3000 + "]}" * 3000
    assert spark.createDataFrame([(deep,)], "doc string").select(richtext.rich_text(F.col("doc")).alias("t")).first().t == ""


def test_rich_text(spark):
    doc = {
        "type": "doc",
        "content": [
            {"type": "heading", "content": [{"type": "text", "text": "Title"}]},
            {"type": "paragraph", "content": [{"type": "text", "text": "a"}, {"type": "hardBreak"}, {"type": "text"}]},
        ],
    }
    trees = [doc, nest(3), nest(7), nest(8), nest(20), {"type": "doc"}]
    rows = [(i, json.dumps(t)) for i, t in enumerate(trees)] + [(90, '"just text"'), (91, None)]
    df = spark.createDataFrame(rows, "i int, doc string").select("i", richtext.rich_text(F.col("doc")).alias("t"))
    got = {r.i: r.t for r in df.collect()}
    assert {i: got[i] for i in range(len(trees))} == {i: plain(t).strip() for i, t in enumerate(trees)}
    assert got[90] == "just text" and got[91] == ""


def test_issue_and_pr_documents(spark):
    issues = [
        {"key": "A-1", "fields": {"summary": "s", "description": "plain", "issuetype": {"name": "Bug"}, "assignee": {"displayName": "me"}}},
        {"key": "A-2", "fields": {"summary": None, "assignee": None, "description": nest(1)}},
    ]
    df = landed.parse_issues(spark.createDataFrame([(json.dumps(i),) for i in issues], "doc string"))
    a, b = df.orderBy("key").collect()
    assert (a.title, a.description, a.type, a.status, a.assignee, a.priority) == ("s", "plain", "Bug", "Unknown", "me", "Medium")
    assert (b.title, b.description, b.type, b.assignee) == ("", plain(nest(1)), "Unknown", "Unassigned")
    prs = [{"number": 3, "title": None, "head": {"ref": "b", "sha": "x"}}, {"action": "opened", "pull_request": {"number": 4, "title": "t", "draft": True}}]
    got = {r.pr_id: r for r in landed.parse_prs(spark.createDataFrame([(json.dumps(p),) for p in prs], "doc string")).collect()}
    assert (got[3].title, got[3].branch, got[3].body, got[3].draft) == ("", "b", "", False)
    assert (got[4].action, got[4].draft) == ("opened", True)


def test_description_is_told_apart_by_its_json_type(spark):
    texts = ["{code}\nselect 1\n{code} payment broken", '{"not": "closed', "[…]", "", " plain"]
    docs = [json.dumps({"key": f"AB-{i}", "fields": {"description": t}}) for i, t in enumerate(texts)]
    docs.append(json.dumps({"key": "AB-9", "fields": {"description": None}}))
    rows = {r.key: r.description for r in landed.parse_issues(spark.createDataFrame([(d,) for d in docs], "doc string")).collect()}
    assert [rows[f"AB-{i}"] for i in range(len(texts))] == texts and rows["AB-9"] == ""


def test_an_event_without_draft_flag_triggers(spark):
    from difflens.functions import values as V
    from difflens.operators.files import triggered_prs

    prs = spark.createDataFrame([(1, V.TRIGGER_ACTIONS[0], None), (2, V.TRIGGER_ACTIONS[0], False), (3, V.TRIGGER_ACTIONS[0], True)], "pr_id long, action string, draft boolean")
    paths = spark.createDataFrame([(i, f"x{V.TRIGGER_SUFFIXES[0]}") for i in (1, 1, 2, 3)], "pr_id long, path string")
    assert sorted(r.pr_id for r in triggered_prs(prs, paths).collect()) == [1, 2]
