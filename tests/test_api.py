import pytest

from siltstone.api import Engine
from siltstone.sources import files


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "project"
    for name, body in {"src/a.ts": "export function alpha() {\n  return 1;\n}\nexport class Beta {}", "src/b.py": "def gamma(x):\n    return x", "node_modules/x.js": "skip", "big.md": "x" * 600_000, ".hidden/c.ts": "const h = 1"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    return root


def test_read_tree(spark, tree, tmp_path):
    assert {r["path"] for r in files.read_tree(spark, str(tree)).collect()} == {"src/a.ts", "src/b.py", ".hidden/c.ts"}
    assert files.read_tree(spark, str(tmp_path / "none")).count() == 0
    assert files.first_available(lambda: files.list_tracked(spark, []), lambda: files.list_tracked(spark, ["a", "a"])).count() == 1


def test_engine(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "index"), {"embedding": {"dimensions": 16}})
    assert e.reindex(str(tree))["success"] is False
    done = e.reindex(str(tree), confirm=True)
    assert done["success"] and done["files"] == 3
    assert not e.needs_reindex()
    e.config("set", "embedding.dimensions", 32)
    assert e.needs_reindex()
    e.config("set", "embedding.dimensions", 16)
    mode, found = e.search("alpha", 5, 0.0)
    assert mode == "hybrid" and found.orderBy("new_rank").first()["file_path"] == "src/a.ts"
    assert e.search("gamma", literal=True)[1].first()["file_path"] == "src/b.py"
    assert e.search("alpha", no_hybrid=True, threshold=-1)[0] == "vector-only"
    assert e.search("alpha", 5, 0.0) == (mode, found) and e.performance("cache")["hits"] == 1
    assert e.grep("grep -rn 'gamma' src/b.py").count() >= 1 and e.grep("ls") is None
    new = spark.createDataFrame([("src/n.ts", "function omega() {}")], "path string, text string")
    e.apply_changes(new, ["src/b.py"])
    assert {r["file_path"] for r in e.index_overview()[1].collect()} == {".hidden/c.ts", "src/a.ts", "src/n.ts"}
    e.collect_garbage(files.list_tracked(spark, ["src/a.ts"]))
    assert e.status()["index"]["files"] == 1
    assert e.performance("metrics").where("name = 'reindex_ms'").count() == 1 and e.performance("report")["cache"]["hits"] == 1
    e.settings["embedding"]["enabled"] = False
    assert e.search("alpha")[0] == "bm25-only"
    assert e.terminate() is False


def test_lists_act_on_indexing(spark, tree, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/index", {"embedding": {"dimensions": 8}})
    e.blacklist("add", "/src/")
    assert e.reindex(f"file://{tree}", confirm=True)["files"] == 1
    e.whitelist("add", "a.ts")
    assert e.reindex(str(tree), confirm=True)["files"] == 2
    again = Engine(spark, f"file://{tmp_path}/index", {"embedding": {"dimensions": 8}})
    assert "/src/" in again.blacklist()
    new = spark.createDataFrame([("src/z.ts", "let z = 1"), ("lib/z.ts", "let z = 1"), ("lib/big.ts", "x" * 600_000), ("lib/none.ts", None)], "path string, text string")
    v = again.apply_changes(new)
    assert {r["file_path"] for r in again.store.read().collect()} == {".hidden/c.ts", "src/a.ts", "lib/z.ts"}
    assert again.apply_changes(new) == v  # stored as it is
    assert again.apply_batch(spark.createDataFrame([("unlink", "lib/z.ts"), ("add", "lib/y.ts"), ("change", "gone.ts")], "event_type string, path string"), lambda p: p.where("path = 'lib/y.ts'").selectExpr("path", "'let y = 2' AS text")) > v
    assert {r["file_path"] for r in again.store.read().collect()} == {".hidden/c.ts", "src/a.ts", "lib/y.ts"}
    e.state.set(sync_status="in_progress", sync_started_at=0)  # its driver was lost
    assert again.reindex(str(tree), confirm=True)["success"]
    e.state.set(sync_status="in_progress", sync_started_at=9e12)
    assert not again.reindex(str(tree), confirm=True)["success"]


def test_pending_vectors_are_tried_again(spark, tree, tmp_path):
    flag = tmp_path / "up"

    def make():
        def model(texts):
            if not flag.exists():
                raise RuntimeError("down")
            return [[1.0, float(len(t))] for t in texts]

        return model

    e = Engine(spark, str(tmp_path / "index"), {"embedding": {"dimensions": 2}}, embed_query=lambda q: [1.0, 0.0], model=make)
    e.reindex(str(tree), confirm=True)
    n = e.store.read().count()
    assert e.retry_pending() == n and len(e.failed) == 3
    flag.write_text("")
    assert e.retry_pending() == 0 and e.failed == [] and e.store.read().count() == n
    assert e.similar([1.0, 5.0], 2).count() == 2


def test_git_listing(spark, tree):
    import subprocess

    assert files.git_tracked(spark, str(tree)).count() == 0 and files.git_blob(str(tree), "src/a.ts") is None
    for args in (["init", "-q"], ["add", "src"], ["-c", "user.email=a@b", "-c", "user.name=n", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(tree), *args], check=True)
    assert {r[0] for r in files.git_tracked(spark, str(tree)).collect()} == {"src/a.ts", "src/b.py"} and files.git_blob(str(tree), "src/b.py").startswith("def gamma")


def test_lists_and_settings(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "i"))
    n = len(e.blacklist())
    assert len(e.blacklist("add", "/zzz/")) == n + 1 and len(e.blacklist("remove", "/zzz/")) == n and e.whitelist("add", "a") == ["a"]
    e.config("set", "search.top_k", "7")
    assert e.config("view", "search.top_k") == 7 and e.config("reset")["search"]["top_k"] == 10
    f = tmp_path / "s.json"
    f.write_text('{"search": {"top_k": 3}, "indexing": {"exclude": ["q/**", "q/**"]}, "x": null}')
    s = files.load_settings(str(f), str(tmp_path / "missing.json"))
    assert s["search"]["top_k"] == 3 and s["search"]["hybrid"]["weight_bm25"] == 0.3 and s["indexing"]["exclude"][-1] == "q/**"
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        files.load_settings(str(tmp_path / "bad.json"))
    st = files.StateFile(spark, str(tmp_path / "st.json"))
    st.set(a=1, b=2)
    st.clear("a")
    assert st.get("a") is None and st.get("b") == 2
