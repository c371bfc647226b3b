import subprocess

from pyspark.sql import functions as F

from codeloom.operators import purity as P
from codeloom.sources import diff, files, gitlog, parser
from codeloom.streaming import events as E

SOURCE = '''import os
from .util import helper


class Service(Base):
    @app.get("/items/{item_id}")
    def read(self, item_id: int) -> str:
        if item_id and self.ready:
            for x in range(3):
                self.read(x)
        url = os.environ["DATABASE_URL"]
        key = os.getenv("API_KEY")
        raise ValueError(url + key)


def test_it():
    return helper()
'''


def test_python_parser(spark):
    rows = parser.parse(spark.createDataFrame([("pkg/a.py", SOURCE), ("bad.py", "def ("), ("x.js", "class A extends B {}\nfunction f() {}\n"), ("n.py", None)], "path string, text string")).cache()
    nodes = {(r["path"], r["kind"], r["name"]): r for r in parser.nodes(rows).collect()}
    read = nodes["pkg/a.py", "method", "read"]
    assert read["recursive"] and read["complexity"] == 4 and read["cognitive"] == 4 and not read["is_test"]
    assert nodes["pkg/a.py", "function", "test_it"]["is_test"]
    assert {("bad.py", "file", "bad.py"), ("n.py", "file", "n.py"), ("x.js", "class", "A"), ("x.js", "function", "f")} <= set(nodes)
    edges = {(r["rel"], r["dst"]) for r in parser.edges(rows).where(F.col("src").contains("read") | F.col("src").isin("pkg/a.py")).collect()}
    assert {("USES", "env::DATABASE_URL"), ("USES", "env::API_KEY"), ("RAISES", "external::ValueError"), ("HTTP_CALLS", "route::/items/{item_id}"), ("IMPORTS", "external_file::.util"), ("RETURNS", "external_type::str"), ("READS", "state::ready")} <= edges


def test_parser_feeds_the_functional_analysis(spark):
    text = """key = lambda x: x
class A:
    def put(self, v):
        self.v = v
        self.n += 1
        return sorted(self.v, key=lambda a: (lambda b: b)(a))
try:
    import fast
except ImportError:
    def slow():
        return 1
"""
    rows = parser.parse(spark.createDataFrame([("m.py", text), ("n.py", "f = 1")], "path string, text string")).cache()
    nodes, edges = parser.nodes(rows), parser.edges(rows)
    names = {(r["kind"], r["name"], r["line"]) for r in nodes.where("path = 'm.py'").collect()}
    assert {("lambda", "$lambda_1_6", 1), ("function", "slow", 10)} <= names and sum(k == "lambda" for k, _, _ in names) == 3
    files = nodes.where("kind = 'file'")
    # file, class, method: the two lambdas of the method are two steps below the file
    assert [tuple(r) for r in P.lambda_density(edges.where("rel = 'CONTAINS'"), parser.lambdas(rows), files).collect()] == [("m.py", 2)]
    assert [tuple(r) for r in P.state_mutations(parser.accesses(rows), nodes).collect()] == [("put", 2)]


def test_long_and_deep_sources():
    chain = "def f(x):\n    if x == 0:\n        return 0\n" + "".join(f"    elif x == {i}:\n        return {i}\n" for i in range(1, 900))
    f = next(r for r in parser.parsed("a.py", chain) if r.get("kind") == "Function")
    assert (f["complexity"], f["cognitive"]) == (901, 900 * 901 // 2)
    assert [r["kind"] for r in parser.parsed("b.py", "(" * 5000 + ")" * 5000)] == ["File"]
    many = parser.parsed("c.js", "function f() {}\n" * 20000)
    assert [r["line"] for r in many if r.get("kind") == "Function"] == list(range(1, 20001))


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@x.org", *a], check=True, capture_output=True, text=True).stdout
    run("init", "-q")
    (tmp_path / "main.py").write_text("x = 1\n")
    run("add", "."), run("commit", "-qm", "initial commit")
    (tmp_path / "utils.py").write_text("y = 1\nz = 2\n")
    run("add", "."), run("commit", "-qm", "fix: resolve bug in helper")
    gitlog.register(spark)
    log = spark.read.format("gitlog").option("repository", str(tmp_path)).load()
    assert sorted(r["subject"] for r in log.collect()) == ["fix: resolve bug in helper", "initial commit"]
    text = run("log", "--numstat", f"--format={gitlog.NUMSTAT_FORMAT}").splitlines()
    lines = spark.createDataFrame([("r", i, x) for i, x in enumerate(text)], "source string, pos long, line string")
    assert sorted((r["file"], r["added"], r["deleted"]) for r in gitlog.numstat(lines).collect()) == [("main.py", 1, 0), ("utils.py", 2, 0)]
    got = gitlog.commits(spark.createDataFrame([(x,) for x in run("log", f"--format={gitlog.COMMIT_FORMAT}").splitlines()], "value string"))
    assert {r["mail"] for r in got.collect()} == {"a@x.org"}
    found = files.repositories(spark, str(tmp_path.parent), 2)
    assert (str(tmp_path), tmp_path.name, "regular") in {tuple(r) for r in found.collect()}


def test_log_lines(spark):
    df = spark.createDataFrame([(" 3 files changed, 10 insertions(+), 2 deletions(-)",), (" 1 file changed, 1 insertion(+)",), (" 1 file changed, 4 deletions(-)",), ("",)], "l string")
    assert [tuple(r) for r in df.select(*gitlog.shortstat(F.col("l")).values()).collect()] == [(3, 10, 2), (1, 1, 0), (1, 0, 4), (0, 0, 0)]
    lines = spark.createDataFrame([("s", i, x) for i, x in enumerate(["commit:a", "-\t-\tbin", "1\t2\tf g", "", "commit:b", "3\t0\tf g"])], "source string, pos long, line string")
    assert sorted(map(tuple, gitlog.numstat(lines).collect())) == [("a", "bin", 0, 0), ("a", "f g", 1, 2), ("b", "f g", 3, 0)]
    assert gitlog.main_branch(["dev", "main"], None, "gone") == "main" and gitlog.main_branch([]) is None


def test_hunks(spark):
    text = ["diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -1,2 +3,4 @@ f", "+code", "@@ -9 +12 @@", "@@ -5,2 +4,0 @@", "+++ /dev/null", "@@ -1,3 +0,0 @@"]
    lines = spark.createDataFrame([("s", i, x) for i, x in enumerate(text)], "source string, pos long, line string")
    assert [tuple(r) for r in diff.hunks(lines).orderBy("start").collect()] == [("x", 3, 6), ("x", 4, 4), ("x", 12, 12)]


def test_tree(spark, tmp_path):
    for name in ("a/b.py", "a/.git/c.py", "node_modules/d.js", "e.txt", "f.GO"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x = 1\ny = 2\nz = 3")
    got = {r["filepath"]: r for r in files.source_files(spark, str(tmp_path)).collect()}
    assert {k: v["lang"] for k, v in got.items()} == {"a/b.py": "python", "f.GO": "go"}
    one = spark.createDataFrame([("1\n2\n3\n4",)], "t string").select(files.body(F.col("t"), F.lit(2), F.lit(3)))
    assert one.first()[0] == "2\n3"


def test_imports_and_records(spark):
    listing = spark.createDataFrame([(x,) for x in ("pkg/util.py", "pkg/__init__.py", "web/lib/index.ts", "src/a/mod.rs", "include/x.h")], "filepath string")
    imports = spark.createDataFrame([("m.py", "python", "pkg.util"), ("m.py", "python", "pkg"), ("pkg/a.py", "python", ".util"), ("web/app.ts", "typescript", "./lib"), ("src/m.rs", "rust", "crate::a"), ("m.c", "c", "x.h"), ("m.py", "python", "numpy")], "filepath string, lang string, target string")
    got = {(r["filepath"], r["target"]): r["resolved"] for r in files.resolved_imports(imports, listing).collect()}
    assert got == {("m.py", "pkg.util"): "pkg/util.py", ("m.py", "pkg"): "pkg/__init__.py", ("pkg/a.py", ".util"): "pkg/util.py", ("web/app.ts", "./lib"): "web/lib/index.ts", ("src/m.rs", "crate::a"): "src/a/mod.rs", ("m.c", "x.h"): "include/x.h", ("m.py", "numpy"): None}
    docs = spark.createDataFrame([("adr/0001-use-x.md", "intro\n# Use X \ntext"), ("adr/readme.md", "# no")], "filepath string, text string")
    assert [tuple(r) for r in files.decision_records(docs).collect()] == [("adr/0001-use-x.md", 1, "Use X")]


def test_stream_upserts_and_sessions(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "filepath string, mtime double")
    rows.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    E.reindexed(stream, store, ["filepath"]).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    spark.createDataFrame([("b", 9.0), ("c", 3.0)], rows.schema).coalesce(1).write.mode("append").parquet(str(source))
    E.reindexed(stream, store, ["filepath"]).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    assert dict(map(tuple, E.latest(spark, store).collect())) == {"a": 1.0, "b": 9.0, "c": 3.0}
    events = spark.createDataFrame([("2024-01-01 00:00:00", "a"), ("2024-01-01 00:00:01", "b"), ("2024-01-01 00:00:02", "a"), ("2024-01-01 00:00:09", "c")], "t string, path string").select(F.col("t").cast("timestamp").alias("ts"), "path")
    assert [r["paths"] for r in E.debounced_paths(events).orderBy("start").collect()] == [["a", "b"], ["c"]]
