"""A small tree in five languages from files to document; parsers, manifests and names on their own."""

import json

import pytest

from tessera.__main__ import main
from tessera.extraction import script_source
from tessera.extraction.frames import record
from tessera.operators import naming
from tessera.operators.modules import judged
from tessera.plans import codegraph
from tessera.sources import manifests, tree

TREE = {
    "package.json": '{"name": "web", "dependencies": {"left": "^1.2.0", "near": "workspace:*", "nick": "npm:real@2.0.0"}}',
    "tsconfig.json": '{\n  // shared\n  "extends": "./base",\n  "compilerOptions": {"strict": true,},\n}\n',
    "base.json": '{"compilerOptions": {"baseUrl": "./app", "paths": {"@b/*": ["none/*", "b/*"], "@b/all": ["b/deep.ts"] /* exact */}}}',
    "app/tsconfig.json": '{"compilerOptions": {"paths": {"@b/*": ["../svc/*"]}}}',
    "app/a/three.ts": 'import { help } from "@b/deep";\nimport { Shape } from "@b/all";\nimport { none } from "@b/gone";\nexport const far = () => help();\n',
    "app/a/one.ts": 'import { help as h } from "../b/all";\nimport left from "left";\nexport function run(): string {\n  return `${h()}!`;\n}\n',
    "app/a/two.ts": 'import { run } from "./one";\nimport nick from "nick";\nexport const go = () => run();\n',
    "app/b/tool.ts": "abstract class Tool {\n  abstract turn(): void;\n  static make() { return 1; }\n  use() { this.turn(); this.help(); Tool.make(); }\n  help() {}\n}\nclass Saw {\n  turn() { this.lost(); }\n  help() {}\n  static make() {}\n}\n",
    "app/b/all.ts": 'export * from "./deep";\nexport { Shape } from "./deep";\n',
    "app/b/deep.ts": "export function help() {\n  return 1;\n}\nexport class Shape {\n  area(): number {\n    return help();\n  }\n}\n",
    "app/b/bad.ts": "export function broken( {\n",
    "app/b/deep.test.ts": 'import { help } from "./deep";\nfunction check() { help(); }\n',
    "svc/go.mod": "module example.org/svc\n\nrequire (\n\texample.org/kit v1.2.3\n)\n",
    "svc/main.go": 'package main\n\nimport (\n\t"example.org/kit/sub"\n\tu "example.org/svc/util"\n)\n\nfunc Main() {\n\tif ok := u.Do(); ok {\n\t\tsub.Other()\n\t}\n}\n',
    "svc/util/util.go": "package util\n\ntype T struct{}\n\nfunc Do() bool { return true }\n\nfunc (t T) Act() {}\n",
    "py/pyproject.toml": '[project]\nname = "tools"\ndependencies = ["requests>=2.0", "bare"]\n',
    "py/main.py": "import requests\nfrom pkg import work\n\n\n@work.mark\ndef run():\n    work.act()\n    requests.get()\n",
    "py/pkg/__init__.py": "",
    "py/pkg/work.py": "def act():\n    pass\n\n\ndef mark(f):\n    return f\n",
    "jv/pom.xml": "<project><parent><artifactId>top</artifactId></parent><artifactId>lib</artifactId><dependencies><dependency><groupId>org.kit.core.x</groupId><artifactId>y</artifactId><version>9</version></dependency></dependencies></project>",
    "jv/src/A.java": "package a;\nimport b.B;\nimport org.kit.core.Z;\npublic class A extends Base {\n  public void run() { B.act(); help(); }\n  void help() {}\n}\n",
    "jv/src/Base.java": "package a;\npublic class Base {}\n",
    "jv/src/B.java": "package b;\npublic class B {\n  public static void act() {}\n}\n",
    "rs/Cargo.toml": '[package]\nname = "rs"\n\n[dependencies]\nserde = "1.0"\nfar = { git = "x" }\n',
    "rs/src/lib.rs": "mod sub;\nuse crate::sub::Thing;\nuse serde::Serialize;\n\npub fn run() {\n    sub::act();\n    Thing::make();\n}\n\n#[cfg(test)]\nmod tests {\n    #[test]\n    fn checks() {\n        super::run();\n    }\n}\n",
    "rs/src/sub.rs": "pub struct Thing;\n\nimpl Thing {\n    pub fn make() {}\n}\n\npub fn act() {}\n",
    "node_modules/left/package.json": '{"name": "left", "version": "1.2.9"}',
    ".gitignore": "gen/\n",
    "gen/x.ts": "export const x = 1;\n",
    "build/y.ts": "export const y = 1;\n",
}


def plant(folder, files):
    for name, text in files.items():
        p = folder / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(folder)


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    root = plant(tmp_path_factory.mktemp("tree"), TREE)
    graph = codegraph.build(spark, root)
    path = root + "/map.json"
    codegraph.write_document(graph, path)
    return root, graph, json.loads(open(path).read())


def test_document(whole):
    _, _, d = whole
    ids = [n["id"] for n in d["nodes"]]
    assert ids == sorted(ids) and list(d) == ["schemaVersion", "nodes", "edges", "modules", "languages", "warnings"]
    assert not any(i.startswith(("gen", "build", "node_modules")) or "test" in i for i in ids)
    assert {"app", "app/a", "py/pkg", "svc/util", "jv/src", "rs/src"} <= set(ids)
    assert d["warnings"] == ["Skipped unparseable file: app/b/bad.ts"] and d["languages"] == ["go", "java", "python", "rust", "typescript"]
    outside = {(n["id"], n["version"]) for n in d["nodes"] if n["kind"] == "external"}
    assert outside == {("left", "1.2.9"), ("real", "2.0.0"), ("example.org/kit", "v1.2.3"), ("requests", ">=2.0"), ("org.kit.core.x:y", "9"), ("serde", "1.0")}


def test_imports(whole):
    edges = {(e["source"], e["target"]): e for e in whole[2]["edges"] if e["type"] == "import"}
    assert set(edges) == {
        ("app/a/one.ts", "app/b/all.ts"), ("app/a/one.ts", "left"), ("app/a/two.ts", "app/a/one.ts"), ("app/a/two.ts", "real"), ("app/b/all.ts", "app/b/deep.ts"), ("app/a/three.ts", "app/b/deep.ts"),
        ("svc/main.go", "example.org/kit"), ("svc/main.go", "svc/util/util.go"), ("py/main.py", "requests"), ("py/main.py", "py/pkg/work.py"),
        ("jv/src/A.java", "jv/src/B.java"), ("jv/src/A.java", "jv/src/Base.java"), ("jv/src/A.java", "org.kit.core.x:y"), ("rs/src/lib.rs", "rs/src/sub.rs"), ("rs/src/lib.rs", "serde"),
    }
    assert len(edges["app/a/three.ts", "app/b/deep.ts"]["locations"]) == 2  # @b/deep by pattern, @b/all by name
    assert edges["app/b/all.ts", "app/b/deep.ts"]["viaReExport"] and len(edges["rs/src/lib.rs", "rs/src/sub.rs"]["locations"]) == 2


def test_calls(whole):
    assert {(e["source"], e["target"]) for e in whole[2]["edges"] if e["type"] == "call"} == {
        ("app/a/one.ts#run", "app/b/deep.ts#help"), ("app/a/two.ts#go", "app/a/one.ts#run"), ("app/b/deep.ts#area", "app/b/deep.ts#help"), ("app/a/three.ts#far", "app/b/deep.ts#help"),
        ("app/b/tool.ts#use", "app/b/tool.ts#help"), ("app/b/tool.ts#use", "app/b/tool.ts#make"), ("app/b/tool.ts#use", "app/b/tool.ts#turn"), ("app/b/tool.ts#use", "app/b/tool.ts#turn#2"),
        ("svc/main.go#Main", "svc/util/util.go#Do"), ("py/main.py#run", "py/pkg/work.py#act"), ("py/main.py#run", "py/pkg/work.py#mark"),
        ("jv/src/A.java#run", "jv/src/B.java#act"), ("jv/src/A.java#run", "jv/src/A.java#help"), ("rs/src/lib.rs#run", "rs/src/sub.rs#act"), ("rs/src/lib.rs#run", "rs/src/sub.rs#make"),
    }


def test_filters(whole):
    _, graph, _ = whole
    got = lambda **k: {r["id"] for r in graph.filter(**k)[0].collect()}
    assert got(path="svc/util") == {"svc", "svc/util", "svc/util/util.go"} | {f"svc/util/util.go#{n}" for n in ("T", "Do", "Act")}
    assert got(search="HELP") == {".", "app", "app/b", "app/b/deep.ts", "app/b/deep.ts#help", "app/b/tool.ts", "app/b/tool.ts#help", "app/b/tool.ts#help#2", "jv", "jv/src", "jv/src/A.java", "jv/src/A.java#help"}
    assert got(path="app/b/deep.ts@go") == set() and "." in got(path="app@npm")
    assert got(path="") == set() and len(got()) == graph.nodes.count()
    nodes, edges, modules = graph.filter(symbol_kind="class")
    assert edges.count() == 2 and modules.count() == graph.modules.count()  # imports among the three files of java


def test_cache_and_generate(spark, tmp_path):
    root = plant(tmp_path / "r", {k: v for k, v in TREE.items() if k.startswith("py/")})
    first = codegraph.generate(spark, root)
    plant(tmp_path / "r", {"py/pkg/work.py": "def mark(f):\n    return f\n"})
    second = codegraph.generate(spark, root)
    fresh = codegraph.generate(spark, root, force=True)
    assert second == fresh and second["nodeCount"] == first["nodeCount"] - 1 and second["edgeCount"] == first["edgeCount"] - 1
    (tmp_path / "r/.tessera/cache.json").write_text("no json")
    assert codegraph.generate(spark, root) == fresh


def test_a_lockfile_is_part_of_the_epoch(spark, tmp_path):
    from tessera.operators import graph as G

    files = [("a/package.json", "1"), ("a/yarn.lock", "2")]
    at = lambda rows: G.epoch(spark.createDataFrame(rows, "path string, content_hash string"), "s").first()["epoch"]
    assert at(files) == at(files[::-1]) != at([files[0], ("a/yarn.lock", "3")])
    plant(tmp_path, {"package.json": "{}", "yarn.lock": "", "go.sum": "", "tsconfig.json": "{}", "x/tsconfig.json": "{}", "notes.lock": ""})
    assert sorted(tree.walk(str(tmp_path), [])) == ["go.sum", "package.json", "tsconfig.json", "yarn.lock"]


def test_lines_of_a_run_share_its_id(spark, tmp_path, capsys):
    import logging

    from tessera.plans import observability

    handlers, propagate = list(observability.log.handlers), observability.log.propagate
    try:
        observability.handle()
        codegraph.generate(spark, plant(tmp_path, {k: v for k, v in TREE.items() if k.startswith("app/") or k == "package.json"}))
        with pytest.raises(ValueError), observability.stage("broken"):
            raise ValueError("no\nmore")
    finally:
        observability.log.handlers, observability.log.propagate = handlers, propagate
        observability.log.setLevel(logging.NOTSET)
    out, err = capsys.readouterr()
    lines = [json.loads(x) for x in err.splitlines() if x.startswith("{")]
    assert out == "" and len({x["runId"] for x in lines if x.get("stage") != "broken"}) == 1
    ends = {x["stage"]: x for x in lines if x["message"] == "stage complete"}
    assert list(ends) == ["discovery", "extraction", "assembly", "document"] and all(x["durationMs"] >= 0 for x in ends.values())
    assert ends["extraction"]["languages"] == {"typescript": {"files": 7, "extracted": 6, "skipped": 1}}
    assert lines[-1] | {"timestamp": "", "durationMs": 0} == {"timestamp": "", "level": "error", "message": "stage failed", "stage": "broken", "durationMs": 0, "error": "no"}


def test_aliases(tmp_path):
    at = lambda files: tree.aliases(plant(tmp_path / str(len(list(tmp_path.iterdir()))), files))
    own = '{"extends": "./up.json", "compilerOptions": {"paths": {"x": ["./src/x", 1], "bad": 2, "u//v/*": ["w//*,]"],},},}'
    assert at({"tsconfig.json": own, "up.json": '{"compilerOptions": {"paths": {"y": ["y"]}}}'}) == [("x", ["src/x"]), ("u//v/*", ["w/*,]"])]
    assert at({"tsconfig.json": '{"extends": ["./a.json", "./c/b"]}', "a.json": '{"compilerOptions": {"paths": {"y": ["y"]}}}', "c/b.json": '{"compilerOptions": {"paths": {"z": ["z"]}}}'}) == [("z", ["c/z"])]
    assert at({"tsconfig.json": '{"extends": "./tsconfig.json"}'}) == at({"tsconfig.json": "{"}) == at({"tsconfig.json": "[]"}) == at({"a": ""}) == []
    got = [("@/*", ["src/*"]), ("@/in/*", ["in/*", "other/*.x"]), ("*.css", ["css"]), ("@/in/one", ["one.ts"])]
    to = lambda spec: script_source.aliased(spec, got)
    assert to("@/a/b") == ["src/a/b"] and to("@/in/b") == ["in/b", "other/b.x"] and to("@/in/one") == ["one.ts"]
    assert to("x.css") == ["css"] and to("left") == [] and to("@") == [] and script_source.aliased("x", []) == []


def test_empty_tree(spark, tmp_path):
    g = codegraph.build(spark, plant(tmp_path / "e", {"readme.md": "x"}))
    codegraph.write_document(g, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"schemaVersion": "1.3.0", "nodes": [], "edges": [], "modules": [], "languages": [], "warnings": []}


def symbols(name, language, text):
    return [(s["local_id"], s["symbol_kind"], s["exported"]) for s in record(name, language, text, "", None)["symbols"]]


def test_parsers():
    assert symbols("a.py", "python", "class A:\n  def f(self): pass\n  class B:\n    def f(self): pass\nx, _y = 1, 2\n") == [("A", "class", True), ("f", "method", True), ("B", "class", True), ("f#2", "method", True), ("x", "const", True), ("_y", "const", False)]
    assert symbols("a.go", "go", "package a\nconst (\n A = 1\n b = f()\n)\ntype I interface{ M() }\nvar c, D = 1, 2\n") == [("A", "const", True), ("b", "const", False), ("I", "interface", True), ("c", "const", False), ("D", "const", True)]
    assert symbols("A.java", "java", "enum E { X(1) { void q() {} }; E(int i) {} int f = g(); @Ann(1) public int g() { return 1; } }") == [("E", "enum", False), ("E#2", "method", False), ("g", "method", True)]
    assert symbols("a.rs", "rust", "pub trait T { fn a(); }\nstruct S;\nimpl T for S { fn a() {} }\nmod m { pub const C: [u8; 2] = [1, 2]; }\n")[:3] == [("T", "interface", True), ("S", "type", False), ("a", "method", False)]
    assert symbols("a.ts", "typescript", "export default function () {}\nlet no = 1;\nexport type U = A | B;\nconst f = async (x) => x, k = 2;\nclass C { get g() { return 1 } p = 1; async m<T>(a: T): Promise<T> { return a } }\nenum E { A }\n") == [
        ("default", "function", True), ("U", "type", True), ("f", "function", False), ("k", "const", False), ("C", "class", False), ("m", "method", False), ("E", "enum", False),
    ]
    for language, text in {"python": "def f(:", "go": "package a\nfunc f( {", "java": "class {", "rust": "fn f( {", "typescript": "`${"}.items():
        assert not record("x", language, text, None, None)["ok"]


def test_manifests():
    read = lambda p, t: manifests.read(p, t, None)
    # no package where its table is missing; the directory's name where only the name is missing or the file is broken
    assert read("a/pyproject.toml", "[tool.poetry]\nname = 'x'")["name"] is None and read("a/Cargo.toml", "[workspace]\nmembers = []")["name"] is None
    for path, text in {"package.json": "{", "go.mod": "go 1.22\n", "pom.xml": "<project></project>", "Cargo.toml": "[package]\nversion = \"1\"", "pyproject.toml": "[project]\nname = 'x'", "build.gradle": ""}.items():
        assert read(f"b/a/{path}", text)["name"] == "a"
    assert read("a/package.json", '{"name": 3, "devDependencies": {"x": "1"}, "dependencies": {"x": "2", "y": "a/b"}}')["name"] == "a"
    assert [(d["name"], d["version"]) for d in read("a/package.json", '{"devDependencies": {"x": "1"}, "dependencies": {"x": "2", "y": "a/b"}}')["deps"]] == [("x", "2")]
    assert read("a/build.gradle", "implementation 'g.h:i:1'\nimplementation \"g:a:${v}\"")["deps"] == [{"ord": 0, "key": "g.h", "name": "g.h:i", "version": "1"}]
    pom = "<project><parent><groupId>g</groupId><artifactId>top</artifactId></parent>\n<artifactId>\n own </artifactId><dependency><groupId>g</groupId><artifactId>x</artifactId></dependency><dependency><groupId>g</groupId><artifactId> y </artifactId><version>${v}</version></dependency></project>"
    assert read("a/pom.xml", pom)["name"] == "own" and [(d["name"], d["version"]) for d in read("a/pom.xml", pom)["deps"]] == [("g:y", "${v}")]


def test_walk_and_config(tmp_path):
    plant(tmp_path, {"a.ts": "", "x/.ts": "", "x/b.py": "", "x/c.txt": "", "out/d.go": "", "k/dist/e.ts": ""})
    (tmp_path / "link.ts").symlink_to(tmp_path / "a.ts")
    assert sorted(tree.walk(str(tmp_path), ["out/**", "**/dist/**"])) == ["a.ts", "x/b.py"]
    (tmp_path / "tessera.config.json").write_text('{"exclud": []}')
    with pytest.raises(ValueError):
        tree.config(str(tmp_path))
    assert main(["generate", "--nope"]) == 1 and main(["read", "--path"]) == 1
    rules = tree.ignore_rules("*.log\n!keep.log\n/top\nsub/\n")
    assert tree.ignored("a/x.log", False, rules) and not tree.ignored("keep.log", False, rules)
    assert tree.ignored("top", False, rules) and not tree.ignored("a/top", False, rules) and tree.ignored("a/sub", True, rules) and not tree.ignored("sub", False, rules)


def row(m, common, children=(), package=None, name=None, tests=False):
    return {"module_id": m, "common": common, "breadth": len(children), "children": list(children), "tests": tests, "package": package, "package_name": name}


def test_names():
    assert naming.settle([row(0, ["src", "a"]), row(1, ["src", "b"])], "src") == {0: "a", 1: "b"}
    assert naming.settle([row(0, ["p", "x"]), row(1, ["p", "y"])], None) == {0: "x", 1: "y"}
    assert naming.settle([row(0, ["a", "x"]), row(1, ["a", "x"]), row(2, [], ["u", "v"])], None) == {0: "x-1", 1: "x-2", 2: "u+v"}
    assert naming.settle([row(5, [], "abcde", ".", "root")], None) == {5: "root"}
    assert naming.settle([row(1, ["t"], tests=True), row(2, ["tests"])], None) == {1: "tests-1", 2: "tests-2"}


def test_refinement_needs_two_parts():
    tri = lambda a: ([f"{a}1", f"{a}1", f"{a}2"], [f"{a}2", f"{a}3", f"{a}3"])
    (a1, b1), (a2, b2) = tri("x"), tri("y")
    got = judged([*"z"], a1 + a2, b1 + b2, [1.0] * 6)
    assert len({c for c, _ in got.values() if c is not None}) == 2 and got["z"] == (None, "isolated")
    assert {r for _, r in judged([], a1, b1, [1.0] * 3).values()} == {"degenerate-partition"}
