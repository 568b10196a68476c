import random

from pyspark.sql import functions as F

from changeloom.operators import definitions as D

FILES = "path string, language string, source string"


def nested(r, language, depth=0, lines=None, found=None, parent=None, kind=None):
    """Random code of nested classes and functions, with what it defines: [kind, name, start, end, parent]."""
    lines, found = [] if lines is None else lines, [] if found is None else found
    pad = "  " * depth
    for _ in range(r.randrange(1, 4)):
        what = r.choice(["class", "def", "line", "text", "blank"]) if depth < 4 else "line"
        name = f"n{len(found)}"
        if what in ("class", "def") and not (what == "class" and kind == "def"):
            start, at = len(lines) + 1, len(found)
            found.append([what, name, start, 0, parent])
            if language == "python":
                lines += [f"{pad}class {name}:"] if what == "class" else r.choice([[f"{pad}def {name}(a, b):"], [f"{pad}def {name}(", f"{pad}a,", "b):"]])
                lines.append(f'{pad}  """doc')
                lines.append('class No: {"""')
            elif what == "class":
                lines += r.choice([[f"{pad}class {name} {{"], [f"{pad}class {name}", f"{pad}{{"]])
            else:
                lines += r.choice([[f"{pad}{name}(a, b) {{ // {{"], [f"{pad}{name}(a, b) {{", f"{pad}  if (a) {{ go('}}'); }} else {{ }}"]]) if kind == "class" else [f"{pad}function {name}(a, b) {{"]
            nested(r, language, depth + 1, lines, found, at + 1, what)
            if language != "python":
                lines.append(f"{pad}}}")
            while not lines[-1].strip():
                lines.pop()
            found[at][3] = len(lines)
        elif what == "text":
            lines.append(f"{pad}x = '}} def no(): {{ class'" + r.choice(["", " # {" if language == "python" else " /* { */"]))
        elif what == "blank":
            lines += ["", pad + "y = 1"]
        else:
            lines.append(f"{pad}call(n0, 1)")
    return lines, found


def test_containment_brute_force(spark):
    r = random.Random(2)
    made = [(lang, *nested(r, lang)) for lang in ("python", "typescript") for _ in range(60)]
    df = spark.createDataFrame([(str(i), lang, "\n".join(lines)) for i, (lang, lines, _) in enumerate(made)], FILES).repartition(4)
    got = {}
    for x in D.definitions(df, ["path"]).collect():
        got.setdefault(int(x.path), []).append((x.d, "class" if x.kind == "class" else "def", x.name, x.start, x.end, x.parent, x.kind, x.scope, x.owner))
    for i, (lang, lines, found) in enumerate(made):
        mine = sorted(got.get(i, []))
        assert [list(m[1:6]) for m in mine] == found, (lang, "\n".join(lines))
        for m in mine:
            up = found[m[5] - 1] if m[5] else None
            assert m[6] == ("class" if m[1] == "class" else "method" if up and up[0] == "class" else "local" if up else "function")
            assert m[7] == (up[1] if m[6] == "local" else None) and m[8] == (up[1] if up and up[0] == "class" else None)


def test_languages(spark):
    cases = {
        "c": ("int add(int a, char **b)\n{\n  return a;\n}\nstatic void no(void) { x(); }\nint use = add(1, 2);\n", [("add", 1, 4, "a int, b char **", True), ("no", 5, 5, "", False)]),
        "go": ("func init() {\n}\nfunc (s *T) get(a, b int, c ...string) error {\n}\nfunc Plain(int, string) {}\n", [("init", 1, 2, "", True), ("get", 3, 4, "a int, b int, c ...string", False), ("Plain", 5, 5, "int int, string string", True)]),
        "java": ("class A {\n  @Override\n  public Map<String, Integer> m(final int a, List<? extends T> b, int... c)\n  {\n    return n(a);\n  }\n}\n", [("A", 1, 7, "", True), ("m", 3, 6, "a int, b List<? extends T>, c int...", True)]),
        "rust": ("#[no_mangle]\nfn seen(x: Vec<(u8, i32)>) {}\nimpl<T> Show for Box<T> {\n    fn m(&mut self, mut a: &'a str) {\n    }\n}\nfn hidden() -> i32 {\n}\n", [("seen", 2, 2, "x Vec<(u8, i32)>", True), ("m", 4, 5, "a &'a str", True), ("hidden", 7, 8, "", False)]),
        "csharp": ("namespace N {\n  public record R(int A);\n  class C {\n    private async Task<int> M(this string s, int b = 1, params int[] c) => b;\n  }\n}\n", None),
        "php": ("<?php\nclass A {\n  public function m(?int $a = null, string ...$b): int {\n  }\n}\n", [("A", 2, 5, "", True), ("m", 3, 4, "a ?int ?, ...b string", True)]),
        "ruby": ("module M\n  def self.f(a, *r, k: 1)\n    x\n  end\n\n  def g\n  end\nend\n", [("M", 1, 8, "", True), ("f", 2, 4, "a, *r, k keyword ?", True), ("g", 6, 7, "", True)]),
        "kotlin": ("private fun f(vararg a: Int) = 1\nfun g(b: String = \"x\") {\n}\n", [("f", 1, 1, "a vararg Int", False), ("g", 2, 3, "b String ?", True)]),
        "scala": ("object O {\n  private def f(a: Int, b: String = \"\"): Int = {\n    1\n  }\n}\n", [("O", 1, 5, "", True), ("f", 2, 4, "a Int, b String ?", False)]),
        "python": ("@deco\ndef f(self, a: int = 1, *r, **k) -> int:\n    '''x\ny = 2\n'''\n    return 1\n\n\nz = 1\ndef _g(): pass\n", [("f", 2, 6, "a int ?, *r, **k", True), ("_g", 10, 10, "", False)]),
    }
    df = spark.createDataFrame([(k, k, s) for k, (s, _) in cases.items()] + [("none", "python", None), ("empty", "go", ""), ("other", "cobol", "x")], FILES)
    out = D.definitions(df, ["path"]).withColumn("p", F.array_join(F.transform("params", lambda p: F.concat_ws(" ", p["name"], p["type"], F.when(p["optional"], "?"))), ", ")).orderBy("path", "d").collect()
    for k, (_, want) in cases.items():
        if want is not None:
            assert [(x.name, x.start, x.end, x.p, x.exported) for x in out if x.path == k] == want, k
    assert {x.path for x in out} <= set(cases)


def test_fields_members_and_locals(spark):
    old = "class A {\n  n: number = 1;\n  gone: string;\n  get(a) { return a; }\n  put(b) { return b + 1; }\n  same() { x(); }\n  same() { y(); }\n  run() {\n    const f = (a) => a;\n    const g = (a) => 1;\n    const g = (a) => 2;\n  }\n}\n"
    new = "class A {\n  n: string = 1;\n  add: string;\n  fetch(a) { return a; }\n  put(b) { return b + 2; }\n  same() { x(); }\n  same() { y( ); }\n  other() {}\n  run() {\n    const f = (a, b) => a;\n    const g = (a) => 1;\n  }\n}\n"
    make = lambda s: spark.createDataFrame([("a.ts", "typescript", s)], FILES)
    o, n = (D.definitions(make(s), ["path"]) for s in (old, new))
    names = lambda d: {r.d: r.name for r in d.collect()}
    on, nn = names(o), names(n)
    got = sorted((on.get(r.old_d, ""), nn.get(r.new_d, ""), r.match) for r in D.match_members(o, n, ["path"]).collect())
    assert got == [("", "other", "added"), ("get", "fetch", "renamed"), ("put", "put", "modified"), ("run", "run", "modified"), ("same", "same", "same"), ("same", "same", "same")]
    assert [(r.scope, r.name, len(r.old_params), len(r.new_params)) for r in D.match_locals(o, n, ["path"]).collect()] == [("run", "f", 1, 2)]
    assert sorted(tuple(r)[1:] for r in D.bodies(o, n, ["path"]).collect()) == [(5, 5, 5, 5), (6, 6, 6, 6), (7, 7, 7, 7), (8, 12, 9, 12)]
    of, nf = (D.fields(make(s), ["path"]) for s in (old, new))
    assert [(r.owner, r.name, r.type, r.line) for r in of.orderBy("line").collect()] == [("A", "n", "number", 2), ("A", "gone", "string", 3)]
    assert [tuple(r)[1:] for r in D.retyped_fields(of, nf, ["path"]).collect()] == [("A", "n", "number", "string")]
    for none in (D.match_members(o.limit(0), n.limit(0), ["path"]), D.bodies(o.limit(0), n, ["path"]), D.fields(make(""), ["path"])):
        assert none.count() == 0
