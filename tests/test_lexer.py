import random
import re

from pyspark.sql import functions as F

from changeloom.functions import arguments, lexer, references
from changeloom.functions import signatures as S
from changeloom.operators import impacts

PATHS = {"python": "a.py", "typescript": "a.ts", "rust": "a.rs", "kotlin": "a.kt", "csharp": "a.cs", "ruby": "a.rb", "go": "a.go"}


class Scanner:
    """Blanks texts and comments one character after the other."""

    def __init__(self, text, language):
        self.s, self.lang, self.i, self.out = text, language, 0, []

    def at(self, k=0):
        return self.s[self.i + k] if 0 <= self.i + k < len(self.s) else ""

    def keep(self, n=1):
        self.out.append(self.s[self.i : self.i + n])
        self.i += n

    def blank(self, n=1):
        self.out.append("".join(c if c == "\n" else " " for c in self.s[self.i : self.i + n]))
        self.i += n

    def run(self):
        while self.i < len(self.s):
            c = self.at()
            if c == "/" and self.at(1) == "/" or c == "#" and not (self.i and self.at(-1) == ".") and self.at(1) not in ("[", "!", "{"):
                while self.at() not in ("", "\n"):
                    self.blank()
            elif c == "#" and self.at(1) == "":
                self.blank()
            elif c == "/" and self.at(1) == "*":
                self.blank(2)
                while self.i < len(self.s) and self.s[self.i : self.i + 2] != "*/":
                    self.blank()
                self.blank(2)
            elif c in "\"'`" and not (c == "'" and self.i and re.match(r"[&<\w]", self.at(-1))):
                self.string(c)
            else:
                self.keep()
        return "".join(self.out)

    def string(self, c):
        n = 3 if self.s[self.i : self.i + 3] == c * 3 and c != "`" else 1
        before = self.s[: self.i].rsplit("\n", 1)[-1]
        prefix = re.search(r"[A-Za-z]*$", before).group().lower()
        f = c != "`" and re.fullmatch("[frb]{1,2}", prefix) and "f" in prefix or self.lang == "csharp" and c == '"' and "$" in re.search(r"[$@]*$", before).group()[-2:]
        dollar = c == "`" or self.lang == "kotlin" and c == '"'
        self.keep(n)
        while self.i < len(self.s):
            two = self.s[self.i : self.i + 2]
            name = re.match(r"\$[^\W\d]\w*", self.s[self.i :])
            if self.s[self.i : self.i + n] == c * n:
                return self.keep(n)
            if self.at() == "\n" and n == 1 and c != "`":
                return None
            if self.at() == "\\" and self.at(1):
                self.blank(2)
            elif dollar and c == '"' and name:
                self.keep(name.end())
            elif f and two == "{{":
                self.blank(2)
            elif dollar and two == "${" or self.lang == "ruby" and c == '"' and two == "#{":
                self.keep(2)
                self.code()
            elif f and self.at() == "{":
                self.keep()
                self.code()
            else:
                self.blank()
        return None

    def code(self):
        depth = 1
        while self.i < len(self.s):
            c = self.at()
            line = self.s[self.i + 1 :].split("\n")[0]
            if c == "`":
                self.keep()
                while self.i < len(self.s) and self.at() != "`":
                    if self.at() == "\\" and self.at(1):
                        self.blank(2)
                    elif self.s[self.i : self.i + 2] == "${":
                        self.keep(2)
                        self.code()
                    else:
                        self.blank()
                self.keep()
            elif c in "\"'" and (m := re.match(rf"(?:\\.|[^\\{c}])*{c}", line)):
                self.keep()
                self.blank(m.end() - 1)
                self.keep()
            else:
                depth += (c == "{") - (c == "}")
                self.keep()
                if not depth:
                    return


def test_blanking_is_that_of_a_scanner(spark):
    r = random.Random(3)
    bits = ['"', "'", "`", '"""', "{", "}", "${", "#{", "{{", "#", "//", "/*", "*/", "\\", "\n", "\n", " ", "ab", "é1", "$x", "f", "$", "&", ".", "[", "x = ", "(", ")", 'f"', '$"', "日"]
    rows = [(k, x) for k in PATHS for x in ["", "a", '""', "''''", '"""a"', "// x", "/* a", "a */ b", "#", "#{x}", "'a", "x.#p # q"]]
    rows += [(k, "".join(r.choice(bits) for _ in range(r.randrange(1, 40)))) for k in PATHS for _ in range(120)]
    # an escape at the very end, or a quote in code that only an escaped one follows, is cut off in other ways: not asked for here
    rows = [(k, x) for k, x in rows if not re.search(r"\\[\"'`\\]|\\$|\\\n", x)]
    df = spark.createDataFrame([(k, x, i) for i, (k, x) in enumerate(rows)], "language string, source string, _ls int").repartition(4)
    got = {(r.language, r.source): r.code for r in lexer.code_only(df).collect()}
    for k, x in rows:
        assert got[k, x] == Scanner(x, k).run(), (k, x)
        assert len(got[k, x]) == len(x)


def test_blanking_edges(spark):
    df = spark.createDataFrame([("python", None), ("python", ""), (None, "x # y"), ("python", "x = '\\'' + y # z"), ("typescript", 'a = "\\\nb" + c'), ("python", "w " * 60000 + '"t" # c')], "language string, source string")
    got = [r.code for r in lexer.code_only(df).collect()]
    assert got[:5] == [None, "", "x    ", "x = '  ' + y    ", 'a = " \n " + c'] and got[5] == "w " * 60000 + '" "    '
    assert lexer.code_only(df.limit(0)).count() == 0


def test_line_facts(spark):
    src = "#!/bin/sh\n# type: ignore\nx = 1  # noqa\n'''doc\n# not a comment\n'''\n//go\n"
    df = spark.createDataFrame([("p", "python", src), ("c", "c", "#define A \\\n  1\n// a\n/* b\n c */ d\n#if X\n"), ("r", "python", None), ("e", "python", "")], "k string, language string, source string")
    got = {(r.k, r.line_no): r for r in lexer.line_facts(df, ["k"]).collect()}
    flag = lambda k, name: [n for (x, n), r in sorted(got.items()) if x == k and r[name]]
    assert flag("p", "comment") == [2] and flag("p", "in_string") == [5, 6] and flag("p", "directive") == [2] and len([1 for k, _ in got if k == "p"]) == 7
    assert flag("c", "comment") == [3, 4] and flag("c", "define") == [1, 2] and not [1 for k, _ in got if k in "re"]


def arguments_of(text, language):
    """The calls of bracketed text, by recursion; names only."""
    out = []
    for m in re.finditer(r"([A-Za-z_]\w*) ?\(", text):
        depth, parts, cur, end = 0, [], "", None
        for i in range(m.end(), len(text)):
            c = text[i]
            if c in "([{":
                depth += 1
            if c in ")]}":
                if not depth:
                    end = i
                    break
                depth -= 1
            if c == "," and not depth:
                parts.append(cur)
                cur = ""
            else:
                cur += c
        if end is None:
            continue
        parts = [p.strip() for p in parts] + ([cur.strip()] if cur.strip() else [])
        spread = [p for p in parts if p.startswith("...") or p.startswith("*") and language in ("python", "kotlin", "ruby") or language == "go" and p.endswith("...")]
        mark = r"(\w+)\s*:(?!:)" if language in ("csharp", "ruby") else r"(\w+)\s*=(?![=>])"
        rest = [p for p in parts if p not in spread and not (language == "ruby" and p.startswith("&"))]
        keys = [re.match(mark, p).group(1) for p in rest if re.match(mark, p)]
        block = language == "kotlin" and re.match(r"[ \t]*\{", text[end + 1 :]) is not None
        out.append((m.group(1), text[: m.start()].count("\n") + 1, len(rest) - len(keys) + block, keys, bool(spread), text[m.start() : end].count("\n")))
    return out


def test_arguments_brute_force(spark):
    r = random.Random(8)

    def term(depth):
        k = r.randrange(9 if depth else 4)
        inner = lambda: ", ".join(arg(depth - 1) for _ in range(r.randrange(4)))
        return [r.choice("abc"), "1", "x == y", "a => b"][k] if k < 4 else [f"f{k}({inner()})", f"g ({inner()})", f"[{inner()}]", "{" + inner() + "}", f"o.h({inner()}) {{ z }}"][k - 4]

    def arg(depth):
        return r.choice(["", "", "", "k = ", "k: ", "*", "...", "&", "\n "]) + term(depth) + r.choice(["", "", "", "..."])

    rows = [(k, "\n".join(term(3) for _ in range(4))) for k in PATHS for _ in range(40)] + [("go", ""), ("go", "f(a"), ("go", "f(a,\n)"), ("go", "))f(")]
    got = arguments.calls(spark.createDataFrame(rows, "language string, code string").repartition(3)).collect()
    assert len(got) == len(rows)
    for x in got:
        assert [(c.name, c.line, c.positional, c.keywords, c.spread, c.lines) for c in x.calls] == arguments_of(x.code, x.language), (x.language, x.code)
    assert arguments.calls(spark.createDataFrame([("go", None)], "language string, code string")).first().calls is None


def test_what_still_fits(spark):
    def params(words):
        return [(w.rstrip("?").split(":")[0], w.rstrip("?").split(":")[1] if ":" in w else None, w.endswith("?")) for w in words.split()]

    cases = [
        ("a.py", "a", "a b", 1, [], False, False), ("a.py", "a", "a b?", 1, [], False, True), ("a.py", "a", "a b", 1, ["b"], False, True), ("a.py", "a b", "a", 2, [], False, False),
        ("a.py", "a", "a", 1, [], True, False), ("a.py", "a", "a **k", 1, ["z"], False, True), ("a.py", "a", "a", 1, ["z"], False, False), ("a.py", "a b", "a *r", 2, [], False, True),
        ("a.py", "a", "c", 1, [], False, False), ("a.ts", "a", "c", 1, [], False, True), ("a.ts", "a b", "b a", 2, [], False, False), ("a.ts", "a:int", "a:str", 1, [], False, False),
        ("a.go", "a:int", "a:int b:...string", 3, [], False, True), ("a.go", "a:int", "a:int b:...string", 1, [], False, True), ("a.rb", "a o", "a o", 1, ["x"], False, True), ("a.rb", "a k:keyword", "a k:keyword", 1, ["k"], False, True),
        ("a.cs", "a", "a r:params", 1, [], False, False), ("a.py", "", "", 0, [], False, True), ("a.py", "", "a?", 0, [], False, True),
    ]
    rows = [(i, p, params(o), params(n), (k, keys, s)) for i, (p, o, n, k, keys, s, _) in enumerate(cases)]
    kind = "array<struct<name:string,type:string,optional:boolean>>"
    df = spark.createDataFrame(rows, f"i int, path string, old {kind}, new {kind}, call struct<positional:int,keywords:array<string>,spread:boolean>")
    got = dict(df.select("i", S.still_fits(F.col("old"), F.col("new"), F.col("call"), F.col("path"))).collect())
    for i, c in enumerate(cases):
        assert got[i] == c[-1], c
    one = lambda words: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).cast("string").alias("type"), F.lit(o).alias("optional")) for n, t, o in params(words)]).cast(kind)
    breaks = [("a.py", "a *r", "a", True), ("a.py", "a", "a *r", False), ("a.py", "a **k", "a **kw", False), ("a.py", "a", "a b?", False), ("a.ts", "a ...r", "a b? ...r", False), ("a.c", "*a", "*a b", True)]
    row = spark.range(1).select(*[S.breaks_callers(one(o), one(n), F.lit(p)).alias(f"c{i}") for i, (p, o, n, _) in enumerate(breaks)]).first()
    assert list(row) == [b for *_, b in breaks]


def test_impacts(spark):
    src = {"lib/f.py": "def f(a, b):\n    return f(1)\n", "lib/x/u.py": "f(1, 2)\nf.f(1,\n  2)\nf(*a)\ny.f(3)\n'f(9)' # f(8)\n", "far/f.py": "def f(q):\n    pass\n", "far/v.py": "f(1, 2)\n", "a.js": "g(1)\ng()\n", "b.js": "h(1)"}
    files = spark.createDataFrame([(1, p, "python" if p.endswith("py") else "typescript", s) for p, s in src.items()] + [(2, "n.py", "python", None)], "change_id long, path string, language string, source string")
    calls = impacts.call_table(files, ["change_id", "path"])
    one = lambda *ns: [(n, None, False) for n in ns]
    kind = "array<struct<name:string,type:string,optional:boolean>>"
    changed = spark.createDataFrame([(1, "lib/f.py", "f", one("a"), one("a", "b"), True), (1, "lib/g.js", "g", one("a"), one("a", "b"), True), (1, "c.js", "h", one("a"), one(), False)], f"change_id long, path string, name string, old {kind}, new {kind}, exported boolean")
    definitions = spark.createDataFrame([(1, "lib/f.py", "f"), (1, "far/f.py", "f"), (1, "lib/g.js", "g"), (1, "c.js", "h")], "change_id long, path string, name string")
    added = spark.createDataFrame([(1, "lib/x/u.py", 3)], "change_id long, path string, line long")
    got = {(r.path, r.line): r.updated for r in impacts.call_impacts(changed, calls, definitions, added).collect()}
    # the far file's call is its neighbour's; a line of f.f's call was added, y.f is not the module's; plain JavaScript may leave an argument out; h is private
    assert got == {("lib/f.py", 2): False, ("lib/x/u.py", 1): False, ("lib/x/u.py", 2): True, ("lib/x/u.py", 4): False, ("a.js", 1): True, ("a.js", 2): True}
    none = impacts.call_impacts(changed.limit(0), calls, definitions)
    assert none.count() == 0 and impacts.stale(none).columns == ["change_id", "def_path", "name", "n_calls", "n_stale"]


def test_what_a_name_may_mean(spark):
    lit = lambda x: F.lit(x).cast("string")
    calls = [("", "f", "a/m.py", "b.py", False, True), ("m", "f", "a/m.py", "b.py", False, True), ("x", "f", "a/m.py", "b.py", False, False), ("a", "f", "a/index.ts", "b.ts", False, True), ("super", "T.f", "m.py", "m.py", False, False), ("x", "T.f", "m.py", "m.py", False, True), ("x", "T.f", "m.py", "b.py", False, False), ("x", "T.outer_sep", "m.py", "b.py", True, True), ("T", "T.f", "m.py", "b.py", False, True), ("U", "T.f", "m.py", "m.py", False, False), ("self", "T.f", "m.py", "b.py", False, False), ("self", "T::f", "m.rs", "m.rs", False, True), ("crate", "f", "m.rs", "b.rs", False, True), ("$t", "T::f", "m.rs", "m.rs", False, False)]
    row = spark.range(1).select(*[references.qualifier_ok(lit(q), lit(n), lit(d), lit(c), F.lit(u)).alias(f"c{i}") for i, (q, n, d, c, u, _) in enumerate(calls)]).first()
    assert [x for x, c in zip(row, calls, strict=True) if x != c[-1]] == [] and list(row) == [c[-1] for c in calls]
    gone = [("", "f", "a/m.py", False, True), ("a", "f", "a/m.py", False, True), ("line", "split", "a/m.py", False, False), ("", "T.f", "m.py", False, False), ("t", "T.f", "m.py", False, True), ("cls", "T.f", "m.py", False, True), ("w", "T.getOut", "m.py", True, True), ("W", "T.getOut", "m.py", True, False)]
    row = spark.range(1).select(*[references.reference_ok(lit(q), lit(n), lit(o), F.lit(u)).alias(f"c{i}") for i, (q, n, o, u, _) in enumerate(gone)]).first()
    assert list(row) == [g[-1] for g in gone]
    reach = [("a/x.go", "a/y.go", True), ("a/x.go", "b/y.go", False), ("a/x.rs", "a/b/y.rs", True), ("a/x.rs", "ab/y.rs", False), ("x.ts", "x.ts", True), ("x.ts", "y.ts", False), ("x.rs", "q/y.rs", True)]
    row = spark.range(1).select(*[references.private_reaches(lit(d), lit(c)).alias(f"c{i}") for i, (d, c, _) in enumerate(reach)]).first()
    assert list(row) == [x[-1] for x in reach]
    lines = [("fn f(x) {", "f", True), ("  f(x);", "f", False), ("class f:", "f", True), ("func (r *T) f() {", "f", True), ("static int f(int a) {", "f", True), ("if f(x) {", "f", False), ("return f(x)", "f", False), ("// fn f(", "f", False), ("def self.f", "f", True), ("x.f() {", "f", False), ("let f = 1", "f", True), ("fn g(", "f", False), ("val a$b = 1", "a$b", True)]
    df = spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(lines)], "i int, t string, n string")
    assert dict(df.select("i", references.defines(F.col("t"), F.col("n"))).collect()) == {i: x[-1] for i, x in enumerate(lines)}
