import random

from pyspark.sql import functions as F

from changeloom.operators import resolve

CTORS = {"__init__", "__new__", "constructor", "__construct"}


def stem(path):
    return path.rsplit("/", 1)[-1].split(".")[0]


def brute(nodes, calls, binds, fields, aliases, parents, words):
    """One change's edges, call by call."""
    by = {n["node"]: n for n in nodes}
    funcs = [n for n in nodes if n["kind"] != "class" and not n["test"]]
    owners = {f["owner"] for f in funcs if f["owner"]}

    def agreed(rows):
        got = {}
        for k, t in rows:
            got.setdefault(k, set()).add(t)
        return {k: next(iter(v)) for k, v in got.items() if len(v) == 1}

    alias = agreed((a, t) for a, t in aliases if a != t)

    def through(t):
        for _ in range(3):
            t = alias.get(t, t)
        return t

    bind, declared = agreed(((b[0], b[1]), b[2]) for b in binds), {(b[0], b[1]) for b in binds if b[3]}
    field = agreed(((o, f), t) for o, f, t in fields)
    up = {}
    for c, p in parents:
        up.setdefault(c, set()).add(p)

    def descends(t, root):
        todo, seen = [t], set()
        while todo:
            x = todo.pop()
            if x == root:
                return True
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
        return False

    in_file, in_node = {(p, w) for p, _, w in words}, {(k, w) for _, k, w in words if k is not None}
    out = set()
    for k, form, q, name in calls:
        me = by[k]
        mine = me["name"] if me["kind"] == "class" else me["owner"]

        def narrow(cs, me=me, k=k):
            folder = lambda p: p.rpartition("/")[0]
            for fits in (lambda f: (k, f["owner"]) in in_node, lambda f: folder(f["path"]) == folder(me["path"]), lambda f: f["path"] == me["path"]):
                some = [f for f in cs if fits(f)]
                cs = some or cs
            return cs

        sees = lambda f, me=me: f["path"] == me["path"] or (me["path"], stem(f["path"])) in in_file or (me["path"], f["owner"]) in in_file
        targets = []
        if form in ("none", "named"):
            targets += [f for f in narrow([f for f in funcs if f["owner"] == name and f["name"] in CTORS]) if sees(f)]
        named = [f for f in funcs if f["name"] == name]
        bound, exact = False, []
        if form == "self":
            exact = [f for f in named if f["owner"] and f["owner"] == mine]
        elif form in ("named", "path", "field"):
            t = field.get((mine, q)) if form == "field" else bind.get((k, q))
            t = through(t) if t else None
            if t and t not in owners and (form == "field" or form == "named" and (k, q) in declared):
                out |= {(k, f["node"]) for f in targets}
                continue
            bound = t in owners
            o = t if bound else q
            exact = [f for f in named if f["owner"] == o] or [f for f in named if not f["owner"] and stem(f["path"]) == o]
        elif form == "none":
            exact = [f for f in named if not f["owner"] or me["language"] not in ("rust", "go") and f["owner"] == mine or f["owner"] == name]
        settled, guessed, cs = bool(exact) and form not in ("none", "unknown"), False, exact
        if not exact and form == "self":
            cs = named
        if not exact and not bound and form in ("named", "field", "unknown"):
            if name in (resolve.BUILTIN if me["language"] in resolve.DYNAMIC else resolve.INTERFACE):
                cs = []
            else:
                cs, guessed = [f for f in named if f["owner"]] if form == "unknown" else named, True
        if not settled and (len(cs) > 4 or len(name) < 3):
            cs = []
        picked = [f for f in narrow(cs) if settled or sees(f)]
        if guessed and len(os_ := {f["owner"] for f in picked}) > 1 and not (None not in os_ and any(all(descends(o, r) for o in os_) for r in os_)):
            picked = []
        out |= {(k, f["node"]) for f in targets + picked}
    return {(a, b) for a, b in out if a != b and not (by[a]["path"] == by[b]["path"] and by[a]["start"] <= by[b]["start"] and by[b]["end"] <= by[a]["end"])}


def random_change(r):
    paths = ["a/one.py", "a/two.py", "b/one.py", "b/three.go"]
    types, names = ["Ta", "Tb", "Tc", "Td"], ["run", "stop", "go", "get", "String", "Ta", "__init__", "other"]
    nodes = []
    for i in range(r.randrange(4, 14)):
        path, kind = r.choice(paths), r.choice(["function", "method", "method", "class"])
        start = r.randrange(1, 30)
        nodes.append({"node": i, "path": path, "language": "go" if path.endswith("go") else "python", "kind": kind, "name": r.choice(types) if kind == "class" else r.choice(names), "owner": r.choice(types) if kind == "method" else None, "start": start, "end": start + r.randrange(0, 6), "test": r.random() < 0.1})
    some = lambda: r.randrange(len(nodes))
    variables = ["x", "y", "one", "Ta", "three"]
    calls = [(some(), r.choice(["none", "self", "named", "named", "field", "path", "unknown"]), r.choice([*variables, *types]), r.choice(names)) for _ in range(r.randrange(1, 14))]
    binds = [(some(), r.choice(variables), r.choice([*types, "Al", "Am", "Out"]), r.random() < 0.5) for _ in range(8)]
    fields = [(r.choice(types), r.choice(variables), r.choice([*types, "Al", "Out"])) for _ in range(4)]
    aliases = [r.choice([("Al", "Am"), ("Am", "Tb"), ("Am", "An"), ("An", "Ao"), ("Ao", "Ap"), ("Ap", "Ta"), ("Al", "Al")]) for _ in range(3)]
    parents = [(r.choice(types), r.choice(types)) for _ in range(3)]
    words = [(p := r.choice(nodes))["path"] and (p["path"], r.choice([None, p["node"]]), r.choice([*types, "one", "two", "three"])) for _ in range(10)]
    return nodes, calls, binds, fields, aliases, parents, words


def test_resolution_brute_force(spark):
    r = random.Random(21)
    rows, want = [[] for _ in range(7)], set()
    for cid in range(250):
        change = random_change(r)
        want |= {(cid, a, b) for a, b in brute(*change)}
        for k, part in enumerate(change):
            rows[k] += [(cid, *(x.values() if isinstance(x, dict) else x)) for x in part]
    ddl = ["node long, path string, language string, kind string, name string, owner string, start long, end long, test boolean", "node long, form string, qualifier string, name string", "node long, var string, type string, declared boolean", "owner string, field string, type string", "alias string, type string", "child string, parent string", "path string, node long, word string"]
    frames = [spark.createDataFrame(x, f"change_id long, {d}").repartition(3) for x, d in zip(rows, ddl, strict=True)]
    got = resolve.resolve_calls(*frames).collect()
    assert len(want) > 200 and len(got) == len({tuple(x) for x in got})
    assert {tuple(x) for x in got} == want
    assert resolve.resolve_calls(*[f.limit(0) for f in frames]).count() == 0


def test_own_type_with_many_methods_drops_a_bare_call(spark):
    node = lambda i, name, owner: (1, i, "a/one.py", "python", "method" if owner else "function", name, owner, i * 10, i * 10 + 5, False)
    nodes = [*[node(i, "run", "Ta") for i in range(5)], node(5, "run", None), node(6, "stop", "Ta"), node(7, "stop", "Tb"), node(8, "go", None)]
    calls = [(1, 6, "none", "", "run"), (1, 7, "none", "", "run"), (1, 8, "none", "", "run")]
    ddl = ["node long, path string, language string, kind string, name string, owner string, start long, end long, test boolean", "node long, form string, qualifier string, name string", "node long, var string, type string, declared boolean", "owner string, field string, type string", "alias string, type string", "child string, parent string", "path string, node long, word string"]
    frames = [spark.createDataFrame(x, f"change_id long, {d}") for x, d in zip([nodes, calls, [], [], [], [], []], ddl, strict=True)]
    assert {(x.src, x.dst) for x in resolve.resolve_calls(*frames).collect()} == {(7, 5), (8, 5)}


def test_type_names(spark):
    cases = {"&mut Foo": ("Foo", "Foo"), "pkg.Type[int]": ("Type", "Type"), "Option<Box<B>>": ("Option", "B"), "int": (None, None), "Result<Vec<T>, E>": ("Result", "Vec"), "-> Optional[a.B]": (None, "B"), "None | Foo": ("None", "Foo"), "(*Foo, error)": (None, "Foo"), '"Foo"': (None, "Foo"), "Promise<Promise<Promise<Promise<X>>>>": ("Promise", "Promise"), "": (None, None)}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {x.t: (x.a, x.b) for x in df.select("t", resolve.type_name(F.col("t")).alias("a"), resolve.returned_type(F.col("t")).alias("b")).collect()} == cases
