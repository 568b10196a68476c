from changeloom.operators import analyze

OLD = {
    "lib/a.py": "import os\n\n\ndef total(qty, price):\n    # sums\n    x = qty * price\n    return x\n\n\ndef helper(a):\n    b = a + 1\n    c = b + 2\n    return c * b\n\n\ndef old_name(z):\n    one = z + 1\n    two = one + z\n    return two * one\n\n\nclass Box:\n    size: int = 1\n\n    def get(self, k):\n        return self.m[k]\n\n    def put(self, k):\n        self.m = k\n",
    "lib/b.py": "def use():\n    return total(1, 2)\n",
    "tests/test_a.py": "def test_total():\n    assert total(2, 3) == 6\n",
    "notes.txt": "one\ntwo\n",
    "gone.py": "def gone():\n    pass\n",
}
NEW = {
    "lib/a.py": "import sys\n\n\ndef total(qty, price, tax):\n    # adds up\n    x = qty*price\n    return x + tax\n\n\ndef new_name(z):\n    one = z + 1\n    two = one + z\n    return two * one\n\n\nclass Box:\n    size: str = 1\n\n    def get(self, k):\n        return self.m.get(k)\n\n    def add(self, q):\n        self.n = [q, q]\n",
    "lib/b.py": "def use():\n    return total(1, 2)\n\n\ndef helper(a):\n    b = a + 1\n    c = b + 2\n    return c * b\n",
    "tests/test_a.py": "def test_total():\n    assert total(2, 3, 1) == 7\n",
    "notes.txt": "one\n\ntwo \n",
    "gone.py": None,
}


def test_a_change_as_a_whole(spark):
    rows = [(7, p, OLD[p], NEW[p], 0) for p in OLD] + [(8, "same.py", "x = 1\n", "x = 1\n", 0), (9, "new.py", None, "def f():\n    pass\n", 0)]
    out = analyze.analyze(spark.createDataFrame(rows, "change_id long, path string, old_source string, new_source string, id int").repartition(3))
    got = out.entries.orderBy("change_id", "id").collect()
    assert [x.id for x in got if x.change_id == 7] == list(range(1, 1 + sum(x.change_id == 7 for x in got)))
    seen = {(x.category, x.kind, x.name, x.detail, x.path) for x in got if x.change_id == 7}
    assert seen == {
        ("dependency", "import", "os", "removed", "lib/a.py"), ("dependency", "import", "sys", "added", "lib/a.py"),
        ("signature", "function", "total", "added param `tax` (callers break)", "lib/a.py"), ("logic", "function", "total", "body modified", "lib/a.py"),
        ("renamed", "function", "new_name", "old_name", "lib/a.py"), ("moved", "function", "helper", "from lib/a.py", "lib/b.py"),
        ("logic", "method", "Box.get", "body modified", "lib/a.py"), ("removed", "method", "Box.put", None, "lib/a.py"), ("added", "method", "Box.add", None, "lib/a.py"),
        ("logic", "field", "Box.size", "int → str", "lib/a.py"), ("logic", "function", "test_total", "body modified", "tests/test_a.py"), ("removed", "function", "gone", None, "gone.py"),
    }
    assert [(x.category, x.name) for x in got if x.change_id == 9] == [("added", "f")] and not [x for x in got if x.change_id == 8]
    where = {(x.category, x.name): (x.side, x.start, x.end) for x in got if x.change_id == 7}
    assert where["moved", "helper"] == ("new", 5, 8) and where["removed", "Box.put"] == ("old", 28, 29) and where["logic", "Box.size"] == ("new", 17, 17)
    label = {(x.path, x.side, x.line): x.noise for x in out.lines.where("change_id = 7").collect()}
    assert label["lib/a.py", "new", 5] == "comment" and label["lib/a.py", "new", 6] == "formatting" and label["lib/a.py", "new", 7] is None
    assert label["lib/b.py", "new", 6] == "moved" and label["lib/a.py", "old", 11] == "moved" and label["lib/a.py", "new", 10] == "rename"
    assert label["notes.txt", "new", 2] == "formatting" and label["notes.txt", "new", 3] is None
    stats = {x.path: (x.added, x.removed, x.test, x.needs_review) for x in out.stats.where("change_id = 7").collect()}
    assert stats["tests/test_a.py"] == (1, 1, 2, 0) and stats["gone.py"] == (0, 2, 0, 2)
    calls = {(x.path, x.line): x.updated for x in out.impacts.collect()}
    assert calls == {("lib/b.py", 2): False, ("tests/test_a.py", 2): True}


def test_moves_with_edits(spark):
    body = "\n".join(f"    v{i} = call{i}(a, {i})" for i in range(12))
    rows = [(1, "a.py", f"def same(a):\n{body}\n", ""), (1, "b.py", "", f"def same(a):\n{body}\n    return v1\n"), (1, "c.py", "", f"def same(a):\n{body}\n    return v1 + v2 + v3\n"), (2, "a.py", "def f():\n    pass\n", ""), (2, "b.py", "", "def g():\n    pass\n")]
    out = analyze.analyze(spark.createDataFrame(rows, "change_id long, path string, old_source string, new_source string"))
    got = {(x.change_id, x.category, x.name, x.detail, x.path) for x in out.entries.collect()}
    assert got == {(1, "moved", "same", "from a.py with edits", "b.py"), (1, "added", "same", None, "c.py"), (2, "moved", "g", "from a.py as f", "b.py")}


def test_nothing(spark):
    none = analyze.analyze(spark.createDataFrame([], "change_id long, path string, old_source string, new_source string"))
    assert [d.count() for d in (none.entries, none.lines, none.stats, none.impacts)] == [0, 0, 0, 0]
