"""Functions, classes, methods, local functions and fields of source files, each with its span and innermost parent.

Lines are blanked by the lexer, so texts and comments neither open nor close anything. A fold over a file's lines keeps the stack of
open definitions: in Python and Ruby they end before a line that is not indented further, elsewhere with the bracket that closes
their body. There is no parse tree: a definition is known by the pattern of the line that it begins on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions import code as C
from changeloom.functions import lexer

_JVM = r"(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|sealed|synchronized|native|default|partial|readonly|unsafe|extern|new)\s+)*"
_KT = r"(?:(?:public|private|protected|internal|open|override|inline|suspend|operator|infix|tailrec|abstract|final)\s+)*"
_RS = r"(?:pub(?:\([^)]*\))?\s+)?"
_TYPED = r"(?!(?:return|new|else|throw|case|goto|await|yield|using|lock|if|in|is|as|delete|do)\b)[\w$.<>\[\],?&]+(?:\s*\*+\s*|\s+)(?:[\w$.<>\[\],?&]+(?:\s*\*+\s*|\s+))*"
# kind and name by a line, the first that fits; `impl` holds methods but is no definition of its own
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "typescript": [
        ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([\w$]+)"),
        ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)"),
        ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[\w$]+)\s*(?::[^=]+)?=>"),
        ("method", r"^\s+(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?([\w$#]+)\s*(?:<[^>(]*>)?\([^;=]*\)\s*(?::[^={;]+)?\{"),
    ],
    "python": [("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(\w+)")],
    "rust": [("class", rf"^\s*{_RS}(?:struct|enum|trait)\s+(\w+)"), ("impl", r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)"), ("function", rf"^\s*{_RS}(?:const\s+|async\s+|unsafe\s+)*fn\s+(\w+)")],
    "go": [("class", r"^\s*type\s+(\w+)\s+(?:struct|interface)\b"), ("function", r"^\s*func\s+(?:\([^)]*\)\s*)?(\w+)")],
    "java": [("class", rf"^\s*{_JVM}(?:class|enum|record|interface)\s+(\w+)"), ("method", rf"^\s*{_JVM}(?:<[^>]*>\s*)?{_TYPED}(\w+)\s*\([^;{{]*(?:\{{.*)?$"), ("method", r"^\s+(?:(?:public|private|protected)\s+)(\w+)\s*\([^;{]*(?:\{.*)?$")],
    "csharp": [("class", rf"^\s*{_JVM}(?:class|enum|record|interface|struct)\s+(\w+)"), ("method", rf"^\s*{_JVM}{_TYPED}(\w+)\s*(?:<[^>]*>)?\([^;{{]*(?:\{{.*)?$"), ("method", r"^\s+(?:(?:public|private|protected|internal)\s+)(\w+)\s*\([^;{]*(?:\{.*)?$")],
    "c": [("class", r"^\s*(?:typedef\s+)?(?:struct|enum|union)\s+(\w+)\s*\{?\s*$"), ("function", rf"^{_TYPED}\*?(\w+)\s*\([^;{{]*(?:\{{.*)?$")],
    "kotlin": [("class", r"^\s*(?:(?:private|internal|public|data|sealed|open|abstract|enum|inner|companion)\s+)*(?:class|object|interface)\s+(\w+)"), ("function", rf"^\s*{_KT}fun\s+(?:<[^>]*>\s*)?(?:[\w.<>]+\.)?(\w+)")],
    "scala": [("class", r"^\s*(?:(?:case|sealed|abstract|final|private)\s+)*(?:class|object|trait|enum)\s+(\w+)"), ("function", r"^\s*(?:(?:private|protected|override|final|implicit|inline)(?:\[\w+\])?\s+)*def\s+(\w+)")],
    "php": [("class", r"^\s*(?:(?:final|abstract|readonly)\s+)*(?:class|interface|trait|enum)\s+(\w+)"), ("function", r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(\w+)")],
    "ruby": [("class", r"^\s*(?:class|module)\s+(?:\w+::)*(\w+)"), ("function", r"^\s*def\s+(?:self\.)?(\w+[?!=]?)")],
}
PATTERNS["tsx"] = PATTERNS["typescript"]
# a field's name and its type, as the first and second group or the other way round (marked by <)
FIELDS: dict[str, str] = {
    "typescript": r"^\s*(?:(?:public|private|protected|static|readonly|declare)\s+)*([\w$#]+)[?!]?\s*(?::\s*([^=;]+?))?\s*(?:=[^>].*)?;?\s*$", "python": r"^\s*(\w+)\s*(?::\s*([^=]+?))?\s*(?:=(?!=).*)?$", "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(\w+)\s*:\s*(.+?),?\s*$", "go": r"^\s*(\w+)\s+([\w.*\[\]{}]+)[^(]*$",
    "kotlin": r"^\s*(?:(?:private|internal|public|protected|override|lateinit|const)\s+)*va[lr]\s+(\w+)\s*(?::\s*([^=]+?))?\s*(?:=.*)?$", "scala": r"^\s*(?:(?:private|protected|override|lazy)\s+)*va[lr]\s+(\w+)\s*(?::\s*([^=]+?))?\s*(?:=.*)?$",
    "java": rf"<^\s*{_JVM}(\S+(?:<[^>]*>)?(?:\[\])?)\s+(\w+)\s*(?:=.*)?;\s*$", "csharp": rf"<^\s*{_JVM}(\S+(?:<[^>]*>)?(?:\[\])?\??)\s+(\w+)\s*(?:(?:=.*)?;|\{{.*\}})\s*$", "c": r"<^\s*(\w[\w\s]*?(?:\s|\*)+)(\w+)\s*(?:\[[^\]]*\])?;\s*$", "php": r"<^\s*(?:(?:public|private|protected|static|readonly|var)\s+)+(\??[\w\\|]*)\s*\$(\w+)\s*(?:=.*)?;\s*$",
}
FIELDS["tsx"] = FIELDS["typescript"]
BY_INDENT = ["python", "ruby"]
NOT_NAMES = ["if", "for", "while", "switch", "catch", "return", "function", "else", "do", "try", "with", "match", "elif", "except", "finally", "lock", "using", "foreach", "when", "synchronized", "sizeof", "typeof", "pass", "break", "continue"]
# where a name or a first line says that nobody outside may use a definition
HIDDEN_NAME = {"python": r"^_(?!_.*__$)", "go": r"^(?!init$)[^\p{Lu}]"}
HIDDEN_LINE = {"rust": r"^\s*+(?!pub\b)", "typescript": r"^\s*+(?!export\b)", "kotlin": r"\bprivate\b", "csharp": r"\b(?:private|file)\b", "c": r"^\s*static\b", "java": r"\bprivate\b", "scala": r"\b(?:private|protected)\b"}
HIDDEN_LINE["tsx"] = HIDDEN_LINE["typescript"]
_DEF = "struct<d:int,kind:string,name:string,header:string,start:int,end:int,parent:int,level:int,opened:boolean>"
PARAMS = "array<struct<name:string,type:string,optional:boolean>>"


def _raw(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _cases(whens: list[tuple[str, str]], rest: str = "NULL") -> str:
    return f"CASE {' '.join(f'WHEN {x} THEN {y}' for x, y in whens)} ELSE {rest} END"


def _per_language(of) -> str:
    return _cases([(f"_lang = '{k}'", of(v)) for k, v in PATTERNS.items()])


def _known(code: str) -> str:
    """SQL for (kind, name) of the definition that begins on a line, null for none."""
    names = ", ".join(f"'{x}'" for x in NOT_NAMES)
    return _per_language(lambda ps: _cases([(f"{code} RLIKE {_raw(p)} AND NOT regexp_extract({code}, {_raw(p)}, 1) IN ({names})", f"struct('{kind}' AS kind, regexp_extract({code}, {_raw(p)}, 1) AS name)") for kind, p in ps]))


def _events() -> str:
    """SQL for the lines of a file: at, code, blank, w (indentation), o and c (opened and closed braces), n (brackets that stay open), k (definition), header."""
    count = lambda s: f"(length(y.line) - length(translate(y.line, '{s}', '')))"
    fits = " OR ".join(f"_lang = '{k}' AND y.line RLIKE {_raw('|'.join(p for _, p in ps))}" for k, ps in PATTERNS.items())
    header = "array_join(slice(transform(scan, z -> z.line), i + 1, 30), '\\n')"
    return f"""transform(scan, (y, i) -> struct(i + 1 AS at, y.line AS code, trim(y.line) = '' OR y.within AS blank, length(regexp_extract(y.line, r'^[ \\t]*', 0)) AS w,
      {count("{")} AS o, {count("}")} AS c, {count("([")} - {count(")]")} AS n,
      CASE WHEN NOT y.within AND ({fits}) THEN {_known("y.line")} END AS k, CASE WHEN NOT y.within AND ({fits}) THEN {header} END AS header))"""


def _fold() -> str:
    """SQL that folds a file's events into its definitions."""
    closed = lambda f, end: f"struct({f}.d AS d, {f}.kind AS kind, {f}.name AS name, {f}.header AS header, {f}.start AS start, {end} AS end, {f}.parent AS parent, {f}.level AS level, true AS opened)"
    new = lambda level, st: f"struct(a.d + 1 AS d, x.k.kind AS kind, x.k.name AS name, x.header AS header, x.at AS start, 0 AS end, get({st}, size({st}) - 1).d AS parent, {level} AS level, false AS opened)"
    none = f"CAST(array() AS array<{_DEF}>)"
    state = lambda st, out, d="a.d": f"struct({st} AS st, {out} AS out, {d} AS d, a.depth + x.o - x.c AS depth, greatest(a.nest + x.n, 0) AS nest, x.at AS last)"
    grown = "a.d + CAST(x.k IS NOT NULL AS INT)"
    # by indentation
    ended = "CASE WHEN _lang = 'ruby' AND x.code RLIKE r'^\\s*end\\b' AND f.level = x.w THEN x.at ELSE a.last END"
    left = "filter(a.st, f -> f.level < x.w)"
    indented = state(f"concat({left}, CASE WHEN x.k IS NULL THEN {none} ELSE array({new('x.w', left)}) END)", f"concat(a.out, transform(filter(a.st, f -> f.level >= x.w), f -> {closed('f', ended)}))", grown)
    # by brackets: an open definition without a body ends before the next one of its level, or with its line
    waiting = "NOT f.opened AND (x.k IS NOT NULL OR x.code RLIKE r'^\\s*\\}') AND a.nest = 0"
    still = f"filter(a.st, f -> NOT ({waiting}))"
    pushed = f"concat({still}, CASE WHEN x.k IS NULL THEN {none} ELSE array({new('a.depth', still)}) END)"
    opened = f"transform({pushed}, f -> struct(f.d AS d, f.kind AS kind, f.name AS name, f.header AS header, f.start AS start, f.end AS end, f.parent AS parent, f.level AS level, f.opened OR x.o > 0 AS opened))"
    short = "NOT f.opened AND a.nest + x.n <= 0 AND (x.code RLIKE r';\\s*$' OR _lang IN ('kotlin', 'scala') AND x.code RLIKE r'\\)?\\s*(?::[^={]+)?=\\s*[^{]*$')"
    over = f"f.opened AND a.depth + x.o - x.c <= f.level OR {short}"
    bound = lambda then: f"element_at(transform(array({opened}), s -> {then}), 1)"
    braced = bound(state(f"filter(s, f -> NOT ({over}))", f"concat(a.out, transform(filter(a.st, f -> {waiting}), f -> {closed('f', 'a.last')}), transform(filter(s, f -> {over}), f -> {closed('f', 'x.at')}))", grown))
    step = _cases([("x.blank", "struct(a.st AS st, a.out AS out, a.d AS d, a.depth + x.o - x.c AS depth, greatest(a.nest + x.n, 0) AS nest, a.last AS last)"), ("_lang IN ('python', 'ruby') AND a.nest > 0", state("a.st", "a.out")), ("_lang IN ('python', 'ruby')", indented), ("x.k IS NULL AND x.o = 0 AND x.c = 0 AND size(filter(a.st, f -> NOT f.opened)) = 0", state("a.st", "a.out"))], braced)
    end = f"concat(a.out, transform(a.st, f -> {closed('f', 'a.last')}))"
    return f"aggregate(ev, struct({none} AS st, {none} AS out, 0 AS d, 0 AS depth, 0 AS nest, 0 AS last), (a, x) -> {step}, a -> array_sort({end}))"


def split_parameters(inside: Column) -> Column:
    """What stands between the commas that lie in no bracket (of up to three levels)."""
    some = r"[^()\[\]{}<>,]|(?<==|-)>"
    for _ in range(3):
        some = rf"[^()\[\]{{}}<>,]|(?<==|-)>|[(\[{{<](?:{some}|,)*[)\]}}>]"
    return F.filter(F.transform(F.regexp_extract_all(inside, F.lit(rf"(?:{some})+"), 0), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")


def parameters(header: Column, language: Column) -> Column:
    """Parameters (name, type, optional) of a declaration that begins the header, by the language's way of writing them.

    A Go or C# receiver, self, cls, a lone void and the marks / and * are none. Where a type is not written it is null.
    """
    h = F.regexp_replace(header, r"^(\s*func\s+)\([^)]*\)\s*", "$1")
    nested = r"[^()]"
    for _ in range(3):
        nested = rf"[^()]|\((?:{nested})*\)"
    parts = F.filter(split_parameters(F.regexp_extract(h, rf"\(((?:{nested})*)\)", 1)), lambda p: ~p.rlike(r"^(?:&?(?:'\w+ )?(?:mut )?self(?: ?:.*)?|cls|/|\*|void)$") & ~((language == "csharp") & p.startswith("this ")))
    text = lambda c: F.when(F.trim(c) != "", F.trim(c))
    one = lambda name, kind, optional: F.struct(name.alias("name"), kind.alias("type"), optional.alias("optional"))
    bare = lambda p: F.regexp_replace(p, r"\s*=(?!>).*$", "")
    given = lambda p: p.rlike(r"=(?!>)")
    colon = F.transform(parts, lambda p: one(F.regexp_extract(p, r"^(?:(?:mut|val|var|vararg|public|private|readonly|override)\s+)*([.*&]*[\w$]+)", 1), text(F.concat(F.when(p.startswith("vararg "), "vararg ").otherwise(""), F.trim(F.regexp_extract(bare(p), r"^[^:]*:(.*)$", 1)))), given(p) | p.rlike(r"^[\w$]+\?")))
    first = F.transform(parts, lambda p: one(F.when(p == "...", "...").otherwise(F.regexp_extract(bare(p), r"([\w$]+)(?:\[\w*\])*$", 1)), text(F.regexp_replace(F.regexp_extract(bare(p), r"^(.*?)[\w$]+(?:\[\w*\])*$", 1), r"^(?:(?:final|@\w+)\s+)+", "")), given(p)))
    # Go: names that share a type stand before it; without any name the types alone are written
    types = F.transform(parts, lambda p: F.regexp_extract(p, r"^\w+ (.+)$", 1))
    go = F.transform(parts, lambda p, i: one(F.regexp_extract(p, r"^[*.\[\]]*([\w.]+)", 1), text(F.coalesce(F.try_element_at(F.filter(F.slice(types, i + 1, F.size(types)), lambda t: t != ""), F.lit(1)), p)), F.lit(False)))
    php = F.transform(parts, lambda p: one(F.concat(F.when(p.contains("..."), "...").otherwise(""), F.regexp_extract(p, r"\$(\w+)", 1)), text(F.regexp_replace(F.regexp_extract(p, r"^([^$]*)\$", 1), r"\.\.\.|&|\b(?:public|private|protected|readonly)\b", "")), given(p)))
    ruby = F.transform(parts, lambda p: one(F.regexp_extract(p, r"^([*&]*\w+)", 1), F.when(p.rlike(r"^\w+:"), "keyword"), given(p) | p.rlike(r"^\w+: ?\S")))
    out = F.when(language.isin("c", "java", "csharp"), first).when(language == "go", go).when(language == "php", php).when(language == "ruby", ruby).otherwise(colon)
    return F.coalesce(out, F.array().cast(PARAMS))


def _pick(language: Column, by: dict[str, str], text: Column) -> Column:
    out = F.lit(False)
    for k, p in by.items():
        out = F.when(language == k, text.rlike(p)).otherwise(out)
    return out


def definitions(files: DataFrame, key: list[str]) -> DataFrame:
    """key, d, kind, name, owner, start, end, parent, scope, params, exported, text, shape of all definitions in files (key, language, source).

    d counts them in order. kind: function, class, method (its innermost parent is a class, or in Go it has a receiver) or local (it
    lies in a function); owner: the class's name; parent: the d of the innermost definition around it, scope: the name of the innermost function around a
    local one. local functions are never exported. shape is the layout-free text without comments in which its own name is masked, so equal shapes are equal but for the name.
    Unknown languages, null and empty sources have no definitions; rows that repeat a file give them again.
    """
    src = files.select(F.struct(*key).alias("_key"), "language", "source").where(F.col("language").isin(list(PATTERNS)))
    held = lexer.scanned(src, "source", "language", strict=True).select("_key", "language", F.col("language").alias("_lang"), F.split("source", "\n").alias("ls"), "scan")
    found = held.withColumn("ev", F.expr(_events())).withColumn("defs", F.expr(_fold()))
    with_text = F.transform("defs", lambda f: F.struct(f.alias("f"), F.arrays_zip(F.slice(F.col("ls"), f["start"], f["end"] - f["start"] + 1).alias("line"), F.slice(F.col("scan"), f["start"], f["end"] - f["start"] + 1).alias("s")).alias("rows"), F.get(F.filter("defs", lambda g: g["d"] == f["parent"]), F.lit(0)).alias("up"), F.get("ls", f["start"] - 2).alias("above")))
    rows = found.select("_key", "language", F.explode(with_text).alias("x"), "defs")
    f, up, lang = F.col("x.f"), F.col("x.up"), F.col("language")
    receiver = F.when(lang == "go", F.regexp_extract(f["header"], r"^\s*func\s+\(\s*(?:\w+\s+)?\*?(\w+)", 1))
    in_class = up["kind"].isin("class", "impl")
    owner = F.when(in_class, up["name"]).when((F.coalesce(receiver, F.lit("")) != ""), receiver)
    kind = F.when(f["kind"].isin("class", "impl"), f["kind"]).when(owner.isNotNull(), "method").when(up["d"].isNotNull(), "local").otherwise("function")
    code = F.filter("x.rows", lambda r: (F.trim(r["line"]) != "") & ~(r["s"]["note"] & ~r["s"]["code"]))
    text = F.array_join(F.transform("x.rows", lambda r: r["line"]), "\n")
    norm = F.array_join(F.transform(code, lambda r: C.code_key(r["line"], lang.isin("python"))), "\n")
    masked = F.regexp_replace(norm, F.concat(F.lit(r"(?<![A-Za-z0-9_$])\Q"), f["name"], F.lit(r"\E(?![A-Za-z0-9_$])")), F.lit("\x02"))
    hidden = F.coalesce(_pick(lang, HIDDEN_NAME, f["name"]) | _pick(lang, HIDDEN_LINE, F.substring_index(f["header"], "\n", 1)), F.lit(False))
    # a method that is not marked for export is seen with its class
    hidden = hidden & ~((kind == "method") & lang.isin("typescript", "tsx") & ~F.coalesce(F.substring_index(f["header"], "\n", 1).rlike(r"\bprivate\b|^\s*#"), F.lit(False)))
    # Rust: what implements a trait, or has an attribute, is seen
    hidden = hidden & ~((lang == "rust") & F.coalesce(F.col("x.above").rlike(r"^\s*#\[") | ((up["kind"] == "impl") & up["header"].rlike(r"^[^\n{]*\sfor\s")), F.lit(False)))
    params = F.when(kind.isin("class", "impl"), F.array().cast(PARAMS)).otherwise(parameters(f["header"], lang))
    number = lambda c: c.cast("long")
    out = rows.select("_key.*", number(f["d"]).alias("d"), kind.alias("kind"), f["name"].alias("name"), owner.alias("owner"), number(f["start"]).alias("start"), number(f["end"]).alias("end"), number(f["parent"]).alias("parent"), F.when(kind == "local", up["name"]).alias("scope"), params.alias("params"), (~hidden & (kind != "local")).alias("exported"), text.alias("text"), masked.alias("shape"))
    return out.where("kind <> 'impl'")


def fields(files: DataFrame, key: list[str]) -> DataFrame:
    """key, owner, name, type, line of the fields of classes: lines that lie in a class and in nothing else, by the language's pattern; the type is null where none is written."""
    src = files.select(F.struct(*key).alias("_key"), "language", "source").where(F.col("language").isin(list(FIELDS)))
    held = lexer.scanned(src, "source", "language", strict=True).select("_key", "language", F.col("language").alias("_lang"), "scan")
    found = held.withColumn("ev", F.expr(_events())).withColumn("defs", F.expr(_fold()))
    inside = F.filter("defs", lambda g: (g["start"] <= F.col("e.at")) & (F.col("e.at") <= g["end"]))
    rows = found.select("_key", "_lang", "defs", F.explode(F.filter("ev", lambda e: ~e["blank"] & e["k"].isNull())).alias("e")).withColumn("in", F.get(F.reverse(F.array_sort(F.transform(inside, lambda g: F.struct(g["start"].alias("start"), g["d"].alias("d"), g["kind"].alias("kind"), g["name"].alias("name"))))), F.lit(0)))
    rows = rows.where("in.kind = 'class' AND in.start < e.at")
    code = F.col("e.code")
    name, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for lang, p in FIELDS.items():
        swap, p = p.startswith("<"), p.lstrip("<")
        fits = (F.col("_lang") == lang) & code.rlike(p)
        name = F.when(fits, F.regexp_extract(code, p, 2 if swap else 1)).otherwise(name)
        kind = F.when(fits, F.trim(F.regexp_extract(code, p, 1 if swap else 2))).otherwise(kind)
    out = rows.select("_key.*", F.col("in.name").alias("owner"), name.alias("name"), F.when(kind != "", kind).alias("type"), F.col("e.at").cast("long").alias("line"))
    return out.where(F.col("name").isNotNull() & ~F.col("name").isin(NOT_NAMES) & ~F.coalesce(F.col("type").rlike(r"^(?:return|package|import|using|namespace|goto|delete|throw)\b"), F.lit(False)))


def match_members(old: DataFrame, new: DataFrame, file: list[str]) -> DataFrame:
    """file, owner, old_d, new_d, match of the methods of two versions' classes: same (equal text but for layout), modified, renamed; removed and added without a partner.

    Of one class the k-th method of a name goes with the k-th; what is left is renamed if its shape (its body and its parameters)
    is that of one other method alone, on both sides. Classes go by their names.
    """
    side = lambda d, s: d.where("kind = 'method'").select(*file, "owner", "name", "d", "shape", F.lit(s).alias("side"))
    both = side(old, "old").unionByName(side(new, "new"))
    per = [*file, "owner"]
    k = F.row_number().over(Window.partitionBy(*per, "name", "side").orderBy("d"))
    w = Window.partitionBy(*per, "name", "k")
    of = lambda s, c, over: F.max(F.when(F.col("side") == s, F.col(c))).over(over)
    named = both.withColumn("k", k).withColumns({"od": of("old", "d", w), "nd": of("new", "d", w), "os": of("old", "shape", w), "ns": of("new", "shape", w)})
    paired = named.where("side = 'old' AND nd IS NOT NULL AND od IS NOT NULL").select(*per, F.col("od").alias("old_d"), F.col("nd").alias("new_d"), F.when(F.col("os") == F.col("ns"), "same").otherwise("modified").alias("match"))
    # a name that the other side has too is no candidate, nor a rival
    w = Window.partitionBy(*per, "shape")
    n = lambda s: F.count_if(F.col("side") == s).over(w)
    rest = named.where("od IS NULL OR nd IS NULL").select(*per, "d", "shape", "side")
    lone = rest.withColumns({"clear": (n("old") == 1) & (n("new") == 1), "od": of("old", "d", w), "nd": of("new", "d", w)})
    renamed = lone.where("clear AND side = 'old'").select(*per, F.col("od").alias("old_d"), F.col("nd").alias("new_d"), F.lit("renamed").alias("match"))
    gone = lone.where("NOT clear").select(*per, F.when(F.col("side") == "old", F.col("d")).alias("old_d"), F.when(F.col("side") == "new", F.col("d")).alias("new_d"), F.when(F.col("side") == "old", "removed").otherwise("added").alias("match"))
    return paired.unionByName(renamed).unionByName(gone)


def unique_locals(defs: DataFrame, file: list[str]) -> DataFrame:
    """Local functions whose name occurs once in their scope."""
    once = F.count("*").over(Window.partitionBy(*file, "scope", "name"))
    return defs.where("kind = 'local'").withColumn("_n", once).where("_n = 1").drop("_n")


def match_locals(old: DataFrame, new: DataFrame, file: list[str]) -> DataFrame:
    """file, scope, name, old_d, new_d, old_params, new_params of local functions by scope and name; names that a scope has more than once are left out."""
    side = lambda d, s: unique_locals(d, file).select(*file, "scope", "name", F.col("d").alias(f"{s}_d"), F.col("params").alias(f"{s}_params"))
    return side(old, "old").join(side(new, "new"), [*file, "scope", "name"])


def bodies(old: DataFrame, new: DataFrame, file: list[str]) -> DataFrame:
    """file, old_start, old_end, new_start, new_end of functions and methods that are on both sides: the k-th by owner and name with the k-th."""
    k = F.row_number().over(Window.partitionBy(*file, "owner", "name").orderBy("d"))
    side = lambda d, s: d.where("kind IN ('function', 'method')").withColumn("_k", k).select(*file, F.coalesce("owner", F.lit("")).alias("_o"), F.col("name").alias("_m"), "_k", F.col("start").alias(f"{s}_start"), F.col("end").alias(f"{s}_end"))
    return side(old, "old").join(side(new, "new"), [*file, "_o", "_m", "_k"]).drop("_o", "_m", "_k")


def retyped_fields(old: DataFrame, new: DataFrame, file: list[str]) -> DataFrame:
    """file, owner, name, old_type, new_type of fields that both sides have with different types."""
    side = lambda d, s: d.groupBy(*file, "owner", "name").agg(F.min_by("type", "line").alias(f"{s}_type"))
    return side(old, "old").join(side(new, "new"), [*file, "owner", "name"]).where(~F.col("old_type").eqNullSafe(F.col("new_type")))
