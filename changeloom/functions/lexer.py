"""What is code and what is text in a source: a scan over tokens as a native fold with a stack.

A line's tokens are folded into the line with texts and comments blanked, character by character; the stack of what is open (a
comment, a string, code within a string) goes on to the next line. So a step copies no more than its own line, and lines
without a mark that opens anything are taken as they are. Null sources give null, empty ones no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"(?<=\$)[\p{L}_][\p{L}\p{N}_]*|[^\x22\x27`/*#\\{}$]+|[\s\S]"  # what may open or close anything by itself, a name behind a dollar, and runs of the rest
# fixed values: what tools read from comments; those of the second list change what is built
SWITCHES = [
    "@ts-ignore", "@ts-expect-error", "@ts-nocheck", "@ts-check", "@flow", "eslint-disable", "eslint-enable", "noqa", "nolint", "pragma:", "type: ignore", "pyright:", "mypy:", "rubocop:", "NOLINT", "clippy::",
    "prettier-ignore", "biome-ignore",
]
BUILD_STARTS = ["//go:", "// +build", "//export ", "//line ", "#!"]
BUILD_PARTS = ["@jsx", "@__PURE__", "#__PURE__", "-*- coding", "webpackChunkName"]

# An open element is '' (code), 'l' or 'c' (comments), '{' (code within a string), or a string: its mark, 1 or 3 of them, and
# what opens code in it: f a brace, t and k '${' (k a plain '$name' too), r '#{', p nothing.
_KIND = """concat(CASE WHEN x.f OR x.t = '"' AND _lang = 'csharp' AND x.d THEN 'f' ELSE '' END,
  CASE WHEN x.t = '`' THEN 't' WHEN x.t = '"' AND _lang = 'kotlin' THEN 'k' WHEN x.t = '"' AND _lang = 'ruby' THEN 'r' ELSE '' END)"""


def _step(out: str, push: str | None = None, pop: bool = False, skip: int = 0, comment: bool = False) -> str:
    """SQL of the next state: `out` appended, an element pushed or popped; the next `skip` tokens are kept, or blanked if negative."""
    stack = f"concat(a.st, array({push}))" if push else "slice(a.st, 1, size(a.st) - 1)" if pop else "a.st"
    seen = "x.t RLIKE r'\\S'"
    marks = f"a.note OR {seen} AS note, a.code AS code" if comment else f"a.note AS note, a.code OR {seen} AS code"
    return f"struct({stack} AS st, concat(a.line, {out}) AS line, {skip} AS skip, {marks})"


_BLANK = "repeat(' ', length(x.t))"


def _fold(strict: bool) -> str:
    """SQL that folds one line's tokens (x: t token, n and m those behind, p the character before, w whether its mark comes again, f and d string prefixes) into (st, line, skip, note, code).

    strict: comment marks are those of the language; else # and // open a comment in any.
    """
    top, hash_, slash = "element_at(a.st, -1)", "true", "true"
    if strict:
        hash_, slash = "coalesce(_lang IN ('python', 'ruby', 'php'), false)", "coalesce(_lang NOT IN ('python', 'ruby'), true)"
    quote = "x.t IN ('\"', '''', '`')"
    q = f"left({top}, 1)"
    three = f"substr({top}, 2, 1) = '3'"
    has = lambda *kinds: "(" + " OR ".join(f"contains({top}, '{k}')" for k in kinds) + ")"
    opening = f"{quote} AND NOT (x.t = '\'\'' AND x.p RLIKE r'[&<\\p{{L}}\\p{{N}}_]')"
    code = [
        (f"{opening} AND x.n = x.t AND x.m = x.t AND x.t <> '`'", _step("x.t", push=f"concat(x.t, '3', {_KIND})", skip=2)),
        (opening, _step("x.t", push=f"concat(x.t, '1', {_KIND})")),
        (f"x.t = '/' AND x.n = '/' AND {slash}", _step("' '", push="'l'", comment=True)),
        (f"x.t = '/' AND x.n = '*' AND {slash}", _step("' '", push="'c'", skip=-1, comment=True)),
        (f"x.t = '#' AND x.p <> '.' AND NOT left(coalesce(x.n, ''), 1) IN ('[', '!', '{{') AND {hash_}", _step("' '", push="'l'", comment=True)),
    ]
    inner = [  # code within a string
        ("x.t = '`'", _step("x.t", push="'`1t'")),
        (f"{quote} AND x.w", _step("x.t", push="concat(x.t, '1p')")),
        ("x.t = '{'", _step("x.t", push="'{'")),
        ("x.t = '}'", _step("x.t", pop=True)),
    ]
    string = [
        (f"x.t = {q} AND NOT {three}", _step("x.t", pop=True)),
        (f"x.t = {q} AND {three} AND x.n = x.t AND x.m = x.t", _step("x.t", pop=True, skip=2)),
        (r"x.t = r'\'", _step("' '", skip=-1)),
        (f"{has('k')} AND x.t = '$' AND x.n RLIKE r'^[\\p{{L}}_]'", _step("'$'", skip=1)),
        (f"{has('t', 'k')} AND x.t = '$' AND x.n = '{{'", _step("x.t", push="'{'", skip=1)),
        (f"{has('f')} AND x.t = '{{' AND x.n = '{{'", _step("' '", skip=-1)),
        (f"{has('f')} AND x.t = '{{'", _step("x.t", push="'{'")),
        (f"{has('r')} AND x.t = '#' AND x.n = '{{'", _step("x.t", push="'{'", skip=1)),
    ]
    skipped = f"""CASE WHEN a.skip > 0 THEN struct(a.st AS st, concat(a.line, x.t) AS line, a.skip - 1 AS skip, a.note AS note, true AS code)
      ELSE struct(a.st AS st, concat(a.line, {_BLANK}) AS line, a.skip + 1 AS skip, a.note AS note, a.code OR NOT {top} IN ('c', '') AS code) END"""
    any_of = lambda whens, rest: f"CASE {' '.join(f'WHEN {c} THEN {s}' for c, s in whens)} ELSE {rest} END"
    by = [
        ("a.skip <> 0", skipped),
        (f"{top} = ''", any_of(code, _step("x.t"))),
        (f"{top} = 'c' AND x.t = '*' AND x.n = '/'", _step("' '", pop=True, skip=-1, comment=True)),
        (f"{top} IN ('l', 'c')", _step(_BLANK, comment=True)),
        (f"{top} = '{{'", any_of(inner, _step("x.t"))),
    ]
    return any_of(by, any_of(string, _step(_BLANK)))


def _scan(strict: bool) -> str:
    """SQL for the lines of `ls` (an array) as structs (line, note, code, within), with the stack that they leave: a fold of folds."""
    tokens = f"regexp_extract_all(l, r'{TOKEN}', 0)"
    rich = """transform(ts, (t, i) -> struct(t AS t, get(ts, i + 1) AS n, get(ts, i + 2) AS m, coalesce(right(get(ts, i - 1), 1), '') AS p,
      CASE WHEN t IN ('"', '''', '`') THEN array_join(slice(ts, i + 2, size(ts)), '') RLIKE concat(r'(^|[^\\\\])', t) ELSE false END AS w,
      CASE WHEN t IN ('"', '''') AND i > 0 THEN regexp_extract(get(ts, i - 1), '[A-Za-z]*$', 0) RLIKE '^(?=.*[fF])[fFrRbB]{1,2}$' ELSE false END AS f,
      CASE WHEN t = '"' AND i > 0 THEN get(ts, i - 1) = '$' OR get(ts, i - 1) = '@' AND coalesce(get(ts, i - 2), '') = '$' ELSE false END AS d))"""
    one = f"""element_at(transform(array({tokens}), ts -> aggregate({rich},
      struct(b.st AS st, '' AS line, 0 AS skip, false AS note, false AS code), (a, x) -> {_fold(strict)})), 1)"""
    plain = "size(b.st) = 1 AND NOT l RLIKE r'[\"\\x27`/#]'"
    # at the end of a line its comment is closed, and so is a string of one mark, unless its last character escapes the end
    done = "CASE WHEN element_at(r.st, -1) = 'l' OR element_at(r.st, -1) RLIKE r'^[\"\\x27]1' AND r.skip = 0 THEN slice(r.st, 1, size(r.st) - 1) ELSE r.st END"
    within = "exists(b.st, s -> s RLIKE r'^[\"\\x27`]')"
    fact = lambda line, note, code: f"struct({line} AS line, {note} AS note, {code} AS code, {within} AS within)"
    long = f"""element_at(transform(array({one}), r -> struct({done} AS st, concat(b.ls, array({fact('r.line', 'r.note', 'r.code')})) AS ls)), 1)"""
    short = f"struct(b.st AS st, concat(b.ls, array({fact('l', 'false', "trim(l) <> ''")})) AS ls)"
    kind = "array<struct<line:string,note:boolean,code:boolean,within:boolean>>"
    return f"aggregate(_ls, struct(array('') AS st, CAST(array() AS {kind}) AS ls), (b, l) -> CASE WHEN {plain} THEN {short} ELSE {long} END, b -> b.ls)"


def scanned(files: DataFrame, source: str, language: str, strict: bool = False) -> DataFrame:
    """files with `scan`: for each line of the source (line: with strings and comments blanked, note: it holds a comment, code: it holds anything else, within: it begins inside a string)."""
    held = files.select(F.struct("*").alias("_row"), F.col(language).alias("_lang"), F.when(F.col(source).isNotNull(), F.split(F.col(source), "\n")).alias("_ls"))
    return held.select("_row.*", F.expr(_scan(strict)).alias("scan"))


def code_only(files: DataFrame, source: str = "source", language: str = "language") -> DataFrame:
    """files with `code`: the source with the texts of strings and comments blanked, character for character; code that stands within strings (`${x}`, f"{x}", "#{x}") stays.

    Comments begin with //, /* or # in any language, as they do for searching names; a # behind a dot or before [, ! or { does
    not, nor does a quote behind a word, & or < open a string. Strings of one mark end at the end of their line, unless that is escaped.
    """
    return scanned(files, source, language).withColumn("code", F.array_join(F.transform("scan", lambda x: x["line"]), "\n")).drop("scan")


def is_build_directive(comment: Column) -> Column:
    """Does the comment change what is built?"""
    t = F.regexp_replace(comment, r"(?U)^\s+", "")
    starts = [t.startswith(x) for x in BUILD_STARTS]
    parts = [t.contains(x) for x in BUILD_PARTS]
    out = starts[0]
    for x in starts[1:] + parts:
        out = out | x
    return out


def is_directive(comment: Column) -> Column:
    """Does a tool act on the comment?"""
    out = is_build_directive(comment) | F.regexp_replace(comment, r"(?U)^\s+", "").startswith("# type:")
    for x in SWITCHES:
        out = out | comment.contains(x)
    return out


def line_facts(files: DataFrame, key: list[str], source: str = "source", language: str = "language") -> DataFrame:
    """key, line_no, line, code (blanked), comment (all it holds is comment), in_string (it begins inside a string), define, directive for each line of each source.

    Comment marks are those of the language. A final line end opens no further line. Lines of a #define in C, with those that it goes on to, are `define`.
    """
    opens = r"^\s*#\s*define\b"
    goes_on = lambda st, line: F.when(F.coalesce(F.get(st["on"], F.size(st["on"]) - 1), F.lit(False)), True).otherwise(line.rlike(opens))
    start = F.struct(F.array().cast("array<boolean>").alias("on"), F.array().cast("array<boolean>").alias("out"))
    step = lambda st, line: F.struct(F.array(goes_on(st, line) & line.rlike(r"\\\r?$")).alias("on"), F.concat(st["out"], F.array(goes_on(st, line))).alias("out"))
    defines = F.when(F.col(language) == "c", F.aggregate(F.split(F.col(source), "\n"), start, step, lambda st: st["out"])).otherwise(F.array().cast("array<boolean>"))
    rows = scanned(files, source, language, strict=True).select(*key, language, F.posexplode(F.arrays_zip(F.split(F.col(source), "\n").alias("line"), F.col("scan"), defines.alias("define"))).alias("at", "x"), F.col(source).alias("_s"))
    rows = rows.where(~((F.col("at") == F.size(F.split("_s", "\n")) - 1) & (F.col("x.line") == "")))
    rows = rows.select(*key, language, (F.col("at") + 1).cast("long").alias("line_no"), F.regexp_replace("x.line", "\r$", "").alias("line"), F.col("x.scan.line").alias("code"), (F.col("x.scan.note") & ~F.col("x.scan.code")).alias("comment"), F.col("x.scan.within").alias("in_string"), F.col("x.define").alias("define"))
    return rows.withColumns({"directive": F.col("comment") & is_directive(F.col("line")), "define": F.coalesce("define", F.lit(False))})
