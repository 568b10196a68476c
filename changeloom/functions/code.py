"""Expressions over lines, names, paths and commands of code.

Null inputs give null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: endings of languages and formats in which indentation is syntax
INDENTED = ["py", "pyi", "pyw", "yaml", "yml", "coffee", "pug", "sass", "haml", "nim"]
# fixed values: file stems that stand for their folder, and methods that stand for their class
FOLDER_STEMS = ["index", "mod", "__init__", "lib", "main"]
CONSTRUCTORS = ["__init__", "__new__", "constructor", "__construct"]
# fixed values: shell tools that write, where a command starts, and calls that write, anywhere
WRITE_TOOLS = ["sed -i", "perl -pi", "tee ", "git apply", "patch -", "patch <", "mv ", "cp ", "rm ", "truncate ", "git checkout -- ", "git restore "]
WRITE_CALLS = ["apply_patch", ".write(", "write_text(", "writeFile", "File.write"]
WORD = r"[\p{IsAlphabetic}\p{N}_]"
_STRING = r'''"(?:\\[\s\S]|[^"\\])*(?:"|$)|'(?:\\[\s\S]|[^'\\])*(?:'|$)|`(?:\\[\s\S]|[^`\\])*(?:`|$)'''
_GAP = "\x01"


def quoted(x: str) -> str:
    """x as a regular expression that matches it alone."""
    return "".join(c if c.isalnum() or c in "_ " else "\\" + c for c in x)


def code_key(line: Column, indented: Column | bool = False) -> Column:
    """A line for comparing layouts: outside of strings no white space but one blank between two words, and, where indentation is syntax, the indentation."""
    parts = F.regexp_extract_all(line, F.lit(rf'''{_STRING}|(?U:\s+)|(?U:[^\s"'`]+)'''), 0)
    marked = F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^(?U:\s+)$"), F.lit(_GAP)).otherwise(x)), "")
    bare = F.regexp_replace(F.regexp_replace(marked, rf"(?<={WORD}){_GAP}(?={WORD})", " "), _GAP, "")
    indented = F.lit(indented) if isinstance(indented, bool) else indented
    return F.when(indented, F.concat(F.regexp_extract(line, r"^(?U:\s*)", 0), bare)).otherwise(bare)


def is_indented(path: Column) -> Column:
    return F.element_at(F.split(path, r"\."), -1).isin(INDENTED)


def rename(line: Column, old: str, new: str) -> Column:
    """The line with every occurrence of an identifier replaced."""
    return F.regexp_replace(line, rf"(?<![A-Za-z0-9_$]){quoted(old)}(?![A-Za-z0-9_$])", new.replace("\\", "\\\\").replace("$", "\\$"))


def apply_renames(line: Column, renames: list[tuple[str, str]]) -> Column:
    """One rename after the other."""
    for old, new in renames:
        line = rename(line, old, new)
    return line


def one_line(text: Column, most: int) -> Column:
    """White space collapsed and the length capped; what is cut ends in an ellipsis within the cap."""
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def snippet(line: Column, number: Column, most: int = 48) -> Column:
    """What an unnamed item is called: the start of its first line, or the line's number where that is blank."""
    t = F.regexp_replace(F.coalesce(line, F.lit("")), r"(?U)^\s+|\s+$", "")
    cut = F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)
    return F.when(t == "", F.concat(F.lit("line "), number.cast("string"))).otherwise(cut)


def bare_name(name: Column) -> Column:
    """Behind the last '::', then behind the last '.'."""
    return F.substring_index(F.substring_index(name, "::", -1), ".", -1)


def owner_of(name: Column) -> Column:
    """What stands before the bare name and its separator; null without one."""
    got = F.regexp_extract(name, r"^([\s\S]*?)(?:::|\.)[^.:]*$", 1)
    return F.when(got != "", got)


def call_name(name: Column) -> Column:
    """The name that callers use: the class's for a constructor."""
    own = bare_name(name)
    return F.when(own.isin(CONSTRUCTORS) & owner_of(name).isNotNull(), bare_name(owner_of(name))).otherwise(own)


def module_name(path: Column) -> Column:
    """The file's stem, or its folder's name where the stem stands for the folder."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    return F.when(stem.isin(FOLDER_STEMS) & (F.size(parts) > 1), F.try_element_at(parts, F.lit(-2))).otherwise(stem)


def remote(url: Column) -> Column:
    """(repo, link) of a git remote: the last two path segments, and the address without user and port; null with fewer."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(url), "/+$", ""), r"(\.git)+$", "")
    ssh = clean.startswith("git@")
    rest = F.when(ssh, F.substring(clean, 5, 1 << 30)).otherwise(F.regexp_replace(F.regexp_extract(clean, r"^[^:]*(?::(?!//)[^:]*)*://([\s\S]*)$", 1), r"^[\s\S]*@", ""))
    host = F.when(ssh, F.regexp_extract(rest, "^([^:]*):", 1)).otherwise(F.regexp_extract(rest, "^([^/]*)/", 1))
    path = F.when(ssh, F.regexp_extract(rest, r"^[^:]*:([\s\S]*)$", 1)).otherwise(F.regexp_extract(rest, r"^[^/]*/([\s\S]*)$", 1))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    out = F.struct(F.array_join(F.slice(parts, -2, 2), "/").alias("repo"), F.concat(F.lit("https://"), F.substring_index(host, ":", 1), F.lit("/"), F.array_join(parts, "/")).alias("link"))
    return F.when(F.size(parts) >= 2, out)


def link_allowed(url: Column, hosts: list[str]) -> Column:
    """https, no '?', '@' or white space, and one of the hosts or a subdomain of one."""
    host = F.regexp_extract(F.lower(url), r"^https://([^/?#:@\s]+)", 1)
    known = F.lit(False)
    for h in hosts:
        known = known | (host == h) | host.endswith("." + h)
    return known & ~url.rlike(r"(?U)[?@\s]")


def writes_files(command: Column) -> Column:
    """Does a shell command write files: by a tool where a command starts, by a call, or by redirection into a file?"""
    starts = r"(?:^ *|[;&|(`\n{] *|sudo |xargs )"
    tools = command.rlike(f"{starts}(?:{'|'.join(map(quoted, WRITE_TOOLS))})")
    calls = command.rlike("|".join(map(quoted, WRITE_CALLS)))
    target = r"[\"']*(?!/dev/|&|=|[0-9])(?=[^\s;&|)]*[./])[^\s;&|)\"']"
    return tools | calls | command.rlike(rf"(?<![0-9&=\-><])>+\s*{target}")


def leaves_folder(command: Column, root: str) -> Column:
    """Does a command change to an absolute folder outside of root?"""
    dirs = F.regexp_extract_all(command, F.lit(r"(?<![\p{IsAlphabetic}\p{N}_-])cd +[\"']?(/[^\s;&|)\"']*)"), 1)
    return F.exists(dirs, lambda d: ~((F.regexp_replace(d, "/+$", "") == root) | d.startswith(root + "/")))


def path_tokens(command: Column) -> Column:
    """Every path a command names, and every tail of one of two segments or one: (tail, segments)."""
    whole = F.regexp_extract_all(command, F.lit(r"[\p{IsAlphabetic}\p{N}_.\-/]+"), 0)
    tails = F.transform(whole, lambda p: F.transform(F.sequence(F.lit(1), F.size(F.split(p, "/"))), lambda n: F.array_join(F.slice(F.split(p, "/"), -n, n), "/")))
    return F.array_distinct(F.flatten(tails))


def parse_answers(body: Column) -> Column:
    """Answers of a '/quiz 1a 2 c' reply as an array of (question, choice), both from 0; null where the body is none or answers nothing."""
    text = F.regexp_extract(F.lower(body), r"^\s*/quiz(?![\p{IsAlphabetic}\p{N}])([\s\S]*)$", 1)
    words = F.concat(F.lit(" "), F.array_join(F.filter(F.split(text, r"(?U)[\s,]+"), lambda w: w != ""), "  "), F.lit(" "))
    hits = F.regexp_extract_all(words, F.lit(r" 0*[1-9][0-9]{0,8}[.:)]*(?:  )?[a-e](?= )"), 0)
    out = F.transform(hits, lambda h: F.struct((F.regexp_extract(h, "[0-9]+", 0).cast("long") - 1).alias("question"), (F.ascii(F.regexp_extract(h, "[a-e]", 0)) - 97).cast("long").alias("choice")))
    return F.when(F.size(out) > 0, out)


def first_json(reply: Column) -> Column:
    """The JSON object of a model's reply: of a fenced block, else from the first brace to the last; null without one."""
    fenced = F.regexp_extract(reply, r"```(?:json)?\s*(\{[\s\S]*?\})\s*```", 1)
    braces = F.regexp_extract(reply, r"(\{[\s\S]*\})", 1)
    return F.when(fenced != "", fenced).when(braces != "", braces)


def whole_json(reply: Column) -> Column:
    """The first JSON object of a reply that is complete: from the first brace to the one that closes it, braces in its texts aside; null where none closes. What follows is left out."""
    tokens = F.regexp_extract_all(F.regexp_extract(reply, r"(\{[\s\S]*)", 1), F.lit(r'"(?:\\[\s\S]|[^"\\])*"|[{}]|[^{}"]+|"'), 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
        return F.when(s["done"], s).otherwise(F.struct(depth.alias("depth"), (s["n"] + 1).alias("n"), (depth == 0).alias("done")))

    end = F.aggregate(tokens, start, step, lambda s: F.when(s["done"], s["n"]))
    return F.when(end.isNotNull(), F.array_join(F.slice(tokens, 1, F.coalesce(end, F.lit(0))), ""))


def apply_fix(draft: Column, find: Column, replace: Column) -> Column:
    """The draft with the one occurrence of `find` replaced; as it was if there is none or more than one."""
    n = F.when(F.length(find) > 0, (F.length(draft) - F.length(F.replace(draft, find, F.lit("")))) / F.length(find))
    return F.when(n == 1, F.replace(draft, find, replace)).otherwise(draft)


def strip_refs(text: Column) -> Column:
    """Without id references in brackets: (#12), lists and ranges of them; kept behind a word that names an issue or a request."""
    one = r"#\d+(?:\s*(?:,|and|-|–|to)\s*#?\d+)*"
    return F.regexp_replace(text, rf"(?i)(?<!(?:issues?|prs?|pull requests?)\s{{0,9}})(?<!\s)\s*\({one}\)", "")


def comment_payload(json: Column, mark: str) -> Column:
    """JSON hidden in an HTML comment; hyphens are escaped so that nothing in it can end the comment."""
    return F.concat(F.lit(f"<!-- {mark} "), F.replace(json, F.lit("-"), F.lit("\\u002d")), F.lit(" -->"))


def read_payload(body: Column, mark: str) -> Column:
    """The JSON of the first such comment in a body; null without one."""
    got = F.regexp_extract(body, rf"<!-- {quoted(mark)} ([\s\S]*?) -->", 1)
    return F.when(got != "", F.replace(got, F.lit("\\u002d"), F.lit("-")))


def context_size(tokens: Column, step: int = 8192, most: int = 65536) -> Column:
    """The context a model needs, in whole steps; null beyond the most."""
    need = (F.ceil(tokens / step) * step).cast("long")
    return F.when(need <= most, need)


def c_quote(path: Column) -> Column:
    """A path as patch headers have it: quoted, with bytes outside of printable ASCII, quotes and backslashes escaped, if it has any."""
    two = F.regexp_extract_all(F.hex(path.cast("binary")), F.lit(".."), 0)
    named = {"22": '\\"', "5C": "\\\\", "09": "\\t", "0A": "\\n", "07": "\\a", "08": "\\b", "0B": "\\v", "0C": "\\f", "0D": "\\r"}

    def byte(h: Column) -> Column:
        value = F.conv(h, 16, 10).cast("int")
        out = F.when((value >= 0x20) & (value <= 0x7E), F.chr(value)).otherwise(F.concat(F.lit("\\"), F.lpad(F.conv(h, 16, 8), 3, "0")))
        for k, v in named.items():
            out = F.when(h == k, v).otherwise(out)
        return out

    return F.when(path.rlike(r'[^\x20-\x7e]|["\\]'), F.concat(F.lit('"'), F.array_join(F.transform(two, byte), ""), F.lit('"'))).otherwise(path)
