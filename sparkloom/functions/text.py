"""Column functions over paths, names and texts. All of them are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalog


#: What ends a line in text that is read line by line.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """x without the blanks of any kind at its ends."""
    return F.regexp_replace(as_column(x), r"(?dU)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalize_path(path: Column | str) -> Column:
    """Slashes for backslash-free POSIX paths; any leading run of dots and slashes goes, so ``.env`` becomes ``env``."""
    p = F.regexp_replace(F.regexp_replace(as_column(path), "/+", "/"), r"(?<=/)\./|/\.?$", "")
    return F.ltrim(p, F.lit("./"))


def file_name(path: Column | str) -> Column:
    return F.substring_index(as_column(path), "/", -1)


def suffix(path: Column | str) -> Column:
    """The last dot and what follows: none for a dotfile's first dot and for names that end in a dot."""
    name = file_name(path)
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def stem(path: Column | str) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def glob_regex(glob: str) -> str:
    """A shell glob as an anchored regular expression: ``*`` takes slashes too."""
    out = []
    i = 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2)
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = close
        else:
            out.append(c if c.isalnum() or c in "_/-" else "\\" + c)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches_any(path: Column | str, globs: list[str]) -> Column:
    """Whether a glob takes the whole path or the file name."""
    if not globs:
        return F.lit(False)
    pattern = "|".join(f"(?:{glob_regex(g)[4:]})" for g in globs)
    path = as_column(path)
    return F.rlike(path, F.lit("(?s)" + pattern)) | F.rlike(file_name(path), F.lit("(?s)" + pattern))


def has_part(path: Column | str, parts: list[str]) -> Column:
    return F.arrays_overlap(F.split(as_column(path), "/"), F.array(*[F.lit(p) for p in parts]))


def under(path: Column, prefix: Column) -> Column:
    """Whether path is prefix or lies below it. An empty prefix holds nothing."""
    clean = F.rtrim(prefix, F.lit("/"))
    return (clean != "") & ((path == clean) | F.startswith(path, F.concat(clean, F.lit("/"))))


def is_ignored(path: Column | str, prefixes: list[str] = ()) -> Column:
    """Whether the scan leaves a normalised path out: by part, lock file name, or configured prefix."""
    path = as_column(path)
    out = has_part(path, catalog.IGNORED_PARTS) | file_name(path).isin(catalog.LOCKFILES)
    for p in prefixes:
        out = out | under(path, normalize_path(F.lit(p)))
    return out


def is_text(path: Column | str) -> Column:
    return F.lower(suffix(path)).isin(catalog.TEXT_EXTENSIONS) | file_name(path).isin(catalog.TEXT_NAMES)


def kept_for_languages(root: Column | str, path: Column | str) -> Column:
    """Whether a file counts for the languages of a tree: no skipped directory in its path or above the tree's root."""
    return ~has_part(F.concat_ws("/", as_column(root), as_column(path)), catalog.LANGUAGE_SKIPPED)


def is_hidden_or_skipped(path: Column | str) -> Column:
    """The profile's skip test: a skipped directory name, or any part that begins with a dot but ``.github``."""
    parts = F.split(as_column(path), "/")
    return F.exists(parts, lambda p: p.isin(catalog.IGNORED_PARTS) | (F.startswith(p, F.lit(".")) & (p != ".github")))


def language(path: Column | str) -> Column:
    pairs = [F.lit(x) for kv in catalog.LANGUAGES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(suffix(path)))


def name_style(name: Column | str) -> Column:
    n = as_column(name)
    return (
        F.when(n.isNull() | (n == ""), "unknown")
        .when(n.contains("-"), "kebab-case")
        .when(n.contains("_"), "snake_case")
        .when(n.rlike("^[A-Z][A-Za-z0-9]+$"), "PascalCase")
        .when(n.rlike("^[a-z][A-Za-z0-9]*$"), "camelCase")
        .otherwise("unknown")
    )


def stripped_name(path: Column | str) -> Column:
    """The file name without the first compound suffix that fits, else its stem."""
    name = file_name(path)
    out = stem(path)
    for s in reversed(catalog.STRIPPED_SUFFIXES):
        out = F.when(name.endswith(s), F.substring(name, F.lit(1), F.length(name) - len(s))).otherwise(out)
    return out


def test_pattern(path: Column | str) -> Column:
    """The test naming that a file shows, or null."""
    name, end = file_name(path), suffix(path)
    return (
        F.when(name.contains(".test."), F.concat(F.lit("*.test"), end))
        .when(name.contains(".spec."), F.concat(F.lit("*.spec"), end))
        .when(name.endswith("_test.go"), "*_test.go")
        .when(name.startswith("test_"), F.concat(F.lit("test_*"), end))
        .when(name.endswith("_spec.rb"), "*_spec.rb")
    )


def package_name(specifier: Column | str) -> Column:
    """The package of an import: two parts after an ``@``, else one."""
    return F.regexp_extract(as_column(specifier), "(?s)^(@[^/]*(?:/[^/]*)?|[^/]*)", 1)


def directory_label(path: Column | str) -> Column:
    parts = F.split(as_column(path), "/")
    labels = F.create_map(*[F.lit(x) for kv in catalog.DIRECTORY_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(labels, F.element_at(parts, -1)), F.try_element_at(labels, F.element_at(parts, 1)), F.lit(catalog.OTHER_DIRECTORY))


def snippet(x: Column) -> Column:
    return F.substring(F.replace(x, F.lit("\n"), F.lit(" ")), 1, catalog.SNIPPET)


def requirement_name(x: Column | str) -> Column:
    return F.regexp_extract(as_column(x), r"(?dU)^[^<>=!~\s\[]*", 0)


def universal_newlines(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), "\r\n?", "\n")


def pattern_flags(flags: str) -> str:
    """A Java flag group that makes a pattern behave as in Python: Unicode classes and cases, only ``\\n`` ends lines."""
    return f"(?dU{'iu' if 'i' in flags else ''}{'m' if 'm' in flags else ''}{'s' if 's' in flags else ''})"


def folded(text: Column | str) -> Column:
    """Lower case such that a lower-case ASCII literal is found wherever a pattern that ignores case finds it."""
    return F.lower(F.translate(as_column(text), "\u0130\u0131\u017f\u212a", "iisk"))


def matches(text: Column, pattern: str, possible: Column | None = None) -> Column:
    """All non-overlapping matches of a pattern that never matches nothing: array of struct(match, line, ordinal).

    A mark is put before each match; as it adds no line, the growth of each line is the number of matches that begin in
    it. All steps are linear in the text and in the matches. possible: a cheap test that holds wherever there is a match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    marked = F.regexp_replace(text, pattern, "\u0001$0")
    begun = F.zip_with(F.split(marked, "\n"), F.split(text, "\n"), lambda a, b: F.length(a) - F.length(b))
    lines = F.flatten(F.transform(begun, lambda n, i: F.array_repeat(i + 1, n)))
    listed = F.transform(F.arrays_zip(found.alias("m"), lines.alias("l")), lambda z, i: F.struct(z["m"].alias("match"), z["l"].alias("line"), i.alias("ordinal")))
    empty = F.expr("CAST(array() AS array<struct<match:string,line:int,ordinal:int>>)")
    hit = text.rlike(pattern)
    return F.when(hit if possible is None else possible & hit, listed).otherwise(empty)
