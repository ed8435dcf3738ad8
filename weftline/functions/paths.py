"""Paths, addresses and names as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Files and folders that change with everything. Fixed values.
CROSS_CUTTING_NAMES = ("Cargo.lock", "yarn.lock", "package-lock.json", "pnpm-lock.yaml", "Gemfile.lock", "composer.lock", "poetry.lock", "uv.lock", "go.sum", "Pipfile.lock", ".gitignore", ".gitattributes")
CROSS_CUTTING_FOLDERS = ("dist", "build", "generated", ".next", "node_modules")
#: What mining leaves out. Fixed values.
EXCLUDED_FOLDERS = ("node_modules/", "target/", "dist/", "build/", "coverage/", ".yarn/", "__snapshots__/")
EXCLUDED_SUFFIXES = (".snap", ".lock", ".min.js", ".min.css", ".map")
LOCKFILES = ("yarn.lock", "package-lock.json", "Cargo.lock", "pnpm-lock.yaml", "Gemfile.lock", "poetry.lock", "go.sum", "Pipfile.lock", "composer.lock")
NESTED_LOCKFILES = ("yarn.lock", "package-lock.json", "Cargo.lock", "pnpm-lock.yaml", "go.sum")
#: Files that suggestions never name: these names anywhere in the path, and a pattern of names. Fixed values.
REJECTED_ANYWHERE = ("yarn-validate-output.log", ".last-flush")
REJECTED_NAME = r"^analyze-v[0-9]+\.mjs$"
#: Names that a set can't have. Fixed values.
RESERVED_NAMES = ("add", "remove", "commit", "why", "restore", "revert", "delete", "move", "stale", "fetch", "push", "doctor", "log", "config", "list", "help", "pre-commit", "advice", "rewrite", "hooks")
#: Names of files and folders that say nothing of what refers to them. Fixed values.
GENERIC_NAMES = ("plugin.json", "package.json", "index.ts", "index.js", "index.tsx", "mod.rs", "main.rs", "main.go", "lib.rs", "init.py", "__init__.py", "README.md", "CHANGELOG.md", "Cargo.toml", "tsconfig.json", "hooks.json", "SKILL.md")
GENERIC_FOLDERS = ("src", "lib", "test", "tests", "dist", "node_modules", ".claude-plugin", "hooks", "skills", "agents", "commands")
#: Commit messages, in the common subset of regular expressions. Fixed patterns.
DEPENDENCY_UPDATE = r"(?i)\b(bump|upgrade|update)\b.*\b(deps?|dependenc|version|packages?)\b|^chore\(deps\)|dependabot|renovate"
FIX = r"(?i)\b(fix(es|ed|ing)?|bug|regression|hotfix|patch|revert|restore|tighten|close[sd]?\s+(the\s+)?\S+\s+loophole|closes?\s+#\d+)\b"
TICKET = r"\b([A-Z][A-Z0-9]+-\d+)\b"
SCOPE = r"^(?:feat|fix|chore|refactor|docs|test|perf|build)\(([^)]+)\)"
#: Language families by extension. Fixed values.
FAMILIES = {
    "ts/js": ("ts", "tsx", "js", "jsx", "mjs", "cjs"),
    "rust": ("rs",),
    "python": ("py",),
    "go": ("go",),
    "jvm": ("java", "kt"),
    "c/c++": ("c", "h", "cc", "cpp", "hpp"),
    "prose": ("md", "txt", "rst"),
    "config": ("json", "yaml", "yml", "toml"),
}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def top_folders(path: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, n), "/")


def is_cross_cutting(path: Column) -> Column:
    folders = "|".join(map(re.escape, CROSS_CUTTING_FOLDERS))
    return basename(path).isin(*CROSS_CUTTING_NAMES) | F.concat(F.lit("/"), path).rlike(f"/({folders})/")


def is_excluded(path: Column) -> Column:
    out = F.lit(False)
    for e in EXCLUDED_FOLDERS:
        out = out | F.startswith(path, F.lit(e)) | F.contains(path, F.lit("/" + e))
    for s in EXCLUDED_SUFFIXES:
        out = out | F.endswith(path, F.lit(s))
    return out


def is_lockfile(path: Column) -> Column:
    nested = "|".join(map(re.escape, NESTED_LOCKFILES))
    return path.isin(*LOCKFILES) | path.rlike(f"/({nested})$")


def is_acceptable(path: Column, report: str = "suggestions") -> Column:
    """A relative path of a file that a suggestion may name; report: stem of the files that hold suggestions themselves."""
    base = basename(path)
    extended = base.rlike(r"\.[A-Za-z0-9]{1,8}$")
    return (
        (path != "")
        & ~F.startswith(path, F.lit("/"))
        & ~F.endswith(path, F.lit("/"))
        & path.rlike("[/.]")
        & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, REJECTED_ANYWHERE)))
        & (extended | (F.size(F.split(path, "/")) > 2))
        & ~base.rlike(REJECTED_NAME)
        & ~base.rlike(rf"^{re.escape(report)}(-v[0-9]+)?\.(mjs|md)$")
    )


def is_dependency_update(message: Column) -> Column:
    return F.coalesce(message.rlike(DEPENDENCY_UPDATE), F.lit(False))


def is_fix(message: Column) -> Column:
    """Whether a commit message tells of a mended fault."""
    return F.coalesce(message.rlike(FIX), F.lit(False))


def under(path: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | (path == p) | F.startswith(path, F.lit(p.rstrip("/") + "/"))
    return out


def family(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([a-zA-Z0-9]+)$", 1))
    out = F.when(ext == "", "?")
    for name, known in FAMILIES.items():
        out = out.when(ext.isin(*known), name)
    return out.otherwise(ext)


def address(path: Column, start: Column, end: Column, whole: Column) -> Column:
    return F.when(whole, path).otherwise(F.concat(path, F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string")))


def parsed_address(text: Column) -> Column:
    """struct(path, start, end, whole); null for a # that isn't #L<s>-L<e> with 1 <= s <= e."""
    shape = r"^([^#]+)#L([0-9]+)-L([0-9]+)$"
    start, end = (F.regexp_extract(text, shape, k).try_cast("bigint") for k in (2, 3))
    ranged = F.struct(F.regexp_extract(text, shape, 1).alias("path"), start.alias("start"), end.alias("end"), F.lit(False).alias("whole"))
    none = F.lit(None).cast("bigint")
    plain = F.struct(text.alias("path"), none.alias("start"), none.alias("end"), F.lit(True).alias("whole"))
    return F.when(text.rlike(shape) & (start >= 1) & (end >= start), ranged).when(~F.contains(text, F.lit("#")) & (text != ""), plain)


def canonical(path: Column) -> Column:
    """Backslashes as slashes, without empty and . segments, each .. taking back a segment before it."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda a, s: F.when((s == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(s == "..", a).otherwise(F.concat(a, F.array(s))))
    return F.array_join(folded, "/")


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: * and ? stay within a segment, ** crosses, {a,b} and [..] choose."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inside = glob[i + 1 : end]
            out += "[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def is_set_name(name: Column) -> Column:
    """Lower-case segments of letters, digits and dashes, each beginning with a letter or digit; not a reserved name."""
    return ~name.isin(*RESERVED_NAMES) & name.rlike(r"^[a-z0-9][a-z0-9-]*(/[a-z0-9][a-z0-9-]*)*$")


def flat_name(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("++"))


def full_name(flat: Column) -> Column:
    return F.replace(flat, F.lit("++"), F.lit("/"))


def cluster_key(subject: Column, body: Column) -> Column:
    """ticket:<ticket> of the subject, else of the body, else scope:<scope> of the subject; null if there is none."""
    found = lambda c, pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    ticket = F.coalesce(found(subject, TICKET), found(body, TICKET))
    return F.coalesce(F.concat(F.lit("ticket:"), ticket), F.concat(F.lit("scope:"), F.lower(found(subject, SCOPE))))


def hunk_key(path: Column, heading: Column, start: Column) -> Column:
    """Where a hunk is: the first 60 characters of its heading without leading marks, or a bucket of 100 lines."""
    clean = F.regexp_replace(F.substr(F.regexp_replace(heading, r"^[#\s>*-]+", ""), F.lit(1), F.lit(60)), r"^\s+|\s+$", "")
    first = F.floor((start - 1) / 100) * 100 + 1
    bucket = F.concat(F.lit("L"), first.cast("string"), F.lit("-L"), (first + 99).cast("string"))
    return F.concat(path, F.lit("#"), F.when(F.coalesce(clean, F.lit("")) != "", clean).otherwise(bucket))


def csv_field(text: Column) -> Column:
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def relative_time(seconds: Column) -> Column:
    """Elapsed seconds in the largest whole unit."""
    units = ((31_536_000, "year"), (2_592_000, "month"), (604_800, "week"), (86_400, "day"), (3600, "hour"), (60, "minute"))
    out = None
    for size, unit in units:
        n = F.floor(seconds / size)
        said = F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
        out = F.when(seconds >= size, said) if out is None else out.when(seconds >= size, said)
    return out.otherwise(F.concat(F.greatest(seconds, F.lit(0)).cast("bigint").cast("string"), F.lit(" seconds ago")))
