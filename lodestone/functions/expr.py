"""Scalar semantics of the engine as pure Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no signal in a focus text.
STOP_WORDS = ("the", "a", "an", "of", "to", "for", "and", "or", "in", "on", "is", "are", "this", "that")
#: What the first fitting clause of a focus token adds to the score.
EXACT_NAME, NAME_PART, DOC_PART, TARGET_PART = 3.0, 2.0, 1.0, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def sqlite_like(c: Column, pattern: str) -> Column:
    """LIKE with ASCII case folding only, live % and _, and no escape character."""
    return ascii_lower(c).like(pattern.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\"))


def short_name(c: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(c, ".", -1)


def parent_name(c: Column) -> Column:
    """What stands before the last dot; empty without one."""
    return F.when(F.instr(c, ".") > 0, F.regexp_replace(c, r"\.[^.]*$", "")).otherwise("")


def display_path(root: Column, path: Column) -> Column:
    return F.when(F.coalesce(root, F.lit("")) != "", F.concat(root, F.lit("/"), path)).otherwise(path)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, ".").otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d, 0 where d is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / F.when(d != 0, d).cast("double"))


def rank_bucket(c: Column, text: str) -> Column:
    """0: equal (case counts), 1: prefix, 2: anything else that was let through."""
    return F.when(c == text, 0).when(sqlite_like(c, f"{text}%"), 1).otherwise(2)


def focus_tokens(focus: str) -> list[str]:
    """Lower-cased words of letters and digits, without stop words, first of each."""
    words = re.findall(r"[^\W_]+", focus.lower())
    return list(dict.fromkeys(w for w in words if w not in STOP_WORDS))


def focus_score(tokens: list[str], name: Column, qualified: Column, doc: Column, targets: Column | None = None) -> Column:
    """The sum over tokens of the first clause that fits; 0 for all without tokens."""
    total = F.lit(0.0)
    n, q, d = F.lower(name), F.lower(qualified), F.lower(F.coalesce(doc, F.lit("")))
    for t in tokens:
        one = F.when(n == t, EXACT_NAME).when(F.contains(n, F.lit(t)) | F.contains(q, F.lit(t)), NAME_PART).when(F.contains(d, F.lit(t)), DOC_PART)
        if targets is not None:
            one = one.when(F.exists(targets, lambda x: F.contains(F.lower(x), F.lit(t))), TARGET_PART)  # noqa: B023
        total = total + one.otherwise(0.0)
    return total


def is_test_file(path: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.split(p, "/")
    folders, base = F.slice(parts, F.lit(1), F.size(parts) - 1), F.element_at(parts, -1)
    ext = F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1))
    stem = F.regexp_replace(base, r"(?i)\.py$", "")
    script = ext.isin(".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts")
    hit = F.when(ext == ".go", base.endswith("_test.go"))
    hit = hit.when(script, F.contains(base, F.lit(".test.")) | F.contains(base, F.lit(".spec.")) | F.array_contains(folders, "__tests__"))
    hit = hit.when(ext == ".py", stem.startswith("test_") | stem.endswith("_test") | F.array_contains(folders, "test") | F.array_contains(folders, "tests"))
    return F.coalesce(hit, F.lit(False)) & ~F.array_contains(folders, "testdata")


def bytes_to_tokens(b: Column, per_token: float) -> Column:
    return F.when(b == 0, F.lit(0).cast("long")).otherwise((b / F.lit(per_token) + 0.5).cast("long"))


def right_trimmed(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, r"\r+$", ""), r"[ \t]+$", "")


#: Constructs of java.util.regex that an RE2 pattern cannot have.
_NOT_RE2 = re.compile(r"\(\?<?[=!]|\(\?>|\\[1-9]|\\k<|[*+?}]\+|\\[GZXR]")


def line_pattern(pattern: str) -> str:
    """The pattern, if RE2 would take it; ValueError otherwise."""
    if _NOT_RE2.search(pattern):
        raise ValueError(f"bad pattern: {pattern!r} uses lookaround, backreferences or possessive quantifiers")
    return pattern


def glob_to_regex(glob: str) -> str:
    """An anchored regular expression: ** spans folders, {a,b} is a choice, * ? and [] stay in one segment."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob.startswith("**", i) and (i == 0 or glob[i - 1] == "/") and i + 2 == len(glob):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end
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
