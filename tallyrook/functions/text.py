"""Text, path and hash helpers as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def slug(x: Column | str) -> Column:
    """Lower case; runs of other characters than a-z and 0-9 become one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "-"), "^-|-$", "")


def fnv1a32(x: Column | str) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as 8 hex digits."""
    digits = F.hex(F.encode(_c(x), "UTF-8"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long")
    h = F.aggregate(places, F.lit(2166136261).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def slug_or_hash(x: Column | str) -> Column:
    return F.when(slug(x) != "", slug(x)).otherwise(fnv1a32(x))


def truncate_bytes(x: Column | str, limit: int, mark: str) -> Column:
    """At most `limit` bytes of UTF-8 and a mark where more was cut; a character that the
    cut splits becomes the replacement character."""
    s = _c(x)
    head = F.make_valid_utf8(F.substring(s.cast("binary"), 1, limit).cast("string"))
    return F.when(F.octet_length(s) <= limit, s).otherwise(F.concat(head, F.lit(mark)))


def ascii_boundaries(pattern: str) -> str:
    r"""\b that only counts ASCII letters, digits and _ as parts of words."""
    word = "[0-9A-Za-z_]"
    return pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")


_WORD = "[0-9A-Za-z_]"


def found_in(x: Column | str, pattern: str, *more: str) -> Column:
    """Whether a text has a match of the pattern, as ascii_boundaries has it, or any of some plain
    texts. A list of phrases is searched faster than as one pattern: those with \\b at both ends
    together, from one boundary on, and others as plain text, or, with wildcards, only where their
    longest plain part is. The text is computed once."""
    inside = pattern[1:-1] if pattern.startswith("(") and pattern.endswith(")") else pattern
    whole, parts, slow = [], list(more), []
    for phrase in inside.split("|"):
        core = re.fullmatch(rf"\\b({_WORD}(?:(?![?*+])[^\\()\[\]{{}}|]*{_WORD})?)\\b", phrase)
        if core:
            whole.append(core[1])
        elif re.fullmatch(r"[^\\()\[\]{}|^$?*+][^\\()\[\]{}|^$]*", phrase):
            parts.append(phrase)
        else:
            slow, whole, parts = [ascii_boundaries(pattern)], [], list(more)
            break
    if whole:
        slow.append(rf"\W(?:{'|'.join(whole)})(?!\w)")  # in Java, \w is ASCII only

    def search(t: Column) -> Column:
        found = [t.contains(p) if p in more or p == _plain(p) else t.contains(_plain(p)) & t.rlike(p) for p in parts] + [t.rlike(p) for p in slow]
        return reduce(lambda a, b: a | b, found)

    return F.exists(F.array(F.concat(F.lit(" "), _c(x)) if whole else _c(x)), search)


def _plain(pattern: str) -> str:
    """The longest part of a pattern of characters and . ? * + that stands in all its matches."""
    return max(re.split(r".[?*+]+|[.]", pattern, flags=re.S), key=len)


def canonical_artifact(x: Column | str) -> Column:
    """Paths below <repo>/.worktrees/<name>/ are those of <repo>; the first such part only."""
    return F.regexp_replace(_c(x), r"(?s)^(.*?)/\.worktrees/[^/]+/(.*)$", "$1/$2")


def clean_path(x: Column | str) -> Column:
    """The shortest equal path by its text alone: no doubled or final slash, no `.`, and `..` taken
    together with the part before it; at the root it goes away. An empty path is `.`."""
    s = _c(x)
    rooted = s.startswith("/")
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        back = F.when((F.size(done) > 0) & (last != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).when(rooted, done).otherwise(F.concat(done, F.array(part)))
        return F.when(part.isin("", "."), done).when(part == "..", back).otherwise(F.concat(done, F.array(part)))

    folded = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(F.aggregate(F.split(s, "/"), none, step), "/"))
    # most paths are clean already
    odd = s.rlike(r"//|(?:^|/)\.\.?(?:/|$)|./$|^$")
    return F.when(~odd, s).otherwise(F.when(folded == "", ".").otherwise(folded))


def artifact_path(x: Column | str) -> Column:
    """What stands before the first #, cleaned."""
    return clean_path(F.substring_index(_c(x), "#", 1))


def artifact_section(x: Column | str) -> Column:
    s = _c(x)
    return F.when(F.instr(s, "#") > 0, F.substring(s, F.instr(s, "#") + 1, F.length(s))).otherwise(F.lit(""))


def strip_fence(x: Column | str) -> Column:
    """The inside of a text that is fenced by ``` lines; other texts as they are."""
    trimmed = F.regexp_replace(_c(x), r"^\s+|\s+$", "")
    inside = F.when(F.instr(trimmed, "\n") > 0, F.substring(trimmed, F.instr(trimmed, "\n") + 1, F.length(trimmed))).otherwise("")
    inside = F.regexp_replace(F.regexp_replace(F.regexp_replace(inside, r"\s+$", ""), "```$", ""), r"^\s+|\s+$", "")
    return F.when(trimmed.startswith("```"), inside).otherwise(_c(x))


def first_line(x: Column | str) -> Column:
    return F.substring_index(_c(x), "\n", 1)


def last_line(x: Column | str) -> Column:
    return F.trim(F.substring_index(F.regexp_replace(_c(x), r"^\s+|\s+$", ""), "\n", -1))


def pr_url(x: Column | str) -> Column:
    return F.trim(F.regexp_extract(_c(x), r"\*\*PR:\*\* ([^\n]*)", 1))


def repo_of_url(x: Column | str) -> Column:
    """owner/repo of a pull request's URL, else empty; what follows the owner may be empty."""
    return F.regexp_extract(_c(x), "^https://github\\.com/([^/]*/[^/]*)", 1)


def outcome(x: Column | str) -> Column:
    return F.regexp_extract(_c(x), r"<!-- outcome: ([0-9A-Za-z_]+) -->", 1)


def with_outcome(x: Column | str, state: Column) -> Column:
    return F.regexp_replace(_c(x), F.lit(r"<!-- outcome: [0-9A-Za-z_]+ -->"), F.concat(F.lit("<!-- outcome: "), state, F.lit(" -->")))


def commit_type(fix_type: Column | str) -> Column:
    return F.when(_c(fix_type) == "escalate-out-of-instructions", "chore").otherwise("docs")


def confidence_rank(x: Column | str) -> Column:
    return F.when(_c(x) == "high", 3).when(_c(x) == "medium", 2).otherwise(1)


def project_dir(x: Column | str) -> Column:
    return F.translate(_c(x), "/.", "--")


# Subjects of commits that have a type, and those that have two.
TYPED_SUBJECT = r"^[a-z]+(\([^)]*\))?!?: "
DOUBLY_TYPED = TYPED_SUBJECT + r"[a-z]+(\([^)]*\))?!?: "


def glob_parts(glob: str) -> tuple[str, str]:
    """(folder, file pattern) of a glob: the folder is what precedes the first part with **."""
    parts = glob.split("/")
    cut = next((i for i, p in enumerate(parts) if p == "**"), len(parts) - 1)
    return "/".join(parts[:cut]) or "/", re.sub(r"^\*\*$", "*", parts[-1])


__all__ = [n for n in dir() if not n.startswith("_") and n not in {"annotations", "re", "reduce", "Column", "F"}]
