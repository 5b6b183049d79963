"""Scalar column functions on texts, paths, names and URLs.

All are built-in Spark expressions. Patterns use (?d) so that only a line feed ends a line
and (?U) so that word and space classes cover all scripts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetfacts import constants as C

# Characters removed by strip(): ASCII and Unicode white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Characters that `.` does not match in a pattern.
LINE_ENDS = "\n\r\x85\u2028\u2029"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def extract_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def string_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def contains_word(text: Column, word: str) -> Column:
    """As `contains`, for long texts: a pattern that is a literal skips by its length."""
    return text.rlike("".join(c if c.isalnum() or c == " " else "\\" + c for c in word))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Some word occurs. Words that hold another of them cannot change that and are left out."""
    words = list(dict.fromkeys(words))
    found = F.lit(False)
    for word in words:
        if not any(other != word and other in word for other in words):
            found = found | contains_word(text, word)
    return found


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of a fixed mapping, null when the key is absent."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


# --- content -------------------------------------------------------------------------


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def decode_ignore(content: Column) -> Column:
    """UTF-8 text with invalid bytes dropped; characters U+FFFD of the text itself stay."""
    text = content.cast("string")
    # Invalid bytes become U+FFFD, so genuine ones are written as two noncharacters meanwhile.
    guarded = F.replace(text, F.lit("\ufffd"), F.lit("\ufdd0\ufdd1"))
    dropped = F.replace(F.make_valid_utf8(guarded), F.lit("\ufffd"), F.lit(""))
    cleaned = F.replace(dropped, F.lit("\ufdd0\ufdd1"), F.lit("\ufffd"))
    return normalise_newlines(F.when(F.is_valid_utf8(text), text).otherwise(cleaned))


def decode_strict(content: Column) -> Column:
    """UTF-8 text, null when any byte is invalid."""
    text = content.cast("string")
    return normalise_newlines(F.when(F.is_valid_utf8(text), text))


def lines(text: Column) -> Column:
    """Lines of a text; a final line feed does not open another line."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n")


def manifest_lines(text: Column) -> Column:
    """Stripped lines of a manifest, also cut at the rarer Unicode line ends."""
    parts = F.split(text, "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]")
    return F.transform(parts, strip)


# --- paths ---------------------------------------------------------------------------


def _dir_pattern(match_filename: bool) -> str:
    names = "|".join(n.replace(".", r"\.") for n in C.VENDORED_DIRS)
    end = r"(?:[/\\]|$)" if match_filename else r"[/\\]"
    return rf"(?:^|[/\\])(?:{names}){end}"


def is_vendored(path: Column, match_filename: bool = True) -> Column:
    """Some part of the path is a vendored or build directory.

    Most paths hold none of the names, so names are looked for before the pattern.
    """
    named = F.lit(False)
    for name in C.VENDORED_DIRS:
        # A name that ends with another one occurs only where that one does.
        if not any(other != name and other in name for other in C.VENDORED_DIRS):
            named = named | path.contains(name)
    return named & path.rlike(_dir_pattern(match_filename))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_extension(path: Column) -> Column:
    """Suffix with its dot; '' for none and for dot-files."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def has_extension(path: Column, *extensions: str) -> Column:
    """As `file_extension(path).isin(...)`, in a form that file statistics can answer."""
    found = F.lit(False)
    for ext in extensions:
        dot_file = (path == ext) | path.endswith("/" + ext)
        found = found | (path.endswith(ext) & ~dot_file)
    return found


def extension_place(path: Column, extensions: list[str]) -> Column:
    """Place of `file_extension(path)` in a list, from 1; 0 when it is none of them."""
    place = F.lit(0)
    for k, ext in enumerate(extensions, 1):
        place = F.when(has_extension(path, ext), k).otherwise(place)
    # The pattern of `file_extension` does not reach over line ends, which hardly any path holds.
    broken = F.lit(False)
    for end in LINE_ENDS:
        broken = broken | path.contains(end)
    listed = F.array_position(string_array(extensions), file_extension(path)).cast("int")
    return F.when(broken, listed).otherwise(place)


def is_important(path: Column) -> Column:
    return file_name(path).isin(C.IMPORTANT_FILENAMES) | path.startswith(C.WORKFLOW_PREFIX)


def parent_dir(path: Column) -> Column:
    return F.substr(path, F.lit(1), F.length(path) - F.length(file_name(path)) - 1)


OUTSIDE = ".."


def _fold_segments(path: Column) -> Column:
    """Fold '.' and '..' segment by segment; null when the path leaves the root."""

    def step(acc: Column, part: Column) -> Column:
        return (
            F.when(acc.isNull() | part.isin("", "."), acc)
            .when((part == "..") & (F.size(acc) == 0), F.lit(None))
            .when(part == "..", F.slice(acc, F.lit(1), F.size(acc) - 1))
            .otherwise(F.array_append(acc, part))
        )

    folded = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.array_join(folded, "/")


def relative_lead(target: Column) -> Column:
    """The steps `./` and `../` a relative target begins with."""
    return F.regexp_extract(target, r"^(?:\./)*(?:\.\./)*", 0)


def resolve_relative(directory: Column, target: Column, lead: Column | None = None) -> Column:
    """A relative target seen from a directory; OUTSIDE when it leaves the root.

    The usual target, `./` or some `../` before plain segments, is resolved by string
    functions; any other is folded segment by segment. `lead`, as a column that has been
    computed before, spares matching it wherever it is read.
    """
    lead = relative_lead(target) if lead is None else lead
    ups = ((F.length(lead) - F.length(F.replace(lead, F.lit("../"), F.lit("")))) / 3).cast("int")
    rest = F.substr(target, F.length(lead) + 1)
    slashes = F.length(directory) - F.length(F.replace(directory, F.lit("/"), F.lit("")))
    depth = F.when(directory == "", 0).otherwise(slashes + 1)
    base = F.call_function("substring_index", directory, F.lit("/"), depth - ups)
    quick = (
        F.when(ups > depth, F.lit(None).cast("string"))
        .when(ups == depth, rest)
        .otherwise(F.concat(base, F.lit("/"), rest))
    )
    folded = _fold_segments(F.concat(directory, F.lit("/"), target))
    unusual = rest.rlike(r"(?:^|/)\.{0,2}(?:/|$)")
    # Never null, so that a join on it adds no null check that would evaluate it again.
    return F.coalesce(F.when(unusual, folded).otherwise(quick), F.lit(OUTSIDE))


# --- versions, requirements, types ---------------------------------------------------


def version_number(constraint: Column) -> Column:
    """First dotted number of a constraint, null when there is none."""
    return extract(constraint, r"(?U)\d+(?:\.\d+)*", 0)


_REQUIREMENT = r"(?dU)^([A-Za-z0-9_\-\.]+)(?:\[.*?\])?\s*([><=!~^].+)?$"


def requirement_name(line: Column) -> Column:
    text = strip(line)
    name = extract(text, _REQUIREMENT, 1)
    return F.coalesce(F.replace(F.lower(name), F.lit("_"), F.lit("-")), text)


def requirement_spec(line: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(strip(line), _REQUIREMENT, 2)), F.lit(""))


def normalise_sql_type(raw: Column) -> Column:
    return F.element_at(F.split(strip(F.upper(raw)), r"(?U)[(\s]"), 1)


# --- names and URLs ------------------------------------------------------------------


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(text, "[^a-zA-Z0-9]+", "-")
    return F.lower(F.btrim(dashed, F.lit("-")))


def repo_slug(url: Column) -> Column:
    segment = F.substring_index(F.rtrim(url, F.lit("/")), "/", -1)
    name = slug(F.regexp_replace(segment, r"\.git$", ""))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("project"))


def owner_repo(url: Column, host: str = "github.com") -> Column:
    """struct(owner, repo) of an https or ssh address, null when it is neither."""

    def tail(text: Column, sep: str) -> Column:
        parts = F.split(F.substring_index(text, host + sep, -1), "/")
        pair = F.struct(
            F.get(parts, F.lit(0)).alias("owner"), F.get(parts, F.lit(1)).alias("repo")
        )
        return F.when(text.contains(host + sep) & (F.size(parts) >= 2), pair)

    cleaned = F.regexp_replace(F.rtrim(strip(url), F.lit("/")), r"\.git$", "")
    return let(cleaned, lambda u: F.coalesce(tail(u, "/"), tail(u, ":")))


def branch_name(number: Column, title: Column, prefix: str = "contrib") -> Column:
    short = F.rtrim(F.substring(slug(F.coalesce(title, F.lit(""))), 1, 50), F.lit("-"))
    return F.concat(F.lit(prefix + "/"), number.cast("string"), F.lit("-"), short)


def commit_message(number: Column, title: Column, issue_type: Column) -> Column:
    kind = F.coalesce(lookup(C.COMMIT_TYPES, issue_type), F.lit("chore"))
    number_text = number.cast("string")
    short = F.when(
        F.coalesce(title, F.lit("")) == "", F.concat(F.lit("address issue #"), number_text)
    ).otherwise(strip(title))
    header = F.concat(kind, F.lit(": "), short)
    cut = F.when(
        F.length(header) > 72, F.concat(F.substring(header, 1, 69), F.lit("..."))
    ).otherwise(header)
    return F.concat(cut, F.lit("\n\nCloses #"), number_text)


# --- display -------------------------------------------------------------------------


def format_size(size: Column) -> Column:
    kb, mb = size / F.lit(1024.0), size / F.lit(1024.0 * 1024.0)
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.format_string("%.1f KB", kb))
        .otherwise(F.format_string("%.1f MB", mb))
    )


def confidence_band(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.9, "high").when(confidence >= 0.7, "medium").otherwise("low")
    )


def diff_files(diff: Column) -> Column:
    return F.regexp_count(diff, F.lit("(?dm)^diff --git"))


def diff_insertions(diff: Column) -> Column:
    return F.regexp_count(diff, F.lit(r"\n\+")) - F.regexp_count(diff, F.lit(r"\n\+\+\+"))


def diff_deletions(diff: Column) -> Column:
    return F.regexp_count(diff, F.lit(r"\n-")) - F.regexp_count(diff, F.lit(r"\n---"))


def diff_stat(diff: Column) -> Column:
    return F.format_string(
        "%d file(s) changed, %d insertion(s), %d deletion(s)",
        diff_files(diff), diff_insertions(diff), diff_deletions(diff),
    )
