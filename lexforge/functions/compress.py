"""Rewriting source text: comments, debug statements, blank lines, white space, minification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LITERAL, NO_LINE_END, SPACES, units


@dataclass(frozen=True)
class Options:
    """What compress() does. The last three are accepted and have no effect."""

    remove_comments: bool = True
    remove_console_logs: bool = False
    remove_debug_code: bool = False
    remove_blank_lines: bool = True
    collapse_whitespace: bool = True
    remove_dead_code: bool = False
    minify: bool = False
    collapse_object_literals: bool = False
    preserve_shebang: bool = True
    shorten_identifiers: bool = False
    remove_type_annotations: bool = False
    preserve_license: bool = True


_BLOCK = "/\\*(?s:.*?)\\*/"
COMMENTS = {
    "python": (f"#{NO_LINE_END}*", '"""(?s:.*?)"""|\'\'\'(?s:.*?)\'\'\''),
    "ruby": (f"#{NO_LINE_END}*", "=begin(?s:.*?)=end"),
    "haskell": (f"--{NO_LINE_END}*", "\\{-(?s:.*?)-\\}"),
}
C_STYLE = (f"//{NO_LINE_END}*", _BLOCK)
MARK = "\\x00STR"


def _gone(x: Column, *patterns: str) -> Column:
    for p in patterns:
        x = F.regexp_replace(x, p, "")
    return x


def trim_line_ends(x: Column) -> Column:
    return F.regexp_replace(x, f"[{SPACES}&&[^\\n]]+(?=\\n|\\z)", "")


def remove_comments(x: Column, language: str | None = None) -> Column:
    return trim_line_ends(_gone(x, *COMMENTS.get(language or "", C_STYLE)))


def remove_console(x: Column) -> Column:
    return _gone(x, f"console\\.[A-Za-z0-9_]+\\([^)]*\\);?[{SPACES}]*")


def remove_debug(x: Column) -> Column:
    return _gone(x, f"debugger;?[{SPACES}]*", f"import[{SPACES}]+pdb;?[{SPACES}]*pdb\\.set_trace\\(\\)")


def remove_blank_lines(x: Column) -> Column:
    return _gone(x, f"(?m)^[{SPACES}]*[\\r\\n]")


def collapse_whitespace(x: Column) -> Column:
    return F.regexp_replace(x, "[ \\t]{2,}", " ")


def remove_dead_code(x: Column) -> Column:
    jump = "(?<![A-Za-z0-9_])(break|continue|return|throw)(?![A-Za-z0-9_])"
    return F.regexp_replace(x, f"{jump}[^;]*;[{SPACES}]*[^}}{SPACES}][^;]*;", "$1;")


def minify(x: Column, collapse_object_literals: bool = False) -> Column:
    s = f"[{SPACES}]"
    x = F.regexp_replace(x, f"{s}+", " ")
    for chars in ("(),:;{}", "!%&*+\\-/<=>?^|~"):
        x = F.regexp_replace(x, f"{s}*([{chars}]){s}*", "$1")
    x = F.regexp_replace(F.regexp_replace(x, ";\\}", "}"), ";\\z", "")
    if collapse_object_literals:
        for opening, closing in ("{}", "[]"):
            x = F.regexp_replace(x, f"\\{opening}{s}+", f"\\{opening}")
            x = F.regexp_replace(x, f"{s}+\\{closing}", f"\\{closing}")
    return x


def _numbered(parts: Column, first: Column) -> Column:
    """The parts, joined by numbered marks."""
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("\0STR"), (i - 1 + first).cast("string"), F.lit("\0"), p))), "")


def protect(x: Column) -> tuple[Column, Column]:
    """(text with literals replaced by numbered marks, literals). Quoted strings come first, then templates."""
    quoted = LITERAL
    template = f"`(?:[^`\\\\]|\\\\{NO_LINE_END})*`"
    strings = F.regexp_extract_all(x, F.lit(quoted), F.lit(0))
    once = _numbered(F.split(x, quoted, -1), F.lit(0))
    templates = F.regexp_extract_all(once, F.lit(template), F.lit(0))
    return _numbered(F.split(once, template, -1), F.size(strings)), F.concat(strings, templates)


def restore(x: Column, literals: Column) -> Column:
    """Marks become literals again, in order. As in scripts' replace, $$ in a literal stands for $."""
    items = F.transform(literals, lambda s, i: F.struct(F.concat(F.lit("\0STR"), i.cast("string"), F.lit("\0")).alias("mark"), F.replace(s, F.lit("$$"), F.lit("$")).alias("text")))
    return F.aggregate(items, x, lambda acc, e: F.replace(acc, e["mark"], e["text"]))


def trim(x: Column) -> Column:
    return _gone(x, f"\\A[{SPACES}]+", f"[{SPACES}]+\\z")


def compress(x: Column, options: Options = Options(), language: str | None = None) -> Column:
    """All steps that the options ask for; literals stay as they are."""
    y, literals = protect(x)
    steps = [
        (options.remove_comments, lambda c: remove_comments(c, language)),
        (options.remove_console_logs, remove_console),
        (options.remove_debug_code, remove_debug),
        (options.remove_blank_lines, remove_blank_lines),
        (options.collapse_whitespace and not options.minify, collapse_whitespace),
        (options.remove_dead_code, remove_dead_code),
        (options.minify, lambda c: minify(c, options.collapse_object_literals)),
    ]
    for wanted, step in steps:
        if wanted:
            y = step(y)
    return F.when(F.length(x) == 0, x).otherwise(trim(restore(y, literals)))


def smart_compress(x: Column, options: Options = Options(), language: str | None = None) -> Column:
    """compress() after the text's shebang line, which languages without # comments then show twice."""
    body = compress(x, options, language)
    if not options.preserve_shebang:
        return body
    return F.when(x.startswith("#!"), F.concat(F.regexp_extract(x, "\\A([^\\n]*\\n?)", 1), body)).otherwise(body)


def estimate(x: Column, options: Options = Options(remove_blank_lines=True)) -> Column:
    """array of (type, count, tokens_saved) for what compression would remove."""
    zero = F.lit(0)
    comments = F.regexp_count(x, F.lit(C_STYLE[0])) + F.regexp_count(x, F.lit(_BLOCK)) if options.remove_comments else zero
    blank = F.size(F.filter(F.split(x, "\\n"), lambda r: ~r.rlike(f"[^{SPACES}]"))) if options.remove_blank_lines else zero
    logs = F.regexp_count(x, F.lit("console\\.[A-Za-z0-9_]+")) if options.remove_console_logs else zero
    found = [F.struct(F.lit(n).alias("type"), c.cast("long").alias("count"), (c * 3).cast("long").alias("tokens_saved")) for n, c in (("comment", comments), ("blankLine", blank), ("consoleLog", logs))]
    return F.filter(F.array(*found), lambda e: e["count"] > 0)


def compress_full(x: Column, options: Options = Options(), language: str | None = None) -> dict[str, Column]:
    """smart_compress() with sizes and what would be removed."""
    code = smart_compress(x, options, language)
    ratio = F.when(units(code) > 0, units(x) / units(code)).otherwise(F.lit(1.0))
    return {"code": code, "original_size": units(x).cast("long"), "compressed_size": units(code).cast("long"), "ratio": ratio, "removed": estimate(x, options)}
