"""Structural reduction of logs with higher-order functions; a registry of further reducers can be passed instead."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, lines

# What counts as noise, errors and test results.
ANSI = "\x1b\\[[0-9;]*[A-Za-z]"
SPINNER = r"^[\s\|/\\\-]*$"
PROGRESS = r"(?i)\b\d+%|\[={0,50}>\s*\]|\b(eta|downloading|extracting)\b"
ERROR_LIKE = r"(?i)error|fail|fatal|panic"
PASS = r"^test .* \.\.\. ok$"
FAIL = r"^test .* \.\.\. FAILED$"
DURATION = r"test result: .*\.|ran for|time:.*s|duration"
FAILURES = r"(?i)failures:"
COMPILER_ERROR = r"(?i)^\s*error(\[.*\])?\s*:.*$"
COMPILER_PLACE = r"^\s*-->\s*([^\s]+):(\d+):(\d+)"
MOST_ERRORS, LAST_LINES, MOST_FAILURES = 20, 3, 201


def _has(line: Column, pattern: str) -> Column:
    return line.rlike("(?Ud)" + pattern)


def _no_repeats(xs: Column) -> Column:
    """Without elements equal to the one before them."""
    return let(xs, lambda ys: F.filter(ys, lambda y, i: (i == 0) | (y != F.get(ys, i - 1))))


def _join(xs: Column) -> Column:
    return F.array_join(xs, "\n")


@dataclass(frozen=True)
class Reducer:
    """Conditions and results over columns kind, content, command and exit_code."""

    name: str
    applies: Callable[[Column, Column], Column]
    reduce: Callable[[Column, Column, Column], Column]
    extract: Callable[[Column, Column, Column], Column]


def _compiler(content: Column, command: Column, exit_code: Column) -> Column:
    return _join(_no_repeats(F.filter(lines(content), lambda x: _has(x, COMPILER_ERROR) | _has(x, COMPILER_PLACE))))


def _test(content: Column, command: Column, exit_code: Column) -> Column:
    def result(xs: Column) -> Column:
        passed, failed = F.size(F.filter(xs, lambda x: _has(x, PASS))), F.exists(xs, lambda x: _has(x, FAIL))
        timing = let(F.filter(xs, lambda x: _has(x, DURATION)), lambda ts: F.when(F.size(ts) > 0, F.concat(F.lit("duration "), F.get(ts, F.size(ts) - 1))).otherwise(""))
        fine = let(passed, lambda n: F.when(n > 0, F.regexp_replace(F.concat(n.cast("string"), F.lit(" tests passed\n0 failed\n"), timing), r"(?U)\s+\z", "")))
        bad = F.slice(F.filter(xs, lambda x: _has(x, FAIL) | _has(x, FAILURES) | x.startswith("----")), 1, MOST_FAILURES)
        return F.coalesce(F.when(~failed, fine), _join(bad))

    return let(lines(content), result)


def _shell_lines(content: Column) -> Column:
    xs = lines(F.regexp_replace(content, ANSI, ""))
    return _no_repeats(F.filter(xs, lambda x: ~_has(x, SPINNER) & ~_has(x, PROGRESS)))


def _shell(content: Column, command: Column, exit_code: Column) -> Column:
    return _join(_shell_lines(content))


def _shell_extract(content: Column, command: Column, exit_code: Column) -> Column:
    indent = lambda xs: F.transform(xs, lambda x: F.concat(F.lit("  "), x))
    none = F.array().cast("array<string>")

    def result(kept: Column) -> Column:
        errors = F.slice(_no_repeats(F.filter(kept, lambda x: _has(x, ERROR_LIKE))), 1, MOST_ERRORS)
        last = F.slice(kept, F.greatest(F.size(kept) - LAST_LINES + 1, F.lit(1)), LAST_LINES)
        parts = F.concat(
            F.when(command.isNotNull(), F.array(F.concat(F.lit("command: "), command))).otherwise(none),
            F.when(exit_code.isNotNull(), F.array(F.concat(F.lit("exit_code: "), exit_code.cast("string")))).otherwise(none),
            F.array(F.lit("errors:")),
            let(errors, lambda es: F.when(F.size(es) > 0, indent(es)).otherwise(F.array(F.lit("  <none>")))),
            F.when(F.size(kept) > 0, F.concat(F.array(F.lit("final_status:")), indent(last))).otherwise(none),
        )
        return _join(parts)

    return let(_shell_lines(content), result)


def _is_test(kind: Column, content: Column) -> Column:
    xs = lines(content)
    seen = F.exists(xs, lambda x: _has(x, PASS) | _has(x, FAIL)) | content.contains("test result:")
    return (kind == "TestResult") | ((kind == "CommandOutput") & seen)


#: In order: the first that applies both reduces and extracts.
REDUCERS = (
    Reducer("compiler", lambda kind, content: kind.isin("Error", "CommandOutput") & content.contains("error["), _compiler, _compiler),
    Reducer("test", _is_test, _test, _test),
    Reducer("shell", lambda kind, content: kind == "CommandOutput", _shell, _shell_extract),
    Reducer("file_read", lambda kind, content: F.lit(False), lambda content, *_: content, lambda content, *_: content),
)


def reducer_name(kind: Column, content: Column, reducers: tuple[Reducer, ...] = REDUCERS) -> Column:
    """The first reducer that applies; null if none does."""
    out = F.lit(None).cast("string")
    for r in reversed(reducers):
        out = F.when(r.applies(kind, content), F.lit(r.name)).otherwise(out)
    return out


def apply(which: str, name: Column, content: Column, command: Column, exit_code: Column, reducers: tuple[Reducer, ...] = REDUCERS) -> Column:
    """``reduce`` or ``extract`` by the named reducer; the content itself without one."""
    out = content
    for r in reversed(reducers):
        out = F.when(name == r.name, getattr(r, which)(content, command, exit_code)).otherwise(out)
    return out
