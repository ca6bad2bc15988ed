"""Behaviour from recorded syscall traces: text lines in, one ``dynamic`` record for each job out.

Each line is tested by a cheap ``contains`` before any pattern, may feed several outputs, and carries its number, by which
lists are put back in order after the one shuffle, on job_id. Only the ``*at`` forms of file calls are read, as the
patterns of the format say; the plain forms (``unlink``, ``chmod``, ``open``) are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims


def _group(line: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(line, pattern, i)


def _seen(line: Column, word: str, pattern: str) -> Column:
    return F.contains(line, F.lit(word)) & line.rlike(pattern)


def is_noise(path: Column) -> Column:
    out = F.lit(False)
    for p in dims.NOISE_PREFIXES:
        out = out | F.startswith(path, F.lit(p))
    return out


def quoted(arg: Column) -> Column:
    """An argument as a shell would need it."""
    return F.when(arg.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), arg).otherwise(F.concat(F.lit("'"), F.replace(arg, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def argv(inside: Column) -> Column:
    return F.transform(F.regexp_extract_all(inside, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1)), lambda a: F.regexp_replace(F.trim(a), '^"+|"+$', ""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def persistence_meaning(path: Column) -> Column:
    out = None
    for pattern, meaning in dims.PERSISTENCE:
        out = F.when(path.rlike(pattern), meaning) if out is None else out.when(path.rlike(pattern), meaning)
    return out


def parse_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (job_id, line_no, line) plus one nullable struct for each kind of event."""
    line = F.col("line")
    at = "-1 ENOENT"
    execve, execveat = line.rlike(dims.EXECVE), line.rlike(dims.EXECVEAT)
    inside = F.when(execve, _group(line, dims.EXECVE, 2)).otherwise(_group(line, dims.EXECVEAT, 2))
    path = F.when(execve, _group(line, dims.EXECVE, 1)).otherwise(_group(line, dims.EXECVEAT, 1))
    tail = F.substring_index(line, ")", -1)
    failed = F.contains(tail, F.lit("-1 ")) & ~tail.rlike("EINPROGRESS|EALREADY|EISCONN")
    connects = _seen(line, "connect(", dims.CONNECT)
    flags, opened = _group(line, dims.OPEN, 2), _group(line, dims.OPEN, 1)
    mode = _group(line, dims.CHMOD, 2)
    return lines.where((F.col("line_no") <= dims.TRACE_LINES)).select(
        "job_id",
        "line_no",
        F.when(F.contains(line, F.lit("execve")) & (execve | execveat) & ~F.contains(line, F.lit(at)), F.struct(path.alias("path"), argv(inside).alias("argv"))).alias("process"),
        F.when(connects, F.struct(_group(line, dims.CONNECT, 2).alias("ip"), _group(line, dims.CONNECT, 1).try_cast("int").alias("port"), failed.alias("failed"))).alias("connect"),
        F.when(~connects & _seen(line, "connect(", dims.UNIX_CONNECT), _group(line, dims.UNIX_CONNECT, 1)).alias("unix"),
        F.when(_seen(line, "open", dims.OPEN) & flags.rlike("O_WRONLY|O_RDWR|O_CREAT") & ~is_noise(opened), opened).alias("written"),
        F.when(_seen(line, "unlink", dims.UNLINK) & ~is_noise(_group(line, dims.UNLINK, 1)), _group(line, dims.UNLINK, 1)).alias("deleted"),
        F.when(_seen(line, "chmod", dims.CHMOD), F.struct(_group(line, dims.CHMOD, 1).alias("path"), mode.alias("mode"), F.substring(mode, -3, 3).rlike("[1357]").alias("makes_executable"))).alias("chmod"),
        F.when(_seen(line, "rename", dims.RENAME) & ~is_noise(_group(line, dims.RENAME, 2)), F.struct(_group(line, dims.RENAME, 1).alias("from"), _group(line, dims.RENAME, 2).alias("to"))).alias("renamed"),
        F.when(_seen(line, "memfd_create", dims.MEMFD), _group(line, dims.MEMFD, 1)).alias("memfd"),
    )


def summarize(lines: DataFrame, launchers: DataFrame | None = None) -> DataFrame:
    """(job_id, dynamic fields) of trace lines; ``launchers`` (job_id, self_argv) names what started each sample.

    A job without lines has no row: see :func:`no_trace`.
    """
    events = parse_lines(lines)
    if launchers is not None:
        events = events.join(launchers.select("job_id", "self_argv"), "job_id", "left")
    else:
        events = events.withColumn("self_argv", F.lit(None).cast("array<string>"))
    p = F.col("process")
    said = F.concat_ws(" ", p["path"], F.array_join(p["argv"], " "))
    own = p.isNotNull() & ~F.coalesce(p["argv"] == F.col("self_argv"), F.lit(False)) & ~said.rlike(dims.HARNESS)
    # Java's \b knows only ASCII words here, as base names of programs are.
    tool = F.lower(F.regexp_extract(base_name(p["path"]), dims.LOLBIN, 0))
    events = events.withColumn("own", F.when(own, F.struct(p["path"].alias("path"), F.substring(F.array_join(F.transform(p["argv"], quoted), " "), 1, 800).alias("command")))).withColumn("tool", F.when(own & (tool != ""), tool))

    found = events.select("job_id", "line_no", F.explode(F.filter(F.array(*[_event(k, *v) for k, v in _KINDS.items()], _persistent("written"), _persistent("chmod.path")), lambda e: e["kind"].isNotNull())).alias("e")).select("job_id", "line_no", "e.*")
    # Kinds that are listed without repeats keep a value's first line; the rest keep each line.
    line = F.when(~F.col("kind").isin(*DISTINCT), F.col("line_no"))
    firsts = found.groupBy("job_id", "kind", "v", line.alias("_line")).agg(F.min("line_no").alias("at"))
    order = [F.when(F.col("kind") == "persistent", F.col("v.a")), F.col("at")]  # those by path, the others by line
    ranked = firsts.withColumn("_k", F.row_number().over(Window.partitionBy("job_id", "kind").orderBy(*order))).where(F.col("_k") <= max(CAPS.values()))
    ranked = ranked.where(F.col("_k") <= F.element_at(F.create_map(*[F.lit(x) for kv in CAPS.items() for x in kv]), F.col("kind")))
    of = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("_k", "v")))), lambda r: r["v"]).alias(k)
    lists = ranked.groupBy("job_id").agg(*map(of, CAPS))
    totals = events.groupBy("job_id").agg(F.max("line_no").alias("trace_lines"), F.count("own").cast("int").alias("process_count"), F.array_sort(F.collect_set("tool")).alias("lolbins_invoked"))
    rows = totals.join(lists, "job_id", "left")
    listed = lambda k, **names: F.coalesce(F.transform(k, lambda v: F.struct(*[v[c].alias(n) for n, c in names.items()])), F.array()).alias(_FIELDS[k])
    plain = lambda k: F.coalesce(F.transform(k, lambda v: v["a"]), F.array().cast("array<string>")).alias(_FIELDS[k])
    return rows.select(
        "job_id",
        "trace_lines",
        listed("own", path="a", command="b"),
        "process_count",
        plain("written"),
        plain("deleted"),
        listed("renamed", **{"from": "a", "to": "b"}),
        listed("chmod", path="a", mode="b", makes_executable="f"),
        listed("connect", ip="a", port="n", failed="f"),
        plain("unix"),
        plain("memfd"),
        listed("persistent", path="a", meaning="b"),
        "lolbins_invoked",
    )


#: How many of a kind a report lists; they are ranked and cut before they are gathered, so no row holds more.
CAPS = {"own": 120, "written": 200, "deleted": 100, "renamed": 60, "chmod": 60, "connect": 120, "unix": 40, "memfd": 20, "persistent": 40}
DISTINCT = ("written", "deleted", "unix", "memfd", "persistent")
_FIELDS = {"own": "processes", "written": "files_written", "deleted": "files_deleted", "renamed": "files_renamed", "chmod": "made_executable", "connect": "tcp_connects", "unix": "unix_sockets", "memfd": "anonymous_executables", "persistent": "persistence_paths"}
#: Of each kind: when there is one, and what its values are, as strings a and b, a number and a flag.
_KINDS = {
    "own": ("own IS NOT NULL", "own.path", "own.command", None, None),
    "written": ("written IS NOT NULL", "written", None, None, None),
    "deleted": ("deleted IS NOT NULL", "deleted", None, None, None),
    "renamed": ("renamed IS NOT NULL", "renamed.from", "renamed.to", None, None),
    "chmod": ("chmod.makes_executable", "chmod.path", "chmod.mode", None, "chmod.makes_executable"),
    "connect": ("connect IS NOT NULL", "connect.ip", None, "connect.port", "connect.failed"),
    "unix": ("unix IS NOT NULL", "unix", None, None, None),
    "memfd": ("memfd IS NOT NULL", "memfd", None, None, None),
}


def _event(kind: str, when: str, a: str, b: str | None, n: str | None, f: str | None) -> Column:
    values = [(F.col(c) if c else F.lit(None)).cast(t).alias(name) for name, c, t in (("a", a, "string"), ("b", b, "string"), ("n", n, "int"), ("f", f, "boolean"))]
    return F.struct(F.when(F.expr(when), kind).alias("kind"), F.struct(*values).alias("v"))


def _persistent(path: str) -> Column:
    """A touched path by which something stays on a machine."""
    meaning = persistence_meaning(F.col(path))
    none = [F.lit(None).cast("int").alias("n"), F.lit(None).cast("boolean").alias("f")]
    return F.struct(F.when(meaning.isNotNull(), "persistent").alias("kind"), F.struct(F.col(path).alias("a"), meaning.alias("b"), *none).alias("v"))


def dynamic_reason(family: Column, detonate: Column) -> tuple[Column, Column]:
    """(engine, reason) of a script that wasn't executed."""
    needs = F.concat(family, F.lit(" needs a Windows host to execute meaningfully; this image deobfuscates and extracts indicators statically instead of pretending to detonate it"))
    reason = F.when(~detonate, F.lit("detonation disabled for this job")).when(family.isin("ps1", "bat"), needs).otherwise(F.concat(F.lit("no execution engine for family '"), family, F.lit("'")))
    return F.when(detonate, F.lit("static-only")), reason
