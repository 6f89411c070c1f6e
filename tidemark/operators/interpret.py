"""Lines to events. Each interpreter claims lines of its own, in this order: test-runner events, libtest results, request
logs, then everything else as log. All take lines (run_id, feed, stream, seq, line, raw_len) and give events

    run_id, feed, stream, seq, kind, template, line, duration_us, outcome, scope, measures

State within a stream (open request, running offset) is folded over slices of seq, so one long log is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import masks
from ..functions.ids import behavior_ids
from ..functions.normalize import Roots, normalized
from .ranges import as_of
from .scans import WIDTH, Fold, by_width, scan

EVENTS, LOG = "file:rspec-events", "file:log/test.log"
RSPEC = "event string, id string, full_description string, declared_full_description string, file_path string, status string, run_time double, exception struct<class:string,message:string>, log_offset long, expected long, defined long, duration double, examples long, failures long, pending long, errors_outside_of_examples long, context string, class string, message string"
RESOURCES = ("user_ms", "system_ms", "max_rss_bytes", "involuntary_switches", "wall_ms")
OUTCOMES = {"passed": "success", "failed": "failure", "pending": "skipped"}


def _event(kind, template, duration_us=None, outcome=None, scope=None, measures=None) -> list[Column]:
    none = F.lit(None)
    return [
        F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), template.alias("template"), (none if duration_us is None else duration_us).cast("long").alias("duration_us"),
        (none if outcome is None else outcome).cast("string").alias("outcome"), (none if scope is None else scope).cast("string").alias("scope"), (none if measures is None else measures).cast("map<string,double>").alias("measures"),
    ]


KEYS = ["run_id", "feed", "stream", "seq", "line"]
EVENT = [*KEYS, "kind", "template", "duration_us", "outcome", "scope", "measures"]
#: From lines to the events of those that it claims.
Interpreter = Callable[[DataFrame], DataFrame]
#: Interpreters that every interpretation asks first, by name, in order of registration.
CLAIMS: dict[str, Interpreter] = {}


def register(name: str, interpreter: Interpreter | None) -> None:
    """Adds an interpreter to those that are always asked, in place of one of the same name; None takes it out."""
    if interpreter is None:
        CLAIMS.pop(name, None)
    else:
        CLAIMS[name] = interpreter


def event_rows(lines: DataFrame, kind: str | Column, template: Column, duration_us: Column | None = None, outcome: Column | None = None, scope: Column | None = None, measures: Column | None = None) -> DataFrame:
    """An event a line, for interpreters of one's own."""
    return lines.select(*KEYS, *_event(kind, template, duration_us, outcome, scope, measures))


def generic(lines: DataFrame, roots: Roots | None = None) -> DataFrame:
    """One log event a line: its template, the first duration in it, and failure where ERROR or FATAL stands early."""
    n = normalized(lines, "line", roots).where(~F.col("line").rlike(r"^Timestamp\s+(?:Thread|\(process\))"))
    first = F.try_element_at(F.filter("normal.slots", lambda s: s["kind"] == "duration"), F.lit(1))["value"]
    failed = F.substring("normal.template", 1, 64).rlike(r"\b(?:ERROR|FATAL)\b")
    return n.select(*KEYS, *_event("log", F.col("normal.template"), F.round(first * 1000), F.when(failed, "failure")))


def rspec(lines: DataFrame) -> DataFrame:
    """Events of the test runner's stream; lines that are no JSON object are left to generic()."""
    e = lines.where(F.col("stream") == EVENTS).withColumn("e", F.from_json("line", RSPEC, {"mode": "PERMISSIVE"})).where("e.event is not null")
    file = F.when(F.col("e.id").contains("["), F.substring_index("e.id", "[", 1)).otherwise(F.col("e.file_path"))
    unnamed = F.col("e.declared_full_description").isNotNull() & (F.col("e.declared_full_description") != F.col("e.full_description"))
    named = F.concat(file, F.lit(" # "), F.when(unnamed, F.concat_ws(" ", F.trim("e.declared_full_description"), F.lit("<unnamed example>"))).otherwise(F.col("e.full_description")))
    status = F.coalesce(*[F.when(F.col("e.status") == k, v) for k, v in OUTCOMES.items()])
    ran = e.where("e.event = 'example'")
    examples = ran.select(*KEYS, *_event("test.example", named, F.round(F.col("e.run_time") * 1e6), status, F.concat(F.lit("example:"), named)))
    thrown = ran.where("e.exception.class is not null").select(*KEYS, *_event("exception", F.col("e.exception.class"), scope=F.concat(F.lit("example:"), named)))
    outside = e.where("e.event = 'error_outside_examples'").select(*KEYS, *_event("exception", load_error(F.col("e.context"), F.col("e.class"), F.col("e.message")), outcome=F.lit("failure")))
    started = e.where("e.event = 'start'").groupBy("run_id").agg(F.max("e.expected").alias("expected"), F.max("e.defined").alias("defined"))
    names = {"examples": F.col("e.examples"), "failures": F.col("e.failures"), "pending": F.col("e.pending"), "errors_outside_of_examples": F.col("e.errors_outside_of_examples"), "expected": F.col("expected"), "defined": F.col("defined")}
    measures = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("double").alias("v")) for k, v in names.items()]), lambda x: x["v"].isNotNull()))
    bad = (F.col("e.failures") > 0) | (F.coalesce("e.errors_outside_of_examples", F.lit(0)) > 0)
    summary = e.where("e.event = 'summary'").join(started, "run_id", "left").select(*KEYS, *_event("test.summary", F.lit("rspec"), F.round(F.col("e.duration") * 1e6), F.when(bad, "failure").otherwise("success"), measures=measures))
    return examples.unionByName(thrown).unionByName(outside).unionByName(summary)


def load_error(context: Column, error: Column, message: Column) -> Column:
    """What failed outside examples: the file, its class and its cause in at most 160 characters."""
    rows = F.split(F.coalesce(message, F.lit("")), "\n")
    caret = F.try_element_at(F.filter(rows, lambda r: r.rlike(r"^\s*\|\s*\^~*\s*\S")), F.lit(-1))
    plain = F.regexp_replace(F.try_element_at(F.filter(rows, lambda r: F.trim(r) != ""), F.lit(1)), r"^\S+:\d+:\s*", "")
    cause = F.substring(F.coalesce(F.regexp_extract(caret, r"\^~*\s*(.*)$", 1), plain, F.lit("")), 1, 160)
    file = F.regexp_extract(context, r"loading (\S+?)\.?$", 1)
    return F.when(file != "", F.concat(file, F.lit(" failed to load: "), F.coalesce(error, F.lit("error")), F.lit(": "), cause)).otherwise(F.regexp_replace(context, r"\.+$", ""))


RESULT = r"^test (.+) \.\.\. (ok|FAILED|ignored)(?:, .*)?$"
TOTALS = r"^test result: (ok|FAILED)\. "


def libtest(lines: DataFrame) -> DataFrame:
    """Results of libtest on stdout: an example a test, and a summary a binary; an ignored test counts as run and pending."""
    out = lines.where("stream = 'stdout'")
    name, result = F.regexp_extract("line", RESULT, 1), F.regexp_extract("line", RESULT, 2)
    # a reason may follow ignored only
    whole = (result != "") & (F.col("line").rlike(r" \.\.\. (?:ok|FAILED|ignored)$") | (result == "ignored"))
    tests = out.where(whole).select(*KEYS, *_event("test.example", masks.unnumbered(name), outcome=F.when(result == "ok", "success").when(result == "FAILED", "failure").otherwise("skipped")))
    number = lambda word: F.coalesce(F.regexp_extract("line", rf"(?:\. |; )(\d+) {word}(?:;|$)", 1).try_cast("double"), F.lit(0.0))
    passed, failed, ignored = number("passed"), number("failed"), number("ignored")
    ran = passed + failed + ignored
    # in this order, since a behavior keeps its first six measures
    entries = {"examples": ran, "expected": ran, "defined": ran + number("filtered out"), "failures": failed, "pending": ignored, "passed": passed}
    measures = F.map_from_arrays(F.array(*map(F.lit, entries)), F.array(*entries.values()))
    took = F.regexp_extract("line", r"finished in ([\d.]+)s", 1).try_cast("double")
    verdict = F.regexp_extract("line", TOTALS, 1)
    sums = out.where(verdict != "").select(*KEYS, *_event("test.summary", F.lit("cargo test"), F.round(took * 1e6), F.when(verdict == "ok", "success").otherwise("failure"), measures=measures))
    return tests.unionByName(sums)


def cargo_notices(lines: DataFrame) -> DataFrame:
    """run_id, stream, seq of what the build tool says on stderr of test targets that failed; results have said so already.

    Names of targets stand one after another below a line with their number: those that form an island of rows ending there.
    """
    err = lines.where("stream = 'stderr'")
    counted, item = F.col("line").rlike(r"^error: 0*[1-9]\d* targets? failed:$"), F.trim("line").rlike("^`--.*`$")
    known = err.where(F.col("line").startswith("error: test failed, to rerun pass `") | F.col("line").rlike(r"^error: \d+ targets? failed:$")).select("run_id", "stream", "seq")
    listed = err.where(counted | item).select("run_id", "stream", "seq", counted.alias("counted"))
    island = F.col("seq") - F.row_number().over(Window.partitionBy("run_id", "stream").orderBy("seq"))
    first = F.min(F.when(F.col("counted"), F.col("seq"))).over(Window.partitionBy("run_id", "stream", "island"))
    items = listed.withColumn("island", island).withColumn("first", first).where(~F.col("counted") & (F.col("seq") > F.col("first"))).select("run_id", "stream", "seq")
    return known.union(items)


QUERY = r"^\s*([A-Za-z0-9 :?_]*?) ?\((\d+(?:\.\d+)?)ms\)  (.*)$"


def requests(lines: DataFrame, width: int = WIDTH) -> DataFrame:
    """Request blocks of a log: lines with block (a number a Started line opens), its action, status and whether it is open here.

    A Started line opens a block, and the first Completed line after it closes it: by the last places of both up to each
    line, folded over slices of the log. counted is the number of queries from the block's beginning on.
    """
    rows = lines.withColumn("text", masks.strip_ansi(F.col("line")))
    start, done, seq = F.col("text").rlike("^Started [A-Z]+ "), F.col("text").rlike(r"^Completed \d{3} "), F.col("seq")
    name = F.trim(F.regexp_extract("text", QUERY, 1))
    counts = (F.col("text").rlike(QUERY) & ~name.isin("TRANSACTION", "SCHEMA")).cast("long")
    action = F.when(F.col("text").rlike("^Processing by "), F.struct(seq.alias("seq"), F.regexp_extract("text", r"^Processing by (\S+)", 1).alias("name")))
    opened = F.when(start, F.struct(seq.alias("seq"), F.regexp_extract("text", r"^Started ([A-Z]+) ", 1).alias("method")))
    folds = {"block": Fold("sum", start.cast("long")), "queries": Fold("sum", counts), "opened": Fold("last", opened), "acted": Fold("last", action), "closed": Fold("last", F.when(done, seq), before=True)}
    rows = scan(rows, ["run_id", "stream"], ["seq"], folds, by_width("seq", width))
    inside = F.col("opened").isNotNull() & (F.coalesce("closed", F.lit(-1)) < F.col("opened.seq"))
    rows = rows.withColumn("in_block", inside)
    rows = rows.withColumns({"method": F.when(F.col("in_block"), F.col("opened.method")), "action": F.when(F.col("in_block") & (F.col("acted.seq") >= F.col("opened.seq")), F.col("acted.name"))})
    return rows.drop("opened", "acted", "closed")


def rails(lines: DataFrame, roots: Roots | None = None, width: int = WIDTH) -> DataFrame:
    """Queries and requests of a log, and its other lines as log, scoped to the endpoint that they serve."""
    rows = requests(lines.where(F.col("stream") == LOG), width)
    name, ms = F.trim(F.regexp_extract("text", QUERY, 1)), F.regexp_extract("text", QUERY, 2).try_cast("double")
    is_query = F.col("text").rlike(QUERY)
    rows = rows.withColumn("endpoint", F.when(F.col("action").isNotNull(), F.concat_ws(" ", "method", "action")))
    scope = F.concat(F.lit("request:"), F.col("endpoint"))
    sql = masks.collapse_binds(F.regexp_replace(F.regexp_extract("text", QUERY, 3), r"  \[\[.*$", ""))
    queries = normalized(rows.where(is_query).withColumn("sql", F.concat_ws(" ", name, sql)), "sql", roots).select(*KEYS, *_event("db.query", F.col("normal.template"), F.round(ms * 1000), scope=scope))
    ended = F.col("text").rlike(r"^Completed \d{3} ")
    code = F.regexp_extract("text", r"^Completed (\d{3}) ", 1).try_cast("int")
    reported = F.regexp_extract("text", r"\((\d+) queries", 1).try_cast("double")
    took = F.regexp_extract("text", r" in (\d+)ms", 1).try_cast("double")
    # a request's own queries: those up to its end without those up to its beginning
    begun = rows.where(F.col("text").rlike("^Started [A-Z]+ ")).select("run_id", "stream", "block", F.col("queries").alias("earlier"))
    done = rows.where(ended & F.col("in_block") & F.col("endpoint").isNotNull()).join(begun, ["run_id", "stream", "block"])
    key = F.concat(F.col("endpoint"), F.lit(" "), F.floor(code / 100).cast("string"), F.lit("xx"))
    served = done.select(*KEYS, *_event("http.request", key, F.round(took * 1000), F.when(code >= 500, "failure"), scope, F.create_map(F.lit("queries"), F.coalesce(reported, (F.col("queries") - F.col("earlier")).cast("double")))))
    silent = F.col("text").rlike("^Started [A-Z]+ ") | (F.col("in_block") & F.col("text").rlike("^Processing by "))
    rest = rows.where(~is_query & ~silent & ~(ended & F.col("in_block") & F.col("endpoint").isNotNull()) & (F.trim("text") != ""))
    other = normalized(rest, "text", roots)
    failed = F.substring("normal.template", 1, 64).rlike(r"\b(?:ERROR|FATAL)\b")
    first = F.try_element_at(F.filter("normal.slots", lambda s: s["kind"] == "duration"), F.lit(1))["value"]
    return queries.unionByName(served).unionByName(other.select(*KEYS, *_event("log", F.col("normal.template"), F.round(first * 1000), F.when(failed, "failure"), scope)))


def example_ranges(lines: DataFrame) -> DataFrame:
    """run_id, id, example, start, end: the bytes of the log that each example wrote, [start, end), none overlapping."""
    e = lines.where(F.col("stream") == EVENTS).select("run_id", "seq", F.from_json("line", RSPEC).alias("e")).where("e.event in ('example_started', 'example') and e.log_offset is not null")
    file = F.when(F.col("e.id").contains("["), F.substring_index("e.id", "[", 1)).otherwise(F.col("e.file_path"))
    rows = e.select("run_id", "seq", "e.event", "e.id", "e.log_offset", F.concat(file, F.lit(" # "), "e.full_description").alias("example"))
    w = Window.partitionBy("run_id").orderBy("seq")
    pairs = rows.withColumns({"was": F.lag("event").over(w), "was_id": F.lag("id").over(w), "start": F.lag("log_offset").over(w)})
    pairs = pairs.where("event = 'example' and was = 'example_started' and was_id = id and start <= log_offset")
    # of ranges that overlap, the first stays. Where none begins before the greatest end so far, all stay; a run that has
    # such a one is gone through in order, since what is dropped drops nothing itself
    before = F.max("log_offset").over(Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    ranges = pairs.withColumn("overlaps", F.coalesce(F.col("start") < before, F.lit(False))).select("run_id", "seq", "id", "example", "start", F.col("log_offset").alias("end"), "overlaps")
    mixed = ranges.where("overlaps").select("run_id").distinct()

    def kept(pdf):
        rows, end = [], -1
        for k, (a, z) in enumerate(zip(pdf.sort_values("seq")["start"], pdf.sort_values("seq")["end"], strict=True)):
            if a >= end:
                rows.append(k)
                end = z
        return pdf.sort_values("seq").iloc[rows]

    apart = ranges.join(mixed, "run_id", "left_anti")
    return apart.unionByName(ranges.join(mixed, "run_id").groupBy("run_id").applyInPandas(kept, ranges.schema)).drop("seq", "overlaps")


def offsets(lines: DataFrame, width: int = WIDTH) -> DataFrame:
    """run_id, stream, seq, at: the bytes of a stream before each of its lines."""
    sums = scan(lines.select("run_id", "stream", "seq", "raw_len"), ["run_id", "stream"], ["seq"], {"at": Fold("sum", F.col("raw_len"), before=True)}, by_width("seq", width))
    return sums.select("run_id", "stream", "seq", F.coalesce("at", F.lit(0)).alias("at"))


def attribute(events: DataFrame, lines: DataFrame, width: int = WIDTH) -> DataFrame:
    """events of the log with the example that ran when their line was written, else the phase between or after examples,
    else the request that they serve; before the first example there is no scope."""
    at = offsets(lines.where(F.col("stream") == LOG), width)
    ranges = example_ranges(lines)
    placed = as_of(at, ranges.select("run_id", F.col("start").alias("at"), "start", "end", "example"), ["run_id"], "at", ["start", "end", "example"])
    edge = ranges.groupBy("run_id").agg(F.max("end").alias("last_end"))
    inside = F.col("at") < F.col("end")
    phase = F.when(F.col("last_end").isNull(), None).when(inside, F.concat(F.lit("example:"), "example")).when(F.col("start").isNull(), None).when(F.col("at") >= F.col("last_end"), "phase:teardown").otherwise("phase:between")
    known = placed.join(edge, "run_id", "left").select("run_id", "stream", "seq", phase.alias("phase"))
    out = events.join(known, ["run_id", "stream", "seq"], "left")
    return out.withColumn("scope", F.coalesce("phase", "scope")).drop("phase")


def resources(runs: DataFrame) -> DataFrame:
    """An event a run from its resource usage: runs has run_id and the measures as columns."""
    named = [x for c in RESOURCES if c in runs.columns for x in (F.lit(c), F.col(c).cast("double"))]
    return runs.select("run_id", F.lit(9).alias("feed"), F.lit("resources").alias("stream"), F.lit(1).cast("long").alias("seq"), F.lit("").alias("line"), *_event("run.resources", F.lit("process resources"), measures=F.create_map(*named)))


def interpret(lines: DataFrame, roots: Roots | None = None, usage: DataFrame | None = None, first: Sequence[Interpreter] = ()) -> DataFrame:
    """All events of lines, with behavior_id, scope_id and arrival, their place in the run by feed, then seq.

    usage: what resources() takes, a row for each run that measured any. first: interpreters of one's own (functions from
    lines to event_rows() of those that they claim), asked in this order before the library's; a line that one claims goes to
    no other.
    """
    left, own = lines, []
    for ask in (*first, *CLAIMS.values()):
        mine = ask(left).select(*EVENT)
        own.append(mine)
        left = left.join(mine.select("run_id", "stream", "seq").distinct(), ["run_id", "stream", "seq"], "left_anti")
    runner, cargo = rspec(left), libtest(left)
    log = attribute(rails(left, roots), lines)  # offsets count all lines, whoever claims them
    claimed = runner.select("run_id", "stream", "seq").union(cargo.select("run_id", "stream", "seq")).distinct().union(cargo_notices(left))
    ignored = left.where((F.col("stream") == EVENTS) & F.get_json_object("line", "$.event").isNotNull()).select("run_id", "stream", "seq")
    rest = left.where((F.col("stream") != LOG) & (F.trim("line") != "")).join(claimed.union(ignored), ["run_id", "stream", "seq"], "left_anti")
    events = runner.unionByName(cargo).unionByName(log).unionByName(generic(rest, roots))
    for mine in own:
        events = events.unionByName(mine)
    if usage is not None:
        events = events.unionByName(resources(usage))
    named = events.withColumn("behavior_id", behavior_ids("kind", "template"))
    kind = F.when(F.col("scope").startswith("example:"), "test.example").when(F.col("scope").startswith("request:"), "scope.request").otherwise("phase")
    return named.withColumn("scope_id", F.when(F.col("scope").isNotNull(), behavior_ids(kind, F.regexp_replace("scope", "^[a-z]+:", "")))).withColumn("arrival", F.struct("feed", "seq", "kind"))
