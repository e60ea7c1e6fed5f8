import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import at, plan, rows
from tracewell.functions import text
from tracewell.functions.masking import mask
from tracewell.operators import analytics, monitoring, reports

LOGIN = "login_name string, client_net_address string, login_time timestamp, event_sequence long"


def test_host_most_used(spark):
    def uses(login, addresses):
        return [(login, a, at(1, 0, i), i) for i, a in enumerate(addresses)]

    logins = spark.createDataFrame(
        uses("old habit", ["z"] * 20 + ["a"] * 6 + ["b"] * 4)  # only the last ten count
        + uses("tie", ["b", "a"] * 4 + ["c", "c"])
        + uses("nobody", [None, None, "x"]),
        LOGIN,
    )
    # At four uses each, the address used last wins; missing addresses count as one address.
    assert rows(analytics.host_most_used(logins)) == sorted(
        [("old habit", "a", 6), ("tie", "a", 4), ("nobody", None, 2)], key=repr
    )
    assert "WindowGroupLimit" in plan(analytics.host_most_used(logins))


@pytest.mark.parametrize("bucket_rows", [1, 3, 1000])
@pytest.mark.parametrize("diff", [0, 1, 2])
def test_missing_sequence_equals_brute_force(spark, bucket_rows, diff):
    rng = random.Random(3)
    data = [(f, rng.randint(1, 12), i) for i, f in enumerate(rng.choices("aaab", k=40))]
    expected = []
    for g in "ab":
        last = 0
        for f, s, i in sorted((r for r in data if r[0] == g), key=lambda r: (r[1], r[2])):
            if s - last != diff:
                expected.append((f, s, i, last))
            last = s
    df = spark.createDataFrame(data, "f string, s long, i long")
    got = analytics.find_missing_seq(df, "f", "s", tie="i", diff=diff, bucket_rows=bucket_rows)
    assert rows(got) == sorted(expected, key=repr)


def test_missing_sequence_goldens(spark):
    df = spark.createDataFrame([("x", s, i) for i, s in enumerate([1, 2, 4, 4])] + [("y", 2, 9)], "f string, s long, i long")
    assert rows(analytics.find_missing_seq(df, "f", "s", tie="i")) == [("x", 4, 2, 2), ("x", 4, 3, 4), ("y", 2, 9, 0)]


def test_numbered_statements(spark):
    texts = ["SELECT Fen=001,Seq=00012,x", "/*001-00013*/SELECT Fen=001,Seq=00013,x", "SELECT 1", "x SELECT Fen=001,Seq=00014"]
    df = spark.createDataFrame([(t,) for t in texts], "statement string")
    assert rows(analytics.numbered_statements(df), "f", "s") == [(1, 12), (1, 13)]


HISTORY = "job_id string, step_id int, instance_id long, run_status int, message string"


def test_last_job_run(spark):
    steps = [("j", 1, 4, 1), ("j", 0, 5, 1), ("j", 1, 6, 0), ("j", 2, 7, 2), ("j", 3, 8, 7), ("j", 0, 9, 4), ("j", 1, 10, 3)]
    steps += [("k", 1, 1, 3), ("k", 0, 2, 1), ("never ended", 1, 3, 1)]
    history = spark.createDataFrame([(*s, "m") for s in steps], HISTORY)
    assert rows(analytics.last_job_run(history), "job_id", "instance_id", "status") == sorted(
        [("j", 6, "Failed"), ("j", 7, "Retry"), ("j", 8, None), ("j", 9, "In Progress"), ("k", 1, "Canceled"), ("k", 2, "Succeeded")],
        key=repr,
    )
    report = analytics.job_status_report(history, "k").orderBy("ordinal").collect()
    assert analytics.job_status_report(history).count() == 4 + 1 + 2 + 1
    assert [(r.status, r.msgs) for r in report] == [
        (None, "Status from previous k job execution "), ("Canceled", "m\r\n"), ("Succeeded", "m\r\n")
    ]
    # The header row is not a failed step.
    assert rows(analytics.job_needs_attention(history, "k"), "status") == [("Canceled",)]


def test_counts_per_day_in_a_zone(spark):
    df = spark.createDataFrame([(at(4, 3),), (at(4, 12),)], "event_time timestamp")
    assert rows(analytics.daily_weekday_counts(df)) == [(dt.date(2024, 3, 4), "Monday", 2)]
    eastern = analytics.daily_weekday_counts(df, display_tz="America/New_York")
    assert rows(eastern) == [(dt.date(2024, 3, 3), "Sunday", 1), (dt.date(2024, 3, 4), "Monday", 1)]


def test_browse_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame(
        [(at(d), "u", "(Cur)-> h" if d == 2 else "h") for d in (1, 2, 3, 4)],
        "event_time timestamp, server_principal_name string, client_net_address string",
    )
    df.withColumn("event_date", F.to_date("event_time")).write.partitionBy("event_date").parquet(f"{tmp_path}/a")
    audit = spark.read.parquet(f"{tmp_path}/a")
    found = analytics.browse_audit(audit, since=at(2), until=at(4), principal="u")
    assert rows(found, "event_time") == [(at(2),), (at(3),)]
    assert "PartitionFilters: [isnotnull(event_date" in plan(found)
    assert rows(analytics.browse_audit(audit, from_live_view=True), "event_time") == [(at(2),)]


def test_event_trace_map(spark):
    got = analytics.event_trace_map(
        spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "trace_event_id int, name string"),
        spark.createDataFrame([(1, "p", "xa"), (2, "p", "xb")], "trace_event_id int, package_name string, xe_event_name string"),
        spark.createDataFrame([(1, 10), (1, 10), (1, 11)], "trace_event_id int, trace_column_id int"),
        spark.createDataFrame([(10, "col10"), (11, "col11")], "trace_column_id int, name string"),
        spark.createDataFrame([(10, "act10")], "trace_column_id int, xe_action_name string"),
    )
    assert rows(got) == sorted(
        [
            (1, "A", "p", "xa", 10, "col10", "act10"),
            (1, "A", "p", "xa", 11, "col11", None),
            (None, "B", "p", "xb", None, None, None),
            (None, "C", None, None, None, None, None),
        ],
        key=repr,
    )


CPU = "record_id int, sql_cpu_utilization int"
STATS = "id int, execution_count long, total_worker_time long"


@pytest.mark.parametrize("cpu,open_", [([1, 80, 90, 76, 99], True), ([99, 80, 90, 75, 99], False), ([], True)])
def test_hot_gate(spark, cpu, open_):
    samples = spark.createDataFrame(list(enumerate(cpu)), CPU)
    stats = spark.createDataFrame([(i, 3, i * 10) for i in range(30)] + [(99, 0, 5)], STATS)
    top = monitoring.top_statements_when_hot(samples, stats, tie=["id"])
    assert top.count() == (25 if open_ else 0)
    if open_:
        assert tuple(top.first()) == (29, 3, 290, 96)
        assert "NestedLoop" not in plan(top)


def test_statement_text(spark):
    df = spark.createDataFrame([("abc def ghi", 8, 14), ("abc def ghi", 8, -1), ("abc", 0, -1)], "t string, s int, e int")
    assert [r[0] for r in df.select(monitoring.statement_text("t", "s", "e")).collect()] == ["def", "def ghi", "abc"]


def test_offsets(spark):
    read = spark.createDataFrame([("f", 1), ("f", 1), ("f", 5), ("f", 9), ("f", 9), ("g", 1)], "file_name string, file_offset long")
    assert rows(monitoring.offset_profile(read)) == [("f", 5, 1, 9, 2)]
    assert monitoring.offset_regressions(read, read).count() == 0
    more = read.unionByName(spark.createDataFrame([("f", 9), ("f", 12)], read.schema))
    assert rows(monitoring.offset_regressions(read, more)) == [("f", 9, 2, 3)]  # a new offset is no regression


@pytest.mark.parametrize(
    "script,expected",
    [
        ("'a''--b' /* x /* y */ z */ -- c", "' ''   ' /*             */ --  "),
        ("-- it's\r\n'x'", "--     \r\n' '"),
        ("'open\r\nstring", "'    \r\n      "),
        ("/* a ' -- \r\n b", "/*        \r\n  "),
        ("a -- b", "a --  "),
        ("a - b / c * d", "a - b / c * d"),
        ("/**/x", "/**/x"),
        ("'", "'"),
        ("", ""),
    ],
)
def test_mask(script, expected):
    assert mask(script) == expected


def test_fingerprints(spark):
    df = spark.createDataFrame(
        [("select 'ab'", 1, 10), ("select 'cd'", 2, 20), ("select 'cd'", 3, 30), (None, 4, 40)],
        "statement string, cpu_time long, dur_micro_sec long",
    )
    got = rows(reports.statement_fingerprints(df), "fingerprint", "executions", "cpu_time", "dur_micro_sec")
    assert got == sorted([("select '  '", 3, 6, 60), (None, 1, 4, 40)], key=repr)


def test_split_batches(spark):
    script = "select 1\r\ngo\r\nselect '\r\nGO\r\n'\r\n GO \r\n/*\r\nGO\r\n*/ x\r\n--GO E- first\r\na\r\nGO\r\nGO\r\nb\r\n--GO E+\r\nc\r\n--GO\r\nd"
    got = reports.split_batches(spark.createDataFrame([(1, script)], "id int, script string"), "id")
    # The mark that ends a chunk carries the switch of that chunk; a switch lasts until the next.
    assert [tuple(r)[1:] for r in got.orderBy("chunk_no", "batch_no").collect()] == [
        (0, True, 0, "select 1"),
        (0, True, 1, "select '\r\nGO\r\n'"),
        (0, True, 2, "/*\r\nGO\r\n*/ x"),
        (1, False, 0, "\r\na"),
        (1, False, 1, ""),
        (1, False, 2, "b"),
        (2, False, 0, "\r\nc"),
        (3, False, 0, "\r\nd"),
    ]


def test_split_batches_by_line_feeds_and_any_character(spark):
    script = "a \ue000 b\nGO\nc\r\nGO\nd\n"
    got = reports.split_batches(spark.createDataFrame([(1, script), (2, "--GO\nx"), (3, None)], "id int, script string"), "id")
    assert rows(got, "id", "chunk_no", "batch_no", "batch") == [
        (1, 0, 0, "a \ue000 b"), (1, 0, 1, "c"), (1, 0, 2, "d\n"), (2, 0, 0, ""), (2, 1, 0, "\nx")
    ]


def test_split_batches_of_odd_scripts(spark):
    # No line becomes an element of an array: a script is cut by two patterns and each chunk by one pass over its mask.
    scripts = {
        1: "--GO\r\n--go e- x\n--GOTO\r\n\r\nb\r\n--GO", 2: "\n--GO\r\r\nGO\r\r\n GO \r\n\nGO", 3: "", 4: "x --GO\n'\nGO\n'\nGO -- c\n\tGO\nG\ngo",
        5: "/* /* */\nGO\n*/\nGO\n--GO E+\n\n--GO E?\na--\n--GO E-",
    }
    got = reports.split_batches(spark.createDataFrame(list(scripts.items()), "id int, script string"), "id")
    assert "lines" not in plan(got)
    assert rows(got, "id", "chunk_no", "errors_muted", "batch_no", "batch") == sorted(
        (i, *found) for i, script in scripts.items() for found in by_lines(script)
    )


def by_lines(script):
    """chunk_no, errors_muted, batch_no, batch of a script, line by line."""
    parts = re.split(r"(\r?\n)", script)
    lines, runs, first = list(zip(parts[::2], [*parts[1::2], ""], strict=True)), [], 0
    joined = lambda run: "".join(x + e for x, e in run[:-1]) + (run[-1][0] if run else "")
    for i, (line, end) in enumerate([*lines, ("--GO", "")]):
        if line.upper().startswith("--GO"):
            runs.append((lines[first - 1][1] if first else "", lines[first:i], line))
            first = i + 1
    muted = False
    for no, (begin, run, line) in enumerate(runs):
        sign = re.match(r"--GO E([+-])", line.upper())
        muted = sign.group(1) == "-" if sign else muted
        text, batches, at = begin + joined(run), [], 0
        pieces = re.split(r"(\r?\n)", text)
        own = list(zip(pieces[::2], [*pieces[1::2], ""], strict=True))
        copies = re.split(r"\r?\n", mask(text))
        for i, (x, _) in enumerate(own):
            if x.strip(" ").upper() == "GO" and x == copies[i]:
                batches.append(joined(own[at:i]))
                at = i + 1
        for i, batch in enumerate([*batches, joined(own[at:])]):
            yield no, muted, i, batch


def test_templates_and_messages(spark):
    errors = spark.createDataFrame(
        [(1, 2, 3, 4, "p", "boom"), (1, 2, 3, None, None, "boom"), (1, 2, 3, 4, "p", None), (1, 2, 3, None, "#errstate#", "#ERRNUMBER#")],
        "number int, severity int, state int, line int, procedure string, message string",
    )
    got = [r.err_msg for r in text.format_error_messages(errors, text.ERROR_TEMPLATE_SHORT).collect()]
    assert got == [
        " Msg: boom Error: 1 Severity: 2 State: 3 at Line:4 in Sql Module:p",
        " Msg: boom Error: 1 Severity: 2 State: 3",
        None,
        " Msg: 1 Error: 1 Severity: 2 State: 3 in Sql Module:#errstate#",
    ]
    long = text.format_error_messages(errors).first().err_msg
    assert long.startswith("-" * 94 + "\n -- Msg: boom\n") and long.endswith("\n " + "-" * 94)
    filled = spark.range(1).select(text.fill_template(F.lit('"#Version#"'), "#version#", F.lit("2"))).first()[0]
    assert filled == "'2'"


def test_paths(spark):
    df = spark.createDataFrame([("D:\\a\\b.xel",), ("b.xel",), ("D:\\",), (None,)], "path string")
    got = {r.path: (r.directory, r.file_name) for r in text.file_path_parts(df, "path").collect()}
    assert got == {"D:\\a\\b.xel": ("D:\\a\\", "b.xel"), "b.xel": ("b.xel", ""), "D:\\": ("D:\\", ""), None: (None, None)}
    there = text.existing_files(df.dropna(), spark.createDataFrame([("b.xel",)], "path string"))
    assert ("b.xel", 1) in rows(there) and there.where("existing is null").count() == 2


def test_patterns(spark):
    df = spark.createDataFrame([("SQL_Stored_Procedure",), ("VIEW",), ("table",)], "kind string")
    got = rows(text.match_patterns(df, "kind", [("%procedure%", "Procedure"), ("%View%", "View"), ("v%", "V")]))
    assert got == [("SQL_Stored_Procedure", "%procedure%", "Procedure"), ("VIEW", "%View%", "View"), ("VIEW", "v%", "V")]


def test_digest_sample_pivot(spark):
    log = spark.createDataFrame([(at(d), f"m{d}") for d in (1, 2, 3, 4)], "msg_date timestamp, msg string")
    assert reports.alert_digest(log).first()[0] == "m4<br>m3<br>m2"
    table = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, "t").alias("title"))
    sample = reports.sample_rows(table, "id", 0.5, 100, "title").collect()
    assert len(sample) == 100 and [r.seq for r in sample] == list(range(1, 101))
    assert all(r.title for r in sample) and sorted(r.id for r in sample) == [r.id for r in sample]
    long = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "k int, action string, v string")
    wide = analytics.pivot_actions(long, ["k"], "action", "v", ["a", "b", "c"])
    assert rows(wide) == [(1, "x", "y", None)]
    assert rows(analytics.unpivot_actions(wide, ["k"], ["a", "b"], "action", "v")) == rows(long)
