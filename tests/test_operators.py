"""Small fixtures, properties and brute-force twins for the operators."""

from __future__ import annotations

import datetime as dt
import glob
import random
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagetide import schema as S
from pagetide.operators import edits, pages, skew, text, traffic, usage
from pagetide.registry import OPERATORS, OptionError, register
from pagetide.sources import intake, tables
from pagetide.plans.inputs import derived, text_pages


def scratch():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# ------------------------------------------------------------ skew helpers

@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_cut_windows_equal_plain_windows(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        check_cut_windows(spark)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cut_window_shuffles_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).select("id", (F.col("id") % 3).alias("k"))
        out = skew.running_total(df, ["k"], skew.piece_of(F.col("id"), 100), [F.col("id")], F.lit(1), "n")
        # rows, partial sums, and the window over the sums (whose output meets the rows again)
        assert plan_of(out).count("Exchange hashpartitioning") <= 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def check_cut_windows(spark):
    rng = random.Random(5)
    data = [(rng.choice([None, "a", "a", "a", "b"]), i, rng.choice([None, 1, 2, 3])) for i in range(1, 400)]
    df = spark.createDataFrame(data, "k string, pos long, v long")
    w = Window.partitionBy("k").orderBy("pos")
    piece, order = skew.piece_of(F.col("pos"), 7), [F.col("pos")]
    plain = df.select("k", "pos", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("t"))
    assert rows(skew.running_total(df, ["k"], piece, order, F.col("v"), "t").select("k", "pos", "t"), "pos") == rows(plain, "pos")
    plain = df.select("k", "pos", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("p"))
    assert rows(skew.previous_value(df, ["k"], piece, order, F.col("v"), "p").select("k", "pos", "p"), "pos") == rows(plain, "pos")
    plain = df.select("k", "pos", F.row_number().over(w).alias("n"))
    assert rows(skew.number_rows(df, ["k"], "pos", "n", 5).select("k", "pos", "n"), "pos") == rows(plain, "pos")


def test_options_reach_every_piece(spark):
    page_rows = spark.range(1, 51).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("page_no"))
    opts = spark.createDataFrame([(1, "x")], "doc_id long, o string")
    got = skew.with_document_options(page_rows, opts, size=8)
    assert got.filter("o = 'x' AND page_count = 50").count() == 50


def test_salted_lookup_equals_join(spark):
    facts = spark.range(300).select("id", (F.col("id") % 3).alias("k"))
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    a, b = skew.salted_lookup(facts, dim, ["k"], ["id"]), facts.join(dim, "k", "left")
    assert rows(a.select("id", "v"), "id") == rows(b.select("id", "v"), "id")


def test_flatten_json(spark):
    from pagetide.operators.catalog import flatten_json

    doc = '{"a": {"b": [1, {"c": "x"}], "e": {}, "n": null}, "d": "y", "l": []}'
    deep = '{"k":' * 40 + "1.50" + "}" * 40
    df = spark.createDataFrame([(1, doc), (2, '"leaf"'), (3, '{"a":"{}","b":"[]","c":"x","d":{}}'), (4, deep), (5, "no {"),
                                (6, None)], "id int, doc string")
    assert rows(flatten_json(df, "doc"), "id", "key") == [
        (1, "a.b[0]", "1"), (1, "a.b[1].c", "x"), (1, "a.n", None), (1, "d", "y"), (2, "", "leaf"),
        (3, "a", "{}"), (3, "b", "[]"), (3, "c", "x"), (4, ".".join("k" * 40), "1.50"), (5, "", None), (6, "", None)]


def test_json_nested_beyond_the_parser_is_one_row(spark):
    from pagetide.operators.catalog import flatten_json

    deep, fair = "[" * 200_000 + "]" * 200_000, "[" * 300 + "7" + "]" * 300
    df = spark.createDataFrame([(1, deep), (2, fair)], "id int, doc string")
    assert rows(flatten_json(df, "doc"), "id") == [(1, "", None), (2, "[0]" * 300, "7")]


def test_every_present_locale_is_checked(spark):
    from pagetide.operators.catalog import check_translations

    told = spark.createDataFrame([("en", "a", "x"), ("de", "b", "y")], "locale string, key string, value string")
    assert rows(check_translations(told, told.select("locale")), "key") == [("de", "a", "missing"), ("de", "b", "extra")]


def test_documents_without_pages_are_reported(spark):
    options = spark.createDataFrame([(1, "1", "1,2", '{"1": 90}', "every"), (2, "1", "1", '{"1": 90}', "every")],
                                    "doc_id long, spec string, order string, rotations string, mode string")
    for fn in (pages.delete_pages, pages.select_pages, pages.reorder_pages, pages.rotate_by_map, pages.split_pages,
               text.extract_text):
        got = fn(doc(spark, 2), options).filter("doc_id = 2").collect()
        assert [r["error_code"] for r in got] == ["missing_input"]
    members = spark.createDataFrame([(7, 2, 0, "a"), (7, 1, 1, "b")], "out_id long, doc_id long, doc_seq long, filename string")
    got = pages.combine_exhibits(doc(spark, 2), members).orderBy("sheet_no").collect()
    assert [r["stamp"] for r in got if r["page_no"] == 0] == ["Exhibit A | a | 0 page(s)", "Exhibit B | b | 2 page(s)"]
    assert [r["doc_id"] for r in got if r["error_code"] == "missing_input"] == [2]


def test_last_angle_of_a_page_holds(spark):
    for raw in ('{"1": 90, " 1": 180}', '{"1": 90, "01": 180}', '{"1": 90, "1": 180}'):
        got = pages.rotate_by_map(doc(spark, 2), opts(spark, rotations=raw)).orderBy("page_no").collect()
        assert [r["rotation"] for r in got] == [180, 0]



# -------------------------------------------------------------------- geo

def test_geo_join_keeps_every_request(spark, sf_dir):
    requests, blocks = derived(spark, sf_dir, "requests"), derived(spark, sf_dir, "geo_blocks")
    a = traffic.geo_lookup(requests, blocks)
    assert a.count() == requests.count()
    assert a.filter("country <> ''").count() > 0


# -------------------------------------------------------------------- pages

def doc(spark, n, doc_id=1):
    return spark.range(1, n + 1).select(
        F.lit(doc_id).cast("long").alias("doc_id"), F.col("id").cast("int").alias("page_no"),
        F.concat(F.lit("PAGE "), "id").alias("text"), F.lit(0).alias("rotation"))


def opts(spark, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([(1, *values.values())], f"doc_id long, {names}")


def test_delete_and_select_are_complements(spark):
    five = doc(spark, 5)
    deleted = rows(pages.delete_pages(five, opts(spark, spec="2,4-5")), "page_no")
    assert [(r[1], r[2]) for r in deleted] == [(1, 1), (3, 2)]
    chosen = rows(pages.select_pages(five, opts(spark, spec="2,4-5")), "page_no")
    assert sorted([r[1] for r in deleted] + [r[1] for r in chosen]) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("spec,code", [("1-5", "bad_option"), ("9", "bad_option"), ("", "missing_option"), ("x", "bad_option")])
def test_delete_errors(spark, spec, code):
    assert rows(pages.delete_pages(doc(spark, 5), opts(spark, spec=spec)), "doc_id") == [(1, None, None, None, code)]


def test_split_overlaps_and_names(spark):
    got = rows(pages.split_pages(doc(spark, 5), opts(spark, spec="1-3,2", mode="ranges")), "group_no", "page_no")
    assert [r[1:4] for r in got] == [(0, "pages-001-003", 1), (0, "pages-001-003", 2), (0, "pages-001-003", 3), (1, "page-002", 2)]


def test_split_then_merge_is_identity(spark):
    parts = pages.split_pages(doc(spark, 6), opts(spark, spec="", mode="every"))
    singles = parts.select((F.col("group_no") + 100).alias("doc_id"), F.lit(1).alias("page_no"),
                           F.concat(F.lit("PAGE "), "page_no").alias("text"))
    members = parts.select(F.lit(1).alias("out_id"), (F.col("group_no") + 100).alias("doc_id"), F.col("group_no").alias("doc_seq"))
    merged = pages.merge_documents(singles, members)
    assert [r[0] for r in rows(merged.select("text", "out_page_no"), "out_page_no")] == [f"PAGE {i}" for i in range(1, 7)]


def test_reorder(spark):
    got = pages.reorder_pages(doc(spark, 3), opts(spark, order="3, 1,2"))
    assert [(r[1], r[2]) for r in rows(got, "page_no")] == [(3, 1), (1, 2), (2, 3)]
    assert rows(pages.reorder_pages(doc(spark, 3), opts(spark, order="1,1,2")).select("error_code"), "error_code") == [("bad_option",)]


def test_rotation_map(spark):
    got = pages.rotate_by_map(doc(spark, 3), opts(spark, rotations='{"1": 90, "3": 270}'))
    assert [r[2] for r in rows(got, "page_no")] == [90, 0, 270]
    for bad in ("nope", "{}", '{"9": 90}', '{"1": 45}', '{"1": "90"}', '{"1": true}'):
        got = pages.rotate_by_map(doc(spark, 3), opts(spark, rotations=bad))
        assert [r[-1] for r in rows(got, "doc_id")] == ["bad_option"], bad


def test_ranges_round_trip(spark):
    back = pages.compact_ranges(doc(spark, 12).filter("page_no IN (1,2,3,5,8,9,10)"))
    assert rows(back, "doc_id") == [(1, "1-3,5,8-10")]


def test_exhibits(spark):
    both = doc(spark, 2).unionByName(doc(spark, 3, 2))
    members = spark.createDataFrame([(1, 1, 0, "a"), (1, 2, 1, "b")], "out_id int, doc_id long, doc_seq int, filename string")
    got = [(r[1], r[4]) for r in rows(pages.combine_exhibits(both, members, bates_start=999999), "sheet_no")]
    assert got == [(1, "Exhibit A | a | 2 page(s)"), (2, "BATES-999999"), (3, "BATES-1000000"),
                   (4, "Exhibit B | b | 3 page(s)"), (5, "BATES-1000001"), (6, "BATES-1000002"), (7, "BATES-1000003")]


def test_n_up(spark):
    got = [r[2:] for r in rows(pages.n_up(doc(spark, 5), 4), "page_no")]
    assert got == [(1, 0, 0), (1, 1, 0), (1, 0, 1), (1, 1, 1), (2, 0, 0)]


def test_compare(spark):
    a = doc(spark, 2).select(F.col("doc_id").alias("pair_id"), "page_no", "text")
    b = doc(spark, 3).select(F.col("doc_id").alias("pair_id"), "page_no", F.when(F.col("page_no") == 1, "new").otherwise(F.col("text")).alias("text"))
    assert [r[2] for r in rows(pages.compare_documents(a, b), "page_no")] == ["changed", "unchanged", "added"]
    assert rows(pages.comparison_summary(pages.compare_documents(a, a)).select("error_code"), "error_code") == [(S.NO_DIFFERENCES,)]


def test_written_groups(spark):
    path = scratch() + "/groups"
    split = pages.split_pages(doc(spark, 4), opts(spark, spec="1-2,4", mode="ranges"))
    pages.write_groups(split, doc(spark, 4), path, folder_per_group=True)
    assert sorted(p.split("out_name=")[1] for p in glob.glob(f"{path}/doc_id=1/out_name=*")) == ["page-004", "pages-001-002"]


# --------------------------------------------------------------------- text

def one_page(spark, body):
    return spark.createDataFrame([(1, 1, body)], "doc_id long, page_no int, text string")


@pytest.mark.parametrize("body,patterns,out,code", [
    ("the cat and the cat", "cat", "the     and the    ", None),
    ("abcd", "bcd,abc", "   d", None),                 # sorted order: abc first
    ("axb", "x,a b", None, "redaction_failed"),        # a blank uncovers a literal
    ("nothing", "zz", None, "no_matches"),
    ("nothing", " , ", None, "invalid_option"),
    ("nothing", "", None, "missing_option"),
    ("Cat", "cat", None, "no_matches"),
])
def test_redact(spark, body, patterns, out, code):
    got = rows(text.redact_documents(one_page(spark, body), opts(spark, patterns=patterns)), "doc_id")
    assert [(r[2], r[4]) for r in got] == [(out, code)]


def test_redacted_documents_hold_no_literal(spark, sf_dir):
    options = derived(spark, sf_dir, "doc_options").select("doc_id", "patterns")
    done = text.redact_documents(text_pages(spark, sf_dir), options).filter("error_code IS NULL").join(options, "doc_id")
    from pagetide.functions.values import literal_list

    left = done.filter(F.exists(literal_list(F.col("patterns")), lambda p: F.col("text").contains(p)))
    assert left.count() == 0 and done.count() > 0


def test_extract_text(spark):
    page_rows = spark.createDataFrame([(1, 1, " a\n\n"), (1, 2, "b \n")], "doc_id long, page_no int, text string")
    assert rows(text.extract_text(page_rows, opts(spark, spec="")), "doc_id") == [(1, "a\n\nb\n", None)]
    path = scratch() + "/texts"
    text.write_texts(text.extract_text(page_rows, opts(spark, spec="")), path, file_per_document=True)
    assert glob.glob(f"{path}/doc_id=1/*.txt")


# -------------------------------------------------------------------- usage

def logins(spark, failures, successes=()):
    base = dt.datetime(2024, 1, 1)
    data = [(i, "u", "ip", t in successes, base + dt.timedelta(seconds=t)) for i, t in enumerate(failures)]
    return spark.createDataFrame(data, "id long, username string, ip string, success boolean, created_at timestamp_ntz")


def test_lockout_hand_cases(spark):
    got = [r[0] for r in rows(usage.lockouts(logins(spark, [0, 1, 2, 3, 4, 5, 6, 1000])).select("outcome", "id"), "id")]
    assert got == ["failed"] * 5 + ["blocked"] * 2 + ["failed"]
    # every 100 s: blocked tries must not extend the lock
    got = [r[0] for r in rows(usage.lockouts(logins(spark, range(0, 1500, 100))).select("outcome", "id"), "id")]
    assert got == ["failed"] * 5 + ["blocked"] * 4 + ["failed"] * 5 + ["blocked"]


def test_quota_gate(spark):
    base = dt.datetime(2024, 1, 1, 10)
    data = [(i, base + dt.timedelta(minutes=m), "ip", "merge", True) for i, m in enumerate([0, 1, 2, 3, 4, 5, 60])]
    df = spark.createDataFrame(data, "id long, ts timestamp_ntz, ip string, tool string, succeeded boolean")
    assert [r[0] for r in rows(usage.quota_gate(df).select("allowed", "id"), "id")] == [True] * 5 + [False, True]


# ------------------------------------------------------------------- intake

def test_parts(spark):
    ups = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 0), (5, 99), (6, 10)], "upload_id long, declared_size long")
    t = dt.datetime(2024, 1, 1)
    sent = [(1, 2, "ij"), (1, 0, "abcd"), (1, 1, "efgh"), (2, 0, "abcd"), (2, 2, "ij"), (3, 0, "abcd"), (3, 1, "efg"), (3, 2, "ij"),
            (6, 0, "abc"), (6, 2, "ij")]
    parts = spark.createDataFrame([(*p, t) for p in sent], "upload_id long, idx int, bytes string, ts timestamp_ntz")
    got = intake.assemble_parts(ups, parts, part_bytes=4, max_bytes=50)
    assert rows(got.select("upload_id", "reject_code", "data"), "upload_id") == [
        (1, None, "abcdefghij"), (2, "missing_part", None), (3, "wrong_part_size", None), (4, "empty_file", None),
        (5, "file_too_large", None), (6, "wrong_part_size", None)]


def test_binary_intake(spark):
    folder = scratch()
    for name, body in (("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b"nope"), ("c.txt", b"t"), ("d.PNG", b"p")):
        with open(f"{folder}/{name}", "wb") as fh:
            fh.write(body)
    got = intake.intake(intake.read_files(spark, folder))
    assert rows(got.select("filename", "reject_code", "status"), "filename") == [
        ("a.pdf", None, "validated"), ("b.pdf", "not_a_pdf", "rejected"), ("c.txt", "unsupported_type", "rejected"),
        ("d.PNG", None, "validated")]
    empty = spark.createDataFrame([("e.png", "", bytearray(), 0)], "filename string, mime string, content binary, size_bytes long")
    assert rows(intake.intake(empty).select("reject_code"), "reject_code") == [("empty_file",)]


def test_conform_rejects(spark):
    with pytest.raises(tables.SchemaMismatch):
        tables.conform(spark.range(1), "jobs")


def test_csv_export(spark, sf_dir):
    path = scratch() + "/jobs"
    traffic.export_csv("jobs", derived(spark, sf_dir, "jobs"), "2024-01-31 00:00:00", path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["created_at", "tool", "status", "error"] and back.count() > 0


# -------------------------------------------------------------------- edits

def test_edit_order_brute_force(spark):
    rng = random.Random(11)
    log, want = [], {}
    for doc_id in range(20):
        order = list(range(1, 7))
        log.append((doc_id, -1, "init", order, 0))
        for seq in range(30):
            action = rng.choice(["move", "move", "reverse", "set_order", "append", "rotate"])
            ids, arg = rng.sample(range(1, 9), rng.choice([2, 6])), rng.randint(-2, 9)
            log.append((doc_id, seq, action, ids, arg))
            if action == "move" and set(ids) & set(order):
                block = [i for i in order if i in ids]
                rest = [i for i in order if i not in ids]
                at = min(max(arg, 0), len(rest))
                order = rest[:at] + block + rest[at:]
            elif action == "reverse":
                order = list(reversed(order))
            elif action == "set_order" and len([i for i in ids if i in order]) == len(order):
                order = [i for i in ids if i in order]
            elif action == "append":
                order = order + [i for i in ids if i not in order]
        want[doc_id] = order
    df = spark.createDataFrame(log, "doc_id long, seq long, action string, ids array<int>, arg int")
    got = {}
    for doc_id, item, _ in rows(edits.fold_order(df), "doc_id", "place"):
        got.setdefault(doc_id, []).append(item)
    assert got == want


# ----------------------------------------------------------------- registry

def test_registry():
    with pytest.raises(ValueError):
        register("split", pages.split_pages, ("pages",))
    with pytest.raises(OptionError) as err:
        OPERATORS["n_up"](None, layout=5)
    assert err.value.code == S.INVALID_OPTION
    with pytest.raises(OptionError) as err:
        OPERATORS["n_up"]()
    assert err.value.code == S.MISSING_INPUT
    with pytest.raises(OptionError):
        OPERATORS["quota_usage"](None, limit=True)


# -------------------------------------------------------------------- plans

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dashboard_scans_requests_once(spark, sf_dir):
    import __spark_entry__ as entry

    plan = plan_of(entry.queries()["a_dashboard_1pass"](spark, sf_dir))
    assert plan.count("events.parquet") == 1 and "BroadcastHashJoin" in plan


def test_look_back_reaches_the_scan(spark, sf_dir):
    from pagetide.plans.inputs import source

    df = traffic.since(source(spark, sf_dir, "events"), "2024-01-31 00:00:00", 7, "ts").select("event_id")
    plan = plan_of(df)
    assert "GreaterThanOrEqual(ts" in plan and "props" not in plan


def replayed_edits(log, pages):
    """State of each page by replaying one document's log from its last init."""
    starts = [e[1] for e in log if e[2] == "init"]
    log = sorted(e for e in log if not starts or e[1] >= max(starts))
    here, angle, marked, out = set(), dict.fromkeys(pages, 0), dict.fromkeys(pages, False), dict.fromkeys(pages, False)
    for _, _, action, ids, arg in log:
        if action in ("init", "append"):
            here |= set(ids)
        elif action == "reset_angles":
            angle = dict.fromkeys(pages, 0)
        elif action in ("set_marked", "clear_marks"):
            marked = {p: action == "set_marked" and p in (ids or ()) for p in pages}
        else:
            for p in ids if action == "toggle_mark" else set(ids):
                if p not in pages or (starts and p not in here):
                    continue
                if action == "rotate":
                    angle[p] += arg
                elif action == "set_angles":
                    angle[p] = arg
                elif action == "toggle_mark":
                    marked[p] = not marked[p]
                elif action == "set_mark":
                    marked[p] = arg == 1
                elif action in ("remove", "restore"):
                    out[p] = action == "remove"
    return {(p, angle[p] % 360, marked[p], out[p]) for p in pages}


def test_edit_state_equals_a_replay_at_any_span(spark, monkeypatch):
    rng = random.Random(11)
    kinds = ["rotate"] * 4 + ["toggle_mark"] * 4 + ["set_angles", "set_mark", "remove", "restore", "append", "reset_angles", "set_marked",
                                                  "clear_marks", "reverse", "move"]
    log, pages = [], range(1, 7)
    for doc in range(1, 13):
        rows = [(doc, k, rng.choice(kinds + ["init"] * (doc % 3)), [rng.randint(1, 7) for _ in range(rng.randint(0, 3))],
                 rng.choice([90, -90, 180, 1, 0])) for k in range(rng.randint(0, 90))]
        log += rows
    log += [(13, 0, "clear_marks", None, 0), (13, 1, "rotate", [1], 450)]
    schema = "doc_id long, seq long, action string, ids array<int>, arg int"
    items = spark.createDataFrame([(d, p) for d in range(1, 15) for p in pages], "doc_id long, item int")
    want = {(d, *row) for d in range(1, 15) for row in replayed_edits([e for e in log if e[0] == d], pages)}
    for span in (3, edits.SPAN):
        monkeypatch.setattr(edits, "SPAN", span)
        got = edits.fold_state(items, spark.createDataFrame(log, schema)).select("doc_id", "item", "angle", "marked", "removed")
        assert {tuple(r) for r in got.collect()} == want
    assert edits.fold_state(items, spark.createDataFrame([], schema)).filter("angle <> 0 OR marked OR removed").isEmpty()


def test_edits_count_from_the_last_init_and_from_a_pages_entry(spark):
    log = [(1, 0, "init", [1, 2], 0), (1, 1, "toggle_mark", [1, 1], 0), (1, 2, "rotate", [3], 90), (1, 3, "append", [3], 0),
           (1, 4, "rotate", [2], 90), (1, 5, "toggle_mark", [2], 0)]
    schema = "doc_id long, seq long, action string, ids array<int>, arg int"
    items = spark.createDataFrame([(1, i) for i in (1, 2, 3)], "doc_id long, item int")
    state = lambda rows_: [(r["item"], r["angle"], r["marked"]) for r in edits.fold_state(
        items, spark.createDataFrame(rows_, schema)).orderBy("item").collect()]
    assert state(log) == [(1, 0, False), (2, 90, True), (3, 0, False)]
    assert state([*log, (1, 6, "init", [1, 2, 3], 0)]) == [(1, 0, False), (2, 0, False), (3, 0, False)]
    order = [*log, (1, 7, "move", [3], 0), (1, 8, "set_order", [3, 2], 0), (1, 9, "reverse", [], 0)]
    got = edits.fold_order(spark.createDataFrame(order, schema)).orderBy("place").collect()
    assert [r["item"] for r in got] == [2, 1, 3]


def replayed(rows, seconds=600):
    """Duplicate reuse, submission by submission."""
    newest, out = {}, {}
    for id_, key, status, at in sorted(rows, key=lambda r: (r[3], r[0])):
        held = newest.get(key)
        if held and held[1] >= at - dt.timedelta(seconds=seconds):
            out[id_] = held[0]
            continue
        out[id_] = id_
        if status in ("queued", "running"):
            newest[key] = (id_, at)
    return out


def test_duplicate_reuse_of_a_key_without_pauses(spark):
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    rows_ = [(i, "hot", rng.choice(["queued", "running", "failed"]), start + dt.timedelta(seconds=rng.randrange(40_000)))
             for i in range(4_000)]
    rows_ += [(5_000 + i, f"k{i % 40}", rng.choice(["queued", "failed"]), start + dt.timedelta(seconds=300 * rng.randrange(40)))
              for i in range(600)]
    df = spark.createDataFrame([(i, k, "[]", "{}", s, t) for i, k, s, t in rows_],
                               "id long, tool string, file_ids string, options string, status string, created_at timestamp_ntz")
    got = usage.reuse_duplicates(df)
    assert {r.id: r.job_id for r in got.collect()} == replayed(rows_)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:  # the rows of the one hot key are worked on by several tasks
        hot = usage.reuse_duplicates(df.filter("tool = 'hot'")).withColumn("task", F.spark_partition_id())
        assert hot.select("task").distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_whole_paths_unless_bounded(spark):
    long = "/tools/" + "x" * 400
    seen = traffic.without_geo(traffic.tracked_requests(spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1), "1.2.3.4", "Firefox", None, long)],
        "request_id long, ts timestamp_ntz, ip string, user_agent string, referer string, path string")))
    assert traffic.to_visits(seen).first().path == long
    assert traffic.to_visits(seen, 256).first().path == long[:256]


def test_sketches_merge_over_days(spark):
    visits = spark.range(20_000).select(
        F.concat(F.lit("v"), F.col("id") % 5_000).alias("ip_trunc"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).cast("timestamp_ntz").alias("created_at"))
    merged = traffic.unique_over(traffic.approximate_uniques(visits)).first().unique_visitors
    assert abs(merged - 5_000) <= 100


def test_sketches_are_as_exact_as_asked(spark):
    """Forty days of 20,000 visitors, each day and all of them together."""
    visits = spark.range(800_000).select(
        F.concat(F.lit("v"), "id").alias("ip_trunc"),
        F.timestamp_seconds(1_700_006_400 + F.col("id") % 40 * 86_400).cast("timestamp_ntz").alias("created_at"))
    stored = traffic.approximate_uniques(visits, 0.02 / 6)
    estimates = [r.visitors_estimate for r in stored.collect()]
    assert len(estimates) == 40 and all(abs(e - 20_000) <= 400 for e in estimates)
    assert all(r.e == r.visitors_estimate for r in stored.withColumn("e", F.hll_sketch_estimate("visitors")).collect())
    assert abs(traffic.unique_over(stored).first().unique_visitors - 800_000) <= 16_000


def test_flatten_json_numbers_quotes_and_plan(spark):
    from pagetide.operators.catalog import flatten_json

    doc = r'{"a":"x \"1.5\" 2 \\","b":-1.50e3,"c 7":[1.0,true,"-2",""],"d":{"e\"1":"[3]"}}'
    df = spark.createDataFrame([(1, doc), (2, "7.10"), (3, "null"), (4, ""), (5, '{"a":1,"a":2}')], "id int, doc string")
    got = flatten_json(df, "doc")
    assert rows(got, "id", "key") == [
        (1, "a", 'x "1.5" 2 \\'), (1, "b", "-1.50e3"), (1, "c 7[0]", "1.0"), (1, "c 7[1]", "true"), (1, "c 7[2]", "-2"),
        (1, "c 7[3]", ""), (1, 'd.e"1', "[3]"), (2, "", "7.10"), (3, "", None), (4, "", None), (5, "", None)]
    assert "Python" not in got._jdf.queryExecution().toString()


def _folded(attempts):
    """Outcomes by the rule itself, attempt by attempt."""
    live, out = {}, {}
    for ip, at, number, success in sorted(attempts, key=lambda a: (a[0] or "", a[1], a[2])):
        held = [t for t in live.get(ip, []) if t > at - 900]
        out[number] = "blocked" if len(held) >= 5 else "ok" if success else "failed"
        live[ip] = held + [at] if out[number] == "failed" else held
    return out


def test_lockouts_of_busy_addresses_follow_the_rule(spark):
    rng = random.Random(4)
    attempts, number = [], 0
    for ip, gap, share in (("a", 40, 0.5), ("b", 200, 0.1), ("c", 170, 0.0), (None, 300, 0.3), ("d", 1, 0.2), ("e", 900, 0.0)):
        at = 0
        for _ in range(400):
            at += rng.choice([0, gap, rng.randrange(1, 2 * gap + 1)])
            number += 1
            attempts.append((ip, at, number, rng.random() < share))
    df = spark.createDataFrame(attempts, "ip string, at int, id long, success boolean").selectExpr(
        "ip", "id", "success", "CAST(timestamp_seconds(at) AS timestamp_ntz) AS created_at")
    got = {r.id: r.outcome for r in usage.lockouts(df).collect()}
    assert got == _folded(attempts)


def test_strip_pairs_sort_no_exploded_rows(spark, sf_dir):
    """Files are dealt before each becomes many rows, and flags need no sort of them."""
    from pagetide.plans.metadata import m_strip_pairs

    plan = m_strip_pairs(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.index("Generate") < plan.index("REPARTITION_BY_NUM")


def test_flatten_json_parses_once_and_deals_rows(spark, monkeypatch):
    from pagetide.operators import catalog

    plans, store = [], catalog.store
    monkeypatch.setattr(catalog, "store", lambda df, name: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or store(df, name))
    deep = '{"a":' * 20 + '[1.50,{"b":"{}"}]' + "}" * 20
    got = catalog.flatten_json(spark.createDataFrame([(1, deep)], "id int, doc string"), "doc")
    key = ".".join("a" * 20)
    assert rows(got, "id", "key") == [(1, f"{key}[0]", "1.50"), (1, f"{key}[1].b", "{}")]
    assert "RoundRobinPartitioning" in plans[0] and not any("from_json" in p or "jsontostructs" in p.lower() for p in plans)
