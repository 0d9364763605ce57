"""What must fail a job or be refused: recordings with holes, leaks, settings out of bounds; and bounds that are reached."""

import pytest
from pyspark.sql import functions as F

from sievewall.operators import containment, delivery, flow, gate, honeypots, review, runs
from sievewall.sources import diffs

PAGE = "source string, page int, next_page int, items array<string>"


def pages(spark, *rows):
    return runs.recorded_pages(spark.createDataFrame([("s", *r) for r in rows], PAGE), "source", page_rows=3, most_pages=4)


def test_pages_come_in_order_or_not_at_all(spark):
    rows = [(2, 3, ["d"]), (1, 2, ["a", "b", "c"]), (3, None, [])]
    assert [(r.place, r.item) for r in pages(spark, *rows).orderBy("place").collect()] == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    wrong = {
        "missing or there twice": [rows[0], rows[2]], "followed by another": [(1, 3, ["a"]), (2, 3, []), (3, None, [])], "not the end": [(1, 2, ["a"]), (2, 3, [])], "more than 3 items": [(1, None, list("abcd"))],
        "more than 4 pages": [(i, i + 1 if i < 5 else None, ["a"]) for i in range(1, 6)], "there twice": [(1, None, ["a"]), (1, None, [])],
    }
    for message, own in wrong.items():
        with pytest.raises(Exception, match=message):
            pages(spark, *own).collect()
    two = spark.createDataFrame([("k", i) for i in range(5)], "key string, n int")
    assert runs.within_pages(two, "key", 5).count() == 5
    with pytest.raises(Exception, match="more than 4 rows"):
        runs.within_pages(two, "key", 4).collect()


def test_a_leak_fails_the_job_and_names_no_text(spark):
    secret = "the untrusted text says so and more of it"
    texts = spark.createDataFrame([(1, secret), (2, None), (3, "short")], "doc_id long, text string")
    columns = ["doc_id", F.lit("pass").alias("reason"), F.length("text").alias("n"), F.sha2("text", 256).alias("digest")]
    public = texts.select(*columns)
    assert containment.leaks(public, texts).count() == 0 and containment.contained(public, texts).count() == 3
    for leaking in (F.substring("text", 3, 24), F.struct(F.array(F.col("text")).alias("x")), F.create_map(F.col("doc_id"), F.concat(F.lit("said: "), "text")), F.concat(F.lit("x" * 1000), F.col("text"))):
        frame = texts.select(*columns, leaking.alias("excerpt"))
        assert [tuple(r) for r in containment.leaks(frame, texts).collect()] == [(1, "excerpt")]
        with pytest.raises(Exception, match="doc_id 1: untrusted text in excerpt") as failure:
            containment.contained(frame, texts).collect()
        assert secret not in str(failure.value).split("SQLSTATE")[0]
    assert containment.leaks(texts.select(*columns, F.substring("text", 1, 23).alias("excerpt")), texts).count() == 0


def test_signs_of_json_are_no_part_of_a_text(spark):
    rows = [
        (1, 'In stnd token = "c6e0f0e683084e797c026e54ed9e255c'), (2, "\\".join(["short words", "abcdefghijklmnopqrstuvw", "x"])), (3, 'one\nabcdefghijklmnopqrstuvw", then nabcdefghijklmnopqrstuvw'),
        (4, '1\n["abcdefghijklmnopqrstuvw'), (5, 'a "quote" and abcdefghijklmnopqrstuvwx'), (6, "\x01abcdefghijklmnopqrstuvw\n1abcdefghijklmnopqrstuvw u0001abcdefghijklmnopqrstuvw"),
    ]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    head = F.substring("text", 1, 40)
    for nested in (F.array(head), F.struct(head.alias("x")), F.create_map(head, F.lit(1)), F.array(F.struct(F.array(head)))):
        assert [tuple(r) for r in containment.leaks(texts.select("doc_id", nested.alias("parts")), texts).collect()] == [(5, "parts")]
    found = containment.leaks(texts.select("doc_id", head.alias("excerpt"), F.array(F.lit(None).cast("string")).alias("parts")), texts).collect()
    assert sorted(tuple(r) for r in found) == [(k, "excerpt") for k in range(1, 7)]


def test_audit_containment_equals_its_sql_around_quotes_and_escapes(spark, tmp_path):
    import duckdb

    from sievewall.plans import chain

    words = "The quick brown fox jumps over lazy dogs while seven wizards quietly box up old jade vases"
    texts = [words[:i] + sign + words[i:] for sign in ('"', "\\", "\n", "\x01") for i in (0, 15, 16, 17, 23, 24, 39, 40)]
    texts += [words[:16] + "\n" + words[16:39] + '" and more', words[:23] + '\n said "' + words[:23] + '", not n' + words[:23], '"' * 60, "\\" * 60, '\\"' * 30, words[:24], words[:23], "", None]
    rows = [(25 * i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = sorted((r.doc_id, r.column) for r in chain.audit_containment(spark, str(tmp_path)).collect())
    assert found == sorted(duck.sql(chain.SQL["audit_containment"]).fetchall())


def test_scenarios_without_a_turn_are_skipped_and_the_worst_turn_counts(spark):
    call = lambda name: [(0, name, "{}", True)]
    turns = spark.createDataFrame([(1, "a", call("note"), ""), (1, "a", call("trap"), ""), (1, "b", call("trap"), ""), (1, "gone", call("trap"), ""), (2, "a", call("note"), "TOK")], "doc_id long, scenario string, calls array<struct<ord:int,name:string,args:string,parsed:boolean>>, text string")
    docs = spark.createDataFrame([(1,), (2,), (3,), (3,)], "doc_id long")
    found = honeypots.scenario_results(docs, [("a", ["trap"], "C"), ("b", [], "C")], turns, ("note",), {"C": "TOK"})
    assert sorted((r.doc_id, r.scenario, r.signal) for r in found.collect()) == [(1, "a", "trap:trap"), (1, "b", "unavailable:malformed-tool-call"), (2, "a", "canary_in_text:C"), (2, "b", honeypots.MISSING), (3, "a", honeypots.MISSING), (3, "b", honeypots.MISSING)]


def test_settings_out_of_bounds_are_errors():
    assert runs.ReviewConfig("owner", "model").threshold == 70
    for wrong in ({"owner": "a b"}, {"owner": ""}, {"model": " "}, {"effort": "most"}, {"threshold": 101}, {"threshold": True}):
        with pytest.raises(ValueError, match="must be"):
            runs.ReviewConfig(**({"owner": "owner", "model": "m"} | wrong))


def test_two_readings_must_agree(spark):
    files = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "change_id long, ord int, path string")
    assert runs.parsed_alike(files, files).count() == 2
    with pytest.raises(Exception, match="parses differently"):
        runs.parsed_alike(files, files.where("ord = 0")).collect()


def test_pure_renames_are_binary_by_their_first_bytes(spark):
    zeros = [b"a\x00b", b"ab", b"x" * 7999 + b"\x00", b"x" * 8000 + b"\x00", None]
    frame = spark.createDataFrame([(i, bytearray(z) if z is not None else None) for i, z in enumerate(zeros)], "i int, content binary")
    none = F.array().cast("array<string>")
    found = frame.orderBy("i").select(gate.found_binary(F.lit("renamed"), F.lit(False), none, F.lit(False), F.col("content")).alias("b")).collect()
    assert [r.b for r in found] == [True, False, True, False, False]
    assert not frame.where(gate.found_binary(F.lit("renamed"), F.lit(False), F.array(F.lit("+x")), F.lit(False), F.col("content"))).count()


def test_lists_and_bodies_reach_their_bounds(spark):
    decisions = spark.createDataFrame([(1, True, ["r"])], "change_id long, block boolean, reasons array<string>")
    hits = spark.range(50).select(F.lit(1).cast("long").alias("change_id"), F.col("id").alias("ord"), F.lit("binary").alias("rule"), F.lit("p").alias("path"), F.lit("d").alias("detail"), F.lit(True).alias("overridable"))
    found = spark.range(200).select(F.lit(1).cast("long").alias("change_id"), F.col("id").alias("ord"), F.lit("bug").alias("category"), F.lit("low").alias("severity"), F.lit("f" * 300).alias("file"), F.lit("review").alias("source"), F.lit("e" * 5000).alias("explanation"))
    scrutiny = spark.range(2000).select(F.lit(1).cast("long").alias("change_id"), F.col("id").alias("ord"), F.lit("q" * 200).alias("path"), F.lit("long-line").alias("reason"))
    body = flow.review_bodies(decisions, hits, found, scrutiny).first().body
    assert body.count("- binary") == flow.HIT_CAP and "- … and 10 more" in body and body.count("- low") == flow.HIT_CAP and "- … and 160 more" in body
    long = decisions.withColumn("reasons", F.array(F.repeat(F.lit("x"), 70_000)))
    cut = flow.review_bodies(long, hits, found, scrutiny).first().body
    assert len(cut) <= flow.BODY_CAP - flow.MARKER_ROOM and cut.endswith("… (truncated)")


def test_changes_that_cannot_be_read_have_no_files(spark):
    changes = spark.createDataFrame([(1, "nonsense"), (2, None), (3, "diff --git a/x b/x\nold mode 1\nnew mode 2\n")], "change_id long, diff string")
    contents = spark.createDataFrame([], "change_id long, side string, path string, content binary")
    g = review.gathered(changes, contents)
    assert [(r.change_id, r.failure) for r in g.failed.collect()] == [(1, review.UNPARSED)] and [r.change_id for r in g.files.collect()] == [3]
    assert review.checked(g, []).count() == 0 and diffs.added_lines(g.files).count() == 0


def test_a_vendor_with_a_probe_of_its_own(spark):
    probes = spark.createDataFrame([(1, "hello"), (2, "there")], "doc_id long, text string")
    vote = lambda ok, flagged, reason: lambda d: d.select("doc_id", F.lit(ok).alias("ok"), F.lit(flagged).alias("flagged"), F.lit(reason).alias("reason"))
    panel = delivery.VendorPanel(1).add("a", vote(True, False, "pass")).add("b", vote(False, True, "b:prompt_attack"), ready=vote(True, False, "pass")).add("c", vote(True, True, "odd"))
    found = {r.member: r.reason for r in panel.readiness(probes).collect()}
    assert found == {"a": None, "b": None, "c": "c_unavailable:bad-result"}
