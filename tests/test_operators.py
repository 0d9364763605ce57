"""Single operators on small literal frames."""

import re
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from sievewall.functions import credentials, encodings, unicode
from sievewall.operators import evaluation, gate, limits, panels, verdicts, windows
from sievewall.sources import corpora, diffs


def column(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in frame.withColumn("x", expression(F.col("t"))).orderBy("i").collect()]


def test_profiles_count_and_precedence(spark):
    text = "a​‮\U000e0041⁠­️x"
    prose = column(spark, [text], lambda t: unicode.hidden_counts(t)["stripped"])
    code = column(spark, [text], lambda t: unicode.hidden_counts(t, "code")["stripped"])
    assert prose == [4] and code == [6]
    with pytest.raises(ValueError):
        unicode.patterns("other")


def test_nfkc_and_slashes_fold(spark):
    frame = spark.createDataFrame([(1, "ﬁ½"), (2, "plain"), (3, None), (4, "a∕b")], "doc_id int, text string")
    found = {r.doc_id: (r.clean, r.nfkc_changed) for r in unicode.sanitized(frame).collect()}
    assert found == {1: ("fi1/2", True), 2: ("plain", False), 3: ("", False), 4: ("a/b", True)}


def test_emoji_selector_is_exempt_once(spark):
    assert column(spark, ["⚠️", "⚠️️", "x️"], unicode.exposed_selectors) == [1, 0, 0]


def test_anomaly_needs_three_and_a_share(spark):
    assert column(spark, ["​​", "​​​", "​" * 3 + "x" * 2998, ""], lambda t: unicode.is_anomalous(unicode.hidden_counts(t)["stripped"], F.length(t))) == [False, True, False, False]


def test_credential_shapes(spark):
    fake = "a1B2" * 30
    good = ["sk-ant-api01-" + fake[:95], "sk-ant-oat01-" + fake[:60], "ghp_" + fake[:36], "EXA_API_KEY=" + fake[:21]]
    assert column(spark, good, credentials.first_rule) == ["anthropic_api_key", "anthropic_oauth_token", "github_token", "env_assignment_secret"]
    assert column(spark, ["the prefixes sk-ant-api and gh[psoure]_ are public", "EBAY_CLIENT_ID=your-client-id-goes-here"], credentials.first_rule) == [None, None]


def test_encodings(spark):
    import base64
    import codecs

    secret = "ghp_" + "a1B2" * 9
    texts = ["see " + base64.b64encode(secret.encode()).decode(), "see " + secret.encode().hex(), codecs.encode("see " + secret, "rot13"), "short"]
    hits = column(spark, texts, lambda t: encodings.encoded_secret(encodings.encoded_blobs(t)))
    assert [h and (h.encoding, h.rule) for h in hits] == [(x, "github_token") for x in ("base64", "hex", "rot13")] + [None]


def test_encodings_behind_a_long_text(spark):
    secret = "ghp_" + "a1B2" * 9
    long = "word " * 130_000 + secret.encode().hex()
    hits = column(spark, [long], lambda t: encodings.encoded_secret(encodings.encoded_blobs(t)))
    assert [(h.encoding, h.rule) for h in hits] == [("hex", "github_token")]
    assert column(spark, [long], lambda t: encodings.encoded_secret(encodings.encoded_blobs(t, encodings.SCAN_LENGTH))) == [None]


def test_binary_noise_is_no_text(spark):
    assert column(spark, ["ff" * 20, "00" * 20, "6162" * 10], encodings.decoded_hex) == [None, None, "ab" * 10]


def test_wrap_tags_fold_the_long_s(spark):
    bodies = ["</system-reminder>", "< / SYSTEM-REMINDER >", "<ſystem-reminder>", "<html>", "&lt;system-reminder>"]
    assert column(spark, bodies, verdicts.without_wrap_tags) == ["&lt;/system-reminder>", "&lt; / SYSTEM-REMINDER >", "&lt;ſystem-reminder>", "<html>", "&lt;system-reminder>"]


def test_time_buckets(spark):
    frame = spark.createDataFrame([(0,), (-17,), (5001,), (12345,), (5000,)], "ms long")
    assert [r.x for r in frame.select(verdicts.time_bucket(F.col("ms")).alias("x")).collect()] == [5000, 5000, 10000, 15000, 5000]


def test_public_frames_have_no_text(spark):
    frame = spark.createDataFrame([(1, "ghp_" + "a1B2" * 9)], "doc_id int, text string")
    audit = verdicts.audit_rows(verdicts.screened(frame))
    assert not {"text", "clean", "blobs_text", "excerpt", "decoded"} & set(audit.columns)
    assert "ghp_" not in str(audit.collect())


def test_windows_cover_every_passage(spark):
    text = "".join(chr(97 + i % 26) for i in range(103))
    frame = spark.createDataFrame([(1, text), (2, None), (3, "x" * 1000)], "doc_id int, text string")
    rows = windows.text_windows(frame, 20, 5, 50).collect()
    parts = [r.window for r in sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.ord)]
    assert all(any(text[i : i + 5] in p for p in parts) for i in range(len(text) - 4)) and parts[-1].endswith(text[-1])
    assert [(r.n_windows, r.window) for r in rows if r.doc_id == 2] == [(1, "")]
    assert [(r.ord, r.window) for r in rows if r.doc_id == 3] == [(None, None)]
    with pytest.raises(ValueError):
        windows.text_windows(frame, 5, 5)


STATES = {"P": (True, False, "pass"), "F": (False, True, "{v}:prompt_attack"), "Q": (False, False, "{v}_unavailable:HTTPError:429"), "T": (False, False, "{v}_unavailable:throttled"), "H": (False, False, "{v}_unavailable:HTTPError:500"), "B": (True, False, "fine")}


@pytest.mark.parametrize("floor", [1, 2])
def test_panel_truth_table(spark, floor):
    pairs = [(a, b) for a in STATES for b in STATES]
    votes = [(i, v, o, *STATES[s][:2], STATES[s][2].format(v=v)) for i, pair in enumerate(pairs) for o, (v, s) in enumerate(zip(("lakera", "model_armor"), pair))]
    frame = spark.createDataFrame(votes, "doc_id int, vendor string, vendor_ord int, ok boolean, flagged boolean, reason string")
    found = {r.doc_id: r.outcome for r in panels.panel_outcome(frame, floor).collect()}
    for i, pair in enumerate(pairs):
        verdicts_given = sum(s in "PF" for s in pair)
        if verdicts_given >= floor:
            wanted = "flagged" if "F" in pair else "pass"
        else:
            wanted = "unavailable" if set(pair) & {"H", "B"} else "degraded-quota"
        assert found[i] == wanted, pair


def test_outage_reasons(spark):
    reasons = ["lakera_unavailable:throttled", "honeypot:honeypot_unavailable:s1:x+skipped=1/6", "l2_arbitration:judge_unavailable+x", "secret_shape:thing_unavailable", "no-key", "pass", "", None]
    assert column(spark, reasons, evaluation.is_outage) == [True, True, True, False, True, False, False, False]


def test_scorecard_of_nothing_is_zero(spark):
    empty = spark.createDataFrame([], "expected string, predicted string")
    row = evaluation.scorecard(empty).first()
    assert (row.tp, row.precision, row.recall, row.f1) == (0, 0.0, 0.0, 0.0)


def test_globs(spark):
    import fnmatch

    names = ["a/b.md", "ab", "a[b", "x.y", "a\nb"]
    for glob in ["a*", "a?b", "[ab]*", "[!a]*", "a[[]b", "*.y", "a[b"]:
        assert column(spark, names, lambda t, g=glob: t.rlike(gate.glob_pattern(g))) == [fnmatch.fnmatchcase(n, glob) for n in names], glob


def test_logical_lines(spark):
    lines = ["a==\\", "\\1\\", "2", "# c \\", "b", "d \\"]
    frame = spark.createDataFrame([("p", i + 1, x) for i, x in enumerate(lines)], "path string, line_no int, line string")
    assert sorted((r.line_no, r.line) for r in gate.logical_lines(frame).collect()) == [(1, "a==12"), (4, " # c \\"), (5, "b"), (6, "d ")]


def test_limiter_follows_refusals(spark):
    kinds = [(0.0, "acquire", 0.0, None), (1.0, "acquire", 1.0, None), (2.0, "acquire", 2.0, None), (3.0, "throttled", 2.0, 50.0), (4.0, "acquire", 4.0, None), (5.0, "success", 2.5, None), (6.0, "acquire", 6.0, None), (64.0, "acquire", 64.0, None), (65.0, "success", 64.0, None), (66.0, "acquire", 66.0, None)]
    frame = spark.createDataFrame([("v", i, t, k, s, "quota", a) for i, (t, k, s, a) in enumerate(kinds)], "vendor string, ord long, ts double, kind string, started_at double, cause string, retry_after double")
    found = [r.decision for r in limits.limiter_decisions(frame, limits.LimiterConfig(interval=10.0, burst=2.0)).orderBy("ord").collect()]
    assert found == ["allowed", "allowed", "throttled", "recorded", "throttled", "recorded", "throttled", "allowed", "recorded", "throttled"]


def test_stream_equals_batch(spark, tmp_path):
    from sievewall.streaming.limits import limiter_stream

    rows = [(f"v{i % 3}", i, float(i * 7), "throttled" if i % 11 == 5 else "success" if i % 4 == 3 else "acquire", float(i * 7 - 3), "service" if i % 2 else "quota", None) for i in range(200)]
    schema = "vendor string, ord long, ts double, kind string, started_at double, cause string, retry_after double"
    frame = spark.createDataFrame(rows, schema)
    config = limits.LimiterConfig(interval=20.0, burst=3.0, backoff=30.0, longest=200.0)
    for part in (frame.where("ord < 90"), frame.where("ord >= 90")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = limiter_stream(stream, config).writeStream.format("memory").queryName("limiter_out").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = sorted(tuple(r) for r in spark.table("limiter_out").collect())
    assert found == sorted(tuple(r) for r in limits.limiter_decisions(frame, config).collect())


DIFF = """diff --git a/x.py b/x.py
index 1..2 100644
--- a/x.py
+++ b/x.py
@@ -1,2 +1,3 @@
 a
-b
+c
+d
\\ No newline at end of file
diff --git "a/t\\303\\244.md" "b/t\\303\\244.md"
new file mode 100644
diff --git a/old b/new
similarity index 90%
rename from old
rename to new
diff --git a/sub b/sub
index 1..2 160000
diff --git a/p.png b/p.png
Binary files a/p.png and b/p.png differ
"""


def test_diffs(spark):
    frame = spark.createDataFrame([(1, DIFF), (2, "rubbish"), (3, ""), (4, DIFF[:90]), (5, None)], "change_id long, diff string")
    parsed = diffs.parsed_diffs(frame)
    assert {r.change_id: r.error for r in parsed.collect()} == {1: None, 2: "content before the first header", 3: None, 4: "truncated hunk", 5: None}
    files = [(r.path, r.old_path, r.status, r.binary, r.gitlink) for r in diffs.changed_files(parsed).orderBy("ord").collect()]
    assert files == [("x.py", None, "modified", False, False), ("tä.md", None, "added", False, False), ("new", "old", "renamed", False, False), ("sub", None, "modified", False, True), ("p.png", None, "modified", True, False)]
    assert sorted((r.line_no, r.text) for r in diffs.added_lines(diffs.changed_files(parsed)).collect()) == [(2, "c"), (3, "d")]


def test_corpora(spark, tmp_path):
    (tmp_path / "labels.jsonl").write_text('{"id": "a.md", "expected": "block"}\n\n{"id": "b", "text": "t", "expected": "pass"}\n')
    (tmp_path / "a.md").write_bytes(b"one\r\ntwo\xff\r")
    found = {r.id: r.text for r in corpora.corpus_folder(spark, str(tmp_path)).collect()}
    assert found == {"a.md": "one\ntwo�\n", "b": "t"}
    (tmp_path / "bad.jsonl").write_text('{"id": "a", "id": "b", "text": "t", "expected": "pass"}\n')
    with pytest.raises(Exception, match="malformed case"):
        corpora.labelled_cases(spark, str(tmp_path / "bad.jsonl")).collect()


def test_settings(spark):
    assert column(spark, ["5", "x", "NaN", "1e400", "99", None], lambda t: corpora.bounded_number(t, 2, 1, 10)) == [5.0, 2.0, 2.0, 2.0, 10.0, 2.0]
    assert column(spark, ["A.example.com.\n\n# c\nb.example.org"], corpora.allowed_hosts) == [["a.example.com", "b.example.org"]]
    with pytest.raises(Exception, match="line 2"):
        column(spark, ["a.example.com\n1.2.3.4"], corpora.allowed_hosts)
    assert column(spark, ["a*\n # x\n\n b"], corpora.exception_globs) == [["a*", "b"]]


def test_rejections_go_to_quarantine(spark):
    frame = spark.createDataFrame([(1, "ghp_" + "a1B2" * 9 + "x" * 500), (2, "fine")], "doc_id int, text string")
    rows = verdicts.rejections(verdicts.screened(frame)).collect()
    assert [(r.doc_id, len(r.prompt)) for r in rows] == [(1, 300)] and '"reason":"secret_shape:github_token"' in rows[0].verdict and "ghp_" not in rows[0].verdict


def test_urls(spark):
    from sievewall.functions import urls

    allowed = F.array(F.lit("registry.npmjs.org"), F.lit("github.com"))
    cases = {
        "https://registry.npmjs.org/x": [],
        "a:https://evil.x/": ["https://evil.x"],
        "https:evil.x https:///evil.y": ["https://evil.x", "https://evil.y"],
        "https://evil\\@registry.npmjs.org": ["https://evil"],
        "http://github.com": ["http://github.com"],
        "git+ssh://git@github.com/a ssh://root@github.com": ["ssh://github.com"],
        "file:../pkg file:///etc": ["file://etc"],
        "git@evil.example:a/b x@1.0.0-alpha.beta: git@npm:^1": ["ssh://evil.example"],
        "https://[::1]:80/ https://github.com.:443/": ["https://[::1]"],
        "ht\ttps://evil.z": ["https://evil.z"],
    }
    assert column(spark, list(cases), lambda t: urls.bad_urls(t, allowed)) == [*cases.values()]


def test_replies(spark):
    from sievewall.functions import replies

    entry = '{"detector_type": "%s", "detected": %s}'
    bodies = {
        '{"flagged": false, "breakdown": [%s]}' % (entry % ("prompt_attack", "false")): "pass",
        '{"flagged": true, "breakdown": [%s, %s]}' % (entry % ("pii", "true"), entry % ("prompt_attack", "true")): "lakera:prompt_attack",
        '{"flagged": false, "breakdown": [%s]}' % (entry % ("prompt_attack", "true")): "lakera_unavailable:bad-response",
        '{"flagged": "false", "breakdown": [%s]}' % (entry % ("prompt_attack", "false")): "lakera_unavailable:bad-response",
        '{"flagged": false, "breakdown": []}': "lakera_unavailable:bad-response",
        '{"flagged": false, "flagged": false, "breakdown": [%s]}' % (entry % ("prompt_attack", "false")): "lakera_unavailable:bad-response",
        "rubbish": "lakera_unavailable:bad-response",
    }
    assert column(spark, list(bodies), replies.lakera_reason) == [*bodies.values()]
    armor = '{"sanitizationResult": {"invocationResult": "%s", "filterResults": {"pi_and_jailbreak": {"piAndJailbreakFilterResult": {"executionState": "%s", "matchState": "%s"}}}}}'
    found = column(spark, [armor % x for x in (("SUCCESS", "EXECUTION_SUCCESS", "MATCH_FOUND"), ("SUCCESS", "EXECUTION_SUCCESS", "NO_MATCH_FOUND"), ("PARTIAL", "", ""), ("SUCCESS", "EXECUTION_SKIPPED", ""), ("SUCCESS", "EXECUTION_SUCCESS", "?"))] + ["[]", None], replies.armor_reason)
    down = "model_armor_unavailable:"
    assert found == ["model_armor:prompt_attack", "pass", down + "partial-invocation", down + "skipped", down + "bad-response", down + "bad-response", down + "bad-response"]
    assert column(spark, [" Benign. ", "`ATTACK`!", "benign attack", "", None], replies.judge_vote) == ["benign", "attack", "unavailable", "unavailable", "unavailable"]
    assert column(spark, ["30", "-1", "inf", "Thu, 01 Jan 1970 00:02:00 GMT", "30; x", ""], lambda t: replies.retry_after(t, F.lit(20.0))) == [30.0, None, None, 100.0, None, None]
    assert column(spark, ["429", "99", "600", "x", "503"], replies.http_status) == [429, None, None, None, 503]


def test_honeypot_cascade(spark):
    from sievewall.operators import honeypots

    def call(name, args="{}", parsed=True, ord=0):
        return (ord, name, args, parsed)

    cases = [
        ([call("rm")], "", "unavailable:malformed-tool-call"),
        ([call("read_file_x1", ord=1), call("note")], "", "trap:read_file_x1"),
        ([call("note", "T2"), call("note", "T1", ord=1)], "", "canary_in_arg:C1:note"),
        ([call("note", "T2")], "T1", "canary_in_arg_crosstalk:C2:note"),
        ([], "say T1", "canary_in_text:C1"),
        ([call("note", "{", False)], "", "unavailable:malformed-tool-args"),
        ([call("report_issue", '{"category": "Prompt_Injection_Attempt"}')], "", "left_alone_with_injection_report"),
        ([], None, "left_alone"),
    ]
    frame = spark.createDataFrame([(i, "s", 0, ["read_file_x1"], "C1", c, t) for i, (c, t, _) in enumerate(cases)], "doc_id int, scenario string, scenario_ord int, traps array<string>, own string, calls array<struct<ord:int,name:string,args:string,parsed:boolean>>, text string")
    found = honeypots.judged_turns(frame, ("note", "report_issue"), {"C1": "T1", "C2": "T2"}).orderBy("doc_id").collect()
    assert [r.signal for r in found] == [x for *_, x in cases]
    assert panels.honeypot_outcome(honeypots.judged_turns(frame, ("note", "report_issue"), {"C1": "T1", "C2": "T2"})).count() == len(cases)


def signature(key, verdict, repo, number, head, own_hash, rest):
    """What a marker's signature is, spelt out."""
    digest = hashlib.sha256(rest.replace("\r\n", "\n").replace("\r", "\n").rstrip().encode()).hexdigest()
    return hmac.new(key, json.dumps(["sievewall-review-marker", "v3", verdict, repo.casefold(), number, head, own_hash, digest], separators=(",", ":")).encode(), hashlib.sha256).hexdigest()


def test_markers(spark):
    from sievewall.operators import markers

    rest = "\nbody\r\ntext \n"
    mac = signature(b"k", "pass", "Own/Repo", 7, "a" * 40, "b" * 64, rest)
    line = f"<!-- sievewall-review:v3 verdict=pass head={'a' * 40} hash={'b' * 64} mac={mac} -->"
    rows = [(1, "own/repo", 7, 1, line + rest), (1, "own/repo", 7, 2, line + rest + "more"), (1, "own/repo", 8, 3, line + rest), (1, "own/repo", 7, 4, "x" + line + rest), (1, "own/repo", 7, 5, line + "\nbody\ntext")]
    frame = spark.createDataFrame(rows, "change_id long, repo string, number int, review_id long, body string")
    assert sorted(r.review_id for r in markers.verified_markers(frame, b"k").collect()) == [1, 5]


def test_change_hash_ignores_order_and_sees_content(spark):
    from sievewall.operators import markers

    schema = "change_id long, path string, old_path string, status string, old_mode string, new_mode string, binary boolean, content_sha256 string, body array<string>"
    a, b = ("a", None, "modified", None, None, False, None, ["+ä"]), ("b", "c", "renamed", None, "100755", True, "00", [])
    rows = [(1, *a), (1, *b), (2, *b), (2, *a), (3, *a), (3, *b[:6], "01", [])]
    found = {r.change_id: r.own_hash for r in markers.changes_hash(spark.createDataFrame(rows, schema)).collect()}
    assert found[1] == found[2] != found[3]


def files_of(spark, *texts):
    parsed = diffs.parsed_diffs(spark.createDataFrame(list(enumerate(texts)), "change_id long, diff string")).collect()
    return [r.error or [(f.path, f.old_path, f.status) for f in r.files] for r in sorted(parsed, key=lambda r: r.change_id)]


def test_quoted_paths_are_read_or_refused(spark):
    head = "diff --git {}\n"
    good = [r'"a/t\303\244 b.md" b/plain name.md', r'a/plain name.md "b/t\303\244.md"', r'"a/a\"b\\c" "b/a\"b\\c"', "a/x y b/x y", "a/p b/q b/r"]
    bad = [r'"a/\377" "b/\377"', r'"a/x\q" "b/x\q"', r'"a/x"y" "b/x"y"', r'"a/x b/x', "a/x", r'"a/\777" "b/x"']
    found = files_of(spark, *(head.format(x) for x in good + bad))
    assert found[:5] == [[("plain name.md", "tä b.md", "renamed")], [("tä.md", "plain name.md", "renamed")], [('a"b\\c', None, "modified")], [("x y", None, "modified")], [("q b/r", "p", "renamed")]]
    assert found[5:] == ["bad file header"] * 6
    moves = files_of(spark, 'diff --git a/o b/n\nsimilarity index 100%\nrename from o\nrename to "n\\"q"\n', 'diff --git a/o b/n\nrename from "o\nrename to n\n')
    assert moves == [[('n"q', "o", "renamed")], "bad quoted path"]


def test_bodies_keep_notes_and_marks_that_look_like_headers(spark):
    text = "diff --git a/q.sql b/q.sql\nindex 1..2 100644\n--- a/q.sql\n+++ b/q.sql\n@@ -1,3 +1,4 @@ x\n--- old comment\n+++ new comment\n same\n\\ No newline at end of file\n+@@ -1 +1 @@\n diff --git\n"
    row = diffs.changed_files(diffs.parsed_diffs(spark.createDataFrame([(1, text)], "change_id long, diff string"))).collect()[0]
    assert row.path == "q.sql" and row.removed == ["-- old comment"] and [tuple(x) for x in row.added] == [(1, "++ new comment"), (3, "@@ -1 +1 @@")]
    assert row.body == ["--- old comment", "+++ new comment", " same", "\\ No newline at end of file", "+@@ -1 +1 @@", " diff --git"]
    short = text.replace("+1,4", "+1,5")
    assert files_of(spark, short, short + "diff --git a/x b/x\n", text + "odd\n", "@@ -1 +1 @@\n", text.replace("@@ -1,3", "@@ -x")) == ["truncated hunk", "bad hunk line", "unexpected line outside a hunk", "content before the first header", "bad hunk header"]


def test_modes_and_links(spark):
    text = "diff --git a/m b/m\nindex 1..2 160000\ndiff --git a/l b/l\nnew file mode 120000\nindex 0..2\n--- /dev/null\n+++ b/l\n@@ -0,0 +1 @@\n+t\ndiff --git a/s b/s\ndeleted file mode 160000\nindex 1..0\ndiff --git a/f b/f\nold mode 100644\nnew mode 100755\n"
    found = [(r.path, r.status, r.old_mode, r.new_mode, r.gitlink) for r in diffs.changed_files(diffs.parsed_diffs(spark.createDataFrame([(1, text)], "change_id long, diff string"))).orderBy("ord").collect()]
    assert found == [("m", "modified", None, None, True), ("l", "added", None, "120000", False), ("s", "deleted", "160000", None, False), ("f", "modified", "100644", "100755", False)]


LOCKS = {
    "package-lock.json": json.dumps({"packages": {"": {"name": "x"}, "node_modules/a": {"resolved": "https://registry.npmjs.org/a.tgz", "funding": {"url": "https://evil.x/f"}, "license": "MIT"}, "node_modules/b": {"resolved": "https://evil.example/b.tgz"}, "node_modules/c": {"resolved": "../c", "link": True}, "node_modules/d": {"resolved": "../d"}, "node_modules/e": {"dependencies": {"funding": "github:o/r#1"}}}}),
    "requirements.txt": "a==1 \\\n  --hash=sha256:1\n--index-url https://pypi.org\\\n.evil.x/simple\n-ihttps://bad.host/s\nb @ https://files.pythonhosted.org/b.whl\n-r 'open\n",
    "flake.lock": json.dumps({"nodes": {"n": {"locked": {"type": "github", "host": "evil.git", "owner": "o"}, "original": {"type": "mercurial"}}}}),
    "bun.lock": '{"packages": {"a": ["a@1.0.0", "", {}, "sha"], "b": ["b@github:o/r", "", {},], "c": ["c@2", "http://x.y/z"],},}',
    "x/pipfile.lock": '{"a": 1, "a": 2}',
    "sub/yarn.lock": "# THIS IS GENERATED\n# yarn lockfile v1\n\n",
    "moved/gemfile.lock": "GEM\n  remote: https://rubygems.org/\n  remote: http://gems.x/ \\\n",
}


def test_lockfiles(spark):
    from sievewall.operators import lockfiles

    base = json.dumps({"packages": {"node_modules/b": {"resolved": "https://old.example/b.tgz"}}})
    files = spark.createDataFrame([*((p, "other.txt" if p.startswith("moved") else None, "modified") for p in LOCKS), ("sub/yarn.lock", None, "modified"), ("gone/bun.lock", None, "deleted"), ("cap/flake.lock", None, "added")], "path string, old_path string, status string")
    heads = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in LOCKS.items()], "path string, content binary")
    bases = spark.createDataFrame([("package-lock.json", bytearray(base.encode()))], "path string, content binary")
    lines = ('  resolved "git+ssh://git@github.com/x"', '  resolved "https://registry.yarnpkg.com/a"', '  x "https:\\u002f\\u002fevil.q/"', '  y "https:\\q//registry.yarnpkg.com"', "")
    added = spark.createDataFrame([("sub/yarn.lock", 3 + i, t) for i, t in enumerate(lines)], "path string, line_no long, text string")
    slot, no = "fetch slot that is not an https URL or a local path", "not allowlisted: "
    assert sorted(tuple(r) for r in lockfiles.lockfile_hits(files, heads, bases, added).collect()) == sorted([
        ("bun.lock", f"{no}{slot}, hosted-git spec github:, http://x.y"), ("flake.lock", f"{no}flake host evil.git, flake input type mercurial"), ("package-lock.json", f"{no}{slot}, hosted-git spec github:, https://evil.example"),
        ("requirements.txt", f"line 3: {no}https://pypi.org.evil.x"), ("requirements.txt", f"line 5: {no}https://bad.host"), ("requirements.txt", f"line 7: {no}options pip cannot split"),
        ("sub/yarn.lock", f"line 3: {no}git+ssh://github.com, hosted-git spec git+ssh:, {slot}"), ("sub/yarn.lock", f"line 5: {no}https://evil.q"), ("sub/yarn.lock", f"line 6: {no}undecodable escape near a URL, https://q"),
        ("x/pipfile.lock", "lockfile does not parse"), ("moved/gemfile.lock", f"line 3: {no}line continuation, http://gems.x"), ("cap/flake.lock", "lockfile too large to check"),
    ])


def test_sinks_of_verdicts(spark, tmp_path):
    from sievewall.operators import delivery

    rows = spark.createDataFrame([("r1", "x")], "report_id string, prompt string")
    delivery.append_quarantine(rows, str(tmp_path / "q"))
    delivery.append_quarantine(rows, str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "q")).count() == 2
    delivery.write_new(rows, str(tmp_path / "n"))
    with pytest.raises(Exception, match="exist"):
        delivery.write_new(rows, str(tmp_path / "n"))
    panel = delivery.VendorPanel(floor=5)
    with pytest.raises(ValueError, match="vendor"):
        panel.votes(rows)
    assert panel.add("a", lambda d: d).floor == 1 and delivery.VendorPanel(floor=0).add("a", lambda d: d).floor == 1
    with pytest.raises(ValueError, match="there already"):
        panel.add("a", lambda d: d)


def test_budget_gives_back_once_and_within_its_month(spark):
    events = [("v", 1, "2026-01-30", "reserve", "a", 60), ("v", 2, "2026-01-30", "reserve", "b", 50), ("v", 3, "2026-01-31", "release", "a", None), ("v", 4, "2026-01-31", "release", "a", None), ("v", 5, "2026-01-31", "reserve", "c", 100), ("v", 6, "2026-02-01", "reserve", "d", 10), ("v", 7, "2026-02-01", "release", "c", None), ("v", 8, "2026-02-02", "reserve", "e", -1), ("v", 9, "2026-02-02", "reserve", "f", None)]
    frame = spark.createDataFrame(events, "vendor string, ord long, day string, kind string, reservation string, amount long").selectExpr("vendor", "ord", "cast(day as timestamp) as ts", "kind", "reservation", "amount")
    assert [(r.decision, r.used) for r in limits.budget_decisions(frame, 100).orderBy("ord").collect()] == [("allowed", 60), ("throttled", 60), ("released", 0), ("ignored", 0), ("allowed", 100), ("allowed", 10), ("ignored", 10), ("error", 10), ("error", 10)]


def test_hidden_characters_of_long_texts(spark):
    """As character by character; a long text with one umlaut costs about a pass of a pattern, not a question for each of its characters."""
    import random
    import time

    from sievewall.functions import rendering
    from sievewall.operators import gate

    rng = random.Random(5)
    hidden = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for own in unicode.ranges_of("code").values() for a, b in own) + "]")
    letters = ["a", "\u200b", "é", "\U000e0041", "\ue000", "#", "\ufe0f", "\u2600", "\x1b", " ", "\U0001f600", "\u0378", "\xad"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(300)] + ["", "\u200b", "\u200bx\u200b", None]
    shown = column(spark, texts, unicode.with_hidden_shown)
    assert shown == [t and hidden.sub(lambda m: f"<U+{ord(m[0]):04X}>", t) if t is not None else None for t in texts]
    counted = column(spark, texts, lambda t: unicode.hidden_counts(t, "code")["stripped"])
    assert counted == [None if t is None else len(hidden.findall(t)) for t in texts]
    bare = [t.replace("\ufe0f", "") for t in texts if t is not None]
    assert column(spark, bare, lambda t: unicode.hidden_points(t, "code")) == [[ord(c) for c in hidden.findall(t)] for t in bare]

    def seconds(expression):
        frame = spark.createDataFrame([(1,)], "i int").select(F.concat(F.repeat(F.lit("plain words "), 200_000), F.lit("\u200b\xe4")).alias("t"))
        found = []
        for _ in range(3):
            began = time.time()
            frame.select(expression(F.col("t")).alias("x")).write.format("noop").mode("overwrite").save()
            found.append(time.time() - began)
        return min(found)

    one = seconds(lambda t: F.regexp_count(t, F.lit("[xyz]")))
    assert seconds(lambda t: F.size(gate.odd_characters(t, gate.CONTROLS))) < 8 * one + 0.4
    assert seconds(lambda t: F.length(unicode.with_hidden_shown(t))) < 8 * one + 0.4
    assert seconds(lambda t: F.length(rendering.neutralised(t, 1 << 30))) < 20 * one + 1
    assert seconds(unicode.exposed_selectors) < 3 * one + 0.4


def test_diffs_and_markers_stay_dealt(spark):
    """Rows that compress well are not merged into a few tasks: more hold some than a shuffle here has, four."""
    from sievewall.operators import flow

    changes = spark.range(400).select(F.col("id").alias("change_id"), F.concat(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -0,0 +1 @@\n+"), F.col("id").cast("string"), F.lit("\n")).alias("diff"))
    read = diffs.parsed_diffs(changes)
    assert read.select(F.spark_partition_id().alias("task")).distinct().count() > 4
    assert read.where("error is null and files[0].added[0].text = cast(change_id as string)").count() == 400
    events = spark.range(400).select(F.col("id").alias("change_id"), F.lit("h").alias("event_head"), F.lit("o").alias("own_hash"))
    rows = events.select("change_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("review_id"), F.lit("block").alias("verdict"), F.lit("h").alias("head"), F.lit("o").alias("own_hash"), F.lit("DISMISSED").alias("state"))
    marked = flow.marks(rows, events)
    assert marked.select(F.spark_partition_id().alias("task")).distinct().count() > 4
    assert marked.where("blocked = array(1, 2) and blocked_head and not carried").count() == 400


def test_pieces_are_looked_for_by_blocks(spark):
    """As by trying every piece, and with fewer looks at the text."""
    import random
    import time

    from sievewall.operators import containment

    rng = random.Random(11)
    pairs = [("".join(rng.choice("ab") for _ in range(rng.randrange(0, 14))), "".join(rng.choice("ab") for _ in range(rng.randrange(0, 30)))) for _ in range(400)]
    for piece in (1, 4, 5, 6):
        frame = spark.createDataFrame([(i, v, t) for i, (v, t) in enumerate(pairs)], "i int, v string, t string")
        found = [r.x for r in frame.withColumn("x", containment.holds_piece(F.col("v"), F.col("t"), piece)).orderBy("i").collect()]
        assert found == [any(v[i : i + piece] in t for i in range(len(v) - piece + 1)) for v, t in pairs]
    frame = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda i: F.md5(i.cast("string").cast("binary"))), "").alias("v"), F.repeat(F.lit("0123456789abcdef ghi "), 2000).alias("t"))
    seconds = []
    for test in (lambda v, t: F.size(F.filter(F.sequence(F.lit(1), F.lit(8000)), lambda i: F.contains(t, F.substring(v, i, F.lit(24))))), containment.holds_piece):
        began = time.time()
        frame.select(test(F.col("v"), F.col("t")).alias("x")).write.format("noop").mode("overwrite").save()
        seconds.append(time.time() - began)
    assert seconds[1] < 2.5 * seconds[0]
