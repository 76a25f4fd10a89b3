"""Positive cases and their clean twins, and properties that hold for any input."""

import sys

import pytest
from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.operators import findings as H, graphs as G, instances as I, inventory as V, logs as L, telemetry as T, text as X, trees as R, usage as U
from factloom.sources import files as FS


def rows(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=repr)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_names_differ_in_case_only(spark):
    df = spark.createDataFrame([(1, "Valve"), (2, "VALVE"), (3, "valve"), (4, " "), (5, None)], "n int, name string")
    assert rows(S.dedupe_names(df, "name", "n")) == [("valve", "Valve")]


@pytest.mark.parametrize(("name", "tokens"), [("MinLevelABCd2", ["min", "level", "ab", "cd", "2"]), ("ABC", ["abc"]), ("a_b-C", ["a", "b", "c"]), ("", [])])
def test_identifier_tokens(spark, name, tokens):
    assert one(spark, S.identifier_tokens(F.lit(name))) == tokens


@pytest.mark.parametrize(("a", "b", "conflict"), [("A.B", "a.b.c", True), ("a.b", "a.bc", False), ("a", "a", True)])
def test_path_conflicts(spark, a, b, conflict):
    assert one(spark, S.path_conflicts(F.lit(a), F.lit(b))) is conflict


@pytest.mark.parametrize(("value", "ms"), [("1.23456", 1.235), ("-3", 0.0), ("x", None), (None, None)])
def test_duration_ms(spark, value, ms):
    assert one(spark, S.duration_ms(F.lit(value).cast("string"))) == ms


@pytest.mark.parametrize(("values", "drifts"), [((("i1", "10"), ("i2", "15")), True), ((("i1", "10"), ("i2", "10")), False)])
def test_parameter_drift(spark, values, drifts):
    df = spark.createDataFrame([("T", "Timeout", i, v) for i, v in values], "moduletype string, parameter string, instance string, value string")
    assert (I.parameter_drift(df).count() > 0) is drifts


def test_an_unresolved_mapping_does_not_fall_back(spark):
    instances = spark.createDataFrame([("T", "a"), ("T", "b"), ("T", "c")], "moduletype string, instance string")
    mappings = spark.createDataFrame([("a", "P", None, "missing"), ("b", "P", "7", None)], "instance string, parameter string, literal string, source string")
    env = spark.createDataFrame([("known", "1")], "source string, init string")
    defaults = spark.createDataFrame([("T", "P", "5")], "moduletype string, parameter string, default string")
    assert rows(I.resolve_parameter_values(instances, mappings, env, defaults), "instance", "value", "status") == [("a", None, "unresolved_mapping"), ("b", "7", "resolved"), ("c", "5", "resolved")]


ACCESS = "var_key string, field string, module_path string, kind string, is_ui boolean, program string, seq int"


def accesses(spark, *xs):
    return spark.createDataFrame([(v, f, m, k, ui, "p", n) for n, (v, f, m, k, ui) in enumerate(xs)], ACCESS)


def test_usage_classes(spark):
    decls = spark.createDataFrame([(v, "local", False) for v in ("unused", "ui", "ro", "nr", "fine")], "var_key string, role string, is_const boolean")
    a = accesses(spark, ("ui", "", "m", "read", True), ("ro", "", "m", "read", False), ("nr", "", "m", "write", False), ("fine", "", "m", "write", False), ("fine", "", "m", "read", False))
    found = dict(rows(U.classify_usage(decls, a), "var_key", "issue"))
    assert found == {"unused": "unused", "ui": "ui_only", "ro": "read_only_non_const", "nr": "never_read", "fine": None}


def test_usage_does_not_depend_on_partitions(spark):
    decls = spark.createDataFrame([("a", "local", False)], "var_key string, role string, is_const boolean")
    a = accesses(spark, *[("a", "", f"m{i % 3}", "read" if i % 2 else "write", False) for i in range(20)])
    assert rows(U.usage_summary(decls, a)) == rows(U.usage_summary(decls, a.repartition(7)))


def test_records_with_cycles_end(spark):
    decls = spark.createDataFrame([("v", "node")], "var_key string, datatype string")
    fields = spark.createDataFrame([("node", "next", "node"), ("node", "value", "int")], "record_key string, field string, datatype string")
    assert rows(U.expand_leaf_fields(decls, fields)) == [("v", "next", "node"), ("v", "value", "int")]


def test_dead_overwrite_and_its_clean_twin(spark):
    bad = accesses(spark, ("x", "", "m", "write", False), ("x", "", "m", "write", False))
    good = accesses(spark, ("x", "", "m", "write", False), ("x", "", "m", "read", False), ("x", "", "m", "write", False))
    assert L.dead_overwrites(bad).count() == 1
    assert L.dead_overwrites(good).count() == 0


@pytest.mark.parametrize(("ops", "issues"), [(("acquire", "release"), []), (("release",), ["release_without_acquire"]), (("acquire", "acquire", "release"), ["double_acquire"]), (("acquire",), ["leak"])])
def test_resource_pairing(spark, ops, issues):
    df = spark.createDataFrame([("h", i, o) for i, o in enumerate(ops)], "handle string, seq int, op string")
    assert [r.issue for r in L.resource_pairing(df).collect()] == issues


GUARDED = "module_path string, var_key string, seq long, kind string, guard array<struct<block long, branch int>>"


@pytest.mark.parametrize(("log", "bad"), [
    ([(1, "write", [(1, 0)]), (2, "write", [(1, 1)]), (9, "read", [])], False),
    ([(1, "write", [(1, 0)]), (9, "read", None)], True),
    ([(1, "write", [(1, 0)]), (2, "read", [(1, 0)])], False),
    ([(1, "write", [(1, 0)]), (2, "read", [(1, 1)])], True),
    ([(1, "write", [(1, 0), (2, 0)]), (2, "write", [(1, 0), (2, 1)]), (3, "write", [(1, 1)]), (9, "read", [])], False),
    ([(1, "write", [(1, 0), (2, 0)]), (3, "write", [(1, 1)]), (9, "read", [])], True),
    ([(1, "write", [(1, 0), (2, 0)]), (2, "write", [(1, 0), (2, 1)]), (3, "read", [(1, 0)]), (4, "read", [(1, 1)])], True),
    ([(k, "write", [(1, 0), (2, 0), (3, k)]) for k in (0, 1)] + [(2, "write", [(1, 0), (2, 1)]), (3, "write", [(1, 1)]), (4, "read", [])], False),
    ([(1, "write", []), (5, "read", [(1, 0), (2, 1), (3, 1)])], False),
    ([(1, "read", []), (1, "write", [])], True),
])
def test_a_write_counts_if_all_branches_write(spark, log, bad):
    df = spark.createDataFrame([("m", "x", *r) for r in log], GUARDED)
    blocks = spark.createDataFrame([("m", b, 2) for b in (1, 2, 3)], "module_path string, block long, branches int")
    assert (L.read_before_write_branches(df, blocks).count() == 1) is bad
    three = spark.createDataFrame([("m", 1, 3)], "module_path string, block long, branches int")
    if bad:  # another branch makes nothing surer
        assert L.read_before_write_branches(df, three).count() == 1


def test_a_missing_enter_write_leaks_until_an_exit_clears(spark):
    schema = "step int, var_key string, phase string"
    contracts = spark.createDataFrame([(1, "x", "enter"), (2, "x", "enter"), (3, "x", "exit"), (4, "x", "enter")], schema)
    writes = spark.createDataFrame([(1, "x", "enter"), (3, "x", "exit")], schema)
    assert rows(L.step_contracts(contracts, writes), "step", "phase", "leaked") == [(2, "enter", True), (4, "enter", False)]


@pytest.mark.parametrize(("second", "conflict"), [((2, "b.c", "write"), True), ((1, "b.c", "write"), False), ((2, "d", "write"), False)])
def test_parallel_conflicts(spark, second, conflict):
    df = spark.createDataFrame([(1, 1, "A", "b", "write"), (1, second[0], "A", second[1], second[2])], "parallel_id int, branch int, var_key string, field string, kind string")
    assert (L.parallel_conflicts(df).count() > 0) is conflict


def edges(spark, *xs):
    return spark.createDataFrame(list(xs), "src int, dst int")


def test_closure_of_a_chain_a_diamond_and_a_cycle(spark):
    assert rows(G.closure(edges(spark, (1, 2), (2, 3), (3, 4)))) == [(1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 3, 1), (2, 4, 2), (3, 4, 1)]
    assert G.closure(edges(spark, (1, 2), (1, 3), (2, 4), (3, 4))).count() == 5
    assert rows(G.cycles(edges(spark, (1, 2), (2, 3), (3, 1), (3, 4), (5, 5)))) == [(1, 1), (2, 1), (3, 1), (5, 5)]


def test_the_closure_of_a_closed_graph_is_itself(spark):
    once = G.closure(edges(spark, (1, 2), (2, 3), (3, 4))).select("src", "dst")
    assert rows(G.closure(once).select("src", "dst")) == rows(once)


def test_empty_edges(spark):
    none = spark.createDataFrame([], "src int, dst int")
    assert G.closure(none).count() == G.cycles(none).count() == G.reverse_impact(none).count() == 0


FINDING = "rule_id string, path string, line int, symbol string, message string, severity string"


def test_findings_are_bags(spark):
    f = lambda n, severity="low": [("r", "p", 1, "s", "m", severity)] * n
    diff = lambda a, b: dict(rows(H.findings_diff(spark.createDataFrame(a, FINDING), spark.createDataFrame(b, FINDING)).groupBy("status").count()))
    assert diff(f(3), f(2)) == {"unchanged": 2, "resolved": 1}
    assert diff(f(2), f(2)) == {"unchanged": 2}
    assert diff(f(1), f(1, "high")) == {"unchanged": 1}
    moved = spark.createDataFrame([("r", "p", None, None, "other", "high")], FINDING)
    same = spark.createDataFrame([("r", "p", None, None, "m", "low")], FINDING)
    assert rows(H.findings_diff(same, moved), "status", "changed") == [("changed", "message,severity")]
    assert rows(H.findings_diff(same, same), "status", "changed") == [("unchanged", "")]


def test_icf_headers_carry_down(spark):
    lines = ["[Unit U1]", "[Operation O1]", "[Journal J1]", "[Group G1]", "k = 1", "; note = 2", "", "[Other]", "k = 3", "[Unit U2]", "k = 4"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    assert rows(V.icf_entries(df), "value", "unit", "operation", "journal", "grp") == [("1", "U1", "O1", "J1", "G1"), ("3", "U1", None, None, None), ("4", "U2", None, None, None)]


def test_leaks_are_found_and_placeholders_are_not(spark):
    text = "mail a.b@mail.example.org and c@d.example.org\npassword = 'example'\ntoken: \"abcdef123\"\n/home/someone/x localhost:8080\ntoken = unquoted1\nsecret='<mine>'\nC:\\Users\\MyUser\\a D:\\b"
    found = rows(X.leak_scan(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")), "line", "rule")
    assert found == [(1, "email"), (1, "email"), (3, "secret"), (4, "home_path"), (4, "local_endpoint"), (7, "windows_path")]


def test_lines_in_order(spark):
    import random

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    rng = random.Random(1)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 90))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))) for _ in range(20)]
    assert [X.lcs_length(list(a), list(b)) for a, b in pairs] == [longest(a, b) for a, b in pairs]
    old = spark.createDataFrame([("x", "a\nb\nc"), ("gone", "a"), ("null", None)], "name string, text string")
    new = spark.createDataFrame([("x", "b\na\nc\nc"), ("null", "q")], "name string, text string")
    assert rows(X.line_diff_counts(old, new)) == [("gone", 0, 0, 1), ("null", 0, 1, 0), ("x", 2, 2, 1)]


def test_nested_comments(spark):
    text = "a := 1;\n(* old: (* x *)\n y = f(2) *)\n(* plain words *)"
    found = rows(X.comments_with_code(spark.createDataFrame([(1, text), (2, None)], "id long, text string")), "start_line", "end_line")
    assert found == [(2, 3)]


def test_retries(spark):
    schema = "session int, seq int, type string, tool string, success boolean"
    bad = spark.createDataFrame([(1, 1, "tool.complete", "a", False), (1, 2, "tool.start", "a", True)], schema)
    good = spark.createDataFrame([(1, 1, "tool.complete", "a", False), (1, 2, "tool.start", "b", True), (1, 3, "tool.start", "a", True)], schema)
    assert rows(T.same_tool_retries(bad), "retries") == [(1,)]
    assert rows(T.same_tool_retries(good), "retries") == [(0,)]


def test_json_lines(spark):
    df = spark.createDataFrame([("f", '{"k": 1}\n\nnot json\n[1]')], "file string, text string")
    assert rows(FS.read_jsonl(df, "k int").select("line_no", "bad", "row.k")) == [(1, None, 1), (3, "not json", None), (4, "[1]", None)]


def test_sources_are_discovered(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "lib" / "Main.s").write_bytes("grüß".encode())
    (tmp_path / "lib" / "Main.l").write_bytes("Dep\n\n other \n".encode())
    (tmp_path / "lib" / "old.x").write_bytes("grüß".encode("cp1252"))
    (tmp_path / ".git" / "no.s").write_text("x")
    found = FS.decode_text(FS.discover_sources(spark, str(tmp_path)))
    assert rows(found, "stem", "kind", "text") == [("main", "dependencies", "Dep\n\n other \n"), ("main", "program", "grüß"), ("old", "program", "grüß")]
    assert rows(FS.dependency_edges(found.where("kind = 'dependencies'"))) == [("main", "dep"), ("main", "other")]


def test_bytes_are_decoded_in_the_jvm_as_python_decodes_them(spark):
    def wanted(b):
        for name in ("utf-8", "cp1252", "latin-1"):
            try:
                return b.decode(name)
            except UnicodeDecodeError:
                pass

    cases = [bytes([b]) for b in range(256)] + [bytes([b, 0xE9]) for b in range(128, 256)] + [b"", "\ufeffgr\u00fc\u00df \U0001f600".encode(), b"\xc0\xaf", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xe2\x82", b"a\x00b\r\n", b"\x80\x81", "\u20ac \u201eq\u201c \u0178".encode("cp1252"), b"\xf8\x88\x80\x80\x80"]
    df = FS.decode_text(spark.createDataFrame([*enumerate(map(bytearray, cases)), (-1, None)], "n int, content binary"))
    assert dict(df.select("n", "text").collect()) == {-1: None, **{i: wanted(b) for i, b in enumerate(cases)}}
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_entry_works_without_the_llm_folders(monkeypatch):
    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("factloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "factloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert "c3_classify_usage" in entry.queries()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_field_overwrites_and_their_clean_twins(spark):
    s = "module_path string, var_key string, field string, seq long, kind string"
    rows = [("m", "a", "x", 1, "write"), ("m", "a", "", 2, "write"), ("m", "b", "x", 1, "write"), ("m", "b", "y", 2, "read"), ("m", "b", "x", 3, "write"), ("m", "c", "x", 1, "write"), ("m", "c", "", 2, "read"), ("m", "c", "x", 3, "write"), ("m", "d", "", 1, "write"), ("m", "d", "x", 2, "write")]
    found = {(r.var_key, r.field, r.seq, r.next_seq) for r in L.dead_overwrites(spark.createDataFrame(rows, s)).collect()}
    assert found == {("a", "x", 1, 2), ("b", "x", 1, 3)}


def test_constant_guards_and_tautologies(spark):
    guards = spark.createDataFrame([(1, 0, 1, None, "=", "TRUE"), (1, 0, 2, "k", "=", "1"), (1, 0, 3, "k", "<>", "1"), (1, 0, 4, "free", "=", "1"), (1, 0, 5, "k", "=", "1"), (1, 0, 5, "free", "=", "1")], "sequence long, branch long, node long, key string, op string, value string")
    known = spark.createDataFrame([("k", "1")], "key string, value string")
    assert {(r.node, r.value) for r in L.constant_guards(guards, known).collect()} == {(1, True), (2, True), (3, False)}
    facts = spark.createDataFrame([(1, "a", "=", "1"), (1, "a", "<>", "1"), (2, "a", "=", "A"), (3, "a", "=", "1"), (3, "a", "<>", "2")], "condition long, key string, op string, value string")
    assert {tuple(r) for r in L.tautologies(facts).collect()} == {(1, "a", "tautology"), (2, "a", "self_compare")}


def test_names_that_say_another_role(spark):
    s = "var_key string, name string, read boolean, written boolean, ui_read boolean, non_ui_read boolean"
    use = spark.createDataFrame([("a", "OpenCmd", True, True, False, True), ("b", "ShutCmd", True, True, False, True), ("c", "PumpStatus", False, True, False, False), ("d", "ValveStatus", False, True, False, False), ("e", "HighAlarm", True, False, False, True), ("f", "LowAlarm", True, False, True, False), ("g", "Level", True, True, True, True)], s)
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "var_key string")
    found = {(r.var_key, r.issue) for r in U.naming_role_mismatch(use, keys("b"), keys("d")).collect()}
    assert found == {("a", "command_as_internal_state"), ("c", "status_written"), ("e", "alarm_as_control_input")}


def test_chains_go_to_their_ends(spark):
    flows = [("m", i, f"v{i}", f"v{i - 1}") for i in range(1, 40)] + [("n", 1, "a", "b")]
    found = {r.chain for r in L.dependency_chains(spark.createDataFrame(flows, "module_path string, seq long, target string, source string")).collect()}
    assert found == {"<-".join(f"v{j}" for j in range(i, -1, -1)) for i in range(2, 40)}


def test_a_variable_is_told_the_first_class_that_fits(spark):
    decls = spark.createDataFrame([(v, r, False) for v, r in (("par", "parameter"), ("ui", "local"), ("idle", "local"), ("bound", "local"), ("status", "local"), ("spared", "local"))], "var_key string, role string, is_const boolean")
    a = accesses(spark, ("par", "", "m", "write", False), ("ui", "", "m", "read", True), ("ui", "", "m", "write", False), ("idle", "", "m", "read", False), ("idle", "", "m", "write", False), ("bound", "", "m", "read", False), ("bound", "", "m", "write", False), ("status", "", "m", "write", False), ("status", "", "m", "read", True), ("spared", "", "m", "write", False))
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "var_key string")
    found = dict(rows(U.classify_usage(decls, a, keys("none"), keys("bound", "status"), keys("spared")), "var_key", "issue"))
    assert found == {"par": None, "ui": "ui_only", "idle": "write_without_effect", "bound": None, "status": "procedure_status", "spared": None}


@pytest.mark.parametrize(("text", "like"), [("a := 1;", True), ("x < y", True), ("IF x THEN;", True), ("if only, then", False), ("f(2)", True), ("plain words", False), ("a == b", False), ("note; see there", False)])
def test_what_looks_like_code(spark, text, like):
    assert one(spark, S.code_hints(F.lit(text))["like_code"]) is like


@pytest.mark.parametrize(("prompt", "bucket"), [("review how we implement the new plan", "review"), ("Implement this PLAN", "implement-this-plan"), ("revalidate", "validate"), (None, "other")])
def test_prompt_buckets(spark, prompt, bucket):
    assert one(spark, S.prompt_bucket(F.lit(prompt).cast("string"))) == bucket


@pytest.mark.parametrize(("value", "ref"), [("F::P:a.b", ("P", "a.b")), ("P:a.b", ("P", "a.b")), (" P : a ", ("P", "a")), ("plain", None), ("F::P:", ("F", ":P:"))])
def test_interface_references(spark, value, ref):
    found = one(spark, S.icf_ref(F.lit(value)))
    assert (found and tuple(found)) == ref


def test_limits_are_crossed_by_min_and_max_alone(spark):
    df = spark.createDataFrame([(1, "MinLevel", "maxLevel"), (2, "LowLevel", "HighLevel"), (3, "MinMax", "max")], "id int, source string, target string")
    assert rows(U.min_max_crossed(df)) == [(1,)]


def test_faults_that_nobody_clears_or_reads(spark):
    s = "module_path string, var_key string, name string, is_boolean boolean, kind string, value boolean"
    df = spark.createDataFrame([("m", "a", "Fault1", True, "write", True), ("m", "b", "OldAlarm", True, "write", True), ("m", "b", "OldAlarm", True, "write", False), ("m", "b", "OldAlarm", True, "read", None), ("n", "b", "OldAlarm", True, "write", True), ("n", "b", "OldAlarm", True, "read", None), ("m", "c", "Level", True, "write", True), ("m", "d", "FaultNo", False, "write", True), ("m", "e", "Fault2", True, "write", None)], s)
    assert rows(L.fault_handling(df)) == [("m", "a", "missing_recovery"), ("m", "a", "unhandled_fault"), ("n", "b", "missing_recovery")]


def test_calls_without_a_signature_are_no_findings(spark):
    calls = spark.createDataFrame([(1, "Open"), (2, "SAFE"), (3, "unknown")], "site int, function string")
    assert rows(L.unsafe_scan_calls(calls, spark.createDataFrame([("open", False), ("safe", True)], "function string, safe boolean"))) == [(1, "Open")]


def test_accuracy_without_annotations(spark):
    f = spark.createDataFrame([("a", "r", "low"), ("b", "r", "high"), ("c", "r", None), ("d", None, "critical"), ("e", "r", "low")], "fingerprint string, rule_id string, severity string")
    notes = spark.createDataFrame([("e", "false_positive", "s")], "fingerprint string, annotation string, rule_id string")
    assert rows(H.accuracy(f, notes), "rule_id", "correct", "false_positive", "missed_issue", "precision") == [("r", 2, 0, 1, 0.6667), ("s", 0, 1, 0, 0.0), ("unknown", 0, 0, 1, 0.0), (None, 2, 1, 2, 0.4)]


def test_grounding_asks_for_any_match_without_regard_to_case(spark):
    df = spark.createDataFrame([(1, ["A", "b", "c"], ["a"]), (2, ["x"], ["y"]), (3, [], ["y"]), (4, None, None)], "session int, candidates array<string>, referenced array<string>")
    assert rows(T.grounding_overlap(df), "session", "overlap", "status") == [(1, 1, "ok"), (2, 0, "ungrounded"), (3, 0, "no-results"), (4, 0, "no-results")]


def test_layout_of_texts(spark):
    assert one(spark, S.normalize_layout(F.lit("\n\n\na \r\n\r\n\r\n\tb\u00a0\n \n"))) == "\na\n\n\tb\n"
    assert one(spark, S.normalize_layout(F.lit(""))) == "\n"


def test_edges_count_once_however_many_paths_lead_to_them(spark):
    df = spark.createDataFrame([(1, 2, ["a"], 1), (1, 3, ["b"], 10), (2, 4, ["a"], 100), (3, 4, ["c"], 1000), (5, 1, ["d"], 10000), (4, 4, ["z"], 7)], "src int, dst int, symbols array<string>, reads long")
    found = {r.node: r for r in G.reverse_impact(df, list_fields=("symbols",), count_fields=("reads",)).collect()}
    assert (found[4].direct, found[4].transitive, found[4].direct_reads, found[4].transitive_reads) == (2, 4, 1100, 11111)
    assert (found[4].direct_symbols, found[4].transitive_symbols, found[4].transitive_symbols_count) == (["a", "c"], ["a", "b", "c", "d"], 4)
    assert (found[5].direct, found[5].transitive, found[5].transitive_reads, found[5].direct_symbols) == (0, 0, 0, [])
    asked = spark.createDataFrame([(4,), (5,)], "node int")
    assert rows(G.reverse_impact(df, asked), "node", "direct", "transitive") == [(4, 2, 4), (5, 0, 0)]


def test_a_thousand_steps_take_ten_rounds(spark, monkeypatch):
    made = []
    inner = G.stored
    monkeypatch.setattr(G, "stored", lambda df, name: made.append(name) or inner(df, name))
    chain = spark.range(1000).selectExpr("cast(id as int) as src", "cast(id + 1 as int) as dst")
    c = G.closure(chain)
    assert c.count() == 1000 * 1001 // 2 and c.where("depth <> dst - src").count() == 0
    assert made.count("closure") <= 11


def test_closures_from_some_sources_and_orders_of_loading(spark):
    e = edges(spark, (1, 2), (2, 3), (3, 1), (4, 5), (3, 4))
    assert rows(G.closure(e, spark.createDataFrame([(4,), (3,)], "src int"))) == [(3, 1, 1), (3, 2, 2), (3, 3, 3), (3, 4, 1), (3, 5, 2), (4, 5, 1)]
    assert rows(G.load_order(edges(spark, (1, 2), (2, 3), (1, 3), (9, 3)))) == [(1, 2), (2, 1), (3, 0), (9, 1)]
    with pytest.raises(RuntimeError, match="cycle"):
        G.load_order(e)
    assert rows(G.cycles(e)) == [(1, 1), (2, 1), (3, 1)]


def test_taint_goes_the_shortest_way_and_of_equals_the_first_by_name(spark):
    names = [(1, "Area.Sensor1"), (2, "b.x"), (3, "A.y"), (4, "Unit.Trip"), (5, "TypeDef:T.Sensor"), (6, "Unit.Sensor2"), (7, "c"), (8, "EStop.Q"), (9, "lone.Sensor")]
    e = edges(spark, (1, 2), (1, 3), (2, 4), (3, 4), (4, 7), (7, 4), (4, 8), (5, 6), (6, 4), (3, 3))
    uses = spark.createDataFrame([(1, "m"), (3, "m"), (4, "n")], "node int, module string")
    found = rows(G.taint_traces(e, spark.createDataFrame(names, "node int, name string"), uses), "source", "sink", "depth", "path", "multi_module")
    # 6 is fed, though by a type definition alone
    assert found == [(1, 4, 2, "Area.Sensor1>A.y>Unit.Trip", True), (1, 8, 3, "Area.Sensor1>A.y>Unit.Trip>EStop.Q", True)]


def test_variants_of_modules(spark):
    m = lambda *xs: spark.createDataFrame([("p", path, kind) for path, kind in xs], "program string, path string, kind string")
    items = spark.createDataFrame([("p", "r.a.pump", "parameters", "Size", "1"), ("p", "r.b.pump", "parameters", "size", "1"), ("p", "r.c.pump", "parameters", "size", "2")], "program string, path string, section string, item string, value string")
    tree = [("R", "single"), ("R.A", "single"), ("R.b", "single"), ("r.c", "single"), ("R.A.Pump", "single"), ("R.b.PUMP", "single"), ("r.c.pump", "single"), ("R.A.Pump.v", "frame"), ("R.b.Pump.V", "frame"), ("R.A.Pump.v.w", "single"), ("R.b.pump.v.w", "single")]
    found = R.version_drift(m(*tree, ("R.c.pump.v", "frame"), ("R.c.pump.v.other", "single")), items)
    assert rows(found) == [("p", "pump", 2, 3, "r")]
    diff = R.variant_diff(m(*tree, ("R.c.pump.v", "frame"), ("R.c.pump.v.other", "single")), items)
    assert rows(diff, "section", "item", "change", "variant", "value") == [("parameters", "size", "modified", 1, "1"), ("parameters", "size", "modified", 2, "2"), ("submodules", "v.other", "only", 2, "single"), ("submodules", "v.w", "only", 1, "single")]
    same = spark.createDataFrame([("p", f"r.{x}.pump", "parameters", "Size", "1") for x in "abc"], items.schema)
    assert rows(R.version_drift(m(*tree, ("R.c.pump.v", "frame"), ("R.c.pump.v.w", "single")), same)) == []
    assert rows(R.version_drift(m(), same)) == [] and rows(R.variant_diff(m(), same)) == []


def test_markers_lift_through_wrappers(spark):
    m = [("P", None), ("P.unit", "Unit"), ("P.unit.tank", None), ("P.unit.tank.L1", None), ("P.unit.tank.L1.Display", None), ("P.unit.tank.L1.Display.Panel", None), ("P.unit.tank.L1.Display.Panel.mark", "Marker"), ("P.unit.Oprframe", None), ("P.unit.Oprframe.fill", None), ("P.L7", None), ("P.L7.mark", "Marker")]
    df = spark.createDataFrame([("p", path, t, t and f"lib:{t}") for path, t in m], "program string, path string, moduletype string, label string")
    rules = spark.createDataFrame([("em", "desc_label", "marker")], "category string, match string, pattern string")
    found = rows(R.classify_modules(df, rules), "path", "category")
    assert found == [("p.l7", "em"), ("p.unit.oprframe.fill", "ops"), ("p.unit.tank", "em")]
    none = spark.createDataFrame([], "program string, path string, parameter string")
    assert rows(R.unit_roots(df, R.classify_modules(df, rules), none), "path") == [("p.unit",)]


def test_a_variable_with_many_users_needs_no_pairs(spark):
    n = 100_000
    log = spark.range(n).selectExpr("'p' as program", "'V' as var_key", "'' as field", "concat('m', id) as module_path", "if(id = 0, 'write', 'read') as kind", "concat('s', id) as site")
    assert L.shared_access_hazards(log).agg(F.count("*"), F.max("users")).first()[:] == (n, n)


def test_shared_accesses_with_kinds_and_sites(spark):
    s = "program string, var_key string, field string, module_path string, kind string, site string"
    log = [("p", "V", "a", "m", "write", "1"), ("p", "v", "A.x", "n", "write", "2"), ("p", "v", "a", "m", "read", "3"), ("p", "v", "b", "m", "read", "4"), ("p", "v", "b", "n", "read", "5"), ("p", "w", "", "m", "write", "6"), ("p", "w", "", "m", "read", "7"), ("q", "v", "a", "z", "write", "8")]
    found = rows(L.shared_access_hazards(spark.createDataFrame(log, s)), "path", "users", "user", "kinds", "sites")
    assert found == [("v.a", 2, "m", "read,write", "1,3"), ("v.a", 2, "n", "write", "2")]


def test_anytype_parameters_need_the_fields_that_are_used(spark):
    need = U.anytype_requirements(spark.createDataFrame([("inner", "P", "speed")], "owner string, parameter string, field string"), spark.createDataFrame([("outer", "Q", "motor", "Inner", "p"), ("outer", "q", "", "outer", "Q")], "owner string, parameter string, prefix string, child_owner string, child_parameter string"))
    assert rows(need) == [("inner", "p", "speed"), ("outer", "q", "motor.speed")]
    fields = spark.createDataFrame([("pump", "motor", "drive"), ("drive", "speed", "real"), ("tank", "motor", "real")], "record_key string, field string, datatype string")
    maps = [(1, "Outer", "q", "AnyType", "Pump", ""), (2, "outer", "Q", "anytype", "tank", ""), (3, "inner", "p", "anytype", "pump", "motor"), (4, "inner", "p", "anytype", "pump", ""), (5, "inner", "p", "real", "pump", "")]
    df = spark.createDataFrame(maps, "id int, owner string, target string, target_type string, source_type string, source_field string")
    assert rows(U.contract_mismatch(df, need, fields), "id", "field") == [(2, "motor.speed"), (4, "speed"), (5, None)]


def test_graphics_rules_meet_entries_by_equal_keys(spark):
    e = spark.createDataFrame([(1, "module", "U.a", None, "a.b", None, "Valve"), (2, "moduletype-instance", "u.A", None, "a.c", "Pump", "P1"), (3, "basepicture", "u.a", None, "", None, "Valve")], "item int, module_kind string, unit_structure_path string, equipment_module_structure_path string, relative_module_path string, moduletype_name string, module_name string")
    v = spark.createDataFrame([(1, "f", "x"), (2, "f", "y")], "item int, field string, actual string")
    r = spark.createDataFrame([("r1", "any", "u.a", None, None, None, None), ("r2", "moduletype", None, None, None, "PUMP", None), ("r3", "single", None, None, None, None, "valve"), ("r4", "frame", None, None, None, None, "valve")], "rule string, module_kind string, unit_structure_path string, equipment_module_structure_path string, relative_module_path string, moduletype_name string, module_name string")
    x = spark.createDataFrame([("r1", "f", "x"), ("r2", "g", "z"), ("r3", "f", "x"), ("r4", "f", "q")], "rule string, field string, expected string")
    found = I.graphics_rules_check(e, v, r, x)
    assert rows(found) == [(2, "any:unit:u.a", "f", "x", "y"), (2, "moduletype:PUMP@", "g", "z", None)]
    assert rows(I.unmatched_rules(e, r)) == [("frame:valve",)]
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("batches", [1, 3])
def test_retries_do_not_depend_on_batches(spark, tmp_path, batches):
    import datetime
    import random

    from factloom.streaming import rollups

    at = datetime.datetime(2024, 1, 1)
    rng = random.Random(5)
    log = [(at + datetime.timedelta(seconds=7 * i), i % 3, i, rng.choice(["tool.start", "tool.complete"]), rng.choice("ab"), rng.random() < 0.3) for i in range(300)]
    end = (at + datetime.timedelta(hours=2), 0, 999, "tool.start", "z", True)
    wanted = {}
    for k in range(3):
        failed, n = None, 0
        for _, _, _, kind, tool, ok in (r for r in log if r[1] == k):
            if kind == "tool.complete" and not ok:
                failed = tool
            elif kind == "tool.start":
                n += failed == tool
                failed = None
        wanted[k] = n
    s = "ts timestamp, session long, seq long, type string, tool string, success boolean"
    rows_ = log[:]
    rng.shuffle(rows_)  # all within the hour that may be late
    for b in range(batches):
        spark.createDataFrame(rows_[b::batches] + ([end] if b == batches - 1 else []), s).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = rollups.drained(rollups.tool_retries(stream, "1 hour"), "retries", rollups.ROCKSDB)
    assert dict(rows(found.groupBy("session").agg(F.sum("retries")))) == wanted


def test_headers_of_interface_files(spark):
    lines = ["[Unit U]", "[Group]", "[open = 1", " = 2 ", "[Group g h ]", "a[0] = b = c", "[Other x]", "k="]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    assert rows(V.icf_entries(df), "unit", "grp", "key", "value") == [("U", "g h", "a[0]", "b = c"), ("U", None, "", "2"), ("U", None, "[open", "1"), ("U", None, "k", "")]


def test_names_in_another_style(spark):
    df = spark.createDataFrame([("v", "PumpOne", 1), ("v", "pumpone", 2), ("v", "TankTwo", 3), ("v", "snake_name", 4), ("v", "_odd", 5), ("v", "allowed_one", 6)], "kind string, name string, n int")
    ok = spark.createDataFrame([("v", "Allowed_One")], "kind string, name string")
    assert rows(I.naming_consistency(df, ok), "name", "style", "dominant") == [("_odd", "unknown", "pascal"), ("pumpone", "lower", "pascal"), ("snake_name", "snake", "pascal")]


def test_known_layers_are_part_of_the_key(spark):
    p = spark.range(400).selectExpr("'c' as container", "id as item", "case when id = 7 then null when id < 9 then 'same' else 'l' || id end as layer", "0d as x0", "0d as y0", "1d + id % 3 as x1", "1d as y1")
    found = I.layout_overlaps(p)
    assert "layer" in found._jdf.queryExecution().sparkPlan().toString().split("Join [")[1].split("]")[0]  # no pairs of all layers
    want = {(min(a, 7), max(a, 7)) for a in range(400) if a != 7} | {(a, b) for a in range(9) for b in range(a + 1, 9)}
    assert rows(found, "item", "other") == sorted(want, key=repr)
    unlike = [("c", 1, None, 0.0, 0.0, 0.1, 500.0), ("c", 2, "a", -5.0, 99.0, 5.0, 99.5), ("c", 3, None, 0.05, 400.0, 3.0, 401.0), ("d", 4, "a", 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(unlike, "container string, item int, layer string, x0 double, y0 double, x1 double, y1 double")
    assert rows(I.layout_overlaps(df)) == [("c", 1, 2), ("c", 1, 3)]
    assert rows(I.layout_overlaps(df.limit(0))) == []


def test_a_scope_above_is_met_once_however_many_locals_it_has(spark):
    df = spark.range(900).selectExpr("'X' as name", "case id % 3 when 0 then 'r' when 1 then 'r.s' else 'r.s.t' end as path", "id")
    found = U.shadowing(df)
    assert "min(id" in found._jdf.queryExecution().optimizedPlan().toString()  # before the join
    assert rows(found) == sorted(((i, i % 3 - 1) for i in range(900) if i % 3), key=repr)


def test_limits_by_other_words(spark):
    df = spark.createDataFrame([(1, "Level_MAX", "Low"), (2, "HighLevel", "min"), (3, "Low", "Low"), (4, "Level_MAX", "Level")], "id int, source string, target string")
    assert rows(U.min_max_crossed(df, ("min", "low"), ("max", "high"))) == [(1,), (2,)]


def test_a_session_has_one_timer_however_many_events_wait():
    import pandas as pd
    from types import SimpleNamespace as N

    from factloom.streaming.rollups import _Retries

    timers, waiting, failed = [], [], []
    r = _Retries(10**9)
    r.handle = N(registerTimer=timers.append)
    r.waiting = N(appendValue=waiting.append, get=lambda: iter(waiting), clear=waiting.clear)
    r.failed = N(exists=lambda: bool(failed), get=lambda: failed[0], clear=failed.clear, update=lambda x: failed.__setitem__(slice(None), [x]))
    n = 500
    df = pd.DataFrame({"ts": pd.to_datetime(range(n), unit="s"), "seq": range(n), "type": ["tool.complete", "tool.start"] * (n // 2), "tool": "a", "success": [False, True] * (n // 2)})
    list(r.handleInputRows((7,), iter([df.iloc[n // 2 :], df.iloc[: n // 2]]), None))
    assert timers == [1]
    at = lambda ms: list(r.handleExpiredTimer((7,), N(getCurrentWatermarkInMs=lambda: ms), None))
    assert at(1)[0:] == [] and timers[1] == 1001  # the failure of 0 s; 1 s is next
    assert at(1)[0:] == [] and failed  # a timer that has nothing to do forgets nothing
    assert at(n * 1000)[0]["retries"].tolist() == [n // 2] and not waiting


@pytest.fixture
def tables(monkeypatch):
    """The tables that operators write, by name, with their numbers of rows."""
    seen = []
    for module in (L, U):
        real = module.stored
        monkeypatch.setattr(module, "stored", lambda df, name, real=real: (lambda out: seen.append((name, out.count())) or out)(real(df, name)))
    return seen


def test_what_follows_a_straight_write_is_left_out(spark, tables):
    guard = "array<struct<block:int,branch:int>>"
    log = spark.range(400).selectExpr("'m' as module_path", "'v' as var_key", "id as seq", "case when id % 2 = 0 then 'read' else 'write' end as kind", f"case when id = 3 then cast(array() as {guard}) else array(struct(cast(id div 4 as int) as block, cast(id % 2 as int) as branch)) end as guard")
    blocks = spark.range(100).selectExpr("'m' as module_path", "cast(id as int) as block", "2 as branches")
    assert rows(L.read_before_write_branches(log, blocks)) == [("m", "v")]
    assert dict(tables)["branches"] == 3


def test_chains_that_have_ended_are_written_once(spark, tables):
    flows = [("m", 100 + i, f"x{i}", f"y{i}") for i in range(50)] + [("m", i, f"v{i}", f"v{i - 1}") for i in range(1, 5)]
    df = spark.createDataFrame(flows, "module_path string, seq long, target string, source string")
    assert len(rows(L.dependency_chains(df))) == 3
    assert [n for name, n in tables if name == "chains"] == [54, 3, 2]


def test_levels_of_aliases_are_tables(spark, tables):
    a = spark.createDataFrame([("c", "f", "m", "read", False)], "var_key string, field string, module_path string, kind string, is_ui boolean")
    links = spark.createDataFrame([("p", "c", "s", 1), ("q", "p", "", 2)], "parent_key string, child_key string, prefix string, level int")
    assert rows(U.propagate_aliases(a, links), "var_key", "field") == [("c", "f"), ("p", "s.f"), ("q", "s.f")]
    assert [n for name, n in tables if name == "aliases"] == [1, 1, 1]


def test_users_of_paths_are_made_once(spark, tables):
    log = spark.range(40).selectExpr("'p' as program", "'v' as var_key", "'' as field", "'m' || id % 4 as module_path", "case when id % 2 = 0 then 'read' else 'write' end as kind", "'s' as site")
    found = L.shared_access_hazards(log)
    assert len(rows(found)) == 4 and tables == [("users", 4)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 0  # accesses are not read again


def test_each_case_of_a_mapping_is_looked_up_once(spark, tables):
    m = spark.range(300).selectExpr("id", "'rec' as source_type", "'AnyType' as target_type", "'o' as owner", "'P' as target", "case when id = 0 then null else '' end as source_field")
    need = spark.createDataFrame([("O", "p", "a"), ("O", "p", "b")], "owner string, parameter string, field string")
    fields = spark.createDataFrame([("Rec", "A", "int")], "record_key string, field string, datatype string")
    found = rows(U.contract_mismatch(m, need, fields), "id", "field")
    assert found == sorted(((i, "b") for i in range(300)), key=repr)
    assert max(n for name, n in tables if name == "asked") <= 4


def test_rounds_over_a_graph_send_no_broadcasts_to_the_driver(spark):
    e = edges(spark, *[(i, i + 1) for i in range(6)]).localCheckpoint()
    with_names = spark.createDataFrame([(i, f"n{i}") for i in range(7)], "node int, name string").withColumn("name", F.when(F.col("node") == 0, "a.Sensor").when(F.col("node") == 6, "b.Trip").otherwise(F.col("name")))
    plans = []
    stored = G.stored
    G.stored = lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, name)
    try:
        traces = G.taint_traces(e, with_names, spark.createDataFrame([(0, "m")], "node int, module string"))
        G.closure(e).count()
    finally:
        G.stored = stored
    plans.append(traces._jdf.queryExecution().executedPlan().toString())
    assert rows(traces, "source", "sink", "depth") == [(0, 6, 6)]
    assert len(plans) > 20 and not [p for p in plans if "Broadcast" in p]


def test_overlaps_and_frames_send_no_broadcasts_to_the_driver(spark, sf_dir, monkeypatch):
    from factloom.jobs.instance_queries import Q

    plans, stored = [], R.stored
    monkeypatch.setattr(R, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, name))
    for query in ("d14_nested_overlaps", "d14_layout_overlaps"):
        plans.append(Q[query](spark, sf_dir)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) >= 6 and not [p for p in plans if "Broadcast" in p]


def test_aliases_are_joined_once_and_counted_in_slices(spark, tables):
    a = spark.createDataFrame([("v0", f, m, "read", False) for f in ("f", "g") for m in ("m", "n")] + [("v3", "f", "m", "read", False)], "var_key string, field string, module_path string, kind string, is_ui boolean")
    links = spark.createDataFrame([(f"v{i + 1}", f"v{i}", "", i) for i in range(6)], "parent_key string, child_key string, prefix string, level int")
    found = U.propagate_aliases(a, links)
    assert [n for name, n in tables if name == "waiting"] == [4, 4, 4, 4, 4]  # v3's own access waited for its level from the first
    counts = U.distinct_counts(found, "var_key", "field", "kind", slice_rows=5)
    assert len([n for name, n in tables if name == "counts"]) == 6 and rows(counts) == rows(found.distinct().groupBy("var_key", "field", "kind").agg(F.count("*").alias("n")))
    assert rows(counts, "n") == [(2,)] * 14
    assert rows(U.propagate_aliases(a, links.limit(0))) == rows(a)
