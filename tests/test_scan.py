"""Scan semantics on hand-made files."""

from pyspark.sql import functions as F

from siftmill.functions import text as X
from siftmill.operators import code, html, rulescan, scan
from siftmill.sources import corpus, rules as R, sinks
from siftmill.sources.rules import Guard, Rule

FILES = "project string, path string, ext string, lang string, content string"


def files(spark, *rows):
    return spark.createDataFrame([("p", path, ".php", "php", content) for path, content in rows], FILES)


def lines_of(df):
    return sorted((r.path, r.line_no) for r in df.collect())


def test_suppression_forms(spark):
    text = "\n".join(
        ["x bad", "x bad # nosec", "x bad # nosec: r1", "x bad # nosec: r2", "x bad # nosec : r1", "x bad # nosecfoo", "x bad @scan-ignore r1", "x bad @scan-ignore all", "x bad @scan-ignore r2"]
    )
    # File-level tags count in the first ten lines only, so the text starts after them.
    body = "\n".join(["ok"] * 10 + [text])
    hits = scan.scan_presence(files(spark, ("a.php", body)), [Rule("r1", "bad")])
    assert [n - 10 for _, n in lines_of(hits)] == [1, 4, 6, 9]


def test_file_level_ignore_stops_at_line_ten(spark):
    early = "\n".join(["@scan-ignore r1"] + ["bad"] * 3)
    late = "\n".join(["ok"] * 10 + ["@scan-ignore r1", "bad"])
    hits = scan.scan_presence(files(spark, ("early.php", early), ("late.php", late)), [Rule("r1", "bad")])
    assert lines_of(hits) == [("late.php", 12)]


def test_guard_window_and_caps(spark):
    text = "guard\na\nb\nbad\nbad\nbad"
    one = scan.scan_presence(files(spark, ("a.php", text)), [Rule("r", "bad", context_guard=Guard("guard", 3, 0))])
    assert lines_of(one) == [("a.php", 5), ("a.php", 6)]
    capped = scan.scan_presence(files(spark, ("a.php", text)), [Rule("r", "bad", max_per_file=2), Rule("s", "bad", dedup="per_file")])
    assert sorted((r.rule_id, r.line_no) for r in capped.collect()) == [("r", 4), ("r", 5), ("s", 4)]


def test_look_around_patterns(spark):
    text = "echo $a\necho esc($a)\nprint $a"
    hits = scan.scan_presence(files(spark, ("a.php", text)), [Rule("r", r"echo(?!\s+esc)"), Rule("s", r"(?<=print )\$")])
    assert sorted((r.rule_id, r.line_no) for r in hits.collect()) == [("r", 1), ("s", 3)]


def test_line_splitting(spark):
    rows = corpus.explode_lines(files(spark, ("a.php", "x\r\ny\n"), ("b.php", ""))).collect()
    assert sorted((r.path, r.line_no, r.line) for r in rows) == [("a.php", 1, "x"), ("a.php", 2, "y"), ("b.php", 1, "")]


def test_byte_order_mark(spark):
    raw = spark.createDataFrame([(bytearray(b"\xef\xbb\xbfx"),), (bytearray(b"x\xef\xbb\xbf"),)], "raw binary")
    assert [r[0] for r in raw.select(scan.starts_with_bom(F.col("raw"))).collect()] == [True, False]


def test_scopes(spark):
    paths = spark.createDataFrame([("inc/a.php",), ("a.php",), ("inc/x/b.php",), ("inc/a.js",)], "path string")

    def hits(scope, exclude=None):
        return sorted(r.path for r in paths.filter(R.in_scope(F.col("path"), Rule("r", "x", scope=scope, exclude=exclude))).collect())

    assert hits("**/*.php") == ["a.php", "inc/a.php", "inc/x/b.php"]
    assert hits("inc/*.php") == ["inc/a.php"]
    assert hits("inc") == ["inc/a.js", "inc/a.php", "inc/x/b.php"]
    assert hits("**/*.php", "x/*") == ["a.php", "inc/a.php"]


def test_dismissal_scopes(spark):
    hits = spark.createDataFrame([("r", "p1", "a"), ("r", "p2", "a"), ("s", "p1", "b"), ("t", "p1", "c")], "rule_id string, project string, path string")
    dis = spark.createDataFrame(
        [("r", "project", "p1", None, True), ("s", "file", None, "b", True), ("t", "global", None, None, False)], "rule_id string, scope string, project string, path string, active boolean"
    )
    assert sorted((r.rule_id, r.project, r.path) for r in scan.drop_dismissed(hits, dis).collect()) == [("r", "p2", "a"), ("t", "p1", "c")]


def test_rules_roundtrip(spark, tmp_path):
    rows = [{"rule_id": "a", "pattern": "x", "type": "cross_check", "context_guard": {"pattern": "g", "lines_before": None}}, {"rule_id": "b", "type": "manual", "pattern": "y"}, {"rule_id": "c"}]
    path = tmp_path / "rules.json"
    import json

    path.write_text("\n".join(json.dumps(r) for r in rows))
    plan = R.plan_rules(R.read_rules(spark, str(path)))
    assert [(r.rule_id, r.type, r.severity, r.scope, r.context_guard.lines_before) for r in plan] == [("a", "cross-check", "HIGH", "**/*", 3)]


def test_text_tree_and_sinks(spark, tmp_path):
    folder = tmp_path / "src" / "p1"
    folder.mkdir(parents=True)
    (folder / "a.php").write_text("echo $x;\necho $y;\n")
    tree = corpus.read_text_tree(spark, str(tmp_path / "src"))
    assert [(r.project, r.path, r.lang) for r in tree.collect()] == [("p1", "p1/a.php", "php")]
    hits = scan.scan_presence(tree, [Rule("r", r"echo\s+\$")])
    rows = sinks.violation_rows(hits, 3, "2024-05-06 01:02:03")
    sinks.append_by_date(rows, str(tmp_path / "violations"))
    sinks.append_by_date(rows, str(tmp_path / "violations"))
    back = spark.read.parquet(str(tmp_path / "violations"))
    assert back.count() == 4 and [str(r[0]) for r in back.select("scan_date").distinct().collect()] == ["2024-05-06"]
    report = sinks.report_json(hits, 1).collect()[0]
    assert '"count":2' in report.json and '"shown":1' in report.json
    sinks.write_report(hits, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_class_detectors(spark):
    page = lambda c: [("p", "x", ".html", "html", f'<div class="{c}">')]

    def run(fn, c, *args):
        return fn(spark.createDataFrame(page(c), FILES), *args).count()

    assert run(html.class_conflicts, "hidden block") == 1
    assert run(html.class_conflicts, "md:hidden block") == 0
    assert run(html.missing_dark_variants, "bg-white p-2") == 1
    assert run(html.missing_dark_variants, "bg-white dark:bg-black") == 0
    assert run(html.missing_base_styles, "md:grid-cols-2", "grid-cols") == 1
    assert run(html.missing_base_styles, "grid-cols-1 md:grid-cols-2", "grid-cols") == 0


def test_taint_needs_cleaning_in_between(spark):
    dirty = "$a = $_GET['a'];\necho $a;"
    clean = "$a = $_GET['a'];\n$a = esc_html($a);\necho $a;\n$a = $_GET['b'];\necho $a;"
    rows = code.taint_flows(files(spark, ("d.php", dirty), ("c.php", clean))).collect()
    assert sorted((r.path, r.source_line, r.sink_line) for r in rows) == [("c.php", 4, 5), ("d.php", 1, 2)]


def test_input_used_directly_in_a_sink(spark):
    text = "echo $_GET['x'];\necho esc_html($_GET['y']);\n$a = $_POST[z];\ninclude $_REQUEST[\"p\"] . $_GET['q'];\nprint $name;"
    rows = code.direct_flows(files(spark, ("a.php", text))).collect()
    assert sorted((r.line_no, r.input, r.sink, r.risk) for r in rows) == [(1, "$_GET['x']", "echo", "XSS"), (4, '$_REQUEST["p"]', "include", "File Inclusion"), (4, "$_GET['q']", "include", "File Inclusion")][:1] + sorted(
        [(4, '$_REQUEST["p"]', "include", "File Inclusion"), (4, "$_GET['q']", "include", "File Inclusion")]
    )


def test_change_reach_and_risk(spark):
    from siftmill.operators import graph

    tree = files(
        spark, ("inc/a.php", "function alpha() {\n}"), ("b.php", "alpha();\nx();\nalpha();\nfunction beta() {\n}"), ("c.php", "beta();"), ("d.php", "include 'c.php';"), ("e.php", "other();"), ("f.php", "alpha();"),
        ("inc/f2.php", "require 'a.php';\nalpha(alpha(1));"),
    )
    changed = tree.filter("path = 'inc/a.php'")
    assert {r.path: r.distance for r in graph.change_reach(tree, changed).collect()} == {"inc/a.php": 0, "b.php": 1, "f.php": 1, "inc/f2.php": 1, "c.php": 2, "d.php": 3}
    assert {r.path: r.distance for r in graph.change_reach(tree, changed, hops=1).collect()} == {"inc/a.php": 0, "b.php": 1, "f.php": 1, "inc/f2.php": 1}
    lines = {(r.path, r.symbol): r.lines for r in graph.caller_lines(tree, changed).collect()}
    assert lines == {("b.php", "alpha"): [1, 3], ("f.php", "alpha"): [1], ("inc/f2.php", "alpha"): [2]}
    risks = spark.createDataFrame([("p", "HIGH"), ("p", "LOW"), ("q", "MEDIUM"), ("q", "MEDIUM"), ("r", "LOW"), *[("s", "HIGH")] * 3], "project string, risk_level string")
    assert {r.project: r.overall_risk for r in graph.overall_risk(risks).collect()} == {"p": "HIGH", "q": "MEDIUM", "r": "LOW", "s": "CRITICAL"}
    assert graph.change_reach(tree, changed.limit(0)).count() == 0


def test_empty_handler_across_lines(spark):
    rows = code.empty_handlers(files(spark, ("a.php", "x\n} catch (E $e) {\n\n}\ny\ncatch (F $f) {}"))).collect()
    assert sorted(r.line_no for r in rows) == [2, 6]


def test_case_classes(spark):
    names = ["my_name", "MY_NAME", "my-name", "MyName", "myName", "name", "My_name"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(X.case_class(F.col("n")))
    assert [r[0] for r in df.collect()] == ["snake_case", "UPPER_SNAKE", "kebab-case", "PascalCase", "camelCase", "lowercase", "mixed"]


def test_required_literals():
    need = rulescan.required_literals
    assert need(r"\$_POST\[") == (("$_POST[",), False) and need(r"eval\s*\(") == (("eval",), False)
    assert need(r"(?i)Not so|no WAY") == (("no way", "not so"), True)
    assert need(r"(?:innerHTML|outerHTML)\s*=") == (("innerHTML", "outerHTML"), False)
    assert need(r"(?:abcdef|x)*yz") == (("yz",), False) and need(r"(abc){2,}d") == (("abc",), False)
    for none in (r"[0-9]+", r"a?b?", r"abc|[0-9]", r"\p{L}+abc", r"(?x) a b c", r"(?i)straße", "x", ""):
        assert need(none) == ((), False), none
    assert need(r"foo(?=barbaz)qux") == (("foo",), False) and need(r"(?i:abcd)ef") == (("ef",), False)


RULES = [
    Rule("r1", r"bad\("), Rule("r2", r"(?i)WORSE", max_per_file=1), Rule("r3", r"[0-9]{2}", exclude_line="fine"), Rule("r4", "guarded", context_guard=Guard("shield", 1, 1)),
    Rule("r5", "bad", dedup="per_file", scope="inc/**/*.php"), Rule("a1", "must be", type="absence"), Rule("a2", "never there", type="absence", pre_check="bad"),
    Rule("a3", "in one file", type="absence", scope_mode="any"), Rule("a4", "nowhere", type="absence", scope_mode="any", pre_check=r"\d", scope="**/*.php"),
    Rule("c1", "open_it", cross_check="close_it"), Rule("c2", "post_it", cross_check="nonce", cross_check_scope="**/inc/*.php|inc/*.php"), Rule("q'1", r"it's \\ \"odd\""),
]

BODIES = [
    "bad(1)\nbad(2) # nosec\nbad(3) # nosec: r1\nWorse worse\nWORSE", "12\n34 fine\n56 # nosec: r3\n78", "shield\nguarded\nx\nguarded", "@scan-ignore all\nbad(\nopen_it",
    "must be\nopen_it\nopen_it 7", "open_it close_it", "post_it\npost_it here", "nonce post_it", "", "in one file", "it's \\ \"odd\"\nworse bad 9", "@scan-ignore a1\nbad 3",
]


def test_one_pass_gives_what_each_check_gives(spark):
    rows = []
    for p in ("p", "q"):
        for i, body in enumerate(BODIES):
            folder = ["", "inc/", "src/inc/"][i % 3]
            if not (p == "q" and ("nonce" in body or "one file" in body)):
                rows.append((p, f"{folder}{p}{i}.php", ".php", "php", body))
    df = corpus.with_lines(spark.createDataFrame(rows, FILES))
    want = []
    for r in RULES:
        if r.type == "absence":
            found = scan.absence_anywhere(df, r) if r.scope_mode == "any" else scan.absence_per_file(df, r)
        elif r.cross_check_scope:
            found = scan.cross_check_scope(df, r, F.col("path").rlike(R.scope_regex(r.cross_check_scope)))
        elif r.cross_check:
            found = scan.cross_check_same_file(df, r)
        else:
            found = scan.scan_presence(df, [r])
        want += [tuple(x) for x in found.collect()]
    for few in (0, 100):
        assert sorted(tuple(x) for x in rulescan.scan_rules(df, RULES, few=few).collect()) == sorted(want)
    assert {w[1] for w in want} == {r.rule_id for r in RULES} and rulescan.scan_rules(df, []).count() == 0 and rulescan.scan_rules(df.limit(0), RULES).count() == 0


def test_only_the_last_newline_ends_no_line(spark):
    rows = corpus.explode_lines(files(spark, ("a.php", "x\n\n"), ("b.php", "\n\n\n"), ("c.php", "x\n"))).collect()
    assert sorted((r.path, r.line_no, r.line) for r in rows) == [("a.php", 1, "x"), ("a.php", 2, ""), ("b.php", 1, ""), ("b.php", 2, ""), ("b.php", 3, ""), ("c.php", 1, "x")]


def test_few_files_reach_python_at_once(spark, monkeypatch):
    seen, write, name = [], rulescan.written_table, "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(rulescan, "written_table", lambda df, table: (seen.append(int(spark.conf.get(name))), write(df, table))[1])
    before = spark.conf.get(name)
    hits = rulescan.scan_rules(files(spark, *[(f"{i}.php", "ok\nbad") for i in range(600)]), [Rule("r", "bad")], few=0)
    assert hits.count() == 600 and seen == [rulescan.BATCH_FILES] and seen[0] <= 512 and spark.conf.get(name) == before
