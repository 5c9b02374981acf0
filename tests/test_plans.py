"""What the physical plans must and must not hold."""

from siftmill.operators import pairs, rulescan, scan
from siftmill.plans.registry import load_all
from siftmill.plans.scan_plans import PROSE_RULES, rule_range
from siftmill.sources import corpus
from siftmill.sources.tables import table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_a_narrow_map(spark):
    text = plan(scan.scan_presence(corpus.document_files(spark, SF), PROSE_RULES))
    assert "Exchange" not in text and "Python" not in text and "Join" not in text


def test_scan_reads_needed_columns_only(spark):
    text = plan(scan.scan_presence(corpus.document_files(spark, SF), PROSE_RULES))
    assert "n_chars" not in text and "lang" not in text


def test_a_rule_table_is_one_narrow_pass(spark):
    text = plan(rulescan.scan_events(corpus.document_files(spark, SF), rule_range(660)))
    assert text.count("FileScan") == 1 and "Exchange" not in text and "Join" not in text and text.count("ArrowEvalPython") == 1


def test_filters_reach_the_scan(spark):
    text = plan(load_all()["fix_history"].build(spark, SF))
    assert "EqualTo(l_partkey,7)" in text


def test_pair_jobs_have_no_cartesian_product(spark):
    occ = table(spark, SF, "lineitem").selectExpr("l_partkey AS rule_id", "l_orderkey AS loc")
    text = plan(pairs.correlated_rules(occ, 0.5, 2))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_no_query_uses_a_cross_join(spark):
    eager = {"duplicate_clusters", "duplicate_report", "merged_rules", "guardrail_actions", "vector_clusters", "text_clusters", "cross_project_patterns",
             "mined_patterns", "rule_quality_model", "rule_table_scan", "rule_table_scan_138", "component_classifier", "component_threshold"}
    for name, q in load_all().items():
        if name in eager or name.endswith("_stream"):
            continue
        text = plan(q.build(spark, SF))
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name


def test_top_k_is_limited_before_the_shuffle(spark):
    assert plan(load_all()["capped_violations"].build(spark, SF)).count("WindowGroupLimit") >= 2


def test_joins_of_caller_lines_carry_calls_only(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes, types = [load_all()["caller_lines"].build(spark, SF)._jdf.queryExecution().optimizedPlan()], []
        while nodes:
            node = nodes.pop()
            children = [node.children().apply(i) for i in range(node.children().size())]
            nodes += children
            if node.nodeName() == "Join":
                types += [c.output().apply(i).dataType().simpleString() for c in children for i in range(c.output().size())]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(types) <= {"string", "array<int>", "array<struct<symbol:string,no:int>>"}


def test_texts_are_not_sent_by_rule_or_language(spark):
    for name, sides in {"fix_risk": 1, "refined_patterns": 2}.items():
        text = load_all()[name].build(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("strategy=broadcast") >= sides, name


def test_inventory_searches_literals_before_regexes(spark):
    text = plan(load_all()["code_inventory"].build(spark, SF))
    assert text.count("Contains(text") >= 30
