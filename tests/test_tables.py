"""Fixed tables by literal values, and readers on awkward input."""

from pyspark.sql import functions as F

from siftmill.functions import scores
from siftmill.operators import code, html
from siftmill.sources import corpus
from siftmill.streaming.runner import event_stream, run_to_table
from tests import oracle


def test_risk_matrix_is_whole():
    assert len(scores.RISK_MATRIX) == 28
    security = {(s, c): scores.RISK_MATRIX[s, c] for s, c in scores.RISK_MATRIX if c.endswith("-security")}
    assert security == {
        ("CRITICAL", "php-security"): 0.95, ("CRITICAL", "api-security"): 0.95, ("CRITICAL", "auth-security"): 0.95,
        ("HIGH", "php-security"): 0.85, ("HIGH", "api-security"): 0.85, ("HIGH", "auth-security"): 0.85, ("SUGGEST", "php-security"): 0.60,
    }


def test_all_component_types_are_found(spark):
    assert len(html.COMPONENTS) == 20
    pages = [
        ("modal", '<div class="fixed inset-0 z-50 modal"><section></section>' + "<b></b>" * 12 + "</div>", 0), ("dropdown", '<div class="absolute top-full shadow-x dropdown">', 0),
        ("tabs", '<div class="flex border-b gap-1 tabs"><a href="x"></a><button></button></div>', 0), ("accordion", '<div class="collapsible transition-all accordion">', 0),
        ("footer", '<footer class="bg-1 py-2">', 0), ("breadcrumb", '<nav class="flex gap-1 text-sm breadcrumb">a / b</nav>', 0),
    ]
    df = spark.createDataFrame([("p", n, h) for n, h, _ in pages], "project string, path string, content string")
    first = {r.path: (r.component_type, r.score) for r in html.components_of(df).filter("pos = 0").collect()}
    assert first["tabs"] == ("tabs", 10) and first["accordion"] == ("accordion", 9) and first["footer"] == ("footer", 7) and first["breadcrumb"][0] == "breadcrumb"
    assert set(first) >= {"tabs", "accordion", "footer", "breadcrumb"}


def test_last_block_of_a_file_counts(spark):
    block = "\n".join(f"$value_{i} = compute_everything({i});" for i in range(4))
    df = spark.createDataFrame([("p", "a.php", "php", block), ("p", "b.php", "php", block)], "project string, path string, lang string, content string")
    assert [r.files for r in code.repeated_blocks(df, min_files=2).collect()] == [2]


def test_malformed_bytes_are_left_out(spark, tmp_path):
    (tmp_path / "p+q" / "inc").mkdir(parents=True)
    (tmp_path / "p+q" / "inc" / "a.php").write_bytes(b"caf\xe9 \xff ok\n")
    (tmp_path / "p+q" / "b.php").write_bytes("finé".encode())
    rows = {r.path: r for r in corpus.read_text_tree(spark, str(tmp_path / "p+q")).collect()}
    assert rows["inc/a.php"].content == "caf  ok\n" and not rows["inc/a.php"].valid_utf8
    assert rows["b.php"].content == "finé" and rows["b.php"].valid_utf8 and rows["inc/a.php"].project == "inc"


def test_event_stream_of_a_folder_table(spark, tmp_path):
    spark.read.parquet(f"{oracle.sf('0.001')}/events.parquet").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    rows = run_to_table(event_stream(spark, str(tmp_path), files_per_trigger=2).select("event_id"), "folder")
    assert rows.count() == rows.select(F.count_distinct("event_id")).first()[0] == spark.read.parquet(f"{tmp_path}/events.parquet").count()


def test_equal_elements_are_scored_once(spark):
    """Scores of all types are not worked out again for every element of every page."""
    pages = spark.createDataFrame([("p", f"{i}", '<div class="tabs flex gap-1"><a href="x"></a><a href="x"></a>' * 40) for i in range(3)] + [("p", "none", None)], "project string, path string, content string")
    found = html.components_of(pages)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "array_sort" not in plan
    assert {(r.path, r.n) for r in found.groupBy("path").agg(F.count("*").alias("n")).collect()} == {(str(i), 120) for i in range(3)}
