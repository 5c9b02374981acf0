"""Text corpora as one row per file: ``(project, path, ext, lang, content)``.

A file is a single row, so everything a detector needs about a line's neighbourhood is in the
row. The line detectors therefore run as narrow maps over the ``lines`` array and never
shuffle; only what crosses files (absence in any file, cross references, counts) does.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.sources.tables import table

# Language by file extension.
LANG_BY_EXT = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".php": "php",
    ".go": "go",
    ".rs": "rust",
    ".rb": "ruby",
    ".java": "java",
    ".css": "css",
    ".scss": "scss",
    ".less": "less",
    ".html": "html",
    ".sql": "sql",
}

# Directories and compiled assets that are never scanned.
EXCLUDED_DIRS = [
    "node_modules", ".git", "vendor", "__pycache__", ".next", "dist", "build", ".turbo", "out",
]
EXCLUDED_FILES = [
    "src/main.css", "src/output.css", "assets/css/main.css", "dist/style.css", "build/style.css",
    "style.min.css",
]
COMPILED_NAMES = [
    "main.css", "output.css", "style.min.css", "tailwind.css", "compiled.css", "bundle.css",
    "app.min.css",
]

# A scan of fewer splits than this leaves most cores idle, so it is spread first.
FEW_SPLITS = 8


def spread(df: DataFrame) -> DataFrame:
    """Spread a CPU-heavy input that arrives in very few splits; large inputs pass untouched."""
    wanted = min(FEW_SPLITS, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def ext_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def lang_of(ext: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in LANG_BY_EXT.items() for x in kv])
    return F.try_element_at(mapping, ext)


def split_lines(content: Column) -> Column:
    """Lines of a text: CR dropped, no empty line after a trailing newline. Only the last newline goes: ``$`` would also match before it."""
    text = F.regexp_replace(content, "\r", "")
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)


def with_lines(files: DataFrame) -> DataFrame:
    return files.withColumn("lines", split_lines(F.col("content")))


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    keep = [c for c in files.columns if c not in ("content", "lines")]
    source = files if "lines" in files.columns else with_lines(files)
    return source.select(*keep, F.posexplode("lines").alias("pos", "line")).select(
        *keep, (F.col("pos") + 1).alias("line_no"), "line"
    )


def excluded_path(path: Column) -> Column:
    """True for vendored directories and compiled or minified assets."""
    dirs = "|".join(d.replace(".", r"\.") for d in EXCLUDED_DIRS)
    base = F.regexp_extract(path, r"([^/]+)$", 1)
    return (
        path.rlike(rf"(^|/)({dirs}|\.disabled-[^/]*)(/|$)")
        | path.isin(EXCLUDED_FILES)
        | base.isin(COMPILED_NAMES)
        | base.rlike(r"\.min\.(css|js)$")
    )


def read_text_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files under ``root`` read whole, for a user who has a directory and not a table. Malformed bytes are left out; ``valid_utf8`` says where."""
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
    )
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    top = re.sub("^[a-z]+:/*", "/", root.rstrip("/")) + "/"
    rel = F.when(path.startswith(top), F.substring(path, len(top) + 1, 1 << 30)).otherwise(path)
    ext = ext_of(rel)
    return raw.select(
        F.regexp_extract(rel, "^([^/]+)/", 1).alias("project"),
        rel.alias("path"),
        ext.alias("ext"),
        lang_of(ext).alias("lang"),
        F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit("")).alias("content"),
        F.is_valid_utf8(F.col("content").cast("string")).alias("valid_utf8"),
        F.col("content").alias("raw"),
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prose corpus: one file per document, the source is its project."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("project"),
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("path"),
        F.lit(".txt").alias("ext"),
        "lang",
        F.col("text").alias("content"),
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("project"),
        F.col("page_id"),
        F.concat(F.lit("page-"), F.col("page_id")).alias("path"),
        F.lit(".html").alias("ext"),
        F.lit("html").alias("lang"),
        F.col("html").alias("content"),
    )


# A source-code corpus derived from the documents: every sentence of a document selects one
# line, so the corpus grows with the table and stays one row per file (no shuffle).
PHP_LINES = [
    "<?php",
    "function load_item_{n}($id) {",
    "    $name = $_GET['name'];",
    "    $name = sanitize_text_field($name);",
    "    echo $name;",
    "    echo esc_html($name);",
    '    $wpdb->query("SELECT * FROM t WHERE id=" . $id);',
    "    $rows = $wpdb->get_results($sql);",
    "}",
    "    // TODO: handle case {n}",
    "    # FIXME later",
    "    $password = 'hunter{n}secret';",
    "    if (isset($_POST['save'])) {",
    "    wp_verify_nonce($_POST['nonce'], 'save');",
    "    include($path);",
    "    include('part-{n}.php');",
    "    $url = 'https://example.com/api/{n}';",
    "    $body = wp_remote_get($url);",
    "    if (is_wp_error($body)) { return; }",
    "    for ($i = 0; $i < count($rows); $i++) {",
    "    $stock -= 1;",
    "    $usage_count += 1;",
    "    $opt = get_option('k{n}');",
    "    update_option('k{n}', $opt);",
    "    } catch (Exception $e) {}",
    "    try {",
    "class ItemService{n} {",
    "    load_item_{n}(4096);",
    "    error_log('x'); # nosec",
    "    START TRANSACTION",
    "    add_action('init', 'load_item_{n}');",
    "    // @scan-ignore all",
    "    get_template_part('template-parts/part-{n}');",
    "    $meta = get_post_meta($id, 'k');",
    "    foreach ($rows as $row) {",
    "    // $old = {n};",
    "",
    "    var_dump($rows);",
    "    // $older = {n};",
    "    save_order_{n}($row);",
    "    }",
    "    $price = 2599;",
]
JS_LINES = [
    "import { item } from './part-{n}.js'",
    "function loadItem{n}(id) {",
    "  const apiKey = 'abcdefghijklmnopqrstuv{n}';",
    "  eval(code);",
    "  el.innerHTML = body;",
    "  el.innerHTML = sanitize(body);",
    "  fetch('/cart/add/{n}')",
    "  fetch('/cart/add', { headers: { 'X-WP-Nonce': nonce } })",
    "    .then(r => r.json())",
    "    .catch(() => null)",
    "  console.log(id);",
    "  console.debug(id);",
    "}",
    "async function save{n}(x) {",
    "  await send(x);",
    "  try {",
    "  } catch (e) { }",
    "  // HACK: retry {n}",
    "class CartView{n} {",
    "  const [v, setV] = useState(0);",
    "  useEffect(() => {",
    "  loadItem{n}(4096);",
    "  // old{n}();",
    "",
    "  const total_sum_{n} = (a, b) => a + b;",
    "  $.ajax({ url: '/x' });",
    "  axios.get('/api/{n}');",
    "  // older{n}();",
    "  const url = 'http://example.org/{n}';",
    "  console.info(id); # nosec: debug-call",
    "  stock -= 2;",
    "    // #region {n}",
    "  timeout = 2599;",
    "import react from 'react'",
]
PY_LINES = [
    "import os",
    "from .part import item_{n}",
    "def load_item_{n}(x):",
    "    try:",
    "    except Exception: pass",
    "    print(x)",
    "    # XXX: check {n}",
    "class ItemStore{n}:",
    "    return 4096",
    "    value = 2599",
    "",
    "    # old = {n}",
    "    password = 'hunter{n}secret'",
    "    # older = {n}",
    "def loadThing{n}(y):",
    "    eval(y)",
    "\tprint(y)",
    "import json",
    "    for row in rows:",
    "    load_item_{n}(x)",
]
SUBDIRS = ["inc", "template-parts", "src/components", "vendor/lib", "assets/js", "tests"]
STEMS = ["part-{d}", "CartView", "my-page", "store_item", "account-{d}", "functions"]
EXTS = [".php", ".js", ".py", ".php", ".js"]


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived code corpus; the reference SQL of the same derivation is ``CODE_SQL``."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    did = F.col("doc_id")

    def pick(values: list[str], index: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int") + 1)

    digit = (did % 9).cast("string")
    ext = pick(EXTS, did)
    stem = F.replace(pick(STEMS, F.floor(did / 6)), F.lit("{d}"), digit)
    path = F.concat_ws(
        "/", F.lit("themes"), F.col("source"), pick(SUBDIRS, did), F.concat(F.lit("d"), did), F.concat(stem, ext)
    )

    def lines_of(values: list[str]) -> Column:
        return F.transform(
            F.col("segs"),
            lambda s, i: F.replace(
                pick(values, F.length(s) * 7 + (i + 1) * 3 + did), F.lit("{n}"), (F.length(s) % 9).cast("string")
            ),
        )

    lines = (
        F.when(ext == ".php", lines_of(PHP_LINES))
        .when(ext == ".js", lines_of(JS_LINES))
        .otherwise(lines_of(PY_LINES))
    )
    return docs.withColumn("segs", F.split("text", "[.,\n]", -1)).select(
        F.col("source").alias("project"),
        path.alias("path"),
        ext.alias("ext"),
        lang_of(ext).alias("lang"),
        F.concat_ws("\n", lines).alias("content"),
    )
