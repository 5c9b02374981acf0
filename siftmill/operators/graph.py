"""Cross-file relations: importers, callers, dependencies, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.session import cut_lineage, drop_table, written_table

# How a file names another one.
IMPORT_TARGETS = r"(?:require|include|import|from)[^\n]*?([A-Za-z0-9_\-]+\.(?:php|jsx|js|tsx|ts))"
CALL_TOKENS = r"\b([A-Za-z_][A-Za-z0-9_]*)\s*[(:]"
DEFINED = r"(?:function|class)\s+([A-Za-z_][A-Za-z0-9_]*)"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def import_edges(files: DataFrame) -> DataFrame:
    """(project, importer, target name), each once."""
    names = F.array_distinct(F.regexp_extract_all("content", F.lit(IMPORT_TARGETS), F.lit(1)))
    return files.select("project", F.col("path").alias("importer"), F.explode(names).alias("target"))


def importers(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files that import a file of a changed name: one row per (importer, changed name).

    Changed files are reduced to distinct names, so ten changed files of one name do not
    multiply the importers.
    """
    names = changed.select("project", base_name(F.col("path")).alias("target")).distinct()
    return import_edges(files).join(names, ["project", "target"]).filter(base_name(F.col("importer")) != F.col("target"))


def symbol_callers(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Use of the changed files' symbols elsewhere: lines, count and risk per calling file."""
    from siftmill.sources.corpus import with_lines

    symbols = changed.select("project", F.explode(F.regexp_extract_all("content", F.lit(DEFINED), F.lit(1))).alias("symbol")).distinct()
    tokens = F.flatten(
        F.transform(
            "lines",
            lambda x, i: F.transform(F.array_distinct(F.regexp_extract_all(x, F.lit(CALL_TOKENS), F.lit(1))), lambda t: F.struct((i + 1).alias("line_no"), t.alias("symbol"))),
        )
    )
    calls = with_lines(files).select("project", "path", F.inline(tokens)).join(changed.select("project", "path"), ["project", "path"], "left_anti")
    per_symbol = calls.join(symbols, ["project", "symbol"]).groupBy("project", "path", "symbol").agg(
        F.count("*").alias("calls"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")
    )
    return per_symbol


def caller_risk(callers: DataFrame, changed: DataFrame) -> DataFrame:
    """Risk per calling file: HIGH for half of the project's changed symbols or five calls,
    MEDIUM for two of either."""
    names = changed.select("project", F.explode(F.regexp_extract_all("content", F.lit(DEFINED), F.lit(1))).alias("symbol"))
    total = names.groupBy("project").agg(F.countDistinct("symbol").alias("all_symbols"))
    out = callers.groupBy("project", "path").agg(F.count("*").alias("symbols"), F.sum("calls").alias("calls")).join(total, "project")
    calls, symbols = F.col("calls"), F.col("symbols")
    level = F.when((symbols >= F.col("all_symbols") * 0.5) | (calls >= 5), "HIGH").when((symbols >= 2) | (calls >= 2), "MEDIUM").otherwise("LOW")
    return out.select("project", "path", "symbols", "calls", level.alias("risk_level"))


def caller_lines(files: DataFrame, changed: DataFrame) -> DataFrame:
    """(project, path, symbol, lines): where each calling file uses a symbol of the changed files. A list holds lines of one
    file, so it is bounded by the file."""
    from siftmill.sources.corpus import with_lines

    symbols = changed.select("project", F.explode(F.regexp_extract_all("content", F.lit(DEFINED), F.lit(1))).alias("symbol")).distinct()
    calls = F.flatten(
        F.transform(
            "lines",
            lambda x, i: F.transform(F.array_distinct(F.regexp_extract_all(x, F.lit(CALL_TOKENS), F.lit(1))), lambda t: F.struct(t.alias("symbol"), (i + 1).alias("no"))),
        )
    )
    # A name leaves its file with its own lines only, before any join: joins send calls, never a file's text or all its lines once per name.
    of_name = lambda s: F.struct(s.alias("symbol"), F.transform(F.filter("calls", lambda c: c["symbol"] == s), lambda c: c["no"]).alias("lines"))
    found = with_lines(files).select("project", "path", calls.alias("calls"))
    used = found.select("project", "path", F.inline(F.transform(F.array_distinct(F.col("calls")["symbol"]), of_name)))
    return used.join(symbols, ["project", "symbol"]).join(changed.select("project", "path"), ["project", "path"], "left_anti").select("project", "path", "symbol", "lines")


def overall_risk(risks: DataFrame) -> DataFrame:
    """(project, files, high, medium, overall_risk) of a change from the risks of its calling files."""
    out = risks.groupBy("project").agg(F.count("*").alias("files"), F.count_if(F.col("risk_level") == "HIGH").alias("high"), F.count_if(F.col("risk_level") == "MEDIUM").alias("medium"))
    level = F.when(F.col("high") >= 3, "CRITICAL").when(F.col("high") >= 1, "HIGH").when(F.col("medium") >= 2, "MEDIUM").otherwise("LOW")
    return out.withColumn("overall_risk", level)


def change_reach(files: DataFrame, changed: DataFrame, hops: int | None = None) -> DataFrame:
    """(project, path, distance): all files that depend on the changed ones, directly or through others, and over how many
    steps at least. A file depends on another whose symbol it calls or whose name it imports.

    The whole set goes a step at once, through gates: the symbols and names of the files reached last,
    each followed once, lead to their users. A symbol that is defined and used in a third of all files
    is one gate with that many edges, never pairs of files. ``hops`` ends the walk early; else it ends
    when a step reaches nothing new.
    """
    edges = dependency_edges(files)
    defines = edges.filter("kind = 'defines'").select("project", F.col("src").alias("path"), F.concat(F.lit("s:"), "dst").alias("gate"))
    named = files.select("project", "path", F.concat(F.lit("f:"), base_name(F.col("path"))).alias("gate"))
    out_of = written_table(defines.unionByName(named).distinct(), "reach-out")
    uses = edges.filter("kind = 'uses'").select("project", F.concat(F.lit("s:"), "src").alias("gate"), F.col("dst").alias("path"))
    imports = edges.filter("kind = 'imports'").select("project", F.concat(F.lit("f:"), "src").alias("gate"), F.col("dst").alias("path"))
    into = written_table(uses.unionByName(imports).distinct(), "reach-in")
    last = cut_lineage(changed.select("project", "path").distinct())
    reached, opened, distance = last.withColumn("distance", F.lit(0)), None, 0
    while hops is None or distance < hops:
        gates = last.join(out_of, ["project", "path"]).select("project", "gate").distinct()
        if opened is not None:
            gates = gates.join(opened, ["project", "gate"], "left_anti")
        gates = cut_lineage(gates)
        opened = gates if opened is None else opened.unionByName(gates)
        last = cut_lineage(gates.join(into, ["project", "gate"]).select("project", "path").distinct().join(reached, ["project", "path"], "left_anti"))
        if last.isEmpty():
            break
        distance += 1
        reached = reached.unionByName(last.withColumn("distance", F.lit(distance)))
    drop_table(out_of, into)
    return reached


def dependency_edges(files: DataFrame) -> DataFrame:
    """File dependencies as edges through the symbol or file name that causes them.

    ``defines``: file to symbol; ``uses``: symbol to file; ``imports``: file name to file. A
    symbol defined in many files and used in many stays linear in edges; two files depend on
    each other when they share such a node.
    """
    defines = files.select("project", "path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(DEFINED), F.lit(1)))).alias("node"))
    uses = files.select("project", "path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(CALL_TOKENS), F.lit(1)))).alias("node"))
    shared = defines.select("project", "node").distinct()
    a = defines.select("project", F.col("path").alias("src"), F.col("node").alias("dst"), F.lit("defines").alias("kind"))
    b = uses.join(shared, ["project", "node"], "left_semi").select("project", F.col("node").alias("src"), F.col("path").alias("dst"), F.lit("uses").alias("kind"))
    c = import_edges(files).select("project", F.col("target").alias("src"), F.col("importer").alias("dst"), F.lit("imports").alias("kind"))
    return a.unionByName(b).unionByName(c)


def dependents(edges: DataFrame, path: str) -> DataFrame:
    """Files that depend on one file, from the edge table."""
    nodes = edges.filter((F.col("kind") == "defines") & (F.col("src") == path)).select("project", F.col("dst").alias("node"))
    return edges.filter("kind = 'uses'").join(nodes.withColumnRenamed("node", "src"), ["project", "src"]).select("dst").distinct().filter(F.col("dst") != path)


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components as (node, component), the component being its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) until nothing changes:
    every round is two aggregations, the number of rounds grows with the logarithm of the
    diameter, and the edge list is cut to the checkpoint folder after each, so executors may be
    lost. Hot nodes are only ever seen through min aggregates and equi-joins that adaptive
    execution may split.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u != v")
    e = cut_lineage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        e = cut_lineage(small.filter("u != v").distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(state):
            break
        before = tuple(state)
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
