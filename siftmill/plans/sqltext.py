"""Shared pieces of the reference SQL (DuckDB dialect)."""

from __future__ import annotations

from siftmill.sources import corpus


def lit(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def split_lines(column: str) -> str:
    return (
        "string_split(regexp_replace(regexp_replace(" + column + ", chr(13), '', 'g'), '\\n$', ''), chr(10))"
    )


def _pick(values: list[str], index: str) -> str:
    return f"{sql_list(values)}[CAST(({index}) % {len(values)} AS INT) + 1]"


def _lines(values: list[str]) -> str:
    index = "length(s) * 7 + i * 3 + doc_id"
    return (
        f"list_transform(segs, lambda s, i: replace({_pick(values, index)}, '{{n}}', "
        "CAST(length(s) % 9 AS VARCHAR)))"
    )


_LANG = "CASE ext WHEN '.php' THEN 'php' WHEN '.js' THEN 'javascript' ELSE 'python' END"

# WITH-list member `code(project, path, ext, lang, lines, content)`.
CODE_CTE = f"""
code0 AS (
  SELECT doc_id, source AS project, {_pick(corpus.EXTS, 'doc_id')} AS ext,
         {_pick(corpus.SUBDIRS, 'doc_id')} AS sub,
         replace({_pick(corpus.STEMS, 'doc_id // 6')}, '{{d}}', CAST(doc_id % 9 AS VARCHAR)) AS stem,
         string_split_regex(text, '[.,\\n]') AS segs
  FROM documents),
code1 AS (
  SELECT project, ext, {_LANG} AS lang,
         'themes/' || project || '/' || sub || '/d' || doc_id || '/' || stem || ext AS path,
         CASE ext WHEN '.php' THEN {_lines(corpus.PHP_LINES)}
                  WHEN '.js' THEN {_lines(corpus.JS_LINES)}
                  ELSE {_lines(corpus.PY_LINES)} END AS lines0
  FROM code0),
code2 AS (SELECT project, path, ext, lang, array_to_string(lines0, chr(10)) AS content FROM code1),
code AS MATERIALIZED (SELECT *, {split_lines('content')} AS lines FROM code2)"""

CODE_LINES_CTE = (
    CODE_CTE
    + """,
code_lines AS MATERIALIZED (
  SELECT project, path, ext, lang, unnest(lines) AS line,
         CAST(generate_subscripts(lines, 1) AS INT) AS line_no FROM code)"""
)

DOC_LINES_CTE = f"""
docs AS (
  SELECT source AS project, 'doc-' || doc_id AS path, lang, text AS content,
         {split_lines('text')} AS lines FROM documents),
doc_lines AS MATERIALIZED (
  SELECT project, path, lang, unnest(lines) AS line,
         CAST(generate_subscripts(lines, 1) AS INT) AS line_no FROM docs)"""


def with_code(body: str) -> str:
    return f"WITH {CODE_CTE}\n{body}"


def with_code_lines(body: str) -> str:
    return f"WITH {CODE_LINES_CTE}\n{body}"


def with_docs(body: str) -> str:
    return f"WITH {DOC_LINES_CTE}\n{body}"
