"""The registered queries of this package, one for each operator, and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable
from importlib.util import find_spec
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boilerplate, decontaminate, jaccard_join, language, licenses, packing, repetition, secrets, unigram
from .shared import table


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file; the package that holds these is found, not imported."""
    return str(Path(find_spec("public_tokenizers").origin).parent / name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = lambda i: F.coalesce(F.crc32(i.cast("string")) % 4, F.lit(-1))
    model = language.train(docs, usable=lambda i: fold(i) != 2)
    found = language.identify(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = boilerplate.drop_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", "text")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents")).drop("longest")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.recognise(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentences", " ").alias("sentences"), F.array_join("licenses", ",").alias("licenses"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_matrices(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return packing.pack_certified(pieces).drop("salt")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_secret_scans": op6_secret_scans,
    "op7_license_scans": op7_license_scans,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_token_id_output": op9_token_id_output,
    "op10_best_fit_packing": op10_best_fit_packing,
}

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
k AS (SELECT doc_id, source, text, lines, [trim(x, ' ' || chr(9) || chr(13)) FOR x IN lines] AS keys FROM d),
pages AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source),
l AS (SELECT source, key, count(*) AS n FROM (SELECT source, unnest(list_distinct(keys)) AS key FROM k WHERE source IS NOT NULL) WHERE key <> '' GROUP BY source, key),
bad AS (SELECT l.source, list(key) AS bad FROM l JOIN pages ON l.source = pages.source
        WHERE l.n >= {boilerplate.LEAST_PAGES} AND l.n > {boilerplate.RATIO} * pages.n GROUP BY l.source),
j AS (SELECT doc_id, text, lines, [x FOR x IN lines IF NOT list_contains(coalesce(bad, []), trim(x, ' ' || chr(9) || chr(13)))] AS kept
      FROM k LEFT JOIN bad ON k.source = bad.source)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
       CASE WHEN len(kept) < len(lines) THEN array_to_string(kept, chr(10)) ELSE text END AS text
FROM j
"""


def _op7_sql() -> str:
    """Sentences by map, then a column for each rule: where it matches, its name is noted and its sentences go."""
    keys = ", ".join(f"'{k}'" for k in licenses.KNOWN)
    names = ", ".join(f"'{k}'" for k in licenses.KNOWN.values())
    cut = lambda ends: f"[x FOR x IN [map([{keys}], [{names}])[trim(regexp_replace(lower(y), '[^a-z0-9]+', ' ', 'g'))] FOR y IN string_split_regex({ends}, chr(1))] IF x IS NOT NULL]"
    # RE2 has no look-behind: the stop stays, then a mark stands for the break
    by_line = r"regexp_replace(regexp_replace(t, '([.!?:;])\s+', '\1' || chr(1), 'g'), '\n', chr(1), 'g')"
    wrapped = r"regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g')"
    state, found = "' ' || array_to_string(ids, '  ') || ' '", "[]::VARCHAR[]"
    ctes = [f"s0 AS (SELECT doc_id, way, ids, {state} AS state, {found} AS found FROM both_ways)"]
    for i, (name, ids) in enumerate(licenses.RULES):
        sought = " " + ids.replace(" ", "  ") + " "
        ctes.append(f"s{i + 1} AS (SELECT doc_id, way, ids, replace(state, '{sought}', ' - ') AS state, CASE WHEN contains(state, '{sought}') THEN list_append(found, '{name}') ELSE found END AS found FROM s{i})")
    hint = licenses.HINT.replace("(?i)", "")
    return f"""
WITH d AS (SELECT doc_id, CASE WHEN regexp_matches(text, '{hint}', 'i') THEN text ELSE '' END AS t FROM documents),
both_ways AS (SELECT doc_id, 0 AS way, {cut(by_line)} AS ids FROM d UNION ALL SELECT doc_id, 1 AS way, {cut(wrapped)} AS ids FROM d),
{", ".join(ctes)}
SELECT doc_id, array_to_string(CASE WHEN len(max(ids) FILTER (way = 0)) >= len(max(ids) FILTER (way = 1)) THEN max(ids) FILTER (way = 0) ELSE max(ids) FILTER (way = 1) END, ' ') AS sentences,
       array_to_string(list_sort(list_distinct(flatten(list(found)))), ',') AS licenses
FROM s{len(licenses.RULES)} GROUP BY doc_id
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP4_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_OP4_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_OP4_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, m, w[i:i + m - 1] AS g
        FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
              FROM (SELECT item_id, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0))),
docwin AS (SELECT doc_id, m, i, w[i:i + m - 1] AS g
           FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win))),
found AS (SELECT doc_id, item_id, i, docwin.m AS m FROM docwin JOIN win ON docwin.m = win.m AND docwin.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
         FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN item ON d.doc_id = item.doc_id
"""


def _repeated(n: int) -> str:
    """Words in n-word windows that occur twice or more in the text, first included."""
    return f"""(SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest(range(i, i + {n})) AS p FROM (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times
            FROM (SELECT doc_id, i, hash(w[i:i + {n - 1}]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM d)))
        WHERE times > 1) GROUP BY doc_id)"""


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM documents),
f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             coalesce(three.n, 0) AS n_repeat_words, coalesce(many.n, 0) AS n_covered, coalesce(long.n, 0) AS n_long
      FROM d LEFT JOIN {_repeated(3)} three ON d.doc_id = three.doc_id
      LEFT JOIN {_repeated(repetition.MIN_REPEAT)} many ON d.doc_id = many.doc_id
      LEFT JOIN {_repeated(repetition.MAX_LONGEST + 1)} long ON d.doc_id = long.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_covered <= {repetition.MAX_COVERED_PERCENT} * n_words AND n_long = 0 AS kept,
       n_covered
FROM f
"""

OP8_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(w[i:i + 4]) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT d.doc_id, count(g) AS n_shingles FROM d LEFT JOIN sh ON d.doc_id = sh.doc_id GROUP BY d.doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * i >= 75 * (a.n_shingles + b.n_shingles - i)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x, y FROM both_ways UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x)
SELECT n.doc_id, n_shingles, coalesce(least(n.doc_id, low), n.doc_id) AS component_id
FROM n LEFT JOIN (SELECT x, min(y) AS low FROM reach GROUP BY x) r ON n.doc_id = r.x
"""

ORACLES: dict[str, str] = {"op8_ngram_jaccard_join": OP8_SQL, "op2_line_dedup": OP2_SQL, "op7_license_scans": _op7_sql(), "op4_benchmark_decontamination": OP4_SQL, "op5_quality_rules": OP5_SQL}
