"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.decontaminate import contaminated
from auditlake.llm.html import extract
from auditlake.llm.langid import languages
from auditlake.llm.lm import lm_scores
from auditlake.llm.paragraphs import repeated_paragraphs
from auditlake.llm.pieces import MODEL, encode_documents
from auditlake.llm.quality import quality_rules
from auditlake.llm.shards import token_index
from auditlake.llm.simhash import near_duplicate_groups
from auditlake.llm.toxicity import toxic_documents


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def queries(model: str = MODEL) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries; model is the path of the SentencePiece model that two of them use."""
    return {
        "op1_simhash_near_dedup": lambda s, d: near_duplicate_groups(_t(s, d, "documents")),
        "op2_toxicity": lambda s, d: toxic_documents(_t(s, d, "documents"), _t(s, d, "labels")),
        "op3_benchmark_decontamination": lambda s, d: contaminated(_t(s, d, "documents"), _t(s, d, "benchmark")),
        "op4_substring_dedup": lambda s, d: repeated_paragraphs(_t(s, d, "documents")),
        "op5_lm_scoring": lambda s, d: lm_scores(_t(s, d, "documents")),
        "op6_sentencepiece": lambda s, d: encode_documents(_t(s, d, "documents"), model),
        "op7_quality_rules": lambda s, d: quality_rules(_t(s, d, "documents")),
        "op8_language_id": lambda s, d: languages(_t(s, d, "documents")),
        "op9_html_extraction": lambda s, d: extract(_t(s, d, "pages")),
        "op10_token_index": lambda s, d: token_index(_t(s, d, "documents"), model),
    }


#: Tokens of both engines: runs of letters, digits and underscores in lower case.
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"

OP3 = rf"""
WITH d AS (SELECT DISTINCT doc_id, text, {_TOKENS} t FROM documents WHERE text IS NOT NULL),
b AS (SELECT DISTINCT item_id, text, {_TOKENS} t FROM benchmark WHERE text IS NOT NULL),
dn AS (SELECT row_number() OVER () dk, * FROM d), bn AS (SELECT row_number() OVER () bk, * FROM b),
bs AS (SELECT DISTINCT bk, least(5, len(t)) w, len(t) - least(5, len(t)) + 1 span, list_aggregate(t[i : i + least(5, len(t)) - 1], 'string_agg', ' ') s
       FROM bn, unnest(range(1, len(t) - least(5, len(t)) + 2)) u(i) WHERE len(t) > 0),
m AS (SELECT bk, w, span, count(*) m, ceil(count(*) * 0.6 - 1e-9) o FROM bs GROUP BY ALL),
ds AS (SELECT dk, i - 1 pos, w, list_aggregate(t[i : i + w - 1], 'string_agg', ' ') s FROM dn, (SELECT DISTINCT w FROM bs) x, unnest(range(1, len(t) - w + 2)) u(i)),
h AS (SELECT DISTINCT ds.dk, bs.bk, bs.w, bs.span, ds.pos, bs.s FROM ds JOIN bs ON ds.w = bs.w AND ds.s = bs.s),
win AS (SELECT a.dk, a.bk, a.w, a.pos, count(DISTINCT c.s) k FROM h a JOIN h c ON a.dk = c.dk AND a.bk = c.bk AND a.w = c.w AND c.pos >= a.pos AND c.pos < a.pos + a.span GROUP BY ALL),
best AS (SELECT win.dk, win.bk, m.m, m.o, max(k) k, arg_max(pos, k * 1000000000 - pos) p FROM win JOIN m USING (bk, w) GROUP BY ALL)
SELECT doc_id, item_id, CAST(k AS INTEGER) matched, CAST(m AS INTEGER) shingles, CAST(p AS BIGINT) "start" FROM best JOIN dn USING (dk) JOIN bn USING (bk) WHERE k >= o
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_benchmark_decontamination": OP3}
