"""Queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.session import spread, table

from .ann import nearest_neighbours
from .common import new_path, residue
from .decontaminate import contaminated
from .langid import fit_language_model, identify_language
from .packing import best_fit_packing
from .quality import fit_neighbour_vote, score_texts
from .secrets import scan_secrets
from .sharding import reshard
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .toxicity import fit_toxicity


def _documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


def op1_sharding(spark, sf_dir):
    """The rows of the newest version, read back through the manifest."""
    store = reshard(table(spark, sf_dir, "documents"), new_path(spark, "shards"))
    return store.read().select(
        "doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )


def op2_ann(spark, sf_dir):
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, nearest=5)


def op3_quality(spark, sf_dir):
    docs, labels = _documents(spark, sf_dir), table(spark, sf_dir, "labels")
    held_out = residue("doc_id", 3) == 1
    model = fit_neighbour_vote(docs, labels, ~held_out, column="quality")
    return score_texts(docs.select("doc_id", held_out.alias("held_out"), "text"), model, threshold=0.5)


def op4_toxicity(spark, sf_dir):
    docs, labels = _documents(spark, sf_dir), table(spark, sf_dir, "labels")
    held_out = residue("doc_id", 3) == 1
    model = fit_toxicity(docs, labels, ~held_out, column="toxic")
    return score_texts(docs.select("doc_id", held_out.alias("held_out"), "text"), model, threshold=0.7, prior=0.0)


def op5_langid(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    held_out = residue("doc_id", 5) == 0
    model = fit_language_model(docs, ~held_out)
    found = identify_language(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("score"))


def op6_decontaminate(spark, sf_dir):
    return contaminated(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), least=5, threshold=0.8)


def op7_secrets(spark, sf_dir):
    return scan_secrets(_documents(spark, sf_dir), example_owners=3, example_repos=20)


def op8_simhash(spark, sf_dir):
    return near_duplicates(_documents(spark, sf_dir), radius=2)


def op9_suffix_dedup(spark, sf_dir):
    return remove_repeats(_documents(spark, sf_dir), length=400)


def op10_packing(spark, sf_dir):
    return best_fit_packing(_documents(spark, sf_dir), capacity=1024, end_id=2)


QUERIES = {
    "op1_sharding": op1_sharding, "op2_ann": op2_ann,
    "op3_quality": op3_quality, "op4_toxicity": op4_toxicity, "op5_langid": op5_langid, "op6_decontaminate": op6_decontaminate,
    "op7_secrets": op7_secrets, "op8_simhash": op8_simhash, "op9_suffix_dedup": op9_suffix_dedup, "op10_packing": op10_packing,
}

def _spans(kind: str, rank: int, pattern: str, value: str) -> str:
    """Matches of a pattern with their places: the gaps between the matches and the matches' lengths, summed up."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT rid, '{kind}' AS kind, {rank} AS rank, m, v,
            CAST(sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY k) AS BIGINT) AS stop, stop - length(m) AS start
        FROM (SELECT rid, unnest(range(len(ms))) AS k, unnest(ms) AS m, unnest(vs) AS v, unnest(gaps[1:len(ms)]) AS g
              FROM (SELECT rid, regexp_extract_all(t, '{quoted}') AS ms, {value.format(quoted)} AS vs, string_split_regex(t, '{quoted}') AS gaps FROM docs))"""


_WORD = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = rf"""({_WORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_WHOLE = "regexp_extract_all(t, '{0}')"

ORACLES: dict[str, str] = {
    "op1_sharding": """
        SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256
        FROM documents
    """,
    "op7_secrets": f"""
        WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner FROM documents),
        base AS (
            SELECT * FROM ({_spans("assign", 0, _ASSIGN, "regexp_extract_all(t, '{0}', 2)")}) WHERE length(v) >= 12
            UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]{14,}", _WHOLE)}
            UNION ALL {_spans("hex", 2, "[0-9a-f]{16,}", _WHOLE)}
        ),
        more AS (
            SELECT * FROM ({_spans("owned", 3, "[A-Za-z0-9+/_-]{24,}", _WHOLE)}) o
            WHERE regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')
              AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = o.rid AND b.start < o.stop AND o.start < b.stop)
        ),
        found AS (SELECT * FROM base UNION ALL SELECT * FROM more),
        copied AS (SELECT v FROM found JOIN docs USING (rid) GROUP BY v HAVING count(DISTINCT owner) >= 3 OR count(DISTINCT doc_id) >= 20),
        judged AS (SELECT *, v IN (SELECT v FROM copied) AS copied FROM found)
        SELECT doc_id,
            count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
            sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
            coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3 OR NOT copied), '') AS spans,
            count(*) FILTER (rank = 3 AND NOT copied) AS n_owned, count(*) FILTER (kind IS NOT NULL AND NOT copied) AS n_live, count(*) FILTER (copied) AS n_example
        FROM docs LEFT JOIN judged USING (rid) GROUP BY rid, doc_id
    """,
}
