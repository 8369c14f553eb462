"""Registered queries of the text operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontamination, jaccard_join, language, license_scan, line_rules, packing, secret_scan, simhash, spellings, token_counts, toxicity, url_templates
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The URL rules of the query.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_url_templates", url_templates.judge_sql(URL_RULES))
def op1(spark, sf_dir):
    # To the leaves; the SQL has four levels, which says the same where no path is deeper.
    return url_templates.judge(read(spark, sf_dir, "pages"), URL_RULES, depth=None)


LINE_SQL = f"""WITH doc AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM doc),
count_w AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY 1),
tri AS (SELECT doc_id, i, [w, lead(w) OVER p, lead(w, 2) OVER p] AS g, lead(w, 2) OVER p AS last FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri WHERE last IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY 1),
raw AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM doc),
held AS (SELECT *, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS lw FROM raw WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM held GROUP BY 1),
lines AS (SELECT host, t, regexp_replace(translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[1-9]', '0', 'g') AS line, doc_id, len(lw) AS n FROM held),
by_text AS (SELECT host, t, line, sum(n) AS n FROM lines JOIN (SELECT host, t, min(doc_id) AS doc_id FROM doc GROUP BY ALL) USING (host, t, doc_id) GROUP BY ALL),
size AS (SELECT host, count(DISTINCT t) AS docs FROM doc GROUP BY 1),
common AS (SELECT host, line FROM (SELECT host, line, count(*) AS c FROM by_text GROUP BY ALL) JOIN size USING (host) WHERE c > {line_rules.LEAST} AND c > {line_rules.SHARE} * docs),
gone AS (SELECT host, t, sum(n) AS n FROM by_text JOIN common USING (host, line) GROUP BY ALL),
base AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(g.n, 0) AS n_common_words
  FROM doc d LEFT JOIN count_w USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone g USING (host, t)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND n_words - n_common_words >= {line_rules.LEFT} * n_words AS kept FROM judged"""


@query("op2_line_rules", LINE_SQL)
def op2(spark, sf_dir):
    return line_rules.judge(read(spark, sf_dir, "documents"))


@query("op2_clean_texts")
def op2_texts(spark, sf_dir):
    return line_rules.clean(read(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = read(spark, sf_dir, "documents")
    scored = toxicity.learn(docs, read(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op4_packing")
def op4(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer())


@query("op5_language")
def op5(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return language.learn(docs).classify(docs).select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query("op6_token_counts")
def op6(spark, sf_dir):
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer())


JACCARD_SQL = """WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN size USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""


@query("op7_jaccard_join", JACCARD_SQL)
def op7(spark, sf_dir):
    return jaccard_join.link(read(spark, sf_dir, "documents"))


@query("op8_secret_scan")
def op8(spark, sf_dir):
    found = secret_scan.scan_secrets(read(spark, sf_dir, "documents"))

    def digests(batches):
        for batch in batches:
            spans = [[(s["kind"], s["start"], s["end"]) for s in x] for x in batch.column("spans").to_pylist()]
            counts = {f"n_{k}": pa.array([sum(s[0] == k for s in x) for x in spans], pa.int64()) for k in secret_scan.KINDS[:3]}
            yield table(doc_id=batch.column("doc_id"), **counts, base_sha256=pa.array(map(secret_scan.base_digest, spans), pa.string()), spans=pa.array(map(secret_scan.digest, spans), pa.string()))

    return found.mapInArrow(digests, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


@query("op9_license_scan")
def op9(spark, sf_dir):
    return license_scan.scan_licenses(read(spark, sf_dir, "documents")).drop("detections")


@query("op10_decontamination")
def op10(spark, sf_dir):
    return decontamination.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op11_simhash")
def op11(spark, sf_dir):
    return simhash.link(read(spark, sf_dir, "documents"))


@query("op12_centroids", centroids.cluster_sql())
def op12(spark, sf_dir):
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


@query("op13_spellings", spellings.group_sql())
def op13(spark, sf_dir):
    return spellings.group_spellings(read(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
