"""The registered queries of this package over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_html_extraction")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from docstruct.llm.html_text import main_text

    return main_text(table(spark, folder, "pages"))


@query("op2_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from docstruct.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, folder, "documents"), keep="largest")


@query("op6_ngram_jaccard")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from docstruct.llm.ngram_join import ngram_components

    return ngram_components(table(spark, folder, "documents"), words=3, num=9, den=10)


def quality_held_out():
    """The fold of documents that no training sees."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


#: Shares of the mix by tokens, and how the labels name the domains.
MIX = {"clean": 0.95, "rough": 0.03, "toxic": 0.02}


def domain_labels(labels: DataFrame) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "rough").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", domain.alias("domain"))


@query("op3_mixing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from docstruct.llm.mixing import mixed

    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    out = mixed(docs, domain_labels(labels), MIX, whole="clean")
    shares = [F.get("posterior", F.lit(i)).alias(f"p_{name}") for i, name in enumerate(MIX)]
    return out.select("doc_id", "tokens", *shares, "rate", "copies")


@query("op4_license_scan")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from docstruct.llm.licenses import scan_licenses, template_table

    return scan_licenses(table(spark, folder, "documents"), template_table(spark))


@query("op5_quality_classifier")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from docstruct.llm.quality import scored

    return scored(table(spark, folder, "documents"), table(spark, folder, "labels"), quality_held_out())


@query("op7_line_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from docstruct.llm.line_dedup import duplicate_lines

    return duplicate_lines(table(spark, folder, "documents"))


@query("op8_embedding_near_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from docstruct.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, folder, "embeddings"))


@query("op9_sentencepiece")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from docstruct.llm.pieces import encode

    out = encode(table(spark, folder, "documents").select("doc_id", "text"), decoded="decoded")
    return out.select("doc_id", "n_tokens", "token_ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


@query("op10_warc", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n >= 1000) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM g""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from docstruct.llm.store import written
    from docstruct.llm.warc import from_chunks, to_chunks

    return from_chunks(written(to_chunks(table(spark, folder, "pages")), "warc"))


def packing_tokenizer() -> str:
    """The vocabulary whose ids op13 packs. The driver reads the file; tasks get it with the job."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op11_phrase_mining", """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) AS t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
cuts AS (SELECT lang, phrase, a, i, array_to_string(w[1:i], ' ') AS pl, array_to_string(w[i + 1:k], ' ') AS pr FROM c, range(1, 4) AS t(i) WHERE i < k),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, i, l.a AS l, r.a AS r, ((2000000::HUGEINT * cuts.a) // (l.a + r.a))::BIGINT AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = pl JOIN f r ON r.lang = cuts.lang AND r.phrase = pr),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM c, range(2, 4) AS x(m), range(1, 4) AS y(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from docstruct.llm.phrases import phrases

    return phrases(table(spark, folder, "documents"))


@query("op12_filter_audit", """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(d.t, '[A-Z]')) > 2 * length(d.t),
   regexp_matches(d.t, '[#$%&*|]'), doc_id > first] AS fails FROM d JOIN m USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, e.i, g.i, h.i] AS seq FROM x a, x b, x e, x g, x h WHERE len(list_distinct([a.i, b.i, e.i, g.i, h.i])) = 5),
s AS (SELECT part, seq, step, seq[step] AS i, n, good, toxic, fails[seq[step]] AS here, len(list_filter(seq[1:step - 1], lambda j: fails[j])) > 0 AS gone,
  len(list_filter(fails, lambda y: y)) = 1 AS single FROM c, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, seq, step, any_value(i) AS i, sum(CASE WHEN NOT gone AND NOT here THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN here AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN here AND single THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN here AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM s GROUP BY part, seq, step)
SELECT part, array_to_string(list_transform(seq, lambda j: substr('ABCDE', j, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
  CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley FROM r""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from docstruct.llm.filter_audit import filter_audit

    return filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op13_best_fit_packing")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from docstruct.llm.packing import pack

    return pack(table(spark, folder, "documents"), packing_tokenizer())
