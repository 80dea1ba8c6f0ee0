"""The text operators bound to the given tables, one query each, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyframe.llm import decontaminate, exact, fingerprints, language, licenses, lines, neardup, packing, phrases, pii, ranked, secrets, toxicity
from skyframe.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def of_kind(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select("doc_id", *[of_kind(k) for k in kinds], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), F.transform("spans", lambda s: s["score"]).alias("scores"))


@query("op1_toxicity")
def op1(table):
    docs = table("documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table("labels")))
    return scored.select("doc_id", F.coalesce(~toxicity.learnable(), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op2_language")
def op2(table):
    return language.predict(table("documents")).select(
        "doc_id", (~language.learnable()).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


@query("op3_packing")
def op3(table):
    return packing.pack(table("documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")


@query("op4_decontamination")
def op4(table):
    found = decontaminate.find(table("documents"), table("benchmark"))
    return found.select("doc_id", "contaminated", F.transform("overlaps", lambda o: o["item_id"]).alias("item_ids"),
                        F.coalesce(F.array_max(F.transform("overlaps", lambda o: o["matched"])), F.lit(0)).alias("most_matched"))


@query("op5_secrets")
def op5(table):
    return span_digest(secrets.find(table("documents")), secrets.BASE_KINDS)


@query("op6_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op6(table):
    return exact.groups(table("documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_digest")).alias("text_sha256"))


@query("op7_licenses")
def op7(table):
    return licenses.find(table("documents")).select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"])), ",").alias("licenses"),
        F.transform("licenses", lambda x: x["coverage"]).alias("coverage"),
        F.flatten(F.transform("licenses", lambda x: x["differences"])).alias("differences"))


@query("op8_line_dedup", """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
     k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id""")
def op8(table):
    return lines.drop_common(table("documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_pii")
def op9(table):
    return span_digest(pii.find(table("documents")), pii.BASE_KINDS)


@query("op10_near_dedup")
def op10(table):
    return neardup.classes(table("documents")).select("doc_id", "class_id", "class_size", "class_texts", "kept")


@query("op11_ranked_search", """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
     f AS (SELECT r, doc_id, term, count(*) AS tf FROM d GROUP BY r, doc_id, term),
     s AS (SELECT r, sum(tf)::BIGINT AS n FROM f GROUP BY r),
     a AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM s),
     w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, a GROUP BY term),
     i AS (SELECT DISTINCT item_id, q, term FROM (SELECT item_id, row_number() OVER () AS q, unnest(regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)),
     x AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l))))::BIGINT AS score
           FROM i JOIN w USING (term) JOIN f USING (term) JOIN s USING (r), a GROUP BY q, item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank FROM x WHERE score > 0)
WHERE rank <= 10""")
def op11(table):
    return ranked.rank(table("documents"), table("benchmark"))


@query("op12_fingerprints")
def op12(table):
    return fingerprints.edited(table("documents")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op13_collocations", """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
     t AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
     g AS (SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase
           FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k)),
     f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
     c AS (SELECT * FROM f WHERE k > 1),
     d AS (SELECT s.lang, s.phrase FROM c s JOIN c b ON s.lang = b.lang AND b.k > s.k AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')
           AND 100 * b.a >= 100 * s.a GROUP BY s.lang, s.phrase),
     x AS (SELECT lang, phrase, k, a, j, array_to_string(list_slice(ws, 1, j), ' ') AS head, array_to_string(list_slice(ws, j + 1, k), ' ') AS tail
           FROM (SELECT c.*, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS j FROM c ANTI JOIN d USING (lang, phrase))),
     y AS (SELECT x.lang, x.phrase, x.a, x.j, l.a AS l, r.a AS r, t.n, (1000::HUGEINT * x.a * t.n) // (l.a::HUGEINT * r.a) AS score
           FROM x JOIN f l ON l.lang = x.lang AND l.phrase = x.head JOIN f r ON r.lang = x.lang AND r.phrase = x.tail JOIN t ON t.lang = x.lang),
     z AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM y)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z WHERE o = 1) WHERE rank <= 2000""")
def op13(table):
    return phrases.collocations(table("documents"))
