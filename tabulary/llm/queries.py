"""Named queries over the test tables that apply the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.llm import (
    byte_bpe,
    decontaminate,
    fill_middle,
    filter_audit,
    fingerprints,
    language,
    pii,
    secrets,
    simhash,
    substrings,
    suffixes,
    token_counts,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"))


def held_out() -> F.Column:
    """Whether a document is left out of learning; one without an id isn't."""
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(F.pmod(code, F.lit(4)) == 2, F.lit(False))


@query("op5_language")
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    learned = language.learn(documents.filter(~held_out()))
    found = language.identify(documents, learned)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, folder, "documents"))


# The pattern of a word, and letters that are made lower-case.
WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


@query(
    "op10_decontaminate",
    f"""
    WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
    b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
    s AS (SELECT item_id, w, least(len(w), 10) AS n,
                 unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS start FROM b WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, start, start + n - 1), ' ')
                AS words FROM s),
    lengths AS (SELECT DISTINCT n FROM windows),
    places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS start
               FROM d, lengths WHERE len(w) >= n),
    hits AS (SELECT doc_id, start, p.n, item_id FROM places p JOIN windows v
             ON v.n = p.n AND v.words = array_to_string(list_slice(w, start, start + p.n - 1), ' ')),
    covered AS (SELECT DISTINCT doc_id, unnest(range(start, start + n)) AS place FROM hits),
    counts AS (SELECT doc_id, count(*) AS n_hit FROM covered GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits)
              GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
           coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN counts USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op2_simhash")
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edit_likeness(table(spark, folder, "documents"))


def spans_listed(found: str, condition=None) -> F.Column:
    """Spans as ``kind:start:end``, comma-joined."""
    spans = F.filter(found, condition) if condition else F.col(found)
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def counted(found, kind: str) -> F.Column:
    """How many spans are of one kind."""
    chosen = F.filter(found, lambda s: s["kind"] == kind)
    return F.size(chosen).cast("long").alias(f"n_{kind}")


@query("op4_pii")
def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *(counted(F.filter("found", lambda s: ~s["disguised"]), kind) for kind in pii.KINDS),
        F.sha2(spans_listed("found", lambda s: ~s["disguised"]), 256).alias("base_sha256"),
        spans_listed("found").alias("spans"),
        F.size(F.filter("found", lambda s: s["disguised"])).cast("long").alias("n_disguised"),
    )


@query("op6_secrets")
def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *(counted("found", kind) for kind in secrets.KINDS[:-1]),
        F.sha2(spans_listed("found", lambda s: s["kind"] != "random"), 256).alias("base_sha256"),
        spans_listed("found").alias("spans"),
        counted("found", "random"),
    )


# Five hex digits are four digits of base 32.
PAYLOADS_SQL = """
    SELECT page_id, coalesce(html, '') AS payload,
           array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST(((CAST('0x' || substr(sha1(coalesce(html, '')), CAST(5 * (k // 4) + 1 AS BIGINT), 5)
                           AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)
               FOR k IN range(0, 32)], '') AS payload_digest
    FROM pages
"""


@query(
    "op8_warc",
    f"""
    WITH p AS ({PAYLOADS_SQL}),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM p)
    SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> kept THEN kept END AS refers_to
    FROM m
    """,
)
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    index = warc.archive(table(spark, folder, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, folder, "documents"))
    # Cuts fall between bytes; where one parts a character its rest shows as U+FFFD.
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", text)


# The pattern of a word between blanks.
BLANK_WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query(
    "op11_substring_dedup",
    f"""
    WITH w AS (SELECT doc_id, {BLANK_WORDS_SQL} AS w FROM documents),
    windows AS (SELECT doc_id, start, sha256(array_to_string(list_slice(w, start, start + 19), ' ')) AS words
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS start FROM w)),
    again AS (SELECT doc_id, start FROM windows
              QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, start) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM again),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM w),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept
             FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id),
    counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256, coalesce(kept, '') AS text
    FROM w LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
)
def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, folder, "documents"))
    text = F.col("kept").alias("text")
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", text)


@query(
    "op12_filter_audit",
    f"""
    WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                      {BLANK_WORDS_SQL} AS w FROM documents),
    l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good,
                 bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
    d AS (SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
                 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) AS c,
                 regexp_matches(t, '[#$%&*|]') AS d,
                 coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
    cells AS (SELECT part, [a, b, c, d, e] AS fails, coalesce(good, false) AS good,
                     coalesce(toxic, false) AS toxic, count(*) AS n
              FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL),
    f AS (SELECT unnest(range(1, 6)) AS f),
    orders AS (SELECT [v.f, w.f, x.f, y.f, z.f] AS o FROM f v, f w, f x, f y, f z
               WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5),
    steps AS (SELECT array_to_string([substr('ABCDE', CAST(i AS BIGINT), 1) FOR i IN o], '') AS filter_order,
                     f AS step, o[f] AS own, list_slice(o, 1, f - 1) AS before FROM orders, f),
    found AS (SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS fail,
                     len([i FOR i IN before IF fails[i]]) > 0 AS gone,
                     len([i FOR i IN fails IF i]) AS failing FROM cells, steps),
    sums AS (SELECT part, filter_order, step, own,
                    sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS kept,
                    sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END) AS removed,
                    sum(CASE WHEN gone AND fail THEN n ELSE 0 END) AS redundant,
                    sum(CASE WHEN fail AND failing = 1 THEN n ELSE 0 END) AS unique_fails,
                    sum(CASE WHEN NOT gone AND fail AND good THEN n ELSE 0 END) AS good_lost,
                    sum(CASE WHEN NOT gone AND fail AND toxic THEN n ELSE 0 END) AS toxic_lost
             FROM found GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
           CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
           CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
           CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
    FROM sums
    """,
)
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(
    "op13_fill_in_middle",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                      regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                      sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
    x AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n,
                 CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
                 CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
                 CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3,
                 CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a,
                 greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>')
                           OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
    p AS (SELECT *, coalesce(array_to_string(list_slice(u, 1, a), ''), '') AS p,
                 coalesce(array_to_string(list_slice(u, a + 1, b), ''), '') AS m,
                 coalesce(array_to_string(list_slice(u, b + 1, n), ''), '') AS s FROM c)
    SELECT doc_id, n, form,
           CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t
                            WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                            ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM p
    """,
)
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, folder, "documents"))
    return fill_middle.restored(made).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )
