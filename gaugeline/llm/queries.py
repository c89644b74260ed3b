"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import chat_format, exact_dedup, fingerprint, hard_negatives, jaccard_join, mixing, periodic_runs, piece_codec, quality_mil, secret_scan, substring_dedup, toxic_crf, warc_writer
from gaugeline.llm.common import table
from gaugeline.operators.staging import stage


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_codec.recode(docs, piece_model())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "spans_sha256",
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # the source stands for the owner, its texts in one language for a repository
    found = secret_scan.scan(docs, repo=F.to_json(F.struct("source", "lang")), owner=F.col("source"))
    count = lambda field, value: F.size(F.filter("spans", secret_scan.having(field, value))).cast("long")
    return found.select(
        "doc_id",
        *(count("kind", i).alias(f"n_{k}") for i, k in enumerate(secret_scan.KINDS[:3])),
        F.sha2(secret_scan.text_of(secret_scan.base_of(F.col("spans"))), 256).alias("base_sha256"),
        secret_scan.text_of(F.col("spans")).alias("spans"),
        count("status", "live").alias("n_live"),
        count("status", "copied").alias("n_copied"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["n_repos"])), F.lit(0).cast("long")).alias("most_repos"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("text_sha256", F.sha2(exact_dedup.normalised(F.col("text")), 256))
    return exact_dedup.mark(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.follow(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


KEEP_SCORE = 0.3


def op7_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_mil.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_mil.score(docs, model).drop("text")
    return scored.select("doc_id", quality_mil.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed(table(spark, sf_dir, "documents"), with_text=False)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text")
    written = stage(chat_format.examples(turns.unionByName(planted)), "chat-examples")
    trained = chat_format.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_stop"))
    talks = written.groupBy("conv_id").agg(
        F.max(F.struct("n_turns", "formatted"))["formatted"].alias("whole"),
        F.array_sort(F.collect_list(F.struct("example", trained.alias("text")))).alias("replies"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    lost = F.array_join(F.transform("replies", lambda r: r["text"]), "")
    talks = talks.withColumn("turns", chat_format.read_turns(F.col("whole"))).withColumn("lost", lost)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return talks.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc_writer.write_and_read(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def with_loops(docs: DataFrame) -> DataFrame:
    """(doc_id, text) as op11 is asked to read them: the tail of every tenth text, by hash, repeats its first p words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = docs.select("doc_id", "text", F.when((h % 10 == 0) & F.col("text").isNotNull(), words).alias("words"), F.floor(h / 10).alias("g"))
    sized = split.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    cycle = sized.withColumn("left", F.col("n") - F.col("a")).withColumn("p", 1 + F.floor(F.col("left") / (3 + F.col("g") % 8)))
    whole = lambda c: F.col(c).cast("int")
    block = F.slice("words", whole("a") + 1, whole("p"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(F.col("left") / F.col("p")).cast("int"))), F.lit(1), whole("left"))
    looped = F.array_join(F.concat(F.slice("words", F.lit(1), whole("a")), tail), " ")
    return cycle.select("doc_id", F.when(F.col("n") > 0, looped).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse(with_loops(table(spark, sf_dir, "documents")))
    # lengths times periods stay far under 2**52, so different ratios are different doubles
    ratio = lambda r: F.struct((-r["length"] / r["period"]).alias("ratio"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    best = F.array_min(F.transform("runs", ratio))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    known = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    rows = rows.filter(known).select("vec_id", shifted.alias("label"), whole.alias("embedding"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


TOXIC_SCORE = 0.5


def op13_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxic_crf.fit(docs, table(spark, sf_dir, "labels"))
    tagged = toxic_crf.tag(docs, model).drop("text")
    return tagged.select(
        "doc_id",
        toxic_crf.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"),
        F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",").alias("toxic_spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piece_codec": op1_piece_codec,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_secret_scan": op3_secret_scan,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_fingerprint": op5_fingerprint,
    "op6_mix_sources": op6_mix_sources,
    "op7_quality_mil": op7_quality_mil,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_chat_format": op9_chat_format,
    "op10_warc": op10_warc,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_toxic_crf": op13_toxic_crf,
}

ORACLE: dict[str, str] = {
    "op3_secret_scan": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source AS owner, source IS NULL AS no_owner, lang FROM documents),
             m AS (SELECT r, 0 AS kind, unnest(range(0, len(regexp_extract_all(t, '{assign}')))) AS i, unnest(regexp_extract_all(t, '{assign}')) AS m,
                          unnest(regexp_extract_all(t, '{assign}', 2)) AS v, unnest(string_split_regex(t, '{assign}')[:-2]) AS p FROM d WHERE regexp_matches(t, '{assign}')
                   {others}),
             s AS (SELECT *, CAST(sum(length(p) + length(m)) OVER (PARTITION BY r, kind ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop,
                          regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 10 AS random FROM m),
             c AS (SELECT r, kind, stop - length(m) AS start, stop, sha256(v) AS v, random FROM s WHERE kind <> 0 OR length(v) >= 6),
             e AS (SELECT * FROM c WHERE kind < 3
                   UNION ALL SELECT * FROM c AS x WHERE kind = 3 AND random
                     AND NOT EXISTS (SELECT 1 FROM c AS b WHERE b.r = x.r AND b.kind < 3 AND b.start < x.stop AND x.start < b.stop)),
             o AS (SELECT v, count(DISTINCT coalesce(d.owner, chr(1))) AS n_owners, count(DISTINCT coalesce(d.owner, chr(1)) || chr(2) || coalesce(d.lang, chr(1))) AS n_repos
                   FROM e JOIN d USING (r) GROUP BY v),
             j AS (SELECT e.*, n_repos, CASE WHEN n_owners >= 3 OR (n_owners > 1 AND n_repos >= 6) THEN 'copied' WHEN n_owners = 1 AND random THEN 'live' ELSE 'shared' END AS status,
                          CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'owned' END || ':' || start || ':' || stop AS line
                   FROM e JOIN o USING (v)),
             g AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
                          string_agg(line, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(line, ',' ORDER BY start, kind) AS spans,
                          count(*) FILTER (status = 'live') AS n_live, count(*) FILTER (status = 'copied') AS n_copied, max(n_repos) AS most_repos
                   FROM j WHERE kind < 3 OR status = 'live' GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
               coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most_repos, 0) AS most_repos
        FROM d LEFT JOIN g USING (r)""".replace(
        "{others}",
        " ".join(
            f"UNION ALL SELECT r, {k}, unnest(range(0, len(regexp_extract_all(t, '{p}')))), unnest(regexp_extract_all(t, '{p}')), unnest(regexp_extract_all(t, '{p}')), "
            f"unnest(string_split_regex(t, '{p}')[:-2]) FROM d WHERE regexp_matches(t, '{p}')"
            for k, p in ((1, secret_scan.ACCESS), (2, secret_scan.HEX), (3, secret_scan.BARE))
        ),
    ).replace("{assign}", secret_scan.ASSIGN.replace("'", "''")),
    "op4_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
             g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g ON n.t = g.t""",
    "op6_mix_sources": """
        WITH s AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 0.5) AS raw FROM documents GROUP BY source),
             t AS (SELECT sum(n) AS all_n, sum(raw) AS all_raw FROM s),
             r AS (SELECT source, CAST(all_n AS DOUBLE) * (raw / all_raw) / n AS rate FROM s, t),
             -- rates over 256 do not occur with these weights, so one draw is enough
             k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 10 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM r),
             c AS (SELECT source, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
             a AS (SELECT source, list(cdf ORDER BY cdf) AS cdf FROM c GROUP BY source),
             d AS (SELECT d.*, len(list_filter(cdf, lambda x: x <= CAST(CAST('0x' || md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|1')[1:13] AS BIGINT) AS DOUBLE) / 4503599627370496)) AS n_copies
                   FROM documents d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
             e AS (SELECT *, unnest(range(0, n_copies)) AS copy_no FROM d)
        SELECT doc_id, text, lang, source, n_chars, n_copies, copy_no,
               md5('mix|order|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy_no) AS shuffle_key FROM e""",
    "op9_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)),
             -- what the template adds: two chars for every backslash, one more for each control string's first char
             f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
                          count(*) OVER (PARTITION BY conv_id) AS n,
                          length(text) + length(regexp_replace(text, '[^\\]', '', 'g'))
                            + (length(text) - length(regexp_replace(text, '\[(/?(INST|SYS|ROLE|TURN)\])', '\1', 'g')))
                            + (length(text) - length(regexp_replace(text, '<(/?s>)', '\1', 'g')))
                            + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 4 END AS chars FROM c),
             s AS (SELECT *, 3 + sum(chars) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM f)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
        FROM s GROUP BY conv_id""",
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same, CAST(list_inner_product(a.q, o.q) AS BIGINT) AS score
                   FROM v AS a JOIN v AS o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id AND len(a.q) = len(o.q)),
             p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
                   QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
        QUALIFY row_number() OVER w <= 5""",
}
