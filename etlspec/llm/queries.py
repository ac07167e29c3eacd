"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etlspec.llm import (
    chat,
    clustering,
    decontaminate,
    langid,
    licenses,
    lines,
    manifest,
    packing,
    pseudonyms,
    quality,
    sharding,
    simhash,
    topk,
)
from etlspec.llm.common import ascii_lower, held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_sum_of_squares_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def word_tokenizer(name: str = "word_bpe_49k.json") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query(
    "op1_line_dedup",
    r"""
    WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
    totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
    seen AS (SELECT source, line, count(*) AS n FROM (
        SELECT DISTINCT source, text, trim(x) AS line FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS x FROM pages)
    ) WHERE line <> '' GROUP BY source, line),
    bad AS (SELECT s.source, list(s.line) AS lines FROM seen s JOIN totals t ON s.source IS NOT DISTINCT FROM t.source
        WHERE s.n >= 5 AND s.n > 0.02 * t.pages GROUP BY s.source),
    cut AS (SELECT d.doc_id, string_split(d.text, chr(10)) AS ls, coalesce(b.lines, []) AS lines
        FROM documents d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source)
    SELECT doc_id, array_to_string(list_filter(ls, lambda x: NOT list_contains(lines, trim(x))), chr(10)) AS text,
        len(ls) - len(list_filter(ls, lambda x: NOT list_contains(lines, trim(x)))) AS n_dropped_lines FROM cut
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_dropped_lines")


@query(
    "op3_benchmark_decontamination",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS x
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT k FROM bw),
    dw AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS x
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
    hit AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.x = bw.x),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
        sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op6_stratified_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    slim = docs.select("doc_id", "source", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    placed = sharding.shard(slim, 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


@query(
    "op2_exact_top_k",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored QUALIFY rank <= 5
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@query("op4_format_preserving_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), key="etlspec documents 1")
    return done.select("doc_id", "text", F.to_json("pii").alias("pii"))


@query("op9_chat_formatting")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = chat.read_back(chat.format_windows(turns))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    part = F.struct("window", F.size("turns").alias("n"), spoken.alias("spoken"), F.array_join("targets", "").alias("loss"), "n_chars")
    parts = back.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    total = lambda name: F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p[name])
    whole = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return parts.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(whole("spoken"), 256).alias("turns_sha256"),
        F.char_length(whole("loss")).cast("long").alias("loss_chars"),
        F.sha2(whole("loss"), 256).alias("loss_sha256"),
        total("n_chars").alias("formatted_chars"),
    )


@query("op11_license_scan", licenses.scan_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["places"].isNotNull())
    places = F.flatten(F.transform(base, lambda m: m["places"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(licenses.labels(base), ",").alias("base_labels"),
        F.array_join(licenses.labels("matches"), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("score"),
    )


@query("op12_merkle_manifest", manifest.manifest_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(changed, manifest.leaf_digest(*told, ascii_lower(F.col("text"))))
    leaves = docs.select("doc_id", "source", manifest.leaf_digest(*told, F.col("text")).alias("leaf"), tampered.alias("tampered"))
    tree = manifest.manifest(leaves, keep=["tampered"])
    return tree.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        manifest.proof_digest("proof").alias("proof_sha256"),
        manifest.fold(F.coalesce("tampered", "leaf"), "proof").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_centroid_clustering", clustering.cluster_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.cluster(table(spark, sf_dir, "embeddings"))
    each = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    of = lambda values, kind: F.get(F.array(*map(F.lit, values)), F.col("cluster")).cast(kind)
    return found.assigned.select(
        "vec_id",
        "cluster",
        "distance",
        of(found.inertia, "long").alias("cluster_inertia"),
        F.lit(sum(found.inertia)).cast("long").alias("inertia"),
        of(each, "string").alias("centroid_sha256"),
    )
