"""The registered queries of the corpus operators, each over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokenizers
from .best_fit_packing import pack_best_fit
from .exact_dedup import exact_duplicates
from .jaccard_join import link_components
from .language_id import id_remainder, predict_languages
from .line_dedup import drop_repeated_lines
from .ogg import stored_media
from .pii import PATTERNS, SECRET, find_personal_data, of_kind, spans_text, with_extra
from .pieces import piece_ids
from .shared import read_documents
from .simhash import near_components
from .token_store import tokens_of
from .toxicity import score_toxicity
from .whitening import whiten


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_best_fit(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=0, size=2048)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = predict_languages(read_documents(spark, sf_dir))
    return found.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_extra(*find_personal_data(read_documents(spark, sf_dir)))
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in PATTERNS]
    every = F.concat("base", F.filter("extra", of_kind(*PATTERNS)))
    secrets = spans_text(F.filter("extra", of_kind(SECRET))).alias("secrets")
    return rows.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(every).alias("spans"), F.size(every).cast("long").alias("n_spans"), secrets)


def op4_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens_of(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return rows.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(read_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op6_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_media(read_documents(spark, sf_dir))
    seconds = F.format_string("%.6f", F.element_at("times", -1))
    feature = F.format_string("streams=%d pages=%d packets=%d bad_pages=%d seconds=%s", "streams", "pages", "packets", "bad_pages", seconds)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        feature.alias("feature"),
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = piece_ids(read_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.array_join("ids", ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = drop_repeated_lines(read_documents(spark, sf_dir), min_docs=10, min_points=1)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where it exceeds 64 bits."""
    rows = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=4, scale=256)
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read_documents(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


LLM_QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_personal_data": op3_personal_data,
    "op4_elias_fano": op4_elias_fano,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_ogg": op6_ogg,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_line_dedup": op8_line_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_whitening": op11_whitening,
    "op12_simhash": op12_simhash,
    "op13_alignment": op13_alignment,
}

LLM_ORACLES = {
    "op5_jaccard_join": """
        with recursive words as (
            select row_number() over () as rid, doc_id,
                   list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                               'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D\\x20]+'), lambda w: w <> '') as ws
            from documents
        ), placed as (select rid, len(ws) as n, unnest(ws) as w, generate_subscripts(ws, 1) as i from words where len(ws) >= 5),
        grams as (
            select distinct rid, g from (
                select rid, n, i, concat_ws(' ', w, lead(w, 1) over p, lead(w, 2) over p, lead(w, 3) over p, lead(w, 4) over p) as g
                from placed window p as (partition by rid order by i)) where i <= n - 4
            union all select rid, array_to_string(ws, ' ') from words where len(ws) between 1 and 4
        ), sets as (select w.rid, doc_id, count(g) as n from words w left join grams g on g.rid = w.rid group by 1, 2),
        pairs as (select a.rid as a, b.rid as b, count(*) as n from grams a join grams b on a.g = b.g and a.rid <> b.rid group by 1, 2),
        links as (select a, b from pairs p join sets x on x.rid = a join sets y on y.rid = b where 100 * p.n >= 80 * (x.n + y.n - p.n)),
        reach as (select rid, rid as other from sets union select r.rid, l.b from reach r join links l on l.a = r.other)
        select s.doc_id, s.n as n_shingles, least.component_id
        from sets s join (select r.rid, min(o.doc_id) as component_id from reach r join sets o on o.rid = r.other group by 1) least on least.rid = s.rid
    """,
    "op8_line_dedup": """
        with lines as (
            select rid, doc_id, line, line_no,
                   translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
            from (select rid, doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as line_no
                  from (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))
        ), frequent as (
            select key from lines where length(key) >= 1 group by key having count(distinct rid) >= 10
        )
        select doc_id, count(*) as n_lines, count(f.key) as n_dropped,
               sha256(coalesce(string_agg(l.line, chr(10) order by line_no) filter (where f.key is null), '')) as kept_sha256
        from lines l left join frequent f on l.key = f.key
        group by rid, doc_id
    """,
    "op9_exact_dedup": """
        with groups as (
            select coalesce(text, '') as t, max(doc_id) as keep_id, count(*) as group_size from documents group by 1
        )
        select d.doc_id, g.keep_id, g.group_size, d.doc_id is not distinct from g.keep_id as kept,
               sha256(g.t) as text_sha256
        from documents d join groups g on coalesce(d.text, '') = g.t
    """,
}
