"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"), 8)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnowing import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, taken_by_document

    return taken_by_document(mix(table(spark, sf_dir, "documents")))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .topk import search

    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


#: The rules of the contract.
URL_RULES = ["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/"]


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .url_rules import filter_urls, labels_by_text

    # the tables label documents only: pages are labelled by what such documents say
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, URL_RULES, labels=labels_by_text(pages, table(spark, sf_dir, "documents"), labels))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decode=True, digests=True)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxic_documents

    return toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_copies

    return near_copies(table(spark, sf_dir, "documents"))


def op11_inverted_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .treaps import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster_vectors, with_inertia

    return with_inertia(*cluster_vectors(table(spark, sf_dir, "embeddings"))).drop("scans")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from .packing import pack, pieces

    cut = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pack(cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_winnowing, op3_token_count, op4_mixing, op5_exact_topk, op6_html_text, op7_url_rules, op8_byte_bpe, op9_toxicity, op10_ngram_jaccard, op11_inverted_treaps, op12_hamerly, op13_packing)}


TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id query_id, c.vec_id, cast(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0) as bigint) score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""


JACCARD_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
 i as (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) i from w where len(ws) > 0),
 s as (select distinct doc_id, array_to_string(ws[i:i+4], ' ') sh from i),
 n as (select doc_id, count(*) n from s group by 1),
 p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
 l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
 e as (select a, b from l union all select b, a from l),
 r as (select doc_id id, doc_id root from documents union select e.b, r.root from r join e on e.a = r.id)
select d.doc_id, coalesce(n.n, 0) n_shingles, g.root component_id from documents d left join n using (doc_id) join (select id, min(root) root from r group by 1) g on g.id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    from .centroids import centroid_sql
    from .treaps import search_sql

    return {"op5_exact_topk": TOPK_SQL, "op10_ngram_jaccard": JACCARD_SQL, "op11_inverted_treaps": search_sql(), "op12_hamerly": centroid_sql()}
