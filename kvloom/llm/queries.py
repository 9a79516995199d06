"""The registered queries of this folder: thin views of the operators over the tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path
from .decontamination import leaks
from .exact_dedup import exact_groups
from .language_id import fit as fit_languages
from .language_id import predicted
from .license_scan import license_matches
from .line_dedup import line_summary
from .mixing import mixed
from .mixing import oracle as mixing_oracle
from .simhash import simhash_groups
from .substring_dedup import repeats
from .toxicity import fit as fit_toxicity
from .toxicity import scored
from .warc import read_warc, write_warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def held_out(column: str, folds: int, fold: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds == fold


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_summary(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    found = scored(docs, fit_toxicity(docs, labels))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(~held_out("doc_id", 4, 2)))
    return predicted(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_license_scan": op3_license_scan,
    "op4_decontamination": op4_decontamination,
    "op5_mixing": op5_mixing,
    "op6_warc": op6_warc,
    "op7_simhash": op7_simhash,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
        with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as no from documents),
        sets as (select doc_id, no, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) as words from lines),
        classes as (select words, len(words) as n, min((doc_id, no)) as first, row_number() over (order by min((doc_id, no))) as c from sets where len(words) > 0 group by words),
        often as (select w, count(*) as f from (select unnest(words) as w from classes) group by w),
        ranked as (select c, n, w, row_number() over (partition by c order by f, w) as pos from (select c, n, unnest(words) as w from classes) join often using (w)),
        prefix as (select c, n, w from ranked where pos <= n - (n * 80 + 99) // 100 + 1),
        near as (select distinct a.c as x, b.c as y from prefix a join prefix b on a.w = b.w and a.c <> b.c and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
        alike as (select x, y, b.first as other from near join classes a on a.c = x join classes b on b.c = y where len(list_intersect(a.words, b.words)) * 180 >= (a.n + b.n) * 80),
        facts as (select c, words, first, count(y) as links, min(other) as other from classes left join alike on x = c group by c, words, first)
        select doc_id, min(first[1]) as class_id, count(*) as n_lines, coalesce(sum(((doc_id, no) > first or coalesce((doc_id, no) > other, false))::int), 0)::bigint as n_removed, coalesce(sum(links), 0)::bigint as n_links
        from sets left join facts using (words) group by doc_id""",
    "op6_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages), h as (select page_id, sha1(html) as sha, strlen(html) as n from p), g as (select sha, n, max(page_id) as top from h group by sha, n)
        select page_id, n as payload_bytes,
               list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, 1 + 5 * (i // 4), 5))::int >> (15 - 5 * (i % 4))::int) & 31), 1)), 'string_agg', '') as payload_digest,
               case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to
        from h join g using (sha, n)""",
    "op8_substring_dedup": r"""
        with docs as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
        starts as (select doc_id, unnest(range(1, len(words) - 11)) as i, words from docs where len(words) >= 13),
        windows as (select doc_id, i, array_to_string(words[i:i + 12], ' ') as w from starts),
        lowest as (select w, min(doc_id) as low from windows group by w),
        gone as (select distinct doc_id, unnest(range(i, i + 13)) as j from windows join lowest using (w) where low < doc_id),
        each as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as j from docs),
        kept as (select e.doc_id, count(*) filter (g.j is not null) as n_removed, coalesce(string_agg(case when g.j is null then word end, ' ' order by e.j), '') as t from each e left join gone g on g.doc_id = e.doc_id and g.j = e.j group by e.doc_id)
        select d.doc_id, len(d.words) as n_words, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256 from docs d left join kept k using (doc_id)""",
    "op5_mixing": mixing_oracle(),
    "op9_exact_dedup": r"""
        with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
             g as (select t, min(doc_id) as keep_id, count(*) as group_size from n group by t)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(n.t) as text_sha256 from n join g on n.t = g.t""",
}
