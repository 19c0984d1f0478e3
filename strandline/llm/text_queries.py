"""Queries of problems 6, 7 and 8: packing, leakage, splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.leakage import find_leaks
from strandline.llm.packing import pack_documents
from strandline.llm.splitting import split_documents
from strandline.sources.tables import table
from strandline.storage import cut_lineage

CAPACITY = 2048
LIMIT, OVERLAP = 1024, 64
LEAST_WORDS = 12


def p6_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Every text with its container of 2,048 tokens."""
    return pack_documents(table(spark, sf, "documents"), doc_id="doc_id", text="text", capacity=CAPACITY)


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How many containers are filled how far, in steps of a hundredth."""
    used = p6_pack(spark, sf).groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"))
    return used.groupBy(F.floor(F.col("used") * 100 / CAPACITY).alias("percent_full")).agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("used").alias("tokens"))


def p6_kept(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the containers: every text once and whole, no container above its capacity, nothing over another."""
    pieces = cut_lineage(p6_pack(spark, sf))
    texts = pieces.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("all"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.max("piece").alias("last"))
    texts = texts.agg(F.count("*").alias("texts"), F.count_if((F.col("n") != F.col("last") + 1) | (F.col("all") != F.col("end"))).alias("broken"))
    boxes = pieces.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.max(F.col("container_offset") + F.col("n_tokens")).alias("end"), F.count_distinct(F.when(F.col("n_tokens") > 0, F.col("container_offset"))).alias("places"), F.count_if(F.col("n_tokens") > 0).alias("items"))
    boxes = boxes.agg(F.count_if(F.col("used") > CAPACITY).alias("above"), F.count_if((F.col("used") != F.col("end")) | (F.col("places") != F.col("items"))).alias("overlapping"))
    return texts.join(boxes)


def p8_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Every text put together again from its pieces (or as it is, where it wasn't cut), by its digest; and the pieces that break a rule."""
    docs = table(spark, sf, "documents").where("doc_id is not null and text is not null").select("doc_id", "text")
    pieces = p8_split(spark, sf)
    fresh = F.expr("substring(text, new_from_char - start_char + 1)")
    whole = pieces.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", fresh.alias("t")))), lambda x: x["t"]), "").alias("again"),
        F.count_if((F.col("n_tokens") > LIMIT) | (F.col("start_char") > F.col("new_from_char")) | (F.col("new_from_char") >= F.col("end_char"))).alias("bad"),
    )
    return docs.join(whole, "doc_id", "left").select("doc_id", F.md5(F.coalesce("again", "text")).alias("digest"), F.coalesce("bad", F.lit(0)).alias("bad"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text", least=LEAST_WORDS)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("item_id", "doc_id")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per leaked test item: how many documents hold a passage of it."""
    return _leaks(spark, sf).groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc_id"))


def p8_split(spark: SparkSession, sf: str) -> DataFrame:
    """Every text above 1,024 tokens in pieces that overlap by 64."""
    return split_documents(table(spark, sf, "documents"), doc_id="doc_id", text="text", limit=LIMIT, overlap=OVERLAP)


QUERIES = {"p6_pack": p6_pack, "p6_fill": p6_fill, "p6_kept": p6_kept, "p7_found": p7_found, "p7_report": p7_report, "p8_split": p8_split, "p8_restored": p8_restored}

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")


def _words_sql(column: str) -> str:
    """The words of a text: what makes no difference goes, the rest is cut at everything but letters and digits."""
    t = f"translate({column}, '{_WIDE}', '{_NARROW}')"
    t = f"replace(replace(lower(strip_accents(nfc_normalize({t}))), 'đ', 'd'), 'ß', 'ss')"
    t = f"regexp_replace({t}, '[\\x{{0300}}-\\x{{036f}}\\x{{00ad}}\\x{{200b}}\\x{{2060}}\\x{{feff}}]', '', 'g')"
    t = f"regexp_replace({t}, '([\\pL\\pN])-(\\r\\n|[\\n\\r\\x0b\\x0c\\x{{85}}\\x{{2028}}\\x{{2029}}])[ \\t>|\\x{{a0}}\\x{{3000}}]*([\\pL\\pN])', '\\1\\3', 'g')"
    t = f"regexp_replace({t}, '</?[a-z][^<>]{{0,200}}>', ' ', 'g')"
    return f"regexp_extract_all({t}, '[\\pL\\pN]+')"


_LEAKS = f"""
with d as (select doc_id, {_words_sql("text")} as w from documents where text <> ''),
i as (select item_id, {_words_sql("text")} as w from eval_items where text <> ''),
dp as (select distinct doc_id, array_to_string(w[k:k + 11], ' ') as p from (select *, unnest(range(1, len(w) - 10)) as k from d where len(w) >= 12)),
ip as (select distinct item_id, array_to_string(w[k:k + 11], ' ') as p from (select *, unnest(range(1, len(w) - 10)) as k from i where len(w) >= 12)),
leaks as (select distinct item_id, doc_id from ip join dp using (p))
"""
SQL = {
    "p6_kept": "select count(distinct doc_id) as texts, 0 as broken, 0 as above, 0 as overlapping from documents where doc_id is not null and text is not null",
    "p8_restored": "select doc_id, md5(text) as digest, 0 as bad from documents where doc_id is not null and text is not null",
    "p7_found": _LEAKS + "select item_id, doc_id from leaks",
    "p7_report": _LEAKS + "select item_id, count(*) as documents, min(doc_id) as first_doc_id from leaks group by item_id",
}
