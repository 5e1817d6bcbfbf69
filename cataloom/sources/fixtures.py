"""Deterministic catalog fixtures derived from the driver's tables.

Each view is built twice: as a Spark DataFrame (input of our jobs) and as SQL
text (input of the DuckDB oracle). Both read the whole source table; the
modulo conditions only decide which scenario a row plays (in the catalog but
gone from disk, on disk but not catalogued, requested twice, ...), they never
shrink the data to make a check cheaper. Prompts carry the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The two roots of the reference installation and the address
# its image URLs are built on.
OLD_ROOT = "D:\\ttt\\file_path"
NEW_ROOT = "D:\\ttt\\file_new_path"
BASE_URL = "http://127.0.0.1:5000"
# fixed run times, so that results are reproducible (never "now")
CREATED_TS = "2025-01-01 00:00:00"
RUN_TS = "2025-01-02 00:00:00"

_BS = "\\"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_path(root: str) -> F.Column:
    return F.concat(F.lit(root + _BS), F.col("lang"), F.lit(_BS), F.col("doc_id").cast("string"), F.lit(".png"))


def fx_file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return (d.where(F.col("doc_id") % 11 != 5)
             .select((F.col("doc_id") + 1).cast("int").alias("id"),
                     F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("source")).alias("name"),
                     F.col("text").alias("prompt"),
                     F.col("lang").alias("class"),
                     _doc_path(OLD_ROOT).alias("origin_path"),
                     F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("file_name"),
                     (F.col("doc_id") % 5 != 0).alias("path_check"),
                     F.when(F.col("doc_id") % 4 == 0, _doc_path(NEW_ROOT))
                      .when(F.col("doc_id") % 4 == 1, F.lit(""))
                      .otherwise(F.lit(None).cast("string")).alias("target_path"),
                     F.lit(CREATED_TS).cast("timestamp").alias("created_at"),
                     F.lit(None).cast("timestamp").alias("updated_at")))


def fx_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.where(F.col("doc_id") % 10 != 3).select(_doc_path(OLD_ROOT).alias("origin_path"))


def fx_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path that exists: the walked inventory plus converted copies."""
    f = fx_file_list(spark, sf_dir)
    copies = f.where((F.col("target_path") != "") & (F.col("id") % 3 != 0)).select(F.col("target_path").alias("path"))
    return fx_inventory(spark, sf_dir).select(F.col("origin_path").alias("path")).unionByName(copies)


def fx_file_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 10 + F.col("turn") + 1).cast("int").alias("id"),
        (F.col("conv_id") + 1).cast("int").alias("file_list_id"),
        F.when((F.col("conv_id") + F.col("turn")) % 6 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("/images/img"), (F.col("conv_id") + 1).cast("string"), F.lit("_"),
                             F.lpad(F.col("turn").cast("string"), 3, "0"), F.lit(".png"))).alias("image"),
        F.when(F.col("conv_id") % 16 == 0, F.lit(None))
         .when(F.col("conv_id") % 16 == 8, F.lit(0))
         .otherwise(F.col("turn")).cast("int").alias("sort"))


def fx_image_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx_file_image(spark, sf_dir)
    return g.where(F.col("image").isNotNull() & (F.col("sort") % 3 != 2)).select("image")


# Requested ids grow with the tables: most are asked for twice, one is hot
# (about a tenth of the requests), and unknown ones are negative, which no
# document reaches. The expressions are shared with the oracle's SQL.
UPLOAD_ROW = """case when page_id % 23 = 0 then null
     when page_id % 10 = 7 then 5
     else (page_id - page_id % 3) / 3 + 1 end"""
CONVERT_ID = """case when doc_id % 17 = 0 then null
     when doc_id % 19 = 0 then -1 - doc_id
     when doc_id % 10 = 6 then 3
     else (doc_id - doc_id % 4) / 2 + doc_id % 2 + 1 end"""
EDIT_ID = """case when doc_id % 130 = 39 then 27
     when doc_id % 169 = 26 then -1 - doc_id
     else doc_id - doc_id % 26 + 1 end"""
EDIT_PROMPT = "case when doc_id % 39 = 13 then text else concat('prompt of ', source) end"


def fx_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").cast("int").alias("upload_id"),
                    F.expr(f"cast({UPLOAD_ROW} as int)").alias("file_list_id"),
                    (F.col("page_id") % 9 != 4).alias("has_file"))


def fx_convert_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.where(F.col("doc_id") % 3 != 1).select(F.col("doc_id").cast("int").alias("req_id"), F.expr(f"cast({CONVERT_ID} as int)").alias("id"))


def fx_clear_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx_file_list(spark, sf_dir).where(F.col("id") % 3 == 0).select("id", F.col("id").alias("req_id"))


def fx_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return (d.where(F.col("doc_id") % 13 == 0)
             .select(F.col("doc_id").cast("int").alias("req_id"),
                     F.expr(f"cast({EDIT_ID} as int)").alias("id"),
                     F.concat(F.lit("edited_"), F.col("doc_id").cast("string")).alias("name"),
                     F.when(F.col("doc_id") % 26 == 0, F.lit(None).cast("string")).otherwise(F.lit("cls")).alias("class_name"),
                     F.expr(EDIT_PROMPT).alias("prompt")))


# ---------------------------------------------------------------------------
# The same views as SQL text for the DuckDB oracle. chr(92) is the backslash,
# which keeps one text valid for engines with different escape rules.

_ROOT_SQL = "concat('D:', chr(92), 'ttt', chr(92), 'file_path')"
_NEW_ROOT_SQL = "concat('D:', chr(92), 'ttt', chr(92), 'file_new_path')"

FIXTURE_SQL = {
    "fx_file_list": f"""
select cast(doc_id + 1 as int) as id,
       case when doc_id % 7 = 0 then null else source end as name,
       text as prompt,
       lang as class,
       concat({_ROOT_SQL}, chr(92), lang, chr(92), cast(doc_id as varchar), '.png') as origin_path,
       concat(cast(doc_id as varchar), '.png') as file_name,
       doc_id % 5 <> 0 as path_check,
       case when doc_id % 4 = 0 then concat({_NEW_ROOT_SQL}, chr(92), lang, chr(92), cast(doc_id as varchar), '.png')
            when doc_id % 4 = 1 then ''
            else null end as target_path,
       timestamp '{CREATED_TS}' as created_at,
       cast(null as timestamp) as updated_at
from documents
where doc_id % 11 <> 5""",
    "fx_inventory": f"""
select concat({_ROOT_SQL}, chr(92), lang, chr(92), cast(doc_id as varchar), '.png') as origin_path
from documents
where doc_id % 10 <> 3""",
    "fx_existing": """
select origin_path as path from fx_inventory
union
select target_path as path from fx_file_list where target_path <> '' and id % 3 <> 0""",
    "fx_file_image": """
select cast(conv_id * 10 + turn + 1 as int) as id,
       cast(conv_id + 1 as int) as file_list_id,
       case when (conv_id + turn) % 6 = 0 then null
            else concat('/images/img', cast(conv_id + 1 as varchar), '_', lpad(cast(turn as varchar), 3, '0'), '.png') end as image,
       cast(case when conv_id % 16 = 0 then null when conv_id % 16 = 8 then 0 else turn end as int) as sort
from conversations""",
    "fx_image_inventory": """
select image from fx_file_image where image is not null and sort % 3 <> 2""",
    "fx_uploads": f"""
select cast(page_id as int) as upload_id,
       cast({UPLOAD_ROW} as int) as file_list_id,
       page_id % 9 <> 4 as has_file
from pages""",
    "fx_convert_requests": f"""
select cast(doc_id as int) as req_id,
       cast({CONVERT_ID} as int) as id
from documents
where doc_id % 3 <> 1""",
    "fx_clear_requests": """
select id from fx_file_list where id % 3 = 0""",
    "fx_edits": f"""
select cast(doc_id as int) as req_id,
       cast({EDIT_ID} as int) as id,
       concat('edited_', cast(doc_id as varchar)) as name,
       case when doc_id % 26 = 0 then null else 'cls' end as class_name,
       {EDIT_PROMPT} as prompt
from documents
where doc_id % 13 = 0""",
}


def with_fixtures(body: str) -> str:
    """Prefix an oracle query with every fixture view as a CTE."""
    ctes = ",\n".join(f"{name} as ({sql}\n)" for name, sql in FIXTURE_SQL.items())
    return f"with {ctes}\n{body.strip()}"
