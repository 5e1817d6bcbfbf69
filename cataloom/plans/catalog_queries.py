"""Named catalog queries over the fixture views, each paired with the SQL the
DuckDB oracle runs for the same result. Column names are identical on both
sides. Every query reads whole source tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions.paths import dirname, replace_first
from cataloom.operators import changes as ch
from cataloom.operators import edits as ed
from cataloom.operators import images as im
from cataloom.operators import search as se
from cataloom.operators import sync as sy
from cataloom.operators import transfer as tr
from cataloom.operators.joins import measured, scratch_folder
from cataloom.operators.search_index import SearchIndex
from cataloom.schema import rejects
from cataloom.sources import fixtures as fx
from cataloom.sources.fixtures import BASE_URL, NEW_ROOT, OLD_ROOT, RUN_TS, with_fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = with_fixtures(oracle)
        return fn
    return deco


_ROOT = "concat('D:', chr(92), 'ttt', chr(92), 'file_path')"
_NEW_ROOT = "concat('D:', chr(92), 'ttt', chr(92), 'file_new_path')"
_RUN = f"timestamp '{RUN_TS}'"

# ---------------------------------------------------------------- search

@register("catalog_search", """
select id, name, class, prompt, origin_path, file_name, target_path, 1 as img_exist
from fx_file_list
where name like '%src1%' and class like '%e%'""")
def catalog_search(spark, d):
    f = fx.fx_file_list(spark, d)
    return (se.search(f, name="src1", class_="e", collation="binary")
              .select("id", "name", "class", "prompt", "origin_path", "file_name", "target_path", "img_exist"))


@register("catalog_search_ci", """
select id, prompt from fx_file_list where contains(lower(strip_accents(prompt)), 'etion')""")
def catalog_search_ci(spark, d):
    return se.search(fx.fx_file_list(spark, d), prompt="etion").select("id", "prompt")


@register("catalog_search_multi", """
select id, name, class, file_name from fx_file_list
where contains(lower(strip_accents(class)), 'e')
  and contains(lower(strip_accents(file_name)), '12')
  and contains(lower(strip_accents(name)), 'src1')""")
def catalog_search_multi(spark, d):
    f = fx.fx_file_list(spark, d)
    # upper-case terms and a blank term: insensitive match, blank adds nothing
    return (se.search(f, name="SRC1", class_="E", prompt="  \t", file_name="12")
              .select("id", "name", "class", "file_name"))


@register("catalog_search_wildcard", """
select id from fx_file_list where lower(strip_accents(prompt)) like '%q_e%eau%'""")
def catalog_search_wildcard(spark, d):
    return se.search(fx.fx_file_list(spark, d), prompt="Q_E%EAU").select("id")


_SCRIPTS = """concat(prompt, case id % 6 when 0 then ' 한국어 문서' when 1 then ' 𐐀𐐁𐐂' when 2 then ' Große Straße'
                                  when 3 then ' Щёлково' when 4 then ' ŁÓDŹ' else ' 日本語の文書' end)"""


@register("catalog_search_scripts", f"""
, t as (select id, {_SCRIPTS} as p, replace(lower(strip_accents({_SCRIPTS})), 'ß', 'ss') as folded from fx_file_list)
select '한국' as term, id from t where contains(p, '한국')
union all select '국어_문서', id from t where p like '%국어_문서%'
union all select '𐐨𐐩', id from t where contains(lower(p), '𐐨𐐩')
union all select '𐐨_𐐪', id from t where lower(p) like '%𐐨_𐐪%'
union all select 'GROSSE STRASSE', id from t where contains(folded, 'grosse strasse')
union all select 'ELKOVO%', id from t where false
union all select 'щелк_во', id from t where contains(p, 'Щёлково')
union all select 'łódź', id from t where contains(replace(folded, 'ł', 'l'), 'lodz')
union all select '語%書', id from t where p like '%語%書%'""")
def catalog_search_scripts(spark, d):
    """Terms of several scripts, letters of several cases and ``ß``, with and without wildcards."""
    f = fx.fx_file_list(spark, d).withColumn("prompt", F.expr(_SCRIPTS))
    out = None
    for term in ("한국", "국어_문서", "𐐨𐐩", "𐐨_𐐪", "GROSSE STRASSE", "ELKOVO%", "щелк_во", "łódź", "語%書"):
        found = se.search(f, prompt=term).select(F.lit(term).alias("term"), "id")
        out = found if out is None else out.unionByName(found)
    return out


@register("catalog_search_indexed", """
, t as (select id, name, class, file_name, replace(lower(strip_accents(prompt)), 'ß', 'ss') as folded, prompt from fx_file_list)
select 'etion' as term, id from t where contains(folded, 'etion')
union all select 'ÉTION the', id from t where contains(folded, 'etion the')
union all select 'aße', id from t where contains(folded, 'asse')
union all select 'Q_E%EAU', id from t where lower(strip_accents(prompt)) like '%q_e%eau%'
union all select 'he', id from t where contains(folded, 'he')
union all select 'ing src12 en', id from t where contains(folded, 'ing') and contains(lower(name), 'src12') and contains(class, 'en')
union all select 'no such text', id from t where contains(folded, 'no such text')""")
def catalog_search_indexed(spark, d):
    """Searches of one snapshot answered from its trigram index."""
    catalog = measured(fx.fx_file_list(spark, d))
    index = SearchIndex.build(catalog, scratch_folder(spark, "search_index"))
    asked = {"etion": {"prompt": "etion"}, "ÉTION the": {"prompt": "ÉTION the"}, "aße": {"prompt": "aße"}, "Q_E%EAU": {"prompt": "Q_E%EAU"},
             "he": {"prompt": "he"}, "ing src12 en": {"prompt": "ing", "name": "SRC12", "class_": "en"}, "no such text": {"prompt": "no such text"}}
    out = None
    for term, fields in asked.items():
        found = index.search(catalog, **fields).select(F.lit(term).alias("term"), "id")
        out = found if out is None else out.unionByName(found)
    return out


@register("display_rows", """
select id, coalesce(name, '') as name, coalesce(class, '') as class, coalesce(prompt, '') as prompt,
       coalesce(origin_path, '') as origin_path, coalesce(target_path, '') as target_path
from fx_file_list""")
def display_rows(spark, d):
    return se.display_rows(fx.fx_file_list(spark, d))


@register("distinct_first", """
select class, min(id) as first_id from fx_file_list group by class""")
def distinct_first(spark, d):
    return se.distinct_first(fx.fx_file_list(spark, d), ["class"], "id")


@register("table_scan", "select * from labels")
def table_scan(spark, d):
    return se.scan_table(spark, f"{d}/labels.parquet")


@register("search_json", """
select to_json(struct_pack(id := id, name := name, class := class, file_name := file_name, target_path := target_path,
                           updated_at := updated_at, img_exist := 1)) as json
from fx_file_list
where class like '%e%' and file_name like '%7%'""")
def search_json(spark, d):
    found = se.search(fx.fx_file_list(spark, d), class_="e", file_name="7", collation="binary")
    return se.as_json_rows(found.select("id", "name", "class", "file_name", "target_path", "updated_at", "img_exist"))


@register("schema_rejects", """
select id, 'name:length>50' as reason from fx_file_list where length(name) > 50
union all select id, 'prompt:length>255' from fx_file_list where length(prompt) > 255
union all select id, 'class:length>50' from fx_file_list where length(class) > 50
union all select id, 'origin_path:length>255' from fx_file_list where length(origin_path) > 255
union all select id, 'file_name:length>255' from fx_file_list where length(file_name) > 255
union all select id, 'target_path:length>255' from fx_file_list where length(target_path) > 255""")
def schema_rejects(spark, d):
    return rejects(fx.fx_file_list(spark, d), "file_list")

# ---------------------------------------------------------------- paths

@register("path_rewrite", f"""
select id,
       case when instr(origin_path, {_ROOT}) > 0
            then concat(substr(origin_path, 1, instr(origin_path, {_ROOT}) - 1), {_NEW_ROOT},
                        substr(origin_path, instr(origin_path, {_ROOT}) + length({_ROOT})))
            else origin_path end as new_path
from fx_file_list""")
def path_rewrite(spark, d):
    f = fx.fx_file_list(spark, d)
    return f.select("id", replace_first("origin_path", OLD_ROOT, NEW_ROOT).alias("new_path"))


@register("path_dirname", """
select id, regexp_replace(origin_path, concat('[', chr(92), chr(92), '/]+[^', chr(92), chr(92), '/]*$'), '') as dir
from fx_file_list""")
def path_dirname(spark, d):
    return fx.fx_file_list(spark, d).select("id", dirname("origin_path").alias("dir"))

# ---------------------------------------------------------------- sync

@register("sync_new_files", """
select i.origin_path, regexp_extract(i.origin_path, concat('([^/', chr(92), chr(92), ']+)$'), 1) as file_name
from fx_inventory i anti join fx_file_list f on i.origin_path = f.origin_path""")
def sync_new_files(spark, d):
    return sy.new_files(fx.fx_inventory(spark, d), fx.fx_file_list(spark, d))


@register("sync_path_check", """
select f.id, i.origin_path is not null as path_check
from fx_file_list f left join fx_inventory i on i.origin_path = f.origin_path""")
def sync_path_check(spark, d):
    return sy.path_check(fx.fx_file_list(spark, d), fx.fx_inventory(spark, d)).select("id", "path_check")


@register("sync_stats", """
select (select count(*) from fx_inventory) as total_files_in_directory,
       count(case when f.origin_path is null then 1 end) as new_files_added,
       count(*) as total_files_in_database,
       count(case when i.origin_path is null then 1 end) as missing_files
from fx_file_list f full outer join fx_inventory i on i.origin_path = f.origin_path""")
def sync_stats(spark, d):
    return sy.sync_stats(fx.fx_file_list(spark, d), fx.fx_inventory(spark, d))


@register("missing_files", """
select count(*) as missing_files from fx_file_list where path_check = false""")
def missing_files(spark, d):
    return sy.missing_files(fx.fx_file_list(spark, d))


@register("sync_next_catalog", f"""
select f.id, f.origin_path, f.file_name, i.origin_path is not null as path_check, f.created_at, {_RUN} as updated_at
from fx_file_list f left join (select distinct origin_path from fx_inventory) i on i.origin_path = f.origin_path
union all
select cast((select max(id) from fx_file_list) + row_number() over (order by n.origin_path) as int) as id,
       n.origin_path,
       regexp_extract(n.origin_path, concat('([^/', chr(92), chr(92), ']+)$'), 1) as file_name,
       true as path_check, {_RUN} as created_at, cast(null as timestamp) as updated_at
from fx_inventory n anti join fx_file_list f on n.origin_path = f.origin_path""")
def sync_next_catalog(spark, d):
    nxt = sy.next_catalog(fx.fx_file_list(spark, d), fx.fx_inventory(spark, d), RUN_TS)
    return nxt.select("id", "origin_path", "file_name", "path_check", "created_at", "updated_at")

# ---------------------------------------------------------------- convert / clear

_CONVERT_SQL = """
select req_id, id, name,
       case when pre = 'ok' and row_number() over (partition by new_path, pre order by req_id) > 1 then 'target_exists'
            when pre = 'ok' then 'converted'
            else pre end as status,
       new_path
from (select r.req_id, r.id, f.name, f.new_path,
             case when r.id is null or r.id = 0 then 'missing_id'
                  when f.id is null then 'not_found'
                  when t.path is not null then 'target_exists'
                  when s.path is null then 'source_missing'
                  when length(f.new_path) > 255 then 'rejected'
                  else 'ok' end as pre
      from fx_convert_requests r
      left join (select id, name, origin_path,
                        replace(origin_path, concat('D:', chr(92), 'ttt', chr(92), 'file_path'),
                                concat('D:', chr(92), 'ttt', chr(92), 'file_new_path')) as new_path
                 from fx_file_list) f on f.id = r.id
      left join fx_existing t on t.path = f.new_path
      left join fx_existing s on s.path = f.origin_path) x"""


def _convert(spark, d):
    return tr.convert_plan(fx.fx_convert_requests(spark, d), fx.fx_file_list(spark, d),
                           fx.fx_existing(spark, d), OLD_ROOT, NEW_ROOT)


@register("convert_plan", _CONVERT_SQL)
def convert_plan(spark, d):
    return _convert(spark, d).select("req_id", "id", "name", "status", "new_path")


@register("convert_commit", f"""
, done as (select id, min(new_path) as new_path from ({_CONVERT_SQL}) c where status = 'converted' group by id)
select f.id, case when done.id is not null then done.new_path else f.target_path end as target_path,
       case when done.id is not null then {_RUN} else f.updated_at end as updated_at
from fx_file_list f left join done on done.id = f.id""")
def convert_commit(spark, d):
    nxt = tr.convert_commit(fx.fx_file_list(spark, d), _convert(spark, d), RUN_TS)
    return nxt.select("id", "target_path", "updated_at")


@register("catalog_folded", f"""
, done as (select id, min(new_path) as new_path from ({_CONVERT_SQL}) c where status = 'converted' group by id),
  last as (select * from (select *, row_number() over (partition by id order by req_id desc) as rn from fx_edits
                          where coalesce(length(name), 0) <= 50 and coalesce(length(class_name), 0) <= 50 and coalesce(length(prompt), 0) <= 255) where rn = 1),
  copied as (select f.*, coalesce(done.new_path, f.target_path) as now_path, done.id is not null as made from fx_file_list f left join done on done.id = f.id)
select f.id, case when e.id is not null then e.name else f.name end as name, case when e.id is not null then e.class_name else f.class end as class,
       case when e.id is not null then e.prompt else f.prompt end as prompt,
       case when r.id is not null and g.target_path = f.now_path then null else f.now_path end as target_path,
       case when made or e.id is not null then {_RUN} else f.updated_at end as updated_at
from copied f left join last e on e.id = f.id left join fx_file_list g on g.id = f.id
     left join (select distinct c.id from fx_clear_requests c join fx_file_list b on b.id = c.id where b.target_path <> '') r on r.id = f.id""")
def catalog_folded(spark, d):
    """Appended batches folded into the catalog: edits that later ones replace, copies, clears of what was there before, edits."""
    f, edits = fx.fx_file_list(spark, d), fx.fx_edits(spark, d)
    older = edits.withColumn("name", F.lit("older")).withColumn("prompt", F.lit(None).cast("string"))
    # where the last edit is refused for its length, an older batch has none either
    older = older.join(ed.last_edit_per_id(edits).select("id"), "id", "left_semi")
    batches = [ch.edit_changes(f, older, fx.CREATED_TS, 1, "a"), ch.copy_changes(_convert(spark, d), RUN_TS, 2, "b", "status"),
               ch.clear_changes(tr.clear_plan(fx.fx_clear_requests(spark, d), f, order="id"), 3, "c"), ch.edit_changes(f, edits, RUN_TS, 4, "d")]
    changes = batches[0]
    for more in batches[1:]:
        changes = changes.unionByName(more)
    return ch.fold(f, changes).select("id", "name", "class", "prompt", "target_path", "updated_at")


@register("clear_targets", """
select f.id,
       case when coalesce(f.target_path, '') = '' then 'already_clear' else 'cleared' end as status,
       case when f.target_path = '' then f.target_path else cast(null as varchar) end as target_path
from fx_file_list f join fx_clear_requests r on r.id = f.id""")
def clear_targets(spark, d):
    plan = tr.clear_plan(fx.fx_clear_requests(spark, d), fx.fx_file_list(spark, d), "req_id")
    return plan.select("id", "status", F.col("new_target_path").alias("target_path"))


@register("clear_commit", """
select f.id,
       case when r.id is not null and coalesce(f.target_path, '') <> '' then cast(null as varchar)
            else f.target_path end as target_path,
       f.updated_at
from fx_file_list f left join (select distinct id from fx_clear_requests) r on r.id = f.id""")
def clear_commit(spark, d):
    f = fx.fx_file_list(spark, d)
    plan = tr.clear_plan(fx.fx_clear_requests(spark, d), f, "req_id")
    return tr.clear_commit(f, plan).select("id", "target_path", "updated_at")

# ---------------------------------------------------------------- edits

@register("apply_edits", f"""
select f.id,
       case when e.id is not null then e.name else f.name end as name,
       case when e.id is not null then e.class_name else f.class end as class,
       case when e.id is not null then e.prompt else f.prompt end as prompt,
       case when e.id is not null then {_RUN} else f.updated_at end as updated_at
from fx_file_list f
left join (select * from (select id, name, class_name, prompt,
                                 row_number() over (partition by id order by req_id desc) as rn
                          from fx_edits where not coalesce(length(name) > 50 or length(class_name) > 50 or length(prompt) > 255, false)) y
           where rn = 1) e on e.id = f.id""")
def apply_edits(spark, d):
    out = ed.apply_edits(fx.fx_file_list(spark, d), fx.fx_edits(spark, d), RUN_TS)
    return out.select("id", "name", "class", "prompt", "updated_at")


@register("edit_report", """
select e.req_id, e.id,
       case when e.id is null then 'missing_id'
            when f.id is null then 'not_found'
            when e.refused then 'rejected'
            when e.req_id = max(case when not e.refused then e.req_id end) over (partition by e.id) then 'applied'
            else 'superseded' end as status
from (select *, coalesce(length(name) > 50 or length(class_name) > 50 or length(prompt) > 255, false) as refused from fx_edits) e
left join fx_file_list f on f.id = e.id""")
def edit_report(spark, d):
    return ed.edit_report(fx.fx_file_list(spark, d), fx.fx_edits(spark, d))

# ---------------------------------------------------------------- images

@register("image_assign", """
select upload_id, file_list_id, sort,
       case when has_file then printf('/images/img%d_%03d.png', file_list_id, sort) end as image
from (select u.upload_id, u.file_list_id, u.has_file,
             cast(coalesce(m.mx, 0) + row_number() over (partition by u.file_list_id order by u.upload_id) as int) as sort
      from fx_uploads u
      left join (select file_list_id, max(sort) as mx from fx_file_image group by file_list_id) m
        on m.file_list_id = u.file_list_id
      where u.file_list_id is not null) x""")
def image_assign(spark, d):
    return im.image_assign(fx.fx_uploads(spark, d), fx.fx_file_image(spark, d))


@register("image_commit", f"""
, assigned as (
    select u.upload_id, u.file_list_id,
           case when u.has_file then printf('/images/img%d_%03d.png', u.file_list_id,
               cast(coalesce(m.mx, 0) + row_number() over (partition by u.file_list_id order by u.upload_id) as int)) end as image,
           cast(coalesce(m.mx, 0) + row_number() over (partition by u.file_list_id order by u.upload_id) as int) as sort
    from fx_uploads u
    left join (select file_list_id, max(sort) as mx from fx_file_image group by file_list_id) m
      on m.file_list_id = u.file_list_id
    where u.file_list_id is not null)
select id, file_list_id, image, sort, cast(null as timestamp) as created_at from fx_file_image
union all
select cast((select max(id) from fx_file_image) + row_number() over (order by upload_id) as int) as id,
       file_list_id, image, sort, {_RUN} as created_at
from assigned""")
def image_commit(spark, d):
    images = fx.fx_file_image(spark, d)
    # written once: the second numbering reads it for its bounds and its rows
    assigned = im.image_assign(fx.fx_uploads(spark, d), images).checkpoint()
    out = im.image_commit(images, assigned, RUN_TS)
    return out.select("id", "file_list_id", "image", "sort", "created_at")


@register("upload_status", """
select u.upload_id, u.file_list_id,
       case when u.file_list_id is null then 'missing_id' when not u.has_file then 'no_file' else 'numbered' end as status,
       case when u.file_list_id is not null then s.sort end as sort,
       case when u.file_list_id is not null and u.has_file then printf('/images/img%d_%03d.png', u.file_list_id, s.sort) end as image
from fx_uploads u
join (select v.upload_id, cast(coalesce(m.mx, 0) + row_number() over (partition by v.file_list_id order by v.upload_id) as int) as sort
      from fx_uploads v
      left join (select file_list_id, max(sort) as mx from fx_file_image group by file_list_id) m
        on m.file_list_id = v.file_list_id) s on s.upload_id = u.upload_id""")
def upload_status(spark, d):
    uploads = fx.fx_uploads(spark, d)
    return im.upload_status(uploads, im.image_assign(uploads, fx.fx_file_image(spark, d)))


@register("gallery_for_ids", f"""
, found as (select g.file_list_id, g.sort, g.image, i.image is not null as present
            from fx_file_image g left join (select distinct image from fx_image_inventory) i on i.image = g.image),
asked as (select distinct file_list_id from fx_uploads),
counted as (select a.file_list_id, count(f.file_list_id) as n_rows, count(case when f.present then 1 end) as n_present
            from asked a left join found f on f.file_list_id = a.file_list_id group by a.file_list_id)
select f.file_list_id, 'ok' as status, f.sort, f.image, concat('/static/', f.image) as image_url,
       concat('{BASE_URL}', '/static/', f.image) as full_url
from found f semi join asked a on a.file_list_id = f.file_list_id where f.present
union all
select file_list_id, case when n_rows = 0 then 'no_image_rows' else 'no_image_files' end,
       cast(null as int), cast(null as varchar), cast(null as varchar), cast(null as varchar)
from counted where n_present = 0""")
def gallery_for_ids(spark, d):
    return im.gallery_for_ids(fx.fx_uploads(spark, d), fx.fx_file_image(spark, d), fx.fx_image_inventory(spark, d), BASE_URL)


@register("image_gallery", f"""
select g.file_list_id, g.sort, g.image, concat('/static/', g.image) as image_url,
       concat('{BASE_URL}', '/static/', g.image) as full_url
from fx_file_image g semi join fx_image_inventory i on i.image = g.image""")
def image_gallery(spark, d):
    return im.gallery(fx.fx_file_image(spark, d), fx.fx_image_inventory(spark, d), BASE_URL)


@register("gallery_status", """
select a.file_list_id, coalesce(p.n_rows, 0) as n_rows, coalesce(p.n_present, 0) as n_present,
       case when coalesce(p.n_rows, 0) = 0 then 'no_image_rows'
            when coalesce(p.n_present, 0) = 0 then 'no_image_files' else 'ok' end as status
from (select distinct file_list_id from fx_uploads) a
left join (select g.file_list_id, count(*) as n_rows, count(i.image) as n_present
           from fx_file_image g left join (select distinct image from fx_image_inventory) i on i.image = g.image
           group by g.file_list_id) p on p.file_list_id = a.file_list_id""")
def gallery_status(spark, d):
    return im.gallery_status(fx.fx_uploads(spark, d), fx.fx_file_image(spark, d), fx.fx_image_inventory(spark, d))


@register("catalog_images", """
select f.id, f.file_name, count(g.image) as n_images, max(g.sort) as max_sort
from fx_file_list f left join fx_file_image g on g.file_list_id = f.id
group by f.id, f.file_name""")
def catalog_images(spark, d):
    return im.catalog_images(fx.fx_file_list(spark, d), fx.fx_file_image(spark, d))
