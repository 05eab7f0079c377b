"""The registered archive queries once more, as SQL for DuckDB."""

from html.entities import html5

_DOMAIN = "regexp_extract(lower(url), '^https?://([^/:?#]+)', 1)"
_FILE = "concat(page_id, '.html')"
_TASKS = """tasks as (
  select event_id id, concat('https://u', user_id, '.example/') url, ts created_at,
         case event_type when 'signup' then 'pending' when 'view' then 'running' when 'error' then 'failed' else 'success' end status
  from events)"""
_NEWEST = "row_number() over (partition by url order by created_at desc, id)"
_FILES = f"f as (select {_DOMAIN} domain, {_FILE} filename from pages where page_id % 10 <> 3)"
_INDEX = f"""d as (
  select concat('d', page_id) id, {_DOMAIN} domain, {_FILE} filename from pages where page_id % 7 <> 2
  union all select concat('x', page_id), {_DOMAIN}, {_FILE} from pages where page_id % 11 = 0)"""
_KEYS = "dk as (select domain, filename, count(*) n from d group by domain, filename)"
_ISSUES = """iss as (
  select 'warning' severity, 'meilisearch' store, 'doc_missing' code, f.domain, f.filename
  from f left join dk using (domain, filename) where dk.n is null
  union all select 'warning', 'meilisearch', 'doc_duplicate', f.domain, f.filename from f join dk using (domain, filename) where dk.n > 1
  union all select 'error', 'meilisearch', 'doc_orphan', dk.domain, dk.filename
  from dk left join f on dk.domain = f.domain and dk.filename = f.filename where f.domain is null)"""
_TITLES = """p as (select page_id, regexp_extract(html, '(?i)<title>(.*?)</title>', 1) title
  from pages where regexp_matches(html, '(?i)<title>(.*?)</title>'))"""
_TERMS = r"tok as (select page_id, unnest(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+')) t from p)"


def _counts(where: str = "true", extra: str = "") -> str:
    return f"select {_DOMAIN} source, count(*) {extra} file_count from pages where {where} group by 1"


SQL = {
    "title_extract": f"with {_TITLES} select page_id, title from p",
    "url_normalize": f"select page_id, regexp_replace(trim(url), '#.*$', '') url, {_DOMAIN} as domain from pages",
    "source_stats": _counts(),
    "stats_snapshot": f"select cast(sum(file_count) as bigint) total_files, count(*) sources from ({_counts(extra='- 3')}) where file_count >= 0",
    "source_share": f"""with t as ({_counts()})
select source, file_count, cast(floor(100.0 * file_count / sum(file_count) over () + 0.5) as bigint) pct,
       row_number() over (order by file_count desc, source) rnk from t""",
    "stats_upsert": f"""select source, cast(sum(file_count) as bigint) file_count
from ({_counts('page_id % 2 = 0')} union all {_counts('page_id % 2 = 1')}) group by source""",
    "stats_decrement": f"""with b as ({_counts()}), c as ({_counts('page_id % 3 = 0')})
select b.source, b.file_count - coalesce(c.file_count, 0) file_count from b left join c using (source)
where c.file_count is null or b.file_count > c.file_count""",
    "task_latest": f"with {_TASKS} select id, url, status from (select *, {_NEWEST} rn from tasks) where rn = 1",
    "task_active": f"""with {_TASKS}
select id, url, status from (select *, {_NEWEST} rn from tasks where status in ('pending', 'running')) where rn = 1""",
    "task_recovery": f"""with {_TASKS}
select id, status, row_number() over (order by created_at, id) pos from tasks where status in ('pending', 'running')""",
    "task_submit": f"""with {_TASKS},
a as (select url, bool_or(status in ('pending', 'running')) busy from tasks group by url),
l as (select url, status from (select *, {_NEWEST} rn from tasks) where rn = 1)
select url, case when busy then 'reuse_active' when status = 'success' then 'reuse_success' else 'create' end decision
from a join l using (url)""",
    "task_http_code": f"with {_TASKS} select id, cast(case when status in ('pending', 'running') then 202 else 200 end as bigint) code from tasks",
    "users_page": "select c_custkey id, c_name username, count(*) over () total from customer order by c_custkey limit 10 offset 20",
    "consistency_files": f"""with {_FILES}, {_INDEX}, {_KEYS}
select coalesce(f.domain, dk.domain) as domain, coalesce(f.filename, dk.filename) filename,
       case when dk.n is null then 'doc_missing' when f.domain is null then 'doc_orphan' else 'doc_duplicate' end code
from f full outer join dk on f.domain = dk.domain and f.filename = dk.filename
where dk.n is null or f.domain is null or dk.n > 1""",
    "consistency_stats": f"""with disk as ({_counts('page_id % 10 <> 3')}),
db as ({_counts('page_id % 5 <> 4')} union all select 'gone.example', 4)
select coalesce(disk.source, db.source) source, disk.file_count disk_count, db.file_count db_count,
       case when disk.source is null then 'stat_source_stale' else 'stat_source_mismatch' end code
from disk full outer join db on disk.source = db.source
where disk.source is null or coalesce(db.file_count, 0) <> disk.file_count""",
    "consistency_merge": f"""with {_FILES}, {_INDEX}, {_KEYS}, {_ISSUES}
select distinct * from (select * from iss union all select * from iss where severity = 'error')""",
    "consistency_report": f"""with {_FILES}, {_INDEX}, {_KEYS}, {_ISSUES}
select (select count(*) from f) html_files, (select count(*) from d) meili_documents,
       (select count(*) from iss where severity = 'warning') recoverable,
       (select count(*) from iss where severity = 'error') unrecoverable, (select count(*) from iss) = 0 consistent""",
    "delete_cascade": f"with {_INDEX} select id from d where id not in (select id from d where filename = '11.html')",
    "text_erase": r"select doc_id, length(x) n, md5(x) h from (select doc_id, regexp_replace(text, ' |\n|\r|\\n', '', 'g') x from documents)",
    "search_frequency": f"""with {_TITLES}, {_TERMS},
m as (select page_id, max(case when t = 'the' then 1 else 0 end) w1, max(case when t like 'th%' then 1 else 0 end) w2,
             sum(case when t = 'the' then 1 else 0 end) tf from tok group by page_id)
select page_id, cast(w1 + w2 as bigint) words, cast(tf as bigint) tf,
       row_number() over (order by w1 + w2 desc, tf desc, page_id) rnk, count(*) over () total_hits from m where w1 = 1""",
    "search_typo": f"with {_TITLES}, {_TERMS} select distinct page_id, t from tok where regexp_matches(t, '^[a-z0-9]+$') and levenshtein(t, 'there') <= 1",
    "search_highlight": rf"with {_TITLES} select page_id, regexp_replace(title, '(?i)(the)', '<em>\1</em>', 'g') h from p",
}

_REL = f"""case page_id % 50 when 0 then concat('Temporary/', page_id, '.html') when 1 then concat(page_id, '.html')
    when 2 then concat({_DOMAIN}, '/', page_id, '.txt') when 3 then concat({_DOMAIN}, '/deep/er/', page_id, '.HTM')
    when 4 then concat('_', {_DOMAIN}, '/', page_id, '.html') else concat({_DOMAIN}, '/', page_id, '.html') end"""
_TREE = rf"""e as (select page_id, {_REL} rel, url, html, page_id % 13 = 0 untitled from pages),
s as (select *, split_part(rel, '/', 1) dom, substr(rel, strpos(rel, '/') + 1) fn from e where regexp_matches(lower(rel), '\.html?$')),
f as (select page_id, dom as domain, fn filename, html, untitled from s where contains(rel, '/') and lower(dom) <> 'temporary'),
loose as (select rel from s where not contains(rel, '/'))"""
_HTML = "case when untitled then regexp_replace(html, '(?i)</?title>', '', 'g') else html end"
_HELD = f"""d as (select concat('d', page_id) id, {_DOMAIN} domain, {_FILE} filename from pages
  union all select concat('x', page_id), {_DOMAIN}, {_FILE} from pages where page_id % 11 = 0)"""
_DISK = "disk as (select domain source, count(*) file_count from f group by 1)"
_DB = f"db as ({_counts('page_id % 5 <> 4')} union all select 'gone.example', 4)"
_LOST = """lost as (
  select 'html_unattributed' code, 'error' severity, 'html' store, '' as domain, rel filename from loose
  union all select 'html_unparseable', 'error', 'html', domain, filename from f where untitled
  union all select 'doc_orphan', 'error', 'meilisearch', dk.domain, dk.filename
  from dk left join f on dk.domain = f.domain and dk.filename = f.filename where f.domain is null)"""
_CHECKED = f"""with {_TREE}, {_HELD}, {_KEYS}, {_DISK}, {_DB}, {_LOST}, found as (
  select *, code message, false recoverable from lost
  union all select 'doc_missing', 'warning', 'meilisearch', f.domain, f.filename, 'doc_missing', true
  from f left join dk using (domain, filename) where dk.n is null and not f.untitled
  union all select 'doc_duplicate', 'warning', 'meilisearch', f.domain, f.filename, 'doc_duplicate', true from f join dk using (domain, filename) where dk.n > 1
  union all select case when disk.source is null then 'stat_source_stale' else 'stat_source_mismatch' end, 'warning', 'database', coalesce(disk.source, db.source), '',
         concat(coalesce(disk.file_count, 0), ' files, ', coalesce(db.file_count, 0), ' counted'), true
  from disk full outer join db on disk.source = db.source where disk.source is null or coalesce(db.file_count, 0) <> disk.file_count
  union all select 'stat_total_mismatch', 'warning', 'database', '', '', concat(a, ' files, ', b, ' counted'), true
  from (select (select sum(file_count) from disk) a, (select sum(file_count) from db) b) where a <> b)"""
_AN_ENTRY = """p as (select case page_id % 5 when 0 then concat('a/b/', page_id, '.DUMP') when 1 then concat('x/', page_id, '.dump')
    when 2 then concat(page_id, '/deep/Database.SQL') when 3 then concat(page_id, '.sql') else concat(page_id, '/Archive') end path, page_id % 5 = 4 folder from pages),
c as (select path, folder, lower(split_part(path, '/', -1)) name, len(string_split(path, '/')) depth from p)"""
_SEVEN = f"(select {_DOMAIN} from pages where page_id = 7)"

SQL |= {
    "archive_scan": f"with {_TREE} select domain, filename, concat('/archive/', domain, '/', filename) request_path from f",
    "scan_counts": f"with {_TREE} select domain source, count(*) file_count from f group by 1",
    "scan_total": f"with {_TREE} select count(*) html_files from s",
    "scan_unattributed": f"with {_TREE} select 'html_unattributed' code, 'error' severity, 'html' store, rel filename, rel path, false recoverable from loose",
    "scan_content": f"with {_TREE} select domain, filename, length(x) n, md5(x) h from (select *, {_HTML} x from f)",
    "archive_check": f"{_CHECKED} select code, severity, store, domain, filename, message, recoverable from found",
    "archive_recheck": f"{_CHECKED} select code, severity, store, domain, filename, message, recoverable from found",
    "zip_content": f"with {_TREE} select domain, filename, length(x) n, md5(x) h from (select *, {_HTML} x from f)",
    "issue_labels": f"""{_CHECKED} select concat_ws(' / ', nullif(store, ''), nullif(domain, ''), nullif(filename, '')) line, count(*) n from found group by 1""",
    "archive_repair": f"with {_TREE}, {_HELD}, {_KEYS}, {_LOST} select code, domain, filename from lost",
    "archive_rebuild": f"""with {_TREE} select sha256(concat(domain, chr(0), filename)) id, domain, filename, regexp_extract(html, '(?i)<title>(.*?)</title>', 1) title
from f where not untitled and regexp_matches(html, '(?i)<title>(.*?)</title>')""",
    "archive_refresh": f"with {_TREE}, {_DISK} select source, file_count from disk",
    "archive_delete": f"""with {_HELD}, {_DB}, n as (select domain source, count(*) documents from d where not (filename = '7.html' and domain = {_SEVEN}) group by 1)
select coalesce(n.source, l.source) source, documents, file_count
from n full outer join (select source, file_count - (source = {_SEVEN})::int file_count from db where file_count > (source = {_SEVEN})::int) l on n.source = l.source""",
    "archive_add": f"""with {_DB}, a as (select {_SEVEN} source, 2::bigint added)
select coalesce(a.source, db.source) source, added, coalesce(file_count, 0) + (a.source is not null)::int file_count from a full outer join db on a.source = db.source""",
    "archive_restore": f"""with {_TREE} select domain, filename, regexp_extract(html, '(?i)<title>(.*?)</title>', 1) title, md5(html) h from f""",
    "restore_candidates": f"""with {_AN_ENTRY} select
  (select path from c where not folder and name like '%.dump' order by depth, path limit 1) dump,
  (select path from c where not folder and name like '%.sql' order by name <> 'database.sql', depth, path limit 1) as "database",
  (select path from c where folder and name = 'archive' order by depth, path limit 1) archive_dir""",
    "zip_entries": "select page_id, page_id % 5 in (0, 4) safe from pages",
    "request_paths": f"""select page_id, case when page_id % 5 < 3 then {_DOMAIN} end as domain, case when page_id % 5 < 3 then concat('a b/', page_id, '.html') end filename,
       page_id % 5 > 2 refused from pages""",
}

_RUN = r"[\p{L}\p{N}]+"
_SPAN = '<span style="color: red;">'


def _typos(term: str, budget: int, prefix: bool) -> str:
    """Typos of a term against an ASCII word; other letters count as one sign each."""
    far = f"levenshtein(regexp_replace(term, '[^\\x00-\\x7F]', '#', 'g'), '{term}')"
    return f"case when term = '{term}'{f" or starts_with(term, '{term}')" if prefix else ''} then 0 when {far} between 1 and {budget} then {far} end"


def _matches(words: list[tuple[str, int]]) -> str:
    """mt: the matching terms of m for words with their typo budgets; the last one also as a prefix."""
    each = [
        f"select term, {no} as no, {_typos(w, b, no == len(words) - 1)} typos, (term = '{w}')::bigint exact from m" for no, (w, b) in enumerate(words)
    ]
    return f"mt as (select * from ({' union all '.join(each)}) where typos is not null)"


def _ranked(docs: str, first: tuple[str, int], second: tuple[str, int]) -> str:
    """k: ranks of ``docs`` (id, title, filename, domain, content) for two words."""
    fields = " union all ".join(
        f"select id, {k} field, list_transform(regexp_extract_all(coalesce({f}, ''), '{_RUN}'), lambda x: lower(x)) r from docs"
        for k, f in enumerate(("id", "title", "filename", "domain", "content"))
    )
    return f"""docs as ({docs}), tok as (select id, field, unnest(range(len(r))) pos, unnest(r) term from ({fields})), m as (select distinct term from tok),
{_matches([first, second])}, hit as (select * from tok join mt using (term)),
best as (select id, no, min(typos) typos, min(field) field, max(exact) exact from hit group by id, no),
near as (select a.id, min(abs(b.pos - a.pos)) g from hit a join hit b on a.id = b.id and a.field = b.field and a.no = 0 and b.no = 1 group by a.id),
k as (select a.id, 1 + (b.id is not null)::bigint words, a.typos + coalesce(b.typos, 0) typos,
  case when b.id is null then 0 else least(coalesce(g, 8), 8) end gaps,
  least(a.field, coalesce(b.field, 5))::bigint field, a.exact + coalesce(b.exact, 0) exact
  from (select * from best where no = 0) a left join (select * from best where no = 1) b on a.id = b.id left join near on near.id = a.id)"""


_RANKS = "id, words::bigint words, typos::bigint typos, gaps::bigint gaps, field, exact::bigint exact"
_LIBRARY = "select doc_id::varchar id, lang title, '' filename, source as domain, text as content from documents"
_TITLED = f"select page_id::varchar id, title, '' filename, '' as domain, '' as content from (with {_TITLES} select * from p)"
_ORDER = "row_number() over (order by words desc, typos, gaps, field, exact desc, id) rnk"
_UPKEPT = f"""select id, title, filename, domain, case when id::bigint % 7 > 0 then content else 'there was other text before' end as content
  from ({_LIBRARY}) where id::bigint % 5 > 0 and (id::bigint % 7 > 0 or id::bigint % 3 = 0)"""
_FOUND = f"with {_ranked(_LIBRARY, ('there', 1), ('the', 0))}"


def _excerpts(words: list[tuple[str, int]], size: int = 150) -> str:
    """cut (id, x) and spot (id, no, start, len): excerpts of src (id, text) around the words, and all matches.

    Two signs of another script are written as control characters, as classes of signs can't be taken from each other here.
    """
    one, piece = "[\x01\x02]", "[\x01\x02]|[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\x01\x02]+"
    token = "regexp_matches(p, '^[\\p{L}\\p{N}\x01\x02]')"
    each = " union all ".join(
        f"select term, {no} no from (select distinct term from term) where {_typos(w, b, no == len(words) - 1)} is not null" for no, (w, b) in enumerate(words)
    )
    return f"""pc as (select id, unnest(ps) p, unnest(range(len(ps))) i from (select id, regexp_extract_all(coalesce(text, ''), '{piece}') ps from src)),
tk as (select *, {token} t, (sum({token}::int) over w) - 1 pos, (sum(length(p)) over w) - length(p) off, lead(p) over w nx from pc window w as (partition by id order by i)),
term as (select id, pos, lower(p) term, 1 w, off, length(p) len from tk where t union all
  select id, pos, p || nx, 2, off, 2 from tk where regexp_matches(p, '^{one}') and regexp_matches(nx, '^{one}')),
spot as (select id, no, pos, w, off start, len from term join ({each}) using (term)),
win as (select a.id, a.pos, count(distinct b.no) d, max(b.pos + b.w) e from spot a join spot b on a.id = b.id and b.pos >= a.pos and b.pos < a.pos + {size} group by a.id, a.pos),
bw as (select id, pos lo, least(e, pos + {size}) - pos inside from (select *, row_number() over (partition by id order by d desc, pos) rn from win) where rn = 1),
n as (select id, sum(t::int) n from tk group by id),
rng as (select id, n, case when n <= {size} then 0 else least(greatest(coalesce(lo, 0) - ({size} - coalesce(inside, 0)) // 2, 0), n - {size}) end a,
  from n left join bw using (id)),
shown as (select tk.*, a, a + {size} b, n, (tk.id, pos) in (select (id, pos) from spot union select (id, pos + 1) from spot where w = 2) and t and (pos >= a and pos < a + {size}) hot
  from tk join rng using (id) where (a = 0 or pos >= a) and (a + {size} >= n or pos < a + {size} - 1 or t and pos = a + {size} - 1)),
edge as (select *, coalesce(lag(hot) over w, false) before, coalesce(lead(hot) over w, false) after from shown window w as (partition by id order by i)),
cut as (select id, concat(case when any_value(a) > 0 then '…' else '' end,
  string_agg(concat(case when hot and not before then '{_SPAN}' else '' end, p, case when hot and not after then '</span>' else '' end), '' order by i),
  case when any_value(b) < any_value(n) then '…' else '' end) x from edge group by id)"""


_PAGE_TWO = f"""{_FOUND}, top as (select docs.*, rnk from docs join (select *, {_ORDER} from k) using (id) where rnk between 11 and 20),
src as (select id, content as text from top), {_excerpts([("there", 1), ("the", 0)])}"""
_EVERY_TASK = f"""{_TASKS},
t as (select id::varchar id, url, regexp_extract(url, '//([^/]+)', 1) as domain, status, 'x' || id external, created_at,
  case when status = 'running' then created_at end started_at from tasks)"""
_AT = "timestamp '2030-01-01 00:00:00'"
_ACTIVE = "status in ('pending', 'running')"
_NORMAL = "regexp_replace(url, '#.*$', '')"

SQL |= {
    "search_ranked": f"with {_ranked(_TITLED, ('the', 0), ('there', 1))} select {_RANKS} from k",
    "search_stored": f"{_FOUND} select {_RANKS} from k",
    "search_terms": f"{_FOUND} select term, count(*) occurrences, count(distinct id) documents from tok group by term",
    "search_matches": f"""with {_TITLES}, m as (select distinct unnest(regexp_extract_all(lower(title), '{_RUN}')) term from p),
{_matches([('there', 1), ('tionthere', 2), ('th', 0)])} select term, no::bigint as no, typos::bigint typos, exact from mt""",
    "search_library": f"""{_PAGE_TWO}
select id, title, filename, coalesce(x, '') as content, domain, rnk from top left join cut using (id)""",
    "search_positions": f"{_PAGE_TWO} select id, no::bigint as no, start::bigint as start, len::bigint length from spot",
    "search_near_terms": f"""with {_ranked(_LIBRARY, ('there', 1), ('the', 0)).split(", m as")[0]}, m as (select distinct term from tok),
{_matches([('there', 1), ('tionthere', 2), ('th', 0), ('ingand', 1)])} select term, no::bigint as no, typos::bigint typos, exact from mt""",
    "search_upkeep": f"""with {_ranked(_UPKEPT, ('there', 1), ('the', 0))} select {_RANKS} from k""",
    "search_library_totals": f"{_FOUND} select least(count(*), 1000) total_hits, ceil(least(count(*), 1000) / 10)::bigint total_pages from k",
    "search_crop": f"""with src as (select doc_id::varchar id, replace(replace(text, 'the ', '\x01\x02'), ' ', '\x02') as text from documents),
{_excerpts([("\x01\x02", 0), ("there", 1)])}, sp as (select id, count(*) c, sum(start) s, sum(len) l from spot group by id)
select id, length(coalesce(x, '')) n, md5(replace(replace(coalesce(x, ''), '\x01', '北'), '\x02', '京')) h, coalesce(c, 0) matches, coalesce(s, 0)::bigint starts, coalesce(l, 0)::bigint lengths
from src left join cut using (id) left join sp using (id)""",
    "repair": f"""with {_FILES}, {_INDEX}, {_KEYS} select 'doc_orphan' code, 'error' severity, 'meilisearch' store, dk.domain, dk.filename,
  concat('/archive/', dk.domain, '/', dk.filename) path, 'doc_orphan' message, false recoverable,
  (select list(id order by id) from d where d.domain = dk.domain and d.filename = dk.filename) document_ids
from dk left join f on dk.domain = f.domain and dk.filename = f.filename where f.domain is null""",
    "task_by_id": f"with {_EVERY_TASK} select id, url, domain, status, created_at from t where id = '17'",
    "task_by_status": f"with {_EVERY_TASK} select id, status, created_at from t where status in ('pending', 'failed')",
    "task_start": f"""with {_EVERY_TASK} select id, 'running' status, '' as error, {_AT} updated_at, coalesce(started_at, {_AT}) started_at, null::timestamp finished_at
from t where status <> 'success'""",
    "task_finish": f"""with {_EVERY_TASK} select id, case when not {_ACTIVE} then status when id::bigint % 3 = 0 then 'failed' else 'success' end status,
  case when {_ACTIVE} and id::bigint % 3 <> 0 then 'f' || id else '' end file_name, case when {_ACTIVE} and id::bigint % 3 = 0 then 'boom' else '' end as error,
  external external_task_id, case when {_ACTIVE} then {_AT} else created_at end updated_at, case when {_ACTIVE} then {_AT} end finished_at from t""",
    "task_run": f"""with {_EVERY_TASK} select id, case when not {_ACTIVE} then status when url < 'https://u5' then 'success' else 'failed' end status,
  case when {_ACTIVE} then url[9:-2] || '.html' else '' end file_name, case when {_ACTIVE} and url >= 'https://u5' then 'the fetch failed' else '' end as error,
  case when {_ACTIVE} then 'e' else external end external_task_id from t""",
    "task_create": f"""with {_EVERY_TASK}, a as (select url, bool_or({_ACTIVE}) busy from t group by url),
l as (select url, status from (select *, row_number() over (partition by url order by created_at desc, id) rn from t) where rn = 1),
u as (select {_NORMAL} url, {_DOMAIN} as domain from pages union select url, regexp_extract(url, '//([^/]+)', 1) from t)
select u.url, u.domain, 'pending' status from u left join a on u.url = a.url left join l on u.url = l.url
where a.url is null or not (busy or l.status = 'success')""",
    "url_check": f"""with p as (select *, page_id % 7 in (0, 4, 6) or page_id % 7 = 5 and contains(url, '#') good from pages)
select page_id, case when good then {_NORMAL} end url, case when good then {_DOMAIN} end as domain,
  case when good then null else case page_id % 7 when 1 then 'url scheme is not supported' when 2 then 'url is empty' when 3 then 'url host is missing' else 'url has control characters' end end as error
from p""",
    "url_grammar": f"""with p as (select page_id, page_id % 16 k, {_DOMAIN} h from pages)
select page_id, case k when 4 then concat('https://', h, '/a%20b/%C3%A9/', page_id) when 5 then concat('https://ann:p%40ss@', h, ':8080') when 7 then concat('https://', h, ':')
    when 8 then concat('http://[::1]:80/', h) when 10 then concat('https://b%C3%BC.', h, '/(x)!') when 11 then concat('https://', h, '/A%20/?q=é') end url,
  case when k in (4, 5, 7, 11) then h when k = 8 then '::1' when k = 10 then 'bü.' || h end as domain,
  case when k in (0, 1, 2, 3, 6, 9, 12, 13) then 'url is malformed' when k = 14 then 'url scheme is not supported' when k = 15 then 'url host is missing' end as error from p""",
    "stats_items": f"select source, file_count from ({_counts(extra='- 3')}) where file_count >= 0",
    "stats_replace": _counts("page_id % 10 <> 3"),
    "users_by_name": "select c_custkey id, c_name username from customer where c_name = 'Customer#000000007'",
    "users_create": "select username, 1::bigint n from (select c_name username from customer union select s_name from supplier)",
    "consistency_blank": f"""with {_FILES}, {_INDEX}, g as (select id, case when substr(id, 2)::bigint % 17 = 0 then ' ' else domain end as domain,
  case when substr(id, 2)::bigint % 19 = 0 then null else filename end filename from d),
bk as (select domain, filename, count(*) n, string_agg(id, ',' order by id) ids from g where trim(domain) <> '' and filename is not null group by 1, 2)
select 'doc_blank_key' code, domain, filename, id ids from g where trim(domain) = '' or filename is null
union all select 'doc_missing', f.domain, f.filename, null from f left join bk using (domain, filename) where n is null
union all select 'doc_duplicate', domain, filename, ids from f join bk using (domain, filename) where n > 1
union all select 'doc_orphan', bk.domain, bk.filename, ids from bk left join f on bk.domain = f.domain and bk.filename = f.filename where f.domain is null""",
    "consistency_parse": f"""with {_FILES}, {_INDEX}, {_KEYS}, {_ISSUES}, bad as (select domain, filename from f where split_part(filename, '.', 1)::bigint % 3 = 0)
select code, domain, filename from iss where code <> 'doc_missing' or (domain, filename) not in (select (domain, filename) from bad)
union all select 'html_unparseable', domain, filename from bad""",
}


def _decoded(text: str) -> str:
    """Character references without need of a semicolon, longer names first; what gives an ampersand last."""
    for name in sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (html5[n] == "&", -len(n))):
        text = f"regexp_replace({text}, '&{name};?', '{html5[name]}', 'g')"
    return f"regexp_replace({text}, ' |\\n|\\r|\\\\n', '', 'g')"


_BESIDE = "is_text or name in ('', 'a', 'b', 'br', 'meta', 'span', 'em', 'i', 'strong', 'script', 'style')"
# Right for pages whose tags all match, but for paragraphs that the next one ends and bold text that is never closed: it goes
# on in later blocks, three levels deep at most besides the one just opened.
_TEXTS = f"""raw as (select page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]+>|[^<]+') ts from pages),
piece as (select page_id, unnest(ts) t, unnest(range(len(ts))) pos from raw),
tag as (select *, not starts_with(t, '<') is_text, starts_with(t, '</') closing, lower(regexp_extract(t, '^</?([a-zA-Z0-9]+)', 1)) name from piece),
step as (select *, case when is_text or name in ('', 'p', 'b', 'br', 'meta', 'img', 'link', 'script', 'style', 'html', 'head', 'body') then 0 when closing then -1 else 1 end d,
  case when name <> 'b' then 0 when closing then -1 else 1 end bold,
  case when name = 'p' then (not closing)::int when {_BESIDE} then null else 0 end p,
  case when name = 'b' then (not closing)::int when {_BESIDE} then null else 0 end own from tag),
run as (select *, coalesce(last_value(own ignore nulls) over w, 0) mine, sum(bold) over w bolds from step window w as (partition by page_id order by pos)),
depth as (select *, 3 + sum(d) over w + least(3, bolds - mine) + mine + coalesce(last_value(p ignore nulls) over w, 0) depth
  from run window w as (partition by page_id order by pos)),
once as (select page_id, string_agg({_decoded("t")}, '' order by depth, pos) x from depth where is_text group by 1),
texts as (select page_id, {_decoded("x")} x from once)"""
_BUILT = f"""select sha256(concat(d, chr(0), n)) id, title, n filename, d as domain, x as content
  from (select page_id, {_DOMAIN} d, {_FILE} n, regexp_extract(html, '(?i)<title>(.*?)</title>', 1) title from pages where regexp_matches(html, '(?i)<title>(.*?)</title>'))
  join texts using (page_id)"""
_SEARCHED = f"with {_TEXTS}, {_ranked(_BUILT, ('the', 0), ('market', 1))}"

SQL |= {
    "html_text": f"with {_TEXTS} select page_id, length(x) n, md5(x) h from texts",
    "rebuild_lenient": f"with {_TEXTS}, docs as ({_BUILT}) select id, domain, filename, title, length(content) n from docs",
    "search_totals": f"{_SEARCHED} select least(count(*), 1000) total_hits, ceil(least(count(*), 1000) / 10)::bigint total_pages from k",
    "search_page": f"""{_SEARCHED}, top as (select docs.*, rnk from docs join (select *, {_ORDER} from k) using (id) where rnk <= 10),
src as (select id, content as text from top), {_excerpts([("the", 0), ("market", 1)])}
select id, title, filename, coalesce(x, '') as content, domain, rnk from top left join cut using (id)""",
    "search_json_page": f"""with {_ranked(_LIBRARY, ('fr', 0), ('fr', 0))},
hit_fr as (select docs.*, row_number() over (order by field, exact desc, id) rnk from docs join (
  select id, min(field) field, max((term = 'fr')::int) exact from tok where starts_with(term, 'fr') group by id) using (id)),
row as (select r.rnk, coalesce(id, '') id, coalesce(title, '') title, coalesce(domain, '') as domain,
  case when id is null then '' else concat('\\u003c\\u0026\\u003e\\"\\\\', id) end as content from (select unnest(range(1, 11)) rnk) r left join (from hit_fr where rnk <= 4) using (rnk))
select concat('[', string_agg(concat('    {{        "id": "', id, '",        "title": "', title, '",        "filename": "",        "content": "', content,
  '",        "domain": "', domain, '"    }}'), ',' order by rnk), ']') json from row""",
    "search_padded": f"""with {_ranked(_LIBRARY, ('fr', 0), ('fr', 0))},
hit_fr as (select docs.*, row_number() over (order by field, exact desc, id) rnk from docs join (
  select id, min(field) field, max((term = 'fr')::int) exact from tok where starts_with(term, 'fr') group by id) using (id)),
held as (select * from hit_fr where rnk <= 4 and coalesce(content, '') <> '')
select r.rnk, coalesce(id, '') id, coalesce(title, '') title, coalesce(domain, '') as domain from (select unnest(range(1, 11)) rnk) r left join held using (rnk)""",
    "search_json": f"""with {_ranked(_LIBRARY, ('fr', 0), ('fr', 0))},
hit_fr as (select docs.*, row_number() over (order by field, exact desc, id) rnk from docs join (
  select id, min(field) field, max((term = 'fr')::int) exact from tok where starts_with(term, 'fr') group by id) using (id))
select rnk, concat('{{"id":"', id, '"', case when title is null then '' else concat(',"title":"', title, '"') end,
  case when domain is null then '' else concat(',"domain":"', domain, '"') end, '}}') json from hit_fr where rnk <= 10""",
}
