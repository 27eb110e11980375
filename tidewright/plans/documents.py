"""Document queries: search, outline, paging, inventory, cleaning, integrity, HTML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import text as tx
from tidewright.operators import corpus, integrity
from tidewright.session import load

PATTERN = "licen[cs]ed|password="
PARSERS = [("de", ".de", "German prose"), ("en", ".en", "English prose"), ("es", ".es", "Spanish prose")]


def _path() -> Column:
    """The documents' rows named like files."""
    return F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents")


def doc_search(spark: SparkSession, d: str) -> DataFrame:
    return corpus.search(_docs(spark, d), ["doc_id"], "text", PATTERN, ignore_case=True, most=5, width=300)


def doc_search_literal(spark: SparkSession, d: str) -> DataFrame:
    return corpus.search(_docs(spark, d), ["doc_id"], "text", "License", literal=True)


def doc_search_summary(spark: SparkSession, d: str) -> DataFrame:
    return corpus.search_summary(_docs(spark, d), "text", PATTERN, ignore_case=True, most=5)


def doc_search_limited(spark: SparkSession, d: str) -> DataFrame:
    first = corpus.first_documents(_docs(spark, d).withColumn("path", _path()), "path", 100)
    return corpus.search(first, ["path"], "text", PATTERN, ignore_case=True)


def conversation_search(spark: SparkSession, d: str) -> DataFrame:
    return corpus.search(load(spark, d, "conversations").filter("role = 'assistant'"), ["conv_id", "turn"], "text", "^Th[ae].*[.]$", most=2)


def doc_inventory(spark: SparkSession, d: str) -> DataFrame:
    parsers = spark.createDataFrame([(e, t) for _, e, t in PARSERS], "ext string, description string")
    return corpus.inventory(_docs(spark, d), _path(), parsers)


def doc_parsers(spark: SparkSession, d: str) -> DataFrame:
    files = _docs(spark, d).select(tx.extension(_path()).alias("ext"), "source").distinct()
    table = corpus.parser_table(files.select(F.col("source").alias("description"), "ext"))
    return table.select("description", F.array_join("exts", " ").alias("exts"))


def _page_text() -> Column:
    """Every document as a Markdown page, with a heading to find."""
    meta = {"lang": F.col("lang"), "source": F.col("source"), "chars": F.col("n_chars")}
    warned = F.when(F.col("n_chars") > 5000, F.array(F.lit("long text"))).otherwise(F.array().cast("array<string>"))
    return tx.rendered(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), meta, warned, F.col("text"))


def doc_render(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", _page_text().alias("page"))


def doc_outline(spark: SparkSession, d: str) -> DataFrame:
    pages = _docs(spark, d).select("doc_id", F.regexp_replace(_page_text(), "\n([A-Z][a-z]+[.])", "\n## $1").alias("page"))
    return pages.select("doc_id", F.inline(tx.outline("page")))


def doc_page(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tx.page("text", 100, 500).alias("p")).select("doc_id", "p.*")


def doc_info(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", "lang", F.length("text").cast("bigint").alias("chars"), F.size(tx.lines("text")).cast("bigint").alias("lines"), F.element_at(tx.lines("text"), 1).alias("first_line"))


def doc_clean(spark: SparkSession, d: str) -> DataFrame:
    dirty = F.concat(F.lit(" \t"), F.replace(F.col("text"), F.lit("\n"), F.lit(" \t\r\n\r\n\n\n")), F.lit("\n\n"))
    return _docs(spark, d).select("doc_id", tx.clean(dirty).alias("text"))


def doc_ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    kept = tx.distinct_in_order(tx.lines("text"))
    return _docs(spark, d).select("doc_id", F.size(kept).cast("bigint").alias("n"), F.array_join(kept, "\n").alias("text"))


def doc_table(spark: SparkSession, d: str) -> DataFrame:
    rows = F.transform(tx.lines("text"), lambda x: F.split(x, r" \| "))
    return _docs(spark, d).filter(F.col("text").contains(" | ")).select("doc_id", tx.markdown_table(rows).alias("table"))


def sample_per_group(spark: SparkSession, d: str) -> DataFrame:
    return corpus.sample_per_group(_docs(spark, d), "lang", "doc_id", 3, "7").select("lang", "doc_id", "rank")


def group_report(spark: SparkSession, d: str) -> DataFrame:
    return corpus.group_report(_docs(spark, d), "source", F.col("n_chars") >= 100, F.length("text"))


def cache_left(spark: SparkSession, d: str) -> DataFrame:
    key = corpus.content_key(F.col("source"), F.col("n_chars"), F.col("doc_id"), F.lit("v1"))
    files = _docs(spark, d).select("doc_id", key.alias("key"))
    return corpus.not_cached(files, files.filter("doc_id % 3 <> 0")).select("doc_id", "key")


def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus.cache_stats(_docs(spark, d).select(F.octet_length("text").alias("size")), "size")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return integrity.manifest(_docs(spark, d).withColumn("path", _path()), "path", F.col("text").cast("binary"))


def manifest_files(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d)


def manifest_verify(spark: SparkSession, d: str) -> DataFrame:
    changed = _docs(spark, d).filter("doc_id % 17 <> 0").withColumn("path", F.when(F.col("doc_id") % 19 == 0, F.concat(_path(), F.lit(".new"))).otherwise(_path()))
    text = F.when(F.col("doc_id") % 11 == 0, F.concat(F.col("text"), F.lit("x"))).when(F.col("doc_id") % 13 == 0, F.reverse("text")).otherwise(F.col("text"))
    return integrity.verify(_files(spark, d), integrity.manifest(changed, "path", text.cast("binary")))


def manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    per = _docs(spark, d).select("source", F.struct(_path().alias("path"), F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("sha256")).alias("f"))
    packed = per.groupBy("source").agg(F.to_json(F.struct(F.lit("v1").alias("format"), F.array_sort(F.collect_list("f")).alias("files"))).alias("manifest"))
    return integrity.from_manifest(packed)


def archive_parts(spark: SparkSession, d: str) -> DataFrame:
    files = _docs(spark, d).select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.octet_length("text").cast("bigint").alias("bytes"))
    return integrity.parts(files, 100_000, F.substring("path", 1, 9))


def safe_paths(spark: SparkSession, d: str) -> DataFrame:
    shapes = ["a/{}", "../{}", "a/../{}", "a/../../{}", "/{}", "c:{}", "a\\{}", "./{}", "..", "."]
    made = F.element_at(F.array(*[F.replace(F.lit(s), F.lit("{}"), F.col("doc_id").cast("string")) for s in shapes]), (F.col("doc_id") % len(shapes) + 1).cast("int"))
    return _docs(spark, d).select("doc_id", made.alias("path")).select("doc_id", "path", integrity.safe_path(F.col("path")).alias("safe"))


def page_urls(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", F.replace(F.url_encode(F.to_json(F.struct("page_id", "url"))), F.lit("+"), F.lit("%20")).alias("fragment"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        doc_search, doc_search_literal, doc_search_summary, doc_search_limited, conversation_search, doc_inventory, doc_parsers, doc_render, doc_outline, doc_page, doc_info, doc_clean, doc_ordered_distinct,
        doc_table, sample_per_group, group_report, cache_left, cache_stats, manifest_files, manifest_verify, manifest_round_trip, archive_parts, safe_paths, page_urls,
    )
}

_LINES = r"string_split_regex({0}, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"


def _lines(text: str) -> str:
    cut = _LINES.format(text)
    return f"(case when {cut}[-1] = '' then {cut}[1:len({cut}) - 1] else {cut} end)"


def _hits(select: str, table: str, found: str, most: int, width: int) -> str:
    return f"""
with l as (select {select}, unnest(ls) as line, generate_subscripts(ls, 1) as line_no from (select *, {_lines('text')} as ls from {table})),
h as (select *, row_number() over (partition by {select} order by line_no) as k from l where {found})
select {select}, line_no::int as line_no, substr(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 1, {width}) as text from h where k <= {most}"""


_PATH = "source || '/' || doc_id || '.' || lang"
_RENDER = """'# doc ' || doc_id || chr(10) || chr(10) || concat_ws(chr(10), '- lang: ' || lang, '- source: ' || source, '- chars: ' || n_chars)
  || case when n_chars > 5000 then chr(10) || chr(10) || '> long text' else '' end || chr(10) || chr(10)
  || text"""
_ENDS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

SQL: dict[str, str] = {
    "doc_search": _hits("doc_id", "documents", f"regexp_matches(line, '(?i){PATTERN}')", 5, 300),
    "doc_search_literal": _hits("doc_id", "documents", "contains(line, 'License')", 20, 400),
    "doc_search_limited": _hits("path", f"(select *, {_PATH} as path from documents order by 6 limit 100)", f"regexp_matches(line, '(?i){PATTERN}')", 20, 400),
    "conversation_search": _hits("conv_id, turn", "(select * from conversations where role = 'assistant')", "regexp_matches(line, '^Th[ae].*[.]$')", 2, 400),
    "doc_search_summary": f"""
with l as (select doc_id, unnest({_lines('text')}) as line from documents),
h as (select doc_id, least(count(*), 5) as n from l where regexp_matches(line, '(?i){PATTERN}') group by doc_id)
select (select count(*) from documents) as scanned, count(*) as matched, coalesce(sum(n), 0)::bigint as total_hits from h""",
    "doc_inventory": """
select '.' || lang as ext, count(*) as n, any_value(p.description) as description, any_value(p.description) is not null as supported from documents
left join (values ('.de', 'German prose'), ('.en', 'English prose'), ('.es', 'Spanish prose')) p(ext, description) on p.ext = '.' || lang group by 1""",
    "doc_parsers": "select source as description, string_agg('.' || lang, ' ' order by lang) as exts from (select distinct source, lang from documents) group by source",
    "doc_render": f"select doc_id, {_RENDER} as page from documents",
    "doc_outline": f"""
with p as (select doc_id, string_split(regexp_replace({_RENDER}, '\\n([A-Z][a-z]+[.])', chr(10) || '## \\1', 'g'), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as line_no from p),
h as (select *, row_number() over (partition by doc_id order by line_no) as k from l where regexp_matches(line, '^(#{{1,6}})\\s+(.*)$'))
select doc_id, line_no::int as line_no, length(regexp_extract(line, '^(#{{1,6}})\\s+(.*)$', 1))::int as level, regexp_extract(line, '^(#{{1,6}})\\s+(.*)$', 2) as title from h where k <= 200""",
    "doc_page": "select doc_id, substr(text, 101, 500) as page, greatest(length(text) - 600, 0)::int as remaining, case when length(text) > 600 then 600 end as next_offset from documents",
    "doc_info": f"select doc_id, lang, length(text)::bigint as chars, len({_lines('text')})::bigint as lines, {_lines('text')}[1] as first_line from documents",
    "doc_clean": f"""
select doc_id, regexp_replace(regexp_replace(regexp_replace(replace(chr(32) || chr(9) || replace(text, chr(10), chr(32) || chr(9) || chr(13) || chr(10) || chr(13) || chr(10) || chr(10) || chr(10)) || chr(10) || chr(10), chr(13) || chr(10), chr(10)),
  '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{_ENDS}+|{_ENDS}+$', '', 'g') as text from documents""",
    "doc_ordered_distinct": f"""
with l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from (select doc_id, {_lines('text')} as ls from documents)), f as (select doc_id, line, min(i) as i from l group by all)
select doc_id, count(*) as n, string_agg(line, chr(10) order by i) as text from f group by doc_id""",
    "doc_table": f"""
with l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from (select doc_id, {_lines('text')} as ls from documents where contains(text, ' | '))),
r as (select doc_id, i, string_split(line, ' | ') as c from l), k as (select *, row_number() over (partition by doc_id order by i) as n, max(len(c)) over (partition by doc_id) as w from r where len(list_filter(c, lambda x: x <> '')) > 0),
t as (select doc_id, n, w, '| ' || array_to_string(list_concat(list_transform(c, lambda x: replace(x, '|', '\\|')), list_transform(range(w - len(c)), lambda x: '')), ' | ') || ' |' as s from k),
u as (select doc_id, n, s from t union all select doc_id, 1.5, '| ' || array_to_string(list_transform(range(w), lambda x: '---'), ' | ') || ' |' from t where n = 1)
select doc_id, string_agg(s, chr(10) order by n) as "table" from u group by doc_id""",
    "sample_per_group": "select lang, doc_id, rank::int as rank from (select lang, doc_id, row_number() over (partition by lang order by md5(doc_id || ':7'), doc_id) as rank from documents) where rank <= 3",
    "group_report": "select source, count(*) as n, count(*) filter (n_chars >= 100) as ok, case when count(*) filter (n_chars >= 100) > 0 then (sum(length(text)) filter (n_chars >= 100)) // (count(*) filter (n_chars >= 100)) else 0 end::bigint as avg_chars from documents group by source",
    "cache_left": "select doc_id, sha1(concat_ws('|', source, n_chars, doc_id, 'v1')) as key from documents where doc_id % 3 = 0",
    "cache_stats": "select count(*) as entries, sum(strlen(text))::bigint as bytes from documents",
    "manifest_files": f"select {_PATH} as path, strlen(text)::bigint as bytes, sha256(text) as sha256 from documents",
    "manifest_verify": f"""
with e as (select {_PATH} as path, strlen(text) as b, sha256(text) as s from documents),
a as (select {_PATH} || case when doc_id % 19 = 0 then '.new' else '' end as path, case when doc_id % 11 = 0 then text || 'x' when doc_id % 13 = 0 then array_to_string(list_reverse(string_split(text, '')), '') else text end as t from documents where doc_id % 17 <> 0),
f as (select path, strlen(t) as b, sha256(t) as s from a)
select coalesce(e.path, f.path) as path, case when f.path is null then 'missing' when e.path is null then 'extra' when e.b <> f.b then 'size' when e.s <> f.s then 'hash' else 'ok' end as status from e full join f on e.path = f.path""",
    "manifest_round_trip": f"select 'v1' as format, {_PATH} as path, strlen(text)::bigint as bytes, sha256(text) as sha256 from documents",
    "archive_parts": """
with f as (select lpad(doc_id::varchar, 12, '0') as path, strlen(text) as bytes from documents), e as (select path, bytes, sum(bytes) over (order by path) as upto from f)
select path, ((upto - bytes) // 100000)::bigint as first_part, (greatest(upto - 1, upto - bytes) // 100000)::bigint as last_part from e""",
    "safe_paths": """
select doc_id, replace(['a/{}', '../{}', 'a/../{}', 'a/../../{}', '/{}', 'c:{}', 'a\\{}', './{}', '..', '.'][doc_id % 10 + 1], '{}', doc_id::varchar) as path, doc_id % 10 in (0, 2, 7) as safe from documents""".replace("\\\\", "\\"),
    "page_urls": """select page_id, replace(url_encode('{"page_id":' || page_id || ',"url":"' || url || '"}'), '+', '%20') as fragment, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host from pages""",
}
