"""A query for each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicerank.llm import (anchors, bpe, decontaminate, forest, html_text, lines, spelling, spotsigs, token_counts,
                            token_files, toxicity, turns, urls)
from choicerank.llm.common import Work, on_workers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(on_workers(spark), sf_dir)
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                               public_tokenizers.PATTERN)
    return bpe.digest(tokens)


@query("op2_token_files")
def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{Work(spark).folder}/tokens"
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return token_files.documents(spark, folder)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _lower(value: str) -> str:
    return f"translate({value}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _host(url: str) -> str:
    return _lower(f"regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1)")


def _path(url: str) -> str:
    return f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _plain(url: str) -> str:
    """A url without fragment and dot segments."""
    return rf"""({_lower(f"regexp_extract({url}, '(?s)^(.*?://[^/?#]*)', 1)")}
        || case when contains({_path(url)}, '/.') then
             list_reduce(string_split({_path(url)}, '/'), lambda done, part: case when part = '.' then done
                 when part = '..' then regexp_replace(done, '(?s)/[^/]*$', '') else done || '/' || part end)
             || case when regexp_matches({_path(url)}, '/\.\.?\z') then '/' else '' end
           else {_path(url)} end
        || regexp_extract({url}, '(?s)^.*?://[^?#]*(\?[^#]*)', 1))"""


_REFERENCE = " ".join(f"when piece = '&{name};' then {_text(mark)}" for name, mark in urls.NAMED.items())

# Urls of a class: canonical links and refresh redirects, followed in both directions.
URL_SQL = rf"""
with recursive
p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages),
u as (select *, {_host('url')} as host, {_path('url')} as path, case when contains(url, '://') then {_plain('url')} end as name
      from p),
tags as (select url, name, unnest(regexp_extract_all(regexp_replace(html, {_text(urls.NO_MARKUP)}, ' ', 'g'),
                                                     {_text(urls.TAG)})) as tag from u where name is not null),
codes as (select url, name, list_transform(regexp_extract_all(
                     case when regexp_matches(tag, '(?i)^<link') then regexp_extract(tag, {_text(urls.HREF)}, 1)
                          else regexp_extract(tag, {_text(urls.REFRESH)}, 1) end, {_text(urls.PIECE)}), lambda piece:
                 struct_pack(piece := piece, code := case
                     when regexp_matches(piece, '^&#[xX]')
                     then try_cast('0x' || regexp_extract(piece, '([0-9a-fA-F]+);?$', 1) as bigint)
                     when starts_with(piece, '&#') then try_cast(regexp_extract(piece, '([0-9]+)', 1) as bigint) end)) as parts
          from tags where regexp_matches(tag, {_text(urls.IS_ALIAS)})),
decoded as (select url, name, array_to_string(list_transform(parts, lambda x: case
                     when x.code between 1 and 1114111 and not x.code between 55296 and 57343 then chr(x.code::int)
                     {_REFERENCE.replace('piece =', 'x.piece =')} else x.piece end), '') as link
            from codes where len(parts) > 0),
whole as (select name, case when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link
                            when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:|^#') then null
                            when starts_with(link, '//') then regexp_extract(url, '(?s)^(.*?):', 1) || ':' || link
                            when starts_with(link, '/') then regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || link
                            when starts_with(link, '?') then regexp_extract(url, '(?s)^(.*?://[^?#]*)', 1) || link
                            when {_path('url')} = '' then regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || '/' || link
                            else regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1) || link end as target
          from decoded),
links as (select distinct name as a, {_plain('target')} as b from whole where target is not null and {_plain('target')} <> name),
both_ways as (select a, b from links union select b, a from links),
reach(a, b) as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
rules(verdict, host, path) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
    ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
named as (select name, {_host('name')} as host, {_path('name')} as path
          from (select a as name from both_ways union select b from both_ways)),
spots as (select distinct host, path from u union select host, path from named),
own as (select n.host, n.path, arg_max(r.host || r.path, length(r.host || r.path)) as rule,
               arg_max(r.verdict, length(r.host || r.path)) as verdict
        from spots n join rules r on (n.host = r.host or ends_with(n.host, '.' || r.host)) and starts_with(n.path, r.path)
        group by n.host, n.path),
around as (select reach.a as name, bool_or(own.verdict = 'allow') as allowed, bool_or(own.verdict = 'block') as blocked
           from reach join named on named.name = reach.b join own on own.host = named.host and own.path = named.path
           group by reach.a)
select u.page_id, u.host, u.path, own.rule,
       coalesce(own.verdict, case when around.allowed then 'allow' when around.blocked then 'block' end, 'allow') as verdict
from u left join own on own.host = u.host and own.path = u.path left join around on around.name = u.name
"""


@query("op3_url_filter", URL_SQL)
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


FOREST_SQL = r"""
with recursive
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select distinct doc_id, case when len(words) < 5 then words else words[i:i + 4] end as shingle
      from (select doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (select a.doc_id as a, b.doc_id as b from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id
          join n on n.doc_id = a.doc_id join n m on m.doc_id = b.doc_id
          group by a.doc_id, b.doc_id, n.n, m.n having 100 * count(*) >= 75 * (n.n + m.n - count(*))),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(r.least, w.doc_id)) as component_id,
       w.doc_id = least(w.doc_id, coalesce(r.least, w.doc_id)) as kept
from w left join n using (doc_id) left join (select a, min(b) as least from reach group by a) r on r.a = w.doc_id
"""


@query("op4_minhash_forest", FOREST_SQL)
def minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_toxicity")
def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op6_token_counts")
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                     public_tokenizers.PATTERN)


@query("op7_main_text")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


LINES_SQL = r"""
with l as (select doc_id, cast(line as int) as line, words,
                  list_sort(list_distinct(list_filter(regexp_split_to_array(lower(words), '[ \t\n\x0B\f\r]+'),
                                                      lambda t: t <> ''))) as tokens
           from (select doc_id, unnest(range(0, len(string_split(text, chr(10))))) as line,
                        unnest(string_split(text, chr(10))) as words from documents where doc_id is not null)),
c as (select tokens, len(tokens) as n, min((doc_id, line)) as spot, row_number() over () as class
      from l where len(tokens) > 0 group by tokens),
t as (select class, n, spot, unnest(tokens) as token from c where n >= 5),
f as (select token, count(*) as f from t group by token),
r as (select class, n, spot, token, row_number() over (partition by class order by f, token) as place from t join f using (token)),
x as (select * from r where place <= n - ceil(n * 80 / 100.0) + 1),
met as (select distinct a.class as a, b.class as b from x a join x b
        on a.token = b.token and a.spot < b.spot and a.n * 100 >= b.n * 80 and b.n * 100 >= a.n * 80),
alike as (select distinct met.b as class from met join c p on p.class = met.a join c q on q.class = met.b
          where 100 * len(list_intersect(p.tokens, q.tokens))
                >= 80 * (p.n + q.n - len(list_intersect(p.tokens, q.tokens)))),
gone as (select l.doc_id, l.line from l join c using (tokens)
         where (l.doc_id, l.line) <> c.spot or c.class in (select class from alike)),
kept as (select l.doc_id, string_agg(l.words, chr(10) order by l.line) as text, count(*) as n
         from l left join gone using (doc_id, line) where gone.doc_id is null group by l.doc_id)
select d.doc_id, case when d.text is null then null else len(string_split(d.text, chr(10))) end as n_lines,
       case when d.text is null then 0 else len(string_split(d.text, chr(10))) - coalesce(kept.n, 0) end as n_removed,
       case when d.text is null then null else coalesce(kept.text, '') end as text
from documents d left join kept using (doc_id)
"""


@query("op8_line_dedup", LINES_SQL)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("n_lines", F.when(
        F.col("text").isNotNull(), F.size(F.split("text", "\n"))).cast("bigint"))
    found = lines.dedup_lines(docs, removed="n_removed")
    return found.select("doc_id", "n_lines", F.col("n_removed").cast("bigint").alias("n_removed"), "text")


@query("op9_spot_signatures")
def spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_next(table(spark, sf_dir, "documents"))


@query("op10_decontaminate")
def contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(table(spark, sf_dir, "documents"), spelling.drop_letters()))


@query("op12_conversation_repair")
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    fixed = turns.repair(turns.damaged(rows)).withColumnRenamed("conv_id", "same")
    every = rows.select("conv_id").distinct()  # also those that lost all rows
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in
              ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(fixed, every.conv_id.eqNullSafe(fixed.same), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query("op13_simhash_anchors")
def simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.near_duplicates(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
