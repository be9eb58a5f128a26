"""Queries over small inline tables, for constructs that the corpus does not hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import urls as U
from corpuslens.functions import versions as V
from corpuslens.functions.ranking import PURPOSES
from corpuslens.functions.ranking import rank_sources as rank
from corpuslens.operators import changes

_PAIRS = "('14.2.3','14.2.4'),('14.2.3','14.2.3'),('v15','15.0.0'),('15.0.0-rc.1','15.0.0'),('1.10.0','1.9.9'),('2','1.99.99'),('abc','1.0.0'),('1.0.0-alpha','1.0.0-beta')"
_RANGES = (
    "('14.2.3','^14.1.0',true),('14.2.3','^14.3.0',false),('0.2.5','^0.2.3',true),('0.3.0','^0.2.3',false),('14.2.9','~14.2.1',true),('14.3.0','~14.2.1',false),('14.2.3','14.x',true),('15.0.0','14.*',false),"
    "('14.2.3','>=14.0.0 <15.0.0',true),('15.1.0','>=14.0.0 <15.0.0',false),('13.0.0','^12.0.0 || ^13.0.0',true),('1.2.3','*',true),('1.2.3','latest',true),('1.2.9','1.2.3',true),('x','^1.0.0',false),('2.0.0','<=2.0.0',true),('2.0.1','>2.0.0',true),('2.0.0-rc.1','<2.0.0',true)"
)
_AVAILABLE = "('a','v14',0),('a','v15',1),('a','latest',2),('b','14.2.3',0),('b','14.2',1),('c','v13',0),('c','stable',1),('d','14.2.x',0),('d','14',1),('e','>=14.0.0',0),('e','v9',1)"
_PROJECTS = "('a','14.2.3'),('b','14.2.3'),('b','^14.2.0'),('c','14.2.3'),('d','14.2.3'),('e','14.2.3'),('f','1.0.0')"
_SOURCES = (
    "('https://a/llms.txt','llms_txt','official','valid',0.9D,true),('https://a/sitemap.xml','sitemap','official','valid',0.8D,true),('https://a/docs','web','official','valid',0.7D,false),('https://a/openapi.json','openapi','official','valid',1.0D,true),"
    "('https://gh/a','github','community','valid',0.9D,false),('https://b/docs.md','markdown','third_party','valid',0.95D,true),('https://c/skill','skill','official','unreachable',1.0D,true),('https://d/x','markdown','official','invalid',1.0D,true)"
)
_PATHS = "('/v1/users/42','/v1/users/{id}',true),('https://api.x.com/v1/users/42?x=1','/v1/users/:id',true),('/v1/users','/v1/users/{id}',false),('/V1/Users/','/v1/users',true),('/v1/users/1/posts','/v1/users/{id}',false),('/a.b','/axb',false)"
_OLD = "('GET','/v1/a',false,'p:false,q:true',1),('POST','/v1/b',false,'name:true',2),('GET','/v1/c',false,'',3),('get','/v1/c',false,'z:false',4),('GET','/v1/d',false,'',5)"
_NEW = "('GET','/v1/a',false,'p:true,q:true',1),('POST','/v1/b',true,'name:true',2),('GET','/v1/c',false,'z:false',3),('GET','/v1/e',false,'',4)"
_OLD_NOTES, _NEW_NOTES = "('deprecated','x'),('security','y')", "('deprecated','x'),('removed','z')"
_OLD_TEXT, _NEW_TEXT = "('Intro','a  b',0),('Use','old',1),('Gone','g',2),('Dup','one',3),('Dup','two',4)", "('Intro',' a b',0),('Use','new',1),('New','n',2),('Dup','two',3)"
_IPS = "('8.8.8.8',false),('10.1.2.3',true),('172.16.0.1',true),('172.32.0.1',false),('192.168.1.1',true),('127.0.0.1',true),('169.254.169.254',true),('100.64.0.1',true),('0.0.0.0',true),('224.0.0.1',true),('::1',true),('fe80::1',true),('fd00::1',true),('2606:4700::1111',false),('::ffff:10.0.0.1',true),('nonsense',true)"


def _values(spark, rows, cols):
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({cols})")


def semver_compare(spark, sf):
    return _values(spark, _PAIRS, "a, b").select("a", "b", V.compare_versions(F.col("a"), F.col("b")).cast("long").alias("sign"))


def satisfies_range(spark, sf):
    return _values(spark, _RANGES, "version, range, expected").select("version", "range", V.satisfies(F.col("version"), F.col("range")).alias("fits"))


def version_ladder(spark, sf):
    return V.resolve_versions(_values(spark, _PROJECTS, "project, version"), _values(spark, _AVAILABLE, "project, doc_version, position"))


def rank_sources(spark, sf):
    r = rank(_values(spark, _SOURCES, "url, type, authority, status, confidence, machine_readable"))
    return r.select("purpose", "url", F.round("score", 6).alias("score"), F.col("position").cast("long").alias("position"), "recommended")


def api_path_match(spark, sf):
    p = _values(spark, _PATHS, "candidate, template, expected")
    return p.select("candidate", "template", F.regexp(F.regexp_replace(U.api_path(F.col("candidate")), "/+$", ""), U.path_pattern(F.col("template"))).alias("fits"))


def blocked_ip(spark, sf):
    return _values(spark, _IPS, "ip, expected").select("ip", U.blocked_ip(F.col("ip")).alias("blocked"))


def _endpoints(spark, rows):
    e = _values(spark, rows, "method, path, deprecated, ps, position")
    one = lambda p: F.struct(F.substring_index(p, ":", 1).alias("name"), F.lit("query").alias("location"), (F.substring_index(p, ":", -1) == "true").alias("required"), F.lit("string").alias("type"))
    return e.select("method", "path", "deprecated", F.transform(F.array_remove(F.split("ps", ","), ""), one).alias("parameters"), F.array().cast("array<string>").alias("request_required"), "position")


def endpoint_diff(spark, sf):
    return changes.diff_endpoints(_endpoints(spark, _OLD), _endpoints(spark, _NEW))


def param_diff(spark, sf):
    last = lambda rows: changes.last_by(_endpoints(spark, rows).withColumn("method", F.upper("method")), ["method", "path"], F.col("position"))
    return changes.diff_parameters(last(_OLD), last(_NEW))


def pitfall_diff(spark, sf):
    return changes.diff_pitfalls(_values(spark, _OLD_NOTES, "kind, title"), _values(spark, _NEW_NOTES, "kind, title"))


def section_diff(spark, sf):
    return changes.diff_sections(_values(spark, _OLD_TEXT, "title, content, ordinal"), _values(spark, _NEW_TEXT, "title, content, ordinal"))


QUERIES = {f.__name__: f for f in (semver_compare, satisfies_range, version_ladder, rank_sources, api_path_match, blocked_ip, endpoint_diff, param_diff, pitfall_diff, section_diff)}


def _table(rows, cols):
    return f"(SELECT * FROM (VALUES {rows.replace('D,', ',')}) AS t({cols}))"


_WEIGHTS = ", ".join(f"('{p}', '{t}', {w})" for p, ts in PURPOSES.items() for t, w in ts.items())
_RANKED = f"""
WITH s AS (SELECT * FROM {_table(_SOURCES, 'url, type, authority, status, confidence, machine_readable')}), w(purpose, type, weight) AS (VALUES {_WEIGHTS}),
scored AS (SELECT purpose, url, status, CASE status WHEN 'unreachable' THEN 0.0 WHEN 'invalid' THEN 0.05 ELSE least(1.0, (CAST(weight AS DOUBLE)
  * CASE authority WHEN 'official' THEN 1.0 WHEN 'community' THEN 0.8 ELSE 0.6 END + CASE WHEN machine_readable THEN 0.05 ELSE 0.0 END) * CAST(confidence AS DOUBLE)) END AS score FROM s JOIN w USING (type)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY purpose ORDER BY score DESC, url) AS position FROM scored)
SELECT purpose, url, CAST(round(score, 6) AS DOUBLE) AS score, position, position = min(position) FILTER (status = 'valid') OVER (PARTITION BY purpose) AS recommended FROM ranked"""

#: Expected results by hand: what the fixtures state in their last column, or the rows themselves.
ORACLES = {
    "semver_compare": f"SELECT a, b, CAST(s AS BIGINT) AS sign FROM (SELECT *, row_number() OVER () AS r FROM {_table(_PAIRS, 'a, b')}) JOIN (VALUES (1,-1),(2,0),(3,0),(4,-1),(5,1),(6,1),(7,-1),(8,-1)) AS e(r, s) USING (r)",
    "satisfies_range": f"SELECT version, range, expected AS fits FROM {_table(_RANGES, 'version, range, expected')}",
    "version_ladder": "SELECT project, version, selected, match_type, CAST(confidence AS DOUBLE) AS confidence FROM (VALUES ('a','14.2.3','v14','major',0.9),('b','14.2.3','14.2.3','exact',1.0),('b','^14.2.0','14.2','major_minor',0.95),('c','14.2.3','stable','latest_fallback',0.5),('d','14.2.3','14.2.x','major_minor',0.95),('e','14.2.3','>=14.0.0','range',0.85),('f','1.0.0','unresolved','unresolved',0.0)) AS t(project, version, selected, match_type, confidence)",
    "rank_sources": _RANKED,
    "api_path_match": f"SELECT candidate, template, expected AS fits FROM {_table(_PATHS, 'candidate, template, expected')}",
    "blocked_ip": f"SELECT ip, expected AS blocked FROM {_table(_IPS, 'ip, expected')}",
    "endpoint_diff": "SELECT * FROM (VALUES ('GET','/v1/a','modified'),('POST','/v1/b','deprecated'),('GET','/v1/d','removed'),('GET','/v1/e','added')) AS t(method, path, change)",
    "param_diff": "SELECT * FROM (VALUES ('GET','/v1/a','p','now_required')) AS t(method, path, name, change)",
    "pitfall_diff": f"SELECT kind, title, 'added' AS change FROM ({_table(_NEW_NOTES, 'kind, title')} EXCEPT {_table(_OLD_NOTES, 'kind, title')}) UNION ALL SELECT kind, title, 'removed' FROM ({_table(_OLD_NOTES, 'kind, title')} EXCEPT {_table(_NEW_NOTES, 'kind, title')})",
    "section_diff": "SELECT * FROM (VALUES ('Use','modified'),('Gone','removed'),('New','added')) AS t(title, change)",
}
