"""Log lines made from the test tables.

Each line is one SQL expression over a table row that Spark and the checking engine read
alike, so both sides start from the same text and part ways at the parsing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.sources.text_lines import table_lines

_STAMP = "left(cast(ts as string), 19)"
_MILLIS = "lpad(cast(event_id * 7 % 1000 as string), 3, '0')"
_LEVEL = """(case event_type when 'view' then 'TRACE' when 'click' then 'debug' when 'signup' then 'INFO'
 when 'purchase' then (case when event_id % 2 = 0 then 'WARN' else 'Warning' end)
 else (case event_id % 3 when 0 then 'FATAL' when 1 then 'ERROR' else 'CRITICAL' end) end)"""
_BODY = """concat('user=', cast(user_id as string), ' kind=', event_type, ' value=',
 cast(cast(round(value * 100) as bigint) as string))"""

# One kind of line in twenty each, the bracket style for the rest.
APP_LINE = f"""case event_id % 20
 when 0 then concat('== torn page ', cast(event_id as string), ' corrupted ==')
 when 1 then concat('[', {_STAMP}, '] heartbeat user=', cast(user_id as string))
 when 2 then concat(replace({_STAMP}, ' ', 'T'), ' ', {_LEVEL}, ' ', {_BODY})
 when 3 then concat(substr(cast(ts as string), 6, 2), '/', substr(cast(ts as string), 9, 2), '/',
   substr(cast(ts as string), 1, 4), substr(cast(ts as string), 11, 9), ' ', {_LEVEL}, ' ', {_BODY})
 when 4 then concat({_STAMP}, '.', {_MILLIS}, ' ', {_LEVEL}, ' [worker-', cast(user_id % 5 as string), '] svc.Cart: ', {_BODY})
 when 5 then concat({_STAMP}, '.', {_MILLIS}, '123 ', {_LEVEL}, ' ', {_BODY})
 when 6 then concat('[', {_STAMP}, '] ', {_LEVEL}, 'x: ', {_BODY})
 when 7 then concat({_STAMP}, ',', {_MILLIS}, ' - ', {_LEVEL}, '  [main:Quorum@', cast(user_id as string), '] - ', {_BODY}, ' - tail')
 when 8 then concat('[2024-02-30 ', substr(cast(ts as string), 12, 8), '] ', {_LEVEL}, ': ', {_BODY})
 when 9 then concat('[', {_STAMP}, '] ', {_LEVEL}, ' ', repeat('y', cast(95 + event_id % 7 as int)), '] near: ', {_BODY})
 when 10 then concat('[', {_STAMP}, '] ', {_LEVEL}, ': ', {_BODY}, chr(160), ' ')
 when 11 then concat('[', {_STAMP}, '] ', {_LEVEL}, ':')
 when 12 then concat('[', {_STAMP}, '] ', {_LEVEL}, ': - ] - ', {_BODY})
 when 13 then concat(repeat('.', cast(15 + user_id % 10 as int)), {_STAMP}, ' ', {_LEVEL}, ': ', {_BODY})
 when 14 then concat('[', {_STAMP}, '] ', {_LEVEL}, ': Bağlantı koptu; "', {_BODY}, '"')
 else concat('[', {_STAMP}, '] ', {_LEVEL}, ': ', {_BODY}) end"""

# One source holds a third of the lines.
APP_SOURCE = "concat('app-', case when event_id % 3 = 0 then 'main' else cast(user_id % 5 as string) end, '.log')"

LOG4J_LINE = f"""case when event_id % 10 = 0 then concat({_STAMP}, ' ', {_LEVEL}, ' no millis ', {_BODY})
 else concat({_STAMP}, ',', {_MILLIS}, ' ', {_LEVEL}, ' [thread-', cast(user_id % 7 as string),
 '] org.shop.', event_type, ': ', {_BODY}) end"""

# Day first and no seconds; for a pattern of one's own. Some lines have no such month, some no words.
NODE_LINE = f"""case when event_id % 10 = 0 then concat('node-', cast(event_id as string), ' idle')
 else concat(substr({_STAMP}, 9, 2), '/', case when event_id % 10 = 1 then '13' else substr({_STAMP}, 6, 2) end, '/',
 substr({_STAMP}, 1, 4), ' ', substr({_STAMP}, 12, 5), ' <', {_LEVEL}, '> node-', cast(user_id % 7 as string), ' says ', {_BODY}) end"""

_MONTHS = "'JanFebMarAprMayJunJulAugSepOctNovDec'"
_OMONTH = f"substr({_MONTHS}, month(o_orderdate) * 3 - 2, 3)"
_OTIME = """concat(lpad(cast(o_orderkey % 24 as string), 2, '0'), ':', lpad(cast(o_orderkey % 60 as string), 2, '0'), ':',
 lpad(cast(o_orderkey * 7 % 60 as string), 2, '0'))"""
_OHEAD = f"concat({_OMONTH}, ' ', lpad(cast(day(o_orderdate) as string), 2, case when o_orderkey % 2 = 0 then ' ' else '0' end), ' ', {_OTIME})"
_FULL = f"{_OMONTH}, ' ', cast(day(o_orderdate) as string), ' ', {_OTIME}"

SYSLOG_LINE = f"""case
 when o_orderkey % 11 = 0 then concat('-- mark ', cast(o_orderkey as string))
 when o_orderkey % 11 = 1 then concat({_OHEAD}, ' last message repeated')
 else concat({_OHEAD}, ' host-', cast(o_custkey % 7 as string), ' order',
   case when o_orderkey % 2 = 0 then concat('[', cast(o_custkey as string), ']') else '' end, ': ',
   o_orderpriority, ' total=', cast(cast(round(o_totalprice) as bigint) as string),
   case when o_orderkey % 4 > 2 or o_orderkey % 3 = 2 then '' when o_orderkey % 5 = 0
     then concat(' at Mon ', {_FULL}, ' UTC ', cast(year(o_orderdate) as string))
   when o_orderkey % 5 = 1 then concat(' built Tue ', {_OMONTH}, ' 99 ', {_OTIME}, ' 1991')
   when o_orderkey % 35 = 2 then concat(' seen Wed ', {_FULL}, ' ', cast(year(o_orderdate) - 3 as string)) else '' end) end"""

# Year in the name, years in the content, and neither.
SYSLOG_SOURCE = "case o_orderkey % 3 when 0 then 'content.log' when 1 then 'auth-1995-eu.log' else 'plain.log' end"
FIRST_YEAR = 1995


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def app_lines(spark: SparkSession, sf_dir: str, line: str = APP_LINE) -> DataFrame:
    """Application log lines from ``events``, in several styles, some of them broken."""
    return table_lines(read(spark, sf_dir, "events"), F.expr(line), F.expr(APP_SOURCE), F.col("event_id"),
                       block=F.shiftright("event_id", 20))


def syslog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syslog lines from ``orders`` in the order of their dates."""
    day = F.datediff("o_orderdate", F.lit(f"{FIRST_YEAR}-01-01"))
    return table_lines(
        read(spark, sf_dir, "orders"), F.expr(SYSLOG_LINE), F.expr(SYSLOG_SOURCE),
        F.shiftleft(day.cast("bigint"), 40) + F.col("o_orderkey"), block=F.shiftright(day, 8),
        file_mtime=F.lit("2011-06-01 12:00:00+00:00"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document."""
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return table_lines(docs, F.col("line"), F.concat(F.lit("doc-"), F.col("lang"), F.lit(".txt")),
                       F.shiftleft("doc_id", 20) + F.col("line_no"), block=F.shiftright("doc_id", 16))
